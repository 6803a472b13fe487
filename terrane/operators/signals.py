"""The registry of landscape signals, and a bake that works out each shared source and kernel once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators import raster
from terrane.session import materialize


@dataclass(frozen=True)
class Signal:
    """A column of the edges: the source grid, the kernel with its reach in metres, and where the edge is sampled."""

    name: str
    source: str
    kernel: str
    reach_m: float
    sample: str


def bake(edges: DataFrame, sources: dict[str, DataFrame], signals: list[Signal], cell_m: float, size: float, id_col: str = "edge") -> DataFrame:
    """(edge, one column per signal) of edges (edge, x1, y1, x2, y2, length); signals of one source and kernel share a grid.

    Kernels: ``none``, ``blur`` (mean over a square) and ``deviation`` (standard deviation over a square), each of the
    reach in cells rounded half even and at least 1; samples: ``midpoint`` and ``along``.
    """
    grids: dict[tuple[str, str, int], DataFrame] = {}
    out = edges.select(id_col)
    for s in signals:
        cells = max(1, round(s.reach_m / cell_m))
        key = (s.source, s.kernel, 0 if s.kernel == "none" else cells)
        if key not in grids:
            work = {"none": lambda g, _: g, "blur": raster.uniform_blur, "deviation": raster.local_deviation}[s.kernel]
            grids[key] = materialize(work(sources[s.source], cells), "signal")
        taken = raster.sample_along(edges, grids[key], size, cell_m, id_col) if s.sample == "along" else raster.sample_midpoints(edges, grids[key], size)
        out = out.join(taken.select(id_col, F.col("sample").alias(s.name)), id_col)
    return out
