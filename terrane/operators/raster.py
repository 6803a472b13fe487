"""Raster operators over grid tables (tile, row, col, value), or (row, col, value) for one grid.

Sums over windows are separable: a running frame along the rows, then along the columns. Tiles get the margins that a
kernel needs by copying border cells to their neighbours (``with_halo``), so each tile is worked on by itself.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cells_of_points(points: DataFrame, size: float) -> DataFrame:
    """The distinct cells (row, col) that hold a point, with value 1."""
    return points.select(F.floor(F.col("lat") / size).alias("row"), F.floor(F.col("lon") / size).alias("col")).distinct().withColumn("value", F.lit(1.0))


def _window_sum(grid: DataFrame, value: str, along: str, across: str, radius: int, into: str) -> DataFrame:
    """For each cell of the widened grid the sum of ``value`` within ``radius`` along one axis."""
    spread = grid.select(across, F.explode(F.sequence(F.col(along) - radius, F.col(along) + radius)).alias(along), F.col(value).alias("v"))
    return spread.groupBy(across, along).agg(F.sum("v").alias(into))


def uniform_blur(grid: DataFrame, radius: int) -> DataFrame:
    """Mean over the square window of 2 * radius + 1, counting absent cells as 0; cells with a mean of 0 are left out."""
    by_row = _window_sum(grid, "value", "col", "row", radius, "s")
    both = _window_sum(by_row.select("row", "col", "s"), "s", "row", "col", radius, "t")
    return both.select("row", "col", (F.col("t") / float((2 * radius + 1) ** 2)).alias("value"))


def local_deviation(grid: DataFrame, radius: int, nearest: bool = False) -> DataFrame:
    """Standard deviation over the square window, of the cells that there are (nulls left out).

    With ``nearest`` the grid's outermost rows and columns are repeated beyond its border; else nothing lies there.
    """
    cells = grid.where("value IS NOT NULL").select("row", "col", "value")
    ends = grid.agg(*[f(c).alias(f"{c}_{f.__name__}") for c in ("row", "col") for f in (F.min, F.max)]).first() if nearest else None

    def spread(axis: str) -> Column:
        """The middles of the windows that a cell lies in, and how often it counts there."""

        def times(middle: Column) -> Column:
            at, low, high = F.col(axis), F.lit(ends[f"{axis}_min"]), F.lit(ends[f"{axis}_max"])
            beyond = F.when(at == low, F.greatest(low - middle + radius, F.lit(0))).otherwise(0)
            return 1 + beyond + F.when(at == high, F.greatest(middle + radius - high, F.lit(0))).otherwise(0)

        middles = F.sequence(F.col(axis) - radius, F.col(axis) + radius)
        return F.explode(F.transform(middles, lambda m: F.struct(m.alias("at"), (times(m) if nearest else F.lit(1)).alias("times"))))

    by_row = cells.withColumn("r", spread("row")).withColumn("w", F.col("r.times"))
    by_row = by_row.groupBy("r.at", "col").agg(F.sum(F.col("w") * F.col("value")).alias("s1"), F.sum(F.col("w") * F.col("value") * F.col("value")).alias("s2"), F.sum("w").alias("n"))
    both = by_row.withColumnRenamed("at", "row").withColumn("c", spread("col")).withColumn("w", F.col("c.times"))
    sums = both.groupBy("row", F.col("c.at").alias("col")).agg(*[F.sum(F.col("w") * F.col(x)).alias(x) for x in ("s1", "s2", "n")])
    mean = F.col("s1") / F.col("n")
    out = sums.select("row", "col", F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - mean * mean)).alias("value"))
    return grid.select("row", "col").join(out, ["row", "col"])


def max_pool(grid: DataFrame, factor: int = 2) -> DataFrame:
    """The greatest value of each block of ``factor`` x ``factor`` cells."""
    return grid.groupBy(F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col")).agg(F.max("value").alias("value"))


def pyramid(grid: DataFrame, levels: int) -> DataFrame:
    """(level, row, col, value): the grid and its repeated 2 x 2 maxima."""
    out = grid.select(F.lit(0).alias("level"), "row", "col", "value")
    for k in range(1, levels + 1):
        size = 2**k
        up = grid.groupBy(F.floor(F.col("row") / size).alias("row"), F.floor(F.col("col") / size).alias("col")).agg(F.max("value").alias("value"))
        out = out.unionByName(up.select(F.lit(k).alias("level"), "row", "col", "value"))
    return out


def mosaic(tiles: DataFrame) -> DataFrame:
    """Tiles' cells by global place, the greatest value where they overlap."""
    return tiles.groupBy("row", "col").agg(F.max("value").alias("value"))


def with_halo(grid: DataFrame, tile: int, halo: int) -> DataFrame:
    """Each cell in its own tile and in the tiles within ``halo`` cells: (tile_row, tile_col, row, col, value, home)."""
    span = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile))
    out = grid.withColumn("tile_row", F.explode(span("row"))).withColumn("tile_col", F.explode(span("col")))
    home = (F.floor(F.col("row") / tile) == F.col("tile_row")) & (F.floor(F.col("col") / tile) == F.col("tile_col"))
    return out.withColumn("home", home)


def sample_midpoints(edges: DataFrame, grid: DataFrame, size: float) -> DataFrame:
    """Each edge's value at the cell of its midpoint; 0 off the grid or where the cell is null."""
    at = edges.withColumns({"row": F.floor((F.col("y1") + F.col("y2")) / 2 / size), "col": F.floor((F.col("x1") + F.col("x2")) / 2 / size)})
    return at.join(grid, ["row", "col"], "left").withColumn("sample", F.coalesce("value", F.lit(0.0))).drop("value")


def sample_bilinear(points: DataFrame, grid: DataFrame, size: float, id_col: str, nodata: float | None = None) -> DataFrame:
    """(id, sample): each point's value between the four cells around it, cell (row, col) standing at its corner; null
    where one of the four is missing, null or ``nodata``."""
    y, x = F.col("lat") / size, F.col("lon") / size
    at = points.select(id_col, F.floor(y).alias("r0"), F.floor(x).alias("c0"), (y - F.floor(y)).alias("fr"), (x - F.floor(x)).alias("fc"))
    part = lambda dr, dc: F.struct((F.col("r0") + dr).alias("row"), (F.col("c0") + dc).alias("col"), ((F.col("fr") if dr else 1 - F.col("fr")) * (F.col("fc") if dc else 1 - F.col("fc"))).alias("w"))
    four = at.select(id_col, F.explode(F.array(part(0, 0), part(0, 1), part(1, 0), part(1, 1))).alias("x")).select(id_col, "x.*")
    known = grid.where("value IS NOT NULL") if nodata is None else grid.where((F.col("value") != nodata) & F.col("value").isNotNull())
    found = four.join(known.select("row", "col", "value"), ["row", "col"], "left").groupBy(id_col)
    return found.agg(F.when(F.count("value") == 4, F.sum(F.col("w") * F.col("value"))).alias("sample"))


def sample_along(edges: DataFrame, grid: DataFrame, size: float, spacing: float, id_col: str = "edge", least: int = 3, most: int = 50, nearest: bool = False) -> DataFrame:
    """(edge, sample): mean over evenly spaced points of each edge, off-grid and null cells left out, 0 without any.

    An edge has length / ``spacing`` points, ``least`` to ``most``, cut to a whole number or, if ``nearest``, rounded to one
    (halves to the even), as shares of a mask are taken."""
    n = F.greatest(F.lit(float(least)), F.least(F.lit(float(most)), F.col("length") / spacing))
    n = (F.bround(n) if nearest else F.floor(n)).cast("long")
    points = edges.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    t = F.col("k") / (F.col("n") - 1)
    points = points.select(id_col, F.floor((F.col("y1") + t * (F.col("y2") - F.col("y1"))) / size).alias("row"), F.floor((F.col("x1") + t * (F.col("x2") - F.col("x1"))) / size).alias("col"))
    return points.join(grid, ["row", "col"], "left").groupBy(id_col).agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("sample"))


def _dense(part: pd.DataFrame) -> tuple[np.ndarray, int, int]:
    r0, c0 = int(part["row"].min()), int(part["col"].min())
    out = np.full((int(part["row"].max()) - r0 + 1, int(part["col"].max()) - c0 + 1), np.nan)
    out[part["row"].to_numpy() - r0, part["col"].to_numpy() - c0] = part["value"].to_numpy(float)
    return out, r0, c0


def _per_tile(grid: DataFrame, tile: int, halo: int, work) -> DataFrame:
    """``work(array)`` on each tile with its halo; the tile's own cells of the result."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        array, r0, c0 = _dense(part)
        out = work(array)
        own = part[part["home"]]
        return pd.DataFrame({"row": own["row"], "col": own["col"], "value": out[own["row"].to_numpy() - r0, own["col"].to_numpy() - c0]})

    return with_halo(grid, tile, halo).groupBy("tile_row", "tile_col").applyInPandas(run, "row long, col long, value double")


def _envelope(sources: np.ndarray, squared: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place the least (place - source) ** 2 + squared; sources and places ascend."""
    hull, cuts = [], []
    for k in range(len(sources)):
        cut = -np.inf
        while hull:
            j = hull[-1]
            cut = (squared[k] + sources[k] ** 2 - squared[j] - sources[j] ** 2) / (2 * (sources[k] - sources[j]))
            if cut > cuts[-1]:
                break
            hull.pop()
            cuts.pop()
            cut = -np.inf
        hull.append(k)
        cuts.append(cut)
    best = np.array(hull)[np.maximum(np.searchsorted(cuts, at, side="right") - 1, 0)]
    return (at - sources[best]) ** 2 + squared[best]


def distance_to_high(grid: DataFrame, above: float, resolution: float, tile: int | None = None, halo: int | None = None) -> DataFrame:
    """Distance to the nearest cell with a value above the threshold, at any distance and infinite where there is none:
    a pass by columns, then the lower envelope along the rows, each over the whole grid. A ``halo`` (in cells), where
    given, is the greatest distance given; ``tile`` is no longer read."""
    there = np.array(sorted(r["row"] for r in grid.select("row").distinct().collect()), np.int64)

    def column(part: pd.DataFrame) -> pd.DataFrame:
        high = np.sort(part["row"].to_numpy())
        at = np.searchsorted(high, there)
        gap = np.minimum(np.abs(there - high[np.maximum(at - 1, 0)]), np.abs(high[np.minimum(at, len(high) - 1)] - there))
        return pd.DataFrame({"row": there, "col": int(part["col"].iloc[0]), "gap": gap})

    def along(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("col")
        source, own = part[part["gap"].notna()], part[part["gap"].isna()]
        if not len(source):
            return pd.DataFrame({"row": own["row"], "col": own["col"], "value": np.inf})
        found = _envelope(source["col"].to_numpy(float), source["gap"].to_numpy(float) ** 2, own["col"].to_numpy(float))
        return pd.DataFrame({"row": own["row"], "col": own["col"], "value": np.sqrt(found)})

    gaps = grid.where(F.col("value") > above).select("row", "col").groupBy("col").applyInPandas(column, "row long, col long, gap long")
    cells = grid.select("row", "col", F.lit(None).cast("long").alias("gap")).unionByName(gaps)
    out = cells.groupBy("row").applyInPandas(along, "row long, col long, value double")
    least = F.col("value") if halo is None else F.least(F.col("value"), F.lit(float(halo)))
    return out.select("row", "col", (least * resolution).alias("value"))


def less_gaussian(grid: DataFrame, sigma: float, tile: int = 128) -> DataFrame:
    """Value less its Gaussian mean (weights of present cells only), cut off at three sigmas."""
    radius = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)

    def smooth(a: np.ndarray) -> np.ndarray:
        for axis in (0, 1):
            a = np.apply_along_axis(lambda v: np.convolve(np.pad(v, radius), kernel, "valid"), axis, a)
        return a

    def work(a: np.ndarray) -> np.ndarray:
        there = ~np.isnan(a)
        return a - smooth(np.where(there, a, 0.0)) / np.maximum(smooth(there.astype(float)), 1e-12)

    return _per_tile(grid, tile, radius, work)


def fill_polygons(rings: DataFrame, size: float, id_col: str = "ring_id") -> DataFrame:
    """Cells (row, col) whose centre lies in a ring (array<struct(lon, lat)>), by scan lines: a row per ring and line,
    the crossings sorted and paired, all inside expressions."""
    ring = F.col("ring")
    lats = F.transform(ring, lambda p: p["lat"])
    lines = rings.select(id_col, "ring", F.explode(F.sequence(F.floor(F.array_min(lats) / size), F.floor(F.array_max(lats) / size))).alias("row"))
    y = (F.col("row") + 0.5) * size
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    sides = F.arrays_zip(ring.alias("a"), following.alias("b"))
    over = F.filter(sides, lambda s: (s["a"]["lat"] > y) != (s["b"]["lat"] > y))
    xs = F.array_sort(F.transform(over, lambda s: s["a"]["lon"] + (y - s["a"]["lat"]) * (s["b"]["lon"] - s["a"]["lon"]) / (s["b"]["lat"] - s["a"]["lat"])))
    crossed = lines.select(id_col, "row", xs.alias("xs")).where(F.size("xs") >= 2)
    pairs = crossed.select("row", "xs", F.explode(F.sequence(F.lit(1), F.floor(F.size("xs") / 2).cast("int"))).alias("k"))
    left, right = F.element_at("xs", 2 * F.col("k") - 1), F.element_at("xs", 2 * F.col("k"))
    spans = pairs.select("row", F.ceil(left / size - 0.5).alias("c1"), (F.ceil(right / size - 0.5) - 1).alias("c2")).where("c1 <= c2")
    return spans.select("row", F.explode(F.sequence("c1", "c2")).alias("col")).distinct().withColumn("value", F.lit(1.0))
