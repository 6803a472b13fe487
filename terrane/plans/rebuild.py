"""The whole build: from vertices, edges and places to pruned trunks. Each stage's table is written once and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions import cost
from terrane.operators import graph, proximity, trees
from terrane.session import materialize


def priced(edges: DataFrame, vertices: DataFrame, profile: str = "direct") -> DataFrame:
    """Edges (gid, source, target, length, tags) with cost and reverse_cost; grades come from the vertices' ``elev``."""
    ends = vertices.select("id", "elev")
    e = edges.join(ends.toDF("source", "e1"), "source").join(ends.toDF("target", "e2"), "target")
    grade = F.coalesce(F.try_divide((F.col("e2") - F.col("e1")) * 100, F.col("length")), F.lit(0.0))
    one_way = F.col("oneway") if "oneway" in edges.columns else F.lit(False)
    curve = [F.col(c) if c in edges.columns else F.lit(0.0) for c in ("curv_fwd", "curv_rev")]
    fwd, rev = cost.edge_costs(cost.Edge(edges.columns), profile, F.col("length"), grade, *curve, one_way)
    return e.select("gid", "source", "target", fwd.alias("cost"), rev.alias("reverse_cost")).where("cost IS NOT NULL OR reverse_cost >= 0")


def build(vertices: DataFrame, edges: DataFrame, places: DataFrame, profile: str = "direct", spacing_m: float = 10_000.0, reach_m: float = 100_000.0, polygon_m: float = 30_000.0, seed_m: float = 1_000.0, border: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables by stage: arcs, anchors, chain, trees, trunks, pruned.

    ``places`` has (place, population, lon, lat). An anchor is a place without a more populous one within ``spacing_m``;
    neighbours are the nearest ones by sector within ``reach_m``; a tree spans the vertices within ``polygon_m``.
    """
    out = {"arcs": materialize(graph.both_ways(priced(edges, vertices, profile)), "build-arcs")}
    out["anchors"] = materialize(proximity.local_maxima(places, "place", "population", spacing_m), "build-anchors")
    out["chain"] = materialize(proximity.sector_neighbours(out["anchors"], "place", reach_m), "build-chain")
    at = out["anchors"].select(F.col("place").alias("city"), "lon", "lat")
    near = proximity.radius_join(at, vertices.select(F.col("id").alias("vid"), "lon", "lat"), polygon_m)
    members = materialize(near.select("city", "vid", "dist_m"), "build-members")
    closest = graph.best_by(members, ["city"], ["dist_m", "vid"])
    seeds = members.where(F.col("dist_m") <= seed_m).unionByName(closest).select("city", "vid").distinct()
    out["trees"] = materialize(trees.bounded_trees(members.select("city", "vid"), seeds, out["arcs"]), "build-trees")
    pairs = out["chain"].select(F.col("a").alias("src"), F.col("b").alias("dst"))
    pairs = materialize(pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "build-pairs")
    built = materialize(trees.build_trunks(out["trees"], pairs), "build-trunks")
    out["trunks"] = built.unionByName(trees.direct_trunks(pairs, built))
    frozen = border if border is not None else out["anchors"].select(F.col("place").alias("city")).limit(0)
    out["pruned"] = trees.prune_trunks(out["trunks"], frozen)
    return out
