"""What a map shows: ferry links with their lines, the edges of trees, and the corridors that two trees share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators import tiled


def _ferry_network(vertices: DataFrame, ferries: DataFrame, piers: DataFrame, size_deg: float) -> tuple[tiled.Network, DataFrame]:
    """The ferries' own network, and the piers (vid) on it."""
    both = ferries.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("len_m").alias("cost"))
    both = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost"))
    touched = both.select(F.col("src").alias("vid")).distinct()
    net = tiled.network(vertices.hint("merge").join(touched, "vid", "left_semi"), both, size_deg)
    return net, piers.select("vid").distinct().hint("merge").join(touched, "vid", "left_semi")


def ferry_costs(vertices: DataFrame, ferries: DataFrame, piers: DataFrame, size_deg: float = 2.0) -> DataFrame:
    """(a, b, cost, n_points) of ``ferry_links``, whose lines have ``n_points`` points, without the lines: where most piers hang
    together the links are as many as the square of the piers, and their lines as many times longer."""
    net, docked = _ferry_network(vertices, ferries, piers, size_deg)
    return tiled.costs_between(docked, net).select(F.col("src").alias("a"), F.col("dst").alias("b"), "cost", (F.col("n_arcs") + 1).cast("int").alias("n_points"))


def ferry_links(vertices: DataFrame, ferries: DataFrame, piers: DataFrame, size_deg: float = 2.0) -> DataFrame:
    """(a, b, cost, path) of the piers (vid) that ferries (a, b, len_m; both ways) connect, a < b: the shortest way over
    ferries alone and its line, an array of struct(lon, lat).

    All piers are searched from at once over the ferries' own network of vertices (vid, lon, lat); the vertices of all
    lines are then found together.
    """
    net, docked = _ferry_network(vertices, ferries, piers, size_deg)
    trees = tiled.tiled_paths(docked.select(F.col("vid").alias("search"), F.col("vid").alias("node"), F.lit(0).cast("long").alias("label")), net)
    reached = trees.join(docked.withColumnRenamed("vid", "node"), "node", "left_semi").where("search < node")
    found = tiled.tree_paths(reached.select("search", F.col("node").alias("target")), trees)
    placed = found.join(net.vertices.select("vid", "lon", "lat"), "vid")
    lines = placed.groupBy("search", "target").agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("line"))
    path = F.transform("line", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    costs = reached.select("search", F.col("node").alias("target"), F.col("dist").alias("cost"))
    return costs.join(lines, ["search", "target"]).select(F.col("search").alias("a"), F.col("target").alias("b"), "cost", path.alias("path"))


def tree_edges(trees: DataFrame, places: DataFrame, below: float | None = None, most: int | None = None) -> DataFrame:
    """(city, vid, parent, cost, lon, lat, parent_lon, parent_lat): the edges of trees (city, vid, parent, cost) from each
    vertex to its parent, those that cost less than ``below``; or a city's ``most`` cheapest (ties by vertex)."""
    edges = trees.where("parent IS NOT NULL").select("city", "vid", "parent", "cost")
    if below is not None:
        edges = edges.where(F.col("cost") < below)
    elif most is not None:
        rank = F.row_number().over(Window.partitionBy("city").orderBy("cost", "vid"))
        edges = edges.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")
    at = places.select("vid", "lon", "lat")
    return edges.join(at, "vid").join(at.toDF("parent", "parent_lon", "parent_lat"), "parent").select("city", "vid", "parent", "cost", "lon", "lat", "parent_lon", "parent_lat")


def corridor_edges(trees: DataFrame, pairs: DataFrame, places: DataFrame) -> DataFrame:
    """(a, b, vid, parent, cost_a, cost_b, lon, lat, parent_lon, parent_lat) for pairs (a, b) of cities: the edges of a's
    tree from the vertices that b's tree has too, with the costs in both. Trees are small as files and large in memory, so
    the joins are sort-merge joins by hint."""
    own = pairs.hint("merge").join(trees.where("parent IS NOT NULL").select(F.col("city").alias("a"), "vid", "parent", F.col("cost").alias("cost_a")), "a")
    met = own.hint("merge").join(trees.select(F.col("city").alias("b"), "vid", F.col("cost").alias("cost_b")), ["b", "vid"])
    at = places.select("vid", "lon", "lat")
    return met.hint("merge").join(at, "vid").hint("merge").join(at.toDF("parent", "parent_lon", "parent_lat"), "parent").select("a", "b", "vid", "parent", "cost_a", "cost_b", "lon", "lat", "parent_lon", "parent_lat")


def corridor_sizes(trees: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, n_shared): the vertices of both trees of a pair and those that they share."""
    n = trees.groupBy("city").agg(F.count("*").alias("n"))
    shared = pairs.hint("merge").join(trees.select(F.col("city").alias("a"), "vid"), "a").hint("merge").join(trees.select(F.col("city").alias("b"), "vid"), ["b", "vid"]).groupBy("a", "b").agg(F.count("*").alias("n_shared"))
    held = pairs.hint("merge").join(n.toDF("a", "n_a"), "a").hint("merge").join(n.toDF("b", "n_b"), "b").hint("merge").join(shared, ["a", "b"], "left")
    return held.select("a", "b", "n_a", "n_b", F.coalesce("n_shared", F.lit(0)).alias("n_shared"))
