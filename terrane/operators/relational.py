"""Table maintenance as plain relational operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.session import materialize


def segments(ways: DataFrame, way: str = "way_id", nodes: str = "nodes") -> DataFrame:
    """(way, seq, src, dst) of the consecutive distinct nodes of each way."""
    w = Window.partitionBy(way).orderBy("seq")
    steps = ways.select(way, F.posexplode(nodes).alias("seq", "src")).withColumn("dst", F.lead("src").over(w))
    return steps.where("dst IS NOT NULL AND src <> dst")


def first_positions(nodes: DataFrame, id_col: str) -> DataFrame:
    """One row per node id, with its least longitude and latitude (independently)."""
    return nodes.groupBy(id_col).agg(F.min("lon").alias("lon"), F.min("lat").alias("lat"))


def insert_missing(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with the rows of ``new`` whose keys it lacks, each key once."""
    fresh = new.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True)


def resolve_ids(edges: DataFrame, vertices: DataFrame, outer: str, inner: str) -> DataFrame:
    """``edges`` (src, dst in ``outer`` ids) with ``source`` and ``target`` as ``inner`` ids; unknown ends drop the edge."""
    ids = vertices.select(outer, inner)
    return edges.join(ids.toDF("src", "source"), "src").join(ids.toDF("dst", "target"), "dst")


def surrogate_ids(rows: DataFrame, key: str, into: str, parts: int = 64) -> DataFrame:
    """Dense numbers from 1 in the order of ``key``: ranks within ranges of the key plus the sizes of the ranges before.

    Only the ranges' sizes (``parts`` rows at most) meet in one task.
    """
    # the ranges are used twice, so they are written: dealt anew they could differ
    ranged = materialize(rows.repartitionByRange(parts, key).withColumn("range_no", F.spark_partition_id()), "ranges")
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("range_no").agg(F.count("*").alias("n")).select("range_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    local = F.row_number().over(Window.partitionBy("range_no").orderBy(key))
    return ranged.withColumn("local_no", local).join(F.broadcast(sizes), "range_no").withColumn(into, F.col("base") + F.col("local_no")).drop("range_no", "local_no", "base")


def duplicate_groups(rows: DataFrame, keys: list[str], id_col: str, signals: list[str]) -> DataFrame:
    """Groups of two or more rows with equal keys: least id, greatest signals, and the ids in order."""
    maxima = [F.max(s).alias(s) for s in signals]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(id_col).alias("keep"), F.sort_array(F.collect_list(id_col)).alias("ids"), *maxima).where("n > 1")


def upsert(target: DataFrame, new: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """The newest row of each key from both sides; on equal times the new side's."""
    both = target.withColumn("side", F.lit(0)).unionByName(new.withColumn("side", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(F.desc(newest), F.desc("side"))
    return both.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r", "side")


def apply_staged(target: DataFrame, staged: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``target`` with the non-null values of ``staged``."""
    new = staged.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    return target.join(new, key, "left").withColumns({c: F.coalesce(f"new_{c}", c) for c in columns}).drop(*[f"new_{c}" for c in columns])


def filled(value: Column, other: Column) -> Column:
    """``value`` unless it is empty or null, else ``other``."""
    return F.coalesce(F.nullif(value, F.lit("")), other)


def touching(vertices: DataFrame, edges: DataFrame, id_col: str) -> DataFrame:
    """Vertices at either end of an edge (source, target)."""
    ends = edges.select(F.col("source").alias(id_col)).unionByName(edges.select(F.col("target").alias(id_col)))
    return vertices.join(ends, id_col, "left_semi")


def shared_services(stops: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Sorted routes that serve both a stop of ``left`` and one of ``right``; both are (pair, stop), stops (stop, route)."""
    a = left.join(stops, "stop").select("pair", "route").distinct()
    b = right.join(stops, "stop").select("pair", "route").distinct()
    return a.join(b, ["pair", "route"]).groupBy("pair").agg(F.sort_array(F.collect_set("route")).alias("routes"))


def way_seeds(edges: DataFrame, seeds: list[str], promotable: list[str]) -> DataFrame:
    """Edges (highway, is_ferry, name, ref, length) that may start a chain: seed classes, ferries, and promotable classes
    that have a name or a reference."""
    named = (F.coalesce("name", F.lit("")) != "") | (F.coalesce("ref", F.lit("")) != "")
    return edges.where((F.col("length") > 0) & (F.col("highway").isin(*seeds) | F.col("is_ferry") | (F.col("highway").isin(*promotable) & named)))


def ferry_legs(edges: DataFrame, least_m: float = 100.0) -> DataFrame:
    """Ferry edges (is_ferry, excluded, cost, length) that are open, priced and not too short."""
    return edges.where(F.col("is_ferry") & ~F.col("excluded") & F.col("cost").isNotNull() & (F.col("length") >= least_m))


def cheapest(rows: DataFrame, cost: str, most: int, tie: str, max_cost: float | None = None) -> DataFrame:
    """Rows up to a cost; where none is given, the ``most`` cheapest."""
    if max_cost is not None:
        return rows.where(F.col(cost) <= max_cost)
    return rows.orderBy(cost, tie).limit(most)


def clustered(points: DataFrame, size: float, parts: int | None = None) -> DataFrame:
    """Points (lon, lat) with ``z``, laid out so that a file's rows are near each other: range-dealt and sorted by z."""
    from terrane.functions import geo

    x, y = geo.cell("lon", "lat", size)
    keyed = points.withColumn("z", geo.z_order(x + F.lit(int(180 / size)), y + F.lit(int(90 / size))))
    dealt = keyed.repartitionByRange(parts, "z") if parts else keyed.repartitionByRange("z")
    return dealt.sortWithinPartitions("z")


def best_or(groups: DataFrame, rows: DataFrame, key: str, value: str, default) -> DataFrame:
    """(key, best): the greatest value of each group, or the default where it has none."""
    best = rows.groupBy(key).agg(F.max(value).alias("best"))
    return groups.select(key).distinct().join(best, key, "left").select(key, F.coalesce("best", F.lit(default)).alias("best"))


def box_counts(points: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """One row: all points, those in the closed box, and the others."""
    from terrane.functions import geo

    inside = geo.in_box("lon", "lat", box, closed=True)
    return points.agg(F.count("*").alias("n"), F.count_if(inside).alias("n_inside"), F.count_if(~inside).alias("n_outside"))


def progress(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """``wanted`` with ``done``: whether each key is in the other table."""
    return wanted.join(done.select(key).distinct().withColumn("done", F.lit(True)), key, "left").withColumn("done", F.coalesce("done", F.lit(False)))


def first_region(points: DataFrame, regions: DataFrame, point_id: str, default: str, cell_deg: float = 1.0) -> DataFrame:
    """(point_id, region): of the boxes (region, priority, x0, y0, x1, y1) that hold a point the one of least priority.

    Boxes are copied to the cells that they cover, so points meet the boxes of their cell by an equi-join.
    """
    at = lambda v: F.floor(F.col(v) / cell_deg).cast("long")
    covered = regions.withColumn("cx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("cy", F.explode(F.sequence(at("y0"), at("y1"))))
    held = points.select(point_id, "lon", "lat", at("lon").alias("cx"), at("lat").alias("cy")).join(covered, ["cx", "cy"])
    held = held.where(F.col("lon").between(F.col("x0"), F.col("x1")) & F.col("lat").between(F.col("y0"), F.col("y1")))
    best = held.groupBy(point_id).agg(F.min_by("region", "priority").alias("region"))
    return points.select(point_id).join(best, point_id, "left").select(point_id, F.coalesce("region", F.lit(default)).alias("region"))
