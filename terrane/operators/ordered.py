"""Operations over ordered points: polylines, stages, profiles. Each polyline is one window partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import geo


def with_steps(points: DataFrame, line: str, order: list[str]) -> DataFrame:
    """``step_m`` from the previous point (0 for the first) and ``cum_m`` from the start."""
    w = Window.partitionBy(line).orderBy(*order)
    step = F.coalesce(geo.haversine_m(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat")), F.lit(0.0))
    return points.withColumn("step_m", step).withColumn("cum_m", F.sum("step_m").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def lengths(points: DataFrame, line: str, order: list[str]) -> DataFrame:
    return with_steps(points, line, order).groupBy(line).agg(F.sum("step_m").alias("length_m"), F.count("*").alias("n_points"))


def half_prefix(points: DataFrame, line: str, order: list[str]) -> DataFrame:
    """Points up to the first one past half of the length."""
    w = Window.partitionBy(line)
    before = F.coalesce(F.lag("cum_m").over(w.orderBy(*order)), F.lit(0.0))
    steps = with_steps(points, line, order)
    return steps.withColumns({"half_m": F.max("cum_m").over(w) / 2, "before_m": before}).where((F.col("before_m") <= F.col("half_m")) & ((F.col("before_m") < F.col("half_m")) | (F.col("cum_m") == 0)))


def gaps(points: DataFrame, line: str, order: list[str], more_than_m: float = 300.0) -> DataFrame:
    """The steps longer than a threshold."""
    return with_steps(points, line, order).where(F.col("step_m") > more_than_m)


def drop_repeats(points: DataFrame, line: str, order: list[str]) -> DataFrame:
    """Without points at the place of the one before."""
    w = Window.partitionBy(line).orderBy(*order)
    return points.withColumns({"p_lon": F.lag("lon").over(w), "p_lat": F.lag("lat").over(w)}).where("p_lon IS NULL OR p_lon <> lon OR p_lat <> lat").drop("p_lon", "p_lat")


def climb_profile(points: DataFrame, line: str, order: list[str], elevation: str) -> DataFrame:
    """Cumulative kilometres and metres climbed at each point."""
    w = Window.partitionBy(line).orderBy(*order)
    rise = F.greatest(F.lit(0.0), F.col(elevation) - F.coalesce(F.lag(elevation).over(w), F.col(elevation)))
    steps = with_steps(points, line, order).withColumn("rise", rise)
    return steps.withColumn("climb_m", F.sum("rise").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("cum_km", F.col("cum_m") / 1000).drop("rise")


def curvature_window(points: DataFrame, line: str, order: list[str], ahead_m: int = 300) -> DataFrame:
    """Sum of the bends within ``ahead_m`` behind (curv_rev) and ahead (curv_fwd) of each point, along the line."""
    w = Window.partitionBy(line).orderBy(*order)
    bend = geo.bend_degrees(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"), F.lead("lon").over(w), F.lead("lat").over(w))
    steps = with_steps(points, line, order).withColumn("bend", F.coalesce(bend, F.lit(0.0)))
    along = Window.partitionBy(line).orderBy("cum_m")
    return steps.withColumns({"curv_fwd": F.sum("bend").over(along.rangeBetween(0, ahead_m)), "curv_rev": F.sum("bend").over(along.rangeBetween(-ahead_m, 0))})


def stage_ends(points: DataFrame, line: str, order: list[str], target_km: float, vias: DataFrame | None = None, known_km: DataFrame | None = None) -> DataFrame:
    """One row per stage: each line, or each part of it between ``vias``, is cut into max(1, half-even round(length /
    target)) equal parts, each cut moved to the nearest point (of two equally near ones the later); what doesn't advance
    is left out.

    ``vias`` (line, k, lon, lat) are stops that must end a stage, in order of k, each at the line's nearest point.
    ``known_km`` (line, km) gives lengths that the lines' own are scaled to.
    """
    w = Window.partitionBy(line).orderBy(*order)
    steps = with_steps(points, line, order).withColumn("pos", F.row_number().over(w))
    if known_km is not None:
        whole = F.max("cum_m").over(Window.partitionBy(line))
        scale = F.coalesce(F.try_divide(F.col("known_km") * 1000, whole), F.lit(1.0))
        steps = steps.join(known_km.select(line, F.col("km").alias("known_km")), line, "left").withColumn("cum_m", F.col("cum_m") * scale)
    last = F.lit(2**31 - 1)
    bounds = steps.groupBy(line).agg(F.max("pos").alias("n")).select(line, F.explode(F.array(F.struct(F.lit(-1).alias("k"), F.lit(1).alias("pos")), F.struct(last.alias("k"), F.col("n").alias("pos")))).alias("x")).select(line, "x.*")
    if vias is not None:
        far = geo.haversine_m("v_lon", "v_lat", "lon", "lat")
        at = steps.select(line, "pos", "lon", "lat").join(vias.select(line, "k", F.col("lon").alias("v_lon"), F.col("lat").alias("v_lat")), line)
        bounds = bounds.unionByName(at.groupBy(line, "k").agg(F.min_by("pos", F.struct(far, "pos")).alias("pos")))
    by_k = Window.partitionBy(line).orderBy("k")
    before = F.max("pos").over(by_k.rowsBetween(Window.unboundedPreceding, -1))
    bounds = bounds.withColumn("before", before).where("before IS NULL OR pos > before").join(steps.select(line, "pos", "cum_m"), [line, "pos"])
    parts = bounds.select(line, F.col("pos").alias("end_pos"), F.col("cum_m").alias("end_m"), F.lag("cum_m").over(by_k).alias("from_m")).where("from_m IS NOT NULL")
    days = F.greatest(F.lit(1), F.bround((F.col("end_m") - F.col("from_m")) / 1000 / target_km).cast("int"))
    inner = F.when(days > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), days - 1)), lambda i: F.col("from_m") + (F.col("end_m") - F.col("from_m")) * i / days)).otherwise(F.array().cast("array<double>"))
    cuts = parts.select(line, F.explode(inner).alias("cum_m"))
    # each cut lies between two points of its line: no cut is compared with all points
    same = Window.partitionBy(line, "cum_m")
    marks = steps.select(line, "cum_m", F.struct("cum_m", F.max("pos").over(same).alias("pos")).alias("point")).unionByName(cuts.withColumn("point", F.lit(None).cast("struct<cum_m:double,pos:int>")))
    along = Window.partitionBy(line).orderBy("cum_m", F.col("point").isNull(), F.col("point")["pos"])
    low = F.last("point", True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    high = F.first("point", True).over(along.rowsBetween(0, Window.unboundedFollowing))
    near = marks.select(line, "cum_m", "point", low.alias("low"), high.alias("high")).where("point IS NULL")
    nearer = F.when(F.col("high").isNotNull() & (F.col("high")["cum_m"] - F.col("cum_m") <= F.col("cum_m") - F.col("low")["cum_m"]), F.col("high")).otherwise(F.col("low"))
    ends = near.select(line, nearer.alias("x")).select(line, "x.pos", "x.cum_m").unionByName(parts.select(line, F.col("end_pos").alias("pos"), F.col("end_m").alias("cum_m"))).where("pos > 1").distinct()
    by_pos = Window.partitionBy(line).orderBy("pos")
    km = (F.col("cum_m") - F.coalesce(F.lag("cum_m").over(by_pos), F.lit(0.0))) / 1000
    return ends.select(line, F.row_number().over(by_pos).alias("stage"), "pos", F.round(km, 1).alias("stage_km"))


def totals(points: DataFrame, line: str, order: list[str], kept: DataFrame) -> DataFrame:
    """One row: points and metres of all lines, and the points of the thinned lines ``kept``."""
    steps = with_steps(points, line, order)
    ends = steps.groupBy(line).agg(F.count("*").alias("n"), F.max("cum_m").alias("m"))
    return ends.agg(F.sum("n").alias("n_before"), F.sum("m").alias("metres")).crossJoin(F.broadcast(kept.agg(F.count("*").alias("n_after"))))


def decimated(line: Column, least_m: float) -> Column:
    """An ordered array<struct(lon, lat)> thinned to points at least ``least_m`` from the last kept one, with both ends."""
    last = F.element_at(line, F.size(line))
    start = F.slice(line, 1, 1)

    def keep(acc: Column, p: Column) -> Column:
        q = F.element_at(acc, F.size(acc))
        return F.when(geo.haversine_m(q["lon"], q["lat"], p["lon"], p["lat"]) >= least_m, F.array_append(acc, p)).otherwise(acc)

    def close(acc: Column) -> Column:
        return F.when(F.element_at(acc, F.size(acc)) == last, acc).otherwise(F.array_append(acc, last))

    return F.when(F.size(line) <= 2, line).otherwise(F.aggregate(line, start, keep, close))


def strided(points: DataFrame, line: str, order: list[str], most: int = 200) -> DataFrame:
    """At most about ``most`` points of each line, evenly, always with the last."""
    w = Window.partitionBy(line)
    rows = points.withColumns({"pos": F.row_number().over(w.orderBy(*order)), "n": F.count("*").over(w)})
    stride = F.greatest(F.lit(1), F.ceil(F.col("n") / most))
    return rows.where((F.pmod(F.col("pos") - 1, stride) == 0) | (F.col("pos") == F.col("n"))).drop("n")
