"""Queries over polylines."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import geo
from terrane.operators import ordered
from terrane.plans import tables as t
from terrane.plans.catalog import register

_W = f"WITH {t.LINES}, {t.STEPS}"


@register("polyline_lengths", f"{_W} SELECT line, round(sum(step_m), 2) AS length_m, count(*) AS n_points FROM steps GROUP BY 1")
def polyline_lengths(spark, d):
    return ordered.lengths(t.lines(spark, d), "line", t.ORDER).select("line", F.round("length_m", 2).alias("length_m"), "n_points")


@register("cumulative_km", f"{_W} SELECT line, seq, round(cum_m / 1000, 3) AS km FROM cums")
def cumulative_km(spark, d):
    return ordered.with_steps(t.lines(spark, d), "line", t.ORDER).select("line", "seq", F.round(F.col("cum_m") / 1000, 3).alias("km"))


@register("half_prefix", f"{_W}, h AS (SELECT *, coalesce(lag(cum_m) OVER (PARTITION BY line ORDER BY pos), 0.0) AS before_m, max(cum_m) OVER (PARTITION BY line) / 2 AS half FROM cums) SELECT line, seq FROM h WHERE before_m <= half AND (before_m < half OR cum_m = 0)")
def half_prefix(spark, d):
    return ordered.half_prefix(t.lines(spark, d), "line", t.ORDER).select("line", "seq")


@register("polyline_gaps", f"{_W} SELECT line, seq, round(step_m, 2) AS step_m FROM steps WHERE step_m > 300000")
def polyline_gaps(spark, d):
    return ordered.gaps(t.lines(spark, d), "line", t.ORDER, 300_000).select("line", "seq", F.round("step_m", 2).alias("step_m"))


@register("climb_profile", f"{_W} SELECT line, seq, round(sum(greatest(0, elev - coalesce(pe, elev))) OVER (PARTITION BY line ORDER BY pos ROWS UNBOUNDED PRECEDING), 2) AS climb_m FROM (SELECT *, lag(elev) OVER (PARTITION BY line ORDER BY pos) AS pe FROM cums)")
def climb_profile(spark, d):
    return ordered.climb_profile(t.lines(spark, d), "line", t.ORDER, "elev").select("line", "seq", F.round("climb_m", 2).alias("climb_m"))


#: A step without length has no direction, so no bend; the arctangent of zeros would go by their signs.
_BEND = """coalesce(CASE WHEN (lon = plon AND lat = plat) OR (nlon = lon AND nlat = lat) THEN 0.0::DOUBLE END, abs(degrees(atan2((lon - plon) * cos(radians(lat)) * (nlat - lat) - (lat - plat) * (nlon - lon) * cos(radians(lat)),
 (lon - plon) * cos(radians(lat)) * (nlon - lon) * cos(radians(lat)) + (lat - plat) * (nlat - lat)))), 0.0)"""


@register("curvature_window", f"{_W}, b AS (SELECT line, seq, cum_m, {_BEND} AS bend FROM (SELECT *, lead(lon) OVER v AS nlon, lead(lat) OVER v AS nlat FROM cums WINDOW v AS (PARTITION BY line ORDER BY pos))) SELECT line, seq, round(sum(bend) OVER (PARTITION BY line ORDER BY cum_m RANGE BETWEEN CURRENT ROW AND 500000 FOLLOWING), 3) AS curv_fwd, round(sum(bend) OVER (PARTITION BY line ORDER BY cum_m RANGE BETWEEN 500000 PRECEDING AND CURRENT ROW), 3) AS curv_rev FROM b")
def curvature_window(spark, d):
    return ordered.curvature_window(t.lines(spark, d), "line", t.ORDER, 500_000).select("line", "seq", F.round("curv_fwd", 3).alias("curv_fwd"), F.round("curv_rev", 3).alias("curv_rev"))


@register("repeats_dropped", f"{_W} SELECT line, seq FROM (SELECT line, seq, floor(lon) AS x, lag(floor(lon)) OVER (PARTITION BY line ORDER BY pos) AS px FROM steps) WHERE px IS NULL OR px <> x")
def repeats_dropped(spark, d):
    lines = t.lines(spark, d).withColumns({"lon": F.floor("lon"), "lat": F.lit(0.0)})
    return ordered.drop_repeats(lines, "line", t.ORDER).select("line", "seq")


@register("strided_points", f"{_W} SELECT line, seq FROM (SELECT line, seq, pos, count(*) OVER (PARTITION BY line) AS n FROM steps) WHERE (pos - 1) % greatest(1, ceil(n / 5)) = 0 OR pos = n")
def strided_points(spark, d):
    return ordered.strided(t.lines(spark, d), "line", t.ORDER, 5).select("line", "seq")


@register(
    "stage_split",
    f"""{_W}, tot AS (SELECT line, max(cum_m) AS total FROM cums GROUP BY 1), dd AS (SELECT line, total, greatest(1, CAST(round_even(total / 1000 / 900, 0) AS BIGINT)) AS days FROM tot),
 cuts AS (SELECT line, unnest(range(1, days + 1)) AS day, total, days FROM dd), near AS (SELECT c.line, c.day, pos, cum_m, row_number() OVER (PARTITION BY c.line, c.day ORDER BY abs(cum_m - c.total * c.day / c.days), pos DESC) AS r FROM cuts c JOIN cums USING (line)),
 one AS (SELECT * FROM near WHERE r = 1), kept AS (SELECT *, coalesce(max(pos) OVER (PARTITION BY line ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS furthest FROM one)
 SELECT line, (row_number() OVER v)::INT AS stage, pos::INT AS pos, round((cum_m - coalesce(lag(cum_m) OVER v, 0.0)) / 1000, 1) AS stage_km FROM kept WHERE pos > furthest WINDOW v AS (PARTITION BY line ORDER BY day)""",
)
def stage_split(spark, d):
    return ordered.stage_ends(t.lines(spark, d), "line", t.ORDER, 900.0)


@register("decimated_lines")
def decimated_lines(spark, d):
    rows = t.lines(spark, d).groupBy("line").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "seq", "lon", "lat"))).alias("p"))
    line = F.transform("p", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat")))
    thin = rows.select("line", "p", line.alias("full")).select("line", F.size("full").alias("n_points"), ordered.decimated(F.col("full"), 400_000.0).alias("thin"))
    return thin.select("line", "n_points", F.size("thin").alias("n_kept"), F.to_json("thin").alias("thin"))


@register("points_in_ring", f"WITH {t.STATIONS} SELECT id FROM stations WHERE lat > 47.005 AND lat < 53.005 AND lon < 14.003 - (lat - 47.005) * 8.0 / 6.0 AND lon > 6.003")
def points_in_ring(spark, d):
    ring = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((6.003, 47.005), (14.003, 47.005), (6.003, 53.005))])
    s = t.stations(spark, d)
    return s.where(geo.in_ring("lon", "lat", ring)).select("id")
