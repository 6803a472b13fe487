"""Raster, trace and stream queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import raster, traces
from terrane.plans import tables as t
from terrane.plans.catalog import register
from terrane.session import table
from terrane.streaming import folds, sessions


@register("raster_points", f"WITH {t.STATIONS} SELECT DISTINCT floor(lat / 0.5)::BIGINT AS row, floor(lon / 0.5)::BIGINT AS col FROM stations")
def raster_points(spark, d):
    return raster.cells_of_points(t.stations(spark, d), 0.5).select("row", "col")


@register("raster_blur", f"WITH {t.GRID}, s AS (SELECT row + dr AS row, col + dc AS col, value FROM grid, range(-2, 3) a(dr), range(-2, 3) b(dc)) SELECT row, col, round(sum(value) / 25, 6) AS value FROM s GROUP BY 1, 2")
def raster_blur(spark, d):
    return raster.uniform_blur(t.grid(spark, d), 2).select("row", "col", F.round("value", 6).alias("value"))


@register("raster_deviation", f"WITH {t.GRID}, s AS (SELECT row + dr AS row, col + dc AS col, value FROM grid, range(-2, 3) a(dr), range(-2, 3) b(dc)), g AS (SELECT row, col, sqrt(greatest(0.0, sum(value * value) / count(*) - pow(sum(value) / count(*), 2))) AS value FROM s GROUP BY 1, 2) SELECT row, col, round(g.value, 5) AS value FROM g SEMI JOIN grid USING (row, col)")
def raster_deviation(spark, d):
    return raster.local_deviation(t.grid(spark, d), 2).select("row", "col", F.round("value", 5).alias("value"))


@register("raster_deviation_nearest", f"WITH {t.GRID}, e AS (SELECT min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM grid), s AS (SELECT row, col, greatest(r0, least(r1, row + dr)) AS r, greatest(c0, least(c1, col + dc)) AS c FROM grid, e, range(-2, 3) a(dr), range(-2, 3) b(dc)), g AS (SELECT s.row, s.col, sqrt(greatest(0.0, sum(v.value * v.value) / count(*) - pow(sum(v.value) / count(*), 2))) AS value FROM s JOIN grid v ON v.row = r AND v.col = c GROUP BY 1, 2) SELECT row, col, round(value, 5) AS value FROM g")
def raster_deviation_nearest(spark, d):
    return raster.local_deviation(t.grid(spark, d), 2, nearest=True).select("row", "col", F.round("value", 5).alias("value"))


@register("max_pool_pyramid", f"WITH {t.GRID}, l AS (SELECT unnest(range(0, 4)) AS level) SELECT level::INT AS level, floor(row / pow(2, level))::BIGINT AS row, floor(col / pow(2, level))::BIGINT AS col, max(value) AS value FROM grid, l GROUP BY 1, 2, 3")
def max_pool_pyramid(spark, d):
    return raster.pyramid(t.grid(spark, d), 3)


@register("halo_tiles", f"WITH {t.GRID}, s AS (SELECT DISTINCT floor((row + dr) / 16.0)::BIGINT AS tile_row, floor((col + dc) / 16.0)::BIGINT AS tile_col, row, col FROM grid, (VALUES (-3), (0), (3)) a(dr), (VALUES (-3), (0), (3)) b(dc)) SELECT tile_row, tile_col, count(*) AS n FROM s GROUP BY 1, 2")
def halo_tiles(spark, d):
    return raster.with_halo(t.grid(spark, d), 16, 3).groupBy("tile_row", "tile_col").agg(F.count("*").alias("n"))


def _segments(spark, d):
    li = table(spark, d, "lineitem")
    at = lambda c, m, k: F.pmod(F.col(c) * k, F.lit(m)).cast("double")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge"), at("l_orderkey", 50, 3).alias("x1"), at("l_partkey", 60, 7).alias("y1"), at("l_suppkey", 50, 11).alias("x2"), at("l_orderkey", 60, 13).alias("y2"), (F.col("l_quantity") * 4).cast("double").alias("length"))


_SEG = "seg AS (SELECT l_orderkey * 10 + l_linenumber AS edge, (l_orderkey * 3 % 50)::DOUBLE AS x1, (l_partkey * 7 % 60)::DOUBLE AS y1, (l_suppkey * 11 % 50)::DOUBLE AS x2, (l_orderkey * 13 % 60)::DOUBLE AS y2, (l_quantity * 4)::DOUBLE AS length FROM lineitem)"


@register("sample_midpoints", f"WITH {t.GRID}, {_SEG} SELECT edge, coalesce(value, 0.0) AS sample FROM seg LEFT JOIN grid ON row = floor((y1 + y2) / 2)::BIGINT AND col = floor((x1 + x2) / 2)::BIGINT")
def sample_midpoints(spark, d):
    return raster.sample_midpoints(_segments(spark, d), t.grid(spark, d), 1.0).select("edge", "sample")


@register(
    "sample_along",
    f"WITH {t.GRID}, {_SEG}, n AS (SELECT *, greatest(3, least(50, floor(length / 10)))::BIGINT AS n FROM seg), p AS (SELECT *, unnest(range(n)) AS k FROM n) SELECT edge, round(coalesce(avg(value), 0.0), 6) AS sample FROM (SELECT edge, floor(y1 + (k::DOUBLE / (n - 1)) * (y2 - y1))::BIGINT AS row, floor(x1 + (k::DOUBLE / (n - 1)) * (x2 - x1))::BIGINT AS col FROM p) LEFT JOIN grid USING (row, col) GROUP BY 1",
)
def sample_along(spark, d):
    return raster.sample_along(_segments(spark, d), t.grid(spark, d), 1.0, 10.0).select("edge", F.round("sample", 6).alias("sample"))


@register(
    "mask_shares",
    f"WITH {t.GRID}, {_SEG}, n AS (SELECT *, round_even(greatest(3.0, least(50.0, length / 10)), 0)::BIGINT AS n FROM seg), p AS (SELECT *, unnest(range(n)) AS k FROM n) SELECT edge, round(coalesce(avg(value), 0.0), 6) AS sample FROM (SELECT edge, floor(y1 + (k::DOUBLE / (n - 1)) * (y2 - y1))::BIGINT AS row, floor(x1 + (k::DOUBLE / (n - 1)) * (x2 - x1))::BIGINT AS col FROM p) LEFT JOIN grid USING (row, col) GROUP BY 1",
)
def mask_shares(spark, d):
    return raster.sample_along(_segments(spark, d), t.grid(spark, d), 1.0, 10.0, nearest=True).select("edge", F.round("sample", 6).alias("sample"))


@register("distance_to_high")
def distance_to_high(spark, d):
    return raster.distance_to_high(t.grid(spark, d), 49.0, 30.0)


@register("less_gaussian")
def less_gaussian(spark, d):
    return raster.less_gaussian(t.grid(spark, d), 2.0, tile=32)


@register("filled_polygons", f"WITH {t.ANCHORS}, c AS (SELECT anchor, lon, lat FROM anchors) SELECT DISTINCT row, col FROM (SELECT lon, lat, unnest(range(floor((lat - 0.7013) / 0.25)::BIGINT, floor((lat + 0.7013) / 0.25)::BIGINT + 1)) AS row FROM c), range(0, 100) x(col) WHERE abs((col + 0.5) * 0.25 - lon) + abs((row + 0.5) * 0.25 - lat) < 0.7013")
def filled_polygons(spark, d):
    a = t.anchors(spark, d)
    corner = lambda dx, dy: F.struct((F.col("lon") + dx).alias("lon"), (F.col("lat") + dy).alias("lat"))
    rings = a.select(F.col("anchor").alias("ring_id"), F.array(corner(0.7013, 0.0), corner(0.0, 0.7013), corner(-0.7013, 0.0), corner(0.0, -0.7013)).alias("ring"))
    return raster.fill_polygons(rings, 0.25).select("row", "col")


def _trace(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type").isin("view", "click"), "tool_call").when(F.col("event_type") == "purchase", "round_end").otherwise("request_end")
    return e.select(F.col("user_id").alias("request_id"), kind.alias("event"), F.col("event_type").alias("name"), F.round("value").alias("latency_ms"), (F.col("event_type") == "error").alias("is_error"))


@register("trace_fold", "WITH e AS (SELECT user_id AS request_id, CASE WHEN event_type IN ('view', 'click') THEN 'tool_call' WHEN event_type = 'purchase' THEN 'round_end' ELSE 'request_end' END AS event, event_type AS name, round(value) AS ms FROM events), t AS (SELECT request_id, name, count(*) AS n FROM e WHERE event = 'tool_call' GROUP BY 1, 2), g AS (SELECT request_id, string_agg(name || '=' || n, ',' ORDER BY n DESC, name) AS tools FROM t GROUP BY 1) SELECT request_id, count(*) FILTER (event = 'round_end') AS rounds, count(*) FILTER (event = 'tool_call') AS tool_calls, count(*) FILTER (name = 'error') AS errors, coalesce(sum(ms), 0) AS latency_ms, any_value(tools) AS tools FROM e LEFT JOIN g USING (request_id) GROUP BY 1")
def trace_fold(spark, d):
    return traces.requests(_trace(spark, d))


@register("axis_means", "SELECT 'axis' || label AS axis, round(avg(vec_id % 7), 8) AS mean_score, count(*) AS n_scores FROM embeddings WHERE vec_id % 5 <> 0 GROUP BY 1")
def axis_means(spark, d):
    score = F.when(F.pmod("vec_id", F.lit(5)) != 0, F.pmod("vec_id", F.lit(7)).cast("int"))
    rows = table(spark, d, "embeddings").select(F.array(F.struct(F.concat(F.lit("axis"), F.col("label").cast("string")).alias("axis"), score.alias("score"))).alias("scores"))
    return traces.axis_means(rows).select("axis", F.round("mean_score", 8).alias("mean_score"), "n_scores")


@register("runs_with_scores", "SELECT conv_id AS prompt_id, turn AS run, role, quality FROM conversations LEFT JOIN labels ON conv_id = doc_id")
def runs_with_scores(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("prompt_id"), F.col("turn").alias("run"), "role")
    lab = table(spark, d, "labels").select(F.col("doc_id").alias("prompt_id"), "quality")
    scored = c.select("prompt_id", "run").distinct().join(lab, "prompt_id")
    return traces.runs_with_scores(c, scored).select("prompt_id", "run", "role", "quality")


@register("windowed_counts", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark, d):
    w = sessions.windowed_counts(table(spark, d, "events"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@register("sessionised_events", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, k")
def sessionised_events(spark, d):
    return sessions.sessions(table(spark, d, "events")).select("user_id", "n", "first_ts", "last_ts")


def _rounds(spark, d):
    """Events as a trace: a request is a user's day, a round an hour of it."""
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type").isin("view", "click"), "tool_call").when(F.col("event_type") == "purchase", "round_end").when(F.col("event_type") == "signup", "request_end").otherwise("other")
    request = F.col("user_id") * 100 + F.dayofmonth("ts")
    return e.select(request.alias("request_id"), kind.alias("event"), F.hour("ts").cast("long").alias("round_i"), F.round("value").alias("latency_ms"), (F.pmod("event_id", F.lit(7)) == 0).alias("is_error"), "ts")


_ROUNDS = """e AS (SELECT user_id * 100 + day(ts) AS request_id, CASE WHEN event_type IN ('view', 'click') THEN 'tool_call' WHEN event_type = 'purchase' THEN 'round_end' WHEN event_type = 'signup' THEN 'request_end' ELSE 'other' END AS event,
 hour(ts)::BIGINT AS round_i, round(value) AS ms, event_id % 7 = 0 AS is_error FROM events),
 ends AS (SELECT request_id, bool_or(event = 'request_end') AS ended FROM e GROUP BY 1),
 folded AS (SELECT request_id, round_i, count(*) FILTER (event = 'tool_call') AS n_tools, count(*) FILTER (event = 'tool_call' AND is_error) AS n_errors, coalesce(sum(ms) FILTER (event = 'tool_call'), 0.0) AS tool_ms, coalesce(sum(ms) FILTER (event = 'round_end'), 0.0) AS round_ms FROM e GROUP BY 1, 2)"""


@register("round_folds", f"WITH {_ROUNDS} SELECT folded.*, ended FROM folded JOIN ends USING (request_id)")
def round_folds(spark, d):
    return folds.rounds(_rounds(spark, d))


@register("prompt_means", f"WITH {_ROUNDS}, r AS (SELECT request_id, sum(n_tools) AS tools, sum(tool_ms) AS tool_ms, sum(tool_ms + round_ms) AS wall_ms FROM folded GROUP BY 1) SELECT request_id % 11 AS prompt, count(*) AS n_requests, round(avg(tools), 6) AS mean_tools, round(avg(tool_ms), 6) AS mean_tool_ms, round(avg(wall_ms), 6) AS mean_wall_ms FROM r GROUP BY 1")
def prompt_means(spark, d):
    rows = folds.rounds(_rounds(spark, d))
    prompts = rows.select("request_id").distinct().withColumn("prompt", F.pmod("request_id", F.lit(11)))
    found = folds.prompt_means(rows, prompts)
    return found.select("prompt", "n_requests", *[F.round(c, 6).alias(c) for c in ("mean_tools", "mean_tool_ms", "mean_wall_ms")])
