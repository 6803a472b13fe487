"""The service's tools called on the test tables, with the SQL of what they answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane import service
from terrane.plans import tables as t
from terrane.plans.catalog import register
from terrane.session import table


def _net(spark, d):
    a = t.anchors(spark, d).select("anchor", F.concat(F.lit("db:"), F.col("anchor").cast("string")).alias("ref"), "name", "population", F.lit("austria").alias("country"), "lon", "lat")
    s = t.stations(spark, d).select(F.col("id").alias("station"), "name", F.pmod(F.col("id") * 7, F.lit(13)).alias("n_routes"), F.when(F.col("id") % 3 != 0, F.col("id") % 5).alias("n_routes_rail"), "lon", "lat")
    services = table(spark, d, "orders").select(F.col("o_custkey").alias("station"), F.pmod("o_orderkey", F.lit(500)).cast("string").alias("route")).distinct()
    v = t.vertices(spark, d)
    kind = F.when(F.col("id") % 4 == 0, "lodging").when(F.col("id") % 4 == 1, "food").otherwise("other")
    pois = v.select(F.col("id").alias("poi"), kind.alias("category"), F.when(F.col("id") % 8 == 0, "hotel").otherwise("shed").alias("subtype"), F.concat(F.lit("P"), F.col("id").cast("string")).alias("name"), F.concat(F.lit('{"contact:website": "http://p'), F.col("id").cast("string"), F.lit('"}')).alias("tags"), "lon", "lat")
    k = F.col("anchor")
    steps = a.select(k.alias("src"), F.explode(F.array(k + 1, k + 7)).alias("dst")).join(a.select(k.alias("dst")), "dst").select("src", "dst", (F.pmod(F.col("src") * 7919 + F.col("dst") * 104_729, F.lit(10_007)) + 100).cast("double").alias("cost"))
    chain = steps.unionByName(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost"))
    return service.Network(a, s, services, pois, chain)


_POIS = f"pois AS (SELECT id AS poi, CASE WHEN id % 4 = 0 THEN 'lodging' WHEN id % 4 = 1 THEN 'food' ELSE 'other' END AS category, CASE WHEN id % 8 = 0 THEN 'hotel' ELSE 'shed' END AS subtype, lon, lat FROM ({t.VERTICES.removeprefix('vertices AS (').removesuffix(')')}))"
_NET = f"{t.ANCHORS}, {t.STATIONS}, rail AS (SELECT id AS station, name, coalesce(CASE WHEN id % 3 <> 0 THEN id % 5 END, (id * 7) % 13) AS routes, lon, lat FROM stations)"


def _from(lon, lat):
    return t.haversine_sql(f"{lon}::DOUBLE", f"{lat}::DOUBLE", "lon", "lat")


@register("tool_search_anchors", f"WITH {t.ANCHORS} SELECT anchor, name FROM anchors WHERE lower(name) LIKE '%00000001%' ORDER BY CASE WHEN lower(name) LIKE '00000001%' THEN 0 ELSE 1 END, coalesce(population, 0) DESC, 'db:' || anchor LIMIT 8")
def tool_search_anchors(spark, d):
    return service.call(_net(spark, d), "search_anchors", query=" 00000001 ", limit=8).select("anchor", "name")


@register("tool_stations_near", f"WITH {_NET} SELECT station, round({_from(10, 50)}, 0) AS dist_m FROM rail WHERE {_from(10, 50)} <= 90000 AND routes >= 2 ORDER BY dist_m, station LIMIT 15")
def tool_stations_near(spark, d):
    return service.call(_net(spark, d), "stations_near", lon=10.0, lat=50.0, radius_km=90.0, limit=15, min_routes=2).select("station", "dist_m")


_AT3 = f"(SELECT lon AS x, lat AS y FROM anchors WHERE anchor = 3)"


@register("tool_pois_near_anchor", f"WITH {t.ANCHORS}, {_POIS} SELECT poi, round({t.haversine_sql('x', 'y', 'lon', 'lat')}, 0) AS dist_m FROM pois, {_AT3} WHERE category = 'food' AND {t.haversine_sql('x', 'y', 'lon', 'lat')} <= 80000 ORDER BY dist_m, poi LIMIT 12")
def tool_pois_near_anchor(spark, d):
    return service.call(_net(spark, d), "pois_near_anchor", ref="db:3", category="food", radius_km=80.0, limit=12).select("poi", "dist_m")


@register("tool_search_lodging", f"WITH {_POIS} SELECT poi, round({_from(11, 51)}, 0) AS dist_m, 'http://p' || poi AS website FROM pois WHERE category = 'lodging' AND subtype = 'hotel' AND {_from(11, 51)} <= 120000 ORDER BY dist_m, poi LIMIT 12")
def tool_search_lodging(spark, d):
    return service.call(_net(spark, d), "search_lodging", lon=11.0, lat=51.0, radius_km=120.0).select("poi", "dist_m", "website")


#: Both ends' distances; a vertex lies on the cheapest way if they add up to its cost.
_CHAIN = f"""{t.ANCHORS}, steps AS (SELECT a.anchor AS src, b.anchor AS dst, ((a.anchor * 7919 + b.anchor * 104729) % 10007 + 100)::DOUBLE AS cost FROM anchors a JOIN anchors b ON b.anchor IN (a.anchor + 1, a.anchor + 7)),
chain AS (SELECT src, dst, cost FROM steps UNION ALL SELECT dst, src, cost FROM steps),
walk AS (SELECT s AS start, s AS node, 0.0::DOUBLE AS dist, 0 AS hops FROM (VALUES (0::BIGINT), (9::BIGINT)) v(s) UNION ALL SELECT start, dst, min(dist + cost), hops + 1 FROM walk JOIN chain ON src = node WHERE hops < 60 GROUP BY start, dst, hops + 1),
best AS (SELECT start, node, min(dist) AS dist FROM walk GROUP BY 1, 2)"""


@register("tool_route", f"WITH RECURSIVE {_CHAIN} SELECT x.node AS anchor, x.dist AS dist_m, round(z.dist * 1.20 / 1000, 1) AS km FROM best x JOIN best y ON y.node = x.node JOIN best z ON z.node = 9 AND z.start = 0 WHERE x.start = 0 AND y.start = 9 AND x.dist + y.dist = z.dist")
def tool_route(spark, d):
    return service.call(_net(spark, d), "route", from_ref="db:0", to_ref="db:9").select("anchor", "dist_m", "km")


_LINE = "line AS (SELECT lon, lat, row_number() OVER (ORDER BY o_orderdate, seq) AS seq FROM lines WHERE line = 7)"
_OFF = t.haversine_sql("l.lon", "l.lat", "s.lon", "s.lat")


def _line(spark, d):
    from pyspark.sql import Window

    return t.lines(spark, d).where("line = 7").withColumn("seq", F.row_number().over(Window.partitionBy("line").orderBy("o_orderdate", "seq"))).select("line", "seq", "lon", "lat")


@register("tool_pois_along_route", f"WITH {t.LINES}, {_POIS}, {_LINE} SELECT poi, round(min({_OFF}), 0) AS off_m FROM line l, pois s WHERE category = 'food' AND {_OFF} <= 30000 GROUP BY poi ORDER BY off_m, poi LIMIT 30")
def tool_pois_along_route(spark, d):
    return service.call(_net(spark, d), "pois_along_route", line=_line(spark, d), category="food", buffer_km=30.0).select("poi", "off_m")


@register(
    "tool_stations_along_route",
    f"WITH {_NET}, {t.LINES}, {_LINE}, far AS (SELECT *, coalesce({t.haversine_sql('plon', 'plat', 'lon', 'lat')}, 0.0) AS step_m FROM (SELECT *, lag(lon) OVER (ORDER BY seq) AS plon, lag(lat) OVER (ORDER BY seq) AS plat FROM line)), "
    f"cums AS (SELECT *, sum(step_m) OVER (ORDER BY seq) AS cum_m FROM far), met AS (SELECT station, cum_m, {_OFF} AS off, row_number() OVER (PARTITION BY station ORDER BY {_OFF}, seq) AS r FROM cums l, rail s WHERE routes >= 2 AND {_OFF} <= 30000) "
    "SELECT station, round(cum_m / 1000, 1) AS km, round(off, 0) AS off_m FROM met WHERE r = 1 ORDER BY km, station LIMIT 20",
)
def tool_stations_along_route(spark, d):
    return service.call(_net(spark, d), "stations_along_route", line=_line(spark, d), corridor_km=30.0).select("station", "km", "off_m")


_PAIRS = ((0, 1), (2, 5), (3, 3), (4, 8))
_ENDS = ", ".join(f"({k}::BIGINT, {a}, {b})" for k, (a, b) in enumerate(_PAIRS))
_NEAR = t.haversine_sql("a.lon", "a.lat", "r.lon", "r.lat")


@register(
    "tool_direct_rail_service",
    f"""WITH {_NET}, wanted(pair, x, y) AS (VALUES {_ENDS}), served AS (SELECT DISTINCT o_custkey AS station, CAST(o_orderkey % 500 AS VARCHAR) AS route FROM orders),
near AS (SELECT a.anchor, route FROM anchors a JOIN rail r ON {_NEAR} <= 60000 AND routes >= 1 JOIN served USING (station)),
shared AS (SELECT DISTINCT pair, u.route FROM wanted JOIN near u ON u.anchor = x JOIN near v ON v.anchor = y AND v.route = u.route)
SELECT pair, count(route) > 0 AS direct, coalesce(array_to_string(list_sort(list(route) FILTER (route IS NOT NULL))[1:20], ','), '') AS routes FROM wanted LEFT JOIN shared USING (pair) GROUP BY pair""",
)
def tool_direct_rail_service(spark, d):
    pairs = [(f"db:{a}", f"db:{b}") for a, b in _PAIRS]
    found = service.call(_net(spark, d), "direct_rail_service", pairs=pairs, radius_km=60.0)
    return found.select("pair", "direct", F.coalesce(F.array_join("routes", ","), F.lit("")).alias("routes"))
