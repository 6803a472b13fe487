"""Queries near points and along routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import geo, text
from terrane.operators import ordered, proximity, relational
from terrane.plans import tables as t
from terrane.plans.catalog import register
from terrane.session import table

AT = (10.0, 50.0)
_D = t.haversine_sql("10.0", "50.0", "lon", "lat")


@register("stations_near", f"WITH {t.STATIONS} SELECT id, name, round({_D}, 2) AS dist_m FROM stations WHERE {_D} <= 60000 ORDER BY round({_D}, 2), id LIMIT 20")
def stations_near(spark, d):
    near = t.stations(spark, d).withColumn("dist_m", F.round(geo.haversine_m(*AT, "lon", "lat"), 2)).where(geo.haversine_m(*AT, "lon", "lat") <= 60_000)
    return near.select("id", "name", "dist_m").orderBy("dist_m", "id").limit(20)


@register("pois_in_box", f"WITH {t.STATIONS} SELECT id, kind, lon, lat FROM stations WHERE lon BETWEEN 8 AND 12 AND lat BETWEEN 48 AND 51 AND kind IN ('BUILDING', 'MACHINERY')")
def pois_in_box(spark, d):
    s = t.stations(spark, d)
    return s.where(geo.in_box("lon", "lat", (8, 48, 12, 51), closed=True) & F.col("kind").isin("BUILDING", "MACHINERY")).select("id", "kind", "lon", "lat")


@register("box_owned", f"WITH {t.STATIONS} SELECT floor(lon)::BIGINT AS cx, floor(lat)::BIGINT AS cy, count(*) AS n FROM stations WHERE lon >= 7 AND lon < 13 AND lat >= 47 AND lat < 52 GROUP BY 1, 2")
def box_owned(spark, d):
    cx, cy = geo.cell("lon", "lat")
    return t.stations(spark, d).where(geo.in_box("lon", "lat", (7, 47, 13, 52))).groupBy(cx.alias("cx"), cy.alias("cy")).agg(F.count("*").alias("n"))


_AB = t.haversine_sql("a.lon", "a.lat", "s.lon", "s.lat")


@register("radius_join", f"WITH {t.ANCHORS}, {t.STATIONS} SELECT anchor, id, round({_AB}, 2) AS dist_m FROM anchors a, stations s WHERE {_AB} <= 25000")
def radius_join(spark, d):
    pairs = proximity.pairs_within(t.anchors(spark, d), t.stations(spark, d), "anchor", "id", 25_000)
    return pairs.select("anchor", "id", F.round("dist_m", 2).alias("dist_m"))


@register("nearest_station", f"WITH {t.ANCHORS}, {t.STATIONS} SELECT anchor, id, round(d, 2) AS dist_m FROM (SELECT anchor, id, d, row_number() OVER (PARTITION BY anchor ORDER BY d, id) AS r FROM (SELECT anchor, id, {_AB} AS d FROM anchors a, stations s)) WHERE r = 1")
def nearest_station(spark, d):
    return proximity.nearest(t.anchors(spark, d), t.stations(spark, d), "anchor", "id").select("anchor", "id", F.round("dist_m", 2).alias("dist_m"))


@register("two_nearest_within", f"WITH {t.ANCHORS}, {t.STATIONS} SELECT anchor, id, r::INT AS rank FROM (SELECT anchor, id, row_number() OVER (PARTITION BY anchor ORDER BY d, id) AS r FROM (SELECT anchor, id, {_AB} AS d FROM anchors a, stations s) WHERE d <= 30000) WHERE r <= 2")
def two_nearest_within(spark, d):
    return proximity.nearest_within(t.anchors(spark, d), t.stations(spark, d), "anchor", "id", 30_000, 2).select("anchor", "id", "rank")


@register("stations_with_lodging", f"WITH {t.ANCHORS}, {t.STATIONS} SELECT anchor, count(*) AS n FROM anchors a, stations s WHERE {_AB} <= 15000 GROUP BY anchor")
def stations_with_lodging(spark, d):
    return proximity.counts_within(t.anchors(spark, d), t.stations(spark, d), "anchor", 15_000)


@register("far_stations", f"WITH {t.ANCHORS}, {t.STATIONS} SELECT id, name FROM stations s WHERE NOT EXISTS (SELECT 1 FROM anchors a WHERE {_AB} <= 20000)")
def far_stations(spark, d):
    return proximity.farther_than(t.stations(spark, d), t.anchors(spark, d), "id", 20_000).select("id", "name")


_SS = t.haversine_sql("a.lon", "a.lat", "b.lon", "b.lat")


@register("local_max_anchors", f"WITH {t.STATIONS} SELECT id FROM stations a WHERE NOT EXISTS (SELECT 1 FROM stations b WHERE a.id <> b.id AND {_SS} <= 10000 AND (b.weight > a.weight OR b.weight = a.weight AND b.id > a.id))")
def local_max_anchors(spark, d):
    return proximity.local_maxima(t.stations(spark, d), "id", "weight", 10_000).select("id")


_BOXES = "boxes AS (SELECT n_nationkey AS box, 5.0 + (n_nationkey * 7) % 12 AS x0, 46.0 + (n_nationkey * 5) % 9 AS y0, 1.0 + n_nationkey % 4 AS w FROM nation)"


@register("smallest_container", f"WITH {t.STATIONS}, {_BOXES} SELECT id, box FROM (SELECT id, box, row_number() OVER (PARTITION BY id ORDER BY w * w, box) AS r FROM stations, boxes WHERE lon BETWEEN x0 AND x0 + w AND lat BETWEEN y0 AND y0 + w) WHERE r = 1")
def smallest_container(spark, d):
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    w = 1.0 + F.pmod(k, F.lit(4))
    boxes = n.select(k.alias("box"), (5.0 + F.pmod(k * 7, F.lit(12))).alias("min_lon"), (46.0 + F.pmod(k * 5, F.lit(9))).alias("min_lat"), w.alias("w"))
    boxes = boxes.select("box", "min_lon", "min_lat", (F.col("min_lon") + F.col("w")).alias("max_lon"), (F.col("min_lat") + F.col("w")).alias("max_lat"))
    return proximity.smallest_container(t.stations(spark, d), boxes, "id", "box")


_PD = t.haversine_sql("6.0", "47.0", "lon", "lat")
_PB = t.bearing_sql("6.0", "47.0", "lon", "lat")
_LB = t.bearing_sql("6.0", "47.0", "18.0", "57.0")


@register("corridor_points", f"WITH {t.STATIONS}, x AS (SELECT id, abs(asin(greatest(-1.0, least(1.0, sin({_PD} / {t.R}) * sin(radians({_PB} - {_LB}))))) * {t.R}) AS off FROM stations) SELECT id, round(off, 1) AS off_m FROM x WHERE off <= 15000")
def corridor_points(spark, d):
    off = geo.cross_track_m("lon", "lat", 6.0, 47.0, 18.0, 57.0)
    return t.stations(spark, d).withColumn("off", off).where("off <= 15000").select("id", F.round("off", 1).alias("off_m"))


_S12 = f"""WITH {t.ANCHORS}, pairs AS (SELECT a.anchor AS a, b.anchor AS b, {_SS} AS d, {t.bearing_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS way FROM anchors a, anchors b WHERE a.anchor <> b.anchor),
 s AS (SELECT *, unnest(range(12)) AS sector FROM pairs WHERE d <= 100000 AND d > 0), r AS (SELECT *, row_number() OVER (PARTITION BY a, sector ORDER BY d, b) AS k FROM s WHERE (way - sector * 30 + 360) % 360 < 60)
 SELECT least(a, b) AS a, greatest(a, b) AS b, round(min(d), 2) AS dist_m FROM r WHERE k = 1 GROUP BY 1, 2"""


@register("sector_neighbours", _S12)
def sector_neighbours(spark, d):
    return proximity.sector_neighbours(t.anchors(spark, d), "anchor", 100_000).select("a", "b", F.round("dist_m", 2).alias("dist_m"))


@register(
    "search_anchors",
    f"WITH {t.STATIONS} SELECT id, name, (CASE WHEN lower(name) LIKE 'customer#00000001%' THEN 0 ELSE 1 END)::INT AS place FROM stations WHERE lower(name) LIKE '%00000001%' OR lower(name) LIKE 'customer#00000001%' ORDER BY place, weight DESC, id LIMIT 25",
)
def search_anchors(spark, d):
    low = F.lower("name")
    hits = t.stations(spark, d).where(F.contains(low, F.lit("00000001")))
    for v in text.query_variants(" Customer#00000001 "):
        hits = hits.withColumn("place", F.when(F.startswith(low, F.lit(v)), 0).otherwise(1))
    return hits.orderBy("place", F.desc("weight"), "id").limit(25).select("id", "name", "place")


_ROUTE = f"route AS (SELECT row_number() OVER (ORDER BY o_orderdate, seq) AS pos, lon, lat FROM lines WHERE line = 7)"
_RS = t.haversine_sql("r.lon", "r.lat", "s.lon", "s.lat")


@register("pois_along_route", f"WITH {t.LINES}, {t.STATIONS}, {_ROUTE} SELECT id, round(min({_RS}), 1) AS off_m FROM route r, stations s WHERE {_RS} <= 30000 GROUP BY id")
def pois_along_route(spark, d):
    route = t.lines(spark, d).where("line = 7").select("seq", "lon", "lat")
    pairs = proximity.radius_join(route, t.stations(spark, d).select("id", "lon", "lat"), 30_000)
    return pairs.groupBy("id").agg(F.round(F.min("dist_m"), 1).alias("off_m"))


@register(
    "stations_along_route",
    f"WITH {t.LINES}, {t.STATIONS}, {t.STEPS}, x AS (SELECT id, kind, pos, cum_m, {t.haversine_sql('c.lon', 'c.lat', 's.lon', 's.lat')} AS off FROM cums c, stations s WHERE line = 7), y AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY off, pos) AS r FROM x WHERE off <= 30000) SELECT id, round(cum_m / 1000, 2) AS km FROM y WHERE r = 1 ORDER BY km, id LIMIT 20",
)
def stations_along_route(spark, d):
    route = ordered.with_steps(t.lines(spark, d).where("line = 7"), "line", t.ORDER).select("seq", "cum_m", "lon", "lat", "o_orderdate")
    pairs = proximity.radius_join(route, t.stations(spark, d).select("id", "lon", "lat"), 30_000)
    first = pairs.groupBy("id").agg(F.min_by("cum_m", F.struct("dist_m", "o_orderdate", "seq")).alias("cum_m"))
    return first.select("id", F.round(F.col("cum_m") / 1000, 2).alias("km")).orderBy("km", "id").limit(20)


@register("mercator_tiles", f"WITH {t.STATIONS} SELECT x, y, count(*) AS n FROM (SELECT floor((lon + 180) / 360 * 256)::BIGINT AS x, floor((1 - asinh(tan(radians(lat))) / 3.141592653589793::DOUBLE) / 2 * 256)::BIGINT AS y FROM stations) GROUP BY 1, 2")
def mercator_tiles(spark, d):
    x, y = geo.mercator_tile("lon", "lat", 8)
    return t.stations(spark, d).groupBy(x.alias("x"), y.alias("y")).agg(F.count("*").alias("n"))


_REGIONS = "(1, 'west', 5.0, 46.0, 9.0, 58.0), (2, 'south', 5.0, 46.0, 19.0, 50.0), (3, 'east', 12.0, 50.0, 19.0, 58.0)"


@register("region_dispatch", f"WITH {t.ANCHORS}, regions(priority, region, x0, y0, x1, y1) AS (VALUES {_REGIONS}) SELECT anchor, coalesce((SELECT min_by(region, priority) FROM regions WHERE lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1), 'default') AS region FROM anchors")
def region_dispatch(spark, d):
    boxes = spark.createDataFrame([(1, "west", 5.0, 46.0, 9.0, 58.0), (2, "south", 5.0, 46.0, 19.0, 50.0), (3, "east", 12.0, 50.0, 19.0, 58.0)], "priority int, region string, x0 double, y0 double, x1 double, y1 double")
    return relational.first_region(t.anchors(spark, d), boxes, "anchor", "default")
