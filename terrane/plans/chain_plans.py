"""Queries of the anchor chain, and lookups that keep an order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrane.operators import chains, graph, proximity
from terrane.plans import tables as t
from terrane.plans.catalog import register
from terrane.session import table


@register("multi_snap", f"WITH {t.ANCHORS}, {t.STATIONS}, p AS (SELECT anchor, id AS node, id % 6 AS root, {t.haversine_sql('a.lon', 'a.lat', 's.lon', 's.lat')} AS d FROM anchors a, stations s), f AS (SELECT *, row_number() OVER (PARTITION BY anchor, root ORDER BY d, node) AS r FROM p WHERE d <= 40000), g AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY d, node) AS k FROM f WHERE r = 1) SELECT anchor, node, round(d, 2) AS dist_m FROM g WHERE k <= 3")
def multi_snap(spark, d):
    s = t.stations(spark, d).withColumnRenamed("id", "node")
    roots = s.select("node", F.pmod("node", F.lit(6)).alias("root"))
    return chains.multi_snap(t.anchors(spark, d), s, roots, 40_000, 3).select("anchor", "node", F.round("dist_m", 2).alias("dist_m"))


@register("bridge_gaps")
def bridge_gaps(spark, d):
    s = t.stations(spark, d).select(F.col("id").alias("node"), F.col("kind").alias("name"), "lon", "lat")
    return chains.bridge_gaps(s, s.select("node", F.floor(F.col("node") / 4).alias("root")), 25_000)


@register("bridge_islands", f"WITH {t.STATIONS}, p AS (SELECT a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.id ORDER BY {t.haversine_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')}, b.id) AS k FROM stations a JOIN stations b ON {t.haversine_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 15000) SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, 0.0 AS cost FROM p WHERE k <= 4 AND a <> b AND a % 5 <> b % 5")
def bridge_islands(spark, d):
    s = t.stations(spark, d).withColumnRenamed("id", "node")
    return chains.bridge_islands(s, s.select("node", F.pmod("node", F.lit(5)).alias("root")), 3, 15_000)


@register("station_clusters")
def station_clusters(spark, d):
    s = t.stations(spark, d).select(F.col("id").alias("stop"), F.col("kind").alias("name_key"), "lon", "lat")
    return chains.cluster_stations(s, 0.3)


_PAIRED = f"""WITH RECURSIVE {t.CITY_ARCS}, spots AS (SELECT n_nationkey::BIGINT AS node, {t.lon_sql('n_nationkey')} AS lon, {t.lat_sql('n_nationkey')} AS lat FROM nation),
 p AS (SELECT node AS src, node AS dst, 0.0::DOUBLE AS cost, 0 AS hops FROM spots
 UNION SELECT p.src, arcs.dst, min(p.cost + arcs.cost), hops + 1 FROM p JOIN arcs ON p.dst = arcs.src WHERE hops < 10 GROUP BY p.src, arcs.dst, hops + 1),
 d AS (SELECT src, dst, min(cost) AS cost FROM p GROUP BY 1, 2)"""


@register("bounded_costs", f"{_PAIRED}, w AS (SELECT src, (dst + 5) % 25 AS dst, cost * 1.5::DOUBLE AS crow FROM arcs WHERE src <> (dst + 5) % 25), l AS (SELECT src, least(2 * max(crow) + 50, 300000) AS most FROM w GROUP BY src) SELECT DISTINCT w.src, w.dst, d.cost FROM w JOIN l ON l.src = w.src JOIN d ON d.src = w.src AND d.dst = w.dst WHERE d.cost <= most")
def bounded_costs(spark, d):
    arcs = t.city_arcs(spark, d).withColumn("region", F.lit(0))
    pairs = arcs.select("region", F.col("src"), F.pmod(F.col("dst") + 5, F.lit(25)).alias("dst"), (F.col("cost") * 1.5).alias("crow_m")).where("src <> dst").distinct()
    return chains.bounded_costs(pairs, arcs, "region", extra_m=50.0)


_SERVED = f"served AS (SELECT DISTINCT s_nationkey::BIGINT AS anchor, l_orderkey % 40 AS route FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"
_CITY = f"cities AS (SELECT n_nationkey::BIGINT AS anchor, {t.lon_sql('n_nationkey')} AS lon, {t.lat_sql('n_nationkey')} AS lat FROM nation)"


_LEFT = t.haversine_sql("x.lon", "x.lat", "m.lon", "m.lat")
_NEAR = t.haversine_sql("f.lon", "f.lat", "x.lon", "x.lat")
_ENTRY = f"""{_PAIRED}, m AS (SELECT a.node AS search, x.node AS target, {_NEAR} <= 300000 AS inside, {_LEFT} / 1000 AS km
 FROM spots a JOIN spots x ON x.node <> a.node AND (a.node + x.node) % 2 = 1 JOIN spots f ON f.node = (a.node + 7) % 25 JOIN spots m ON m.node = (a.node + 3) % 25),
 k AS (SELECT *, bool_or(inside) OVER (PARTITION BY search) AS any_near FROM m),
 r AS (SELECT search, target, cost, row_number() OVER (PARTITION BY search ORDER BY cost + 0.05 * km, target) AS r FROM k JOIN d ON search = src AND target = dst WHERE (inside OR NOT any_near) AND cost <= 40)
 SELECT search, target, cost FROM r WHERE r = 1"""


@register("entry_points", _ENTRY)
def entry_points(spark, d):
    at = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"), t.lon_of("n_nationkey").alias("lon"), t.lat_of("n_nationkey").alias("lat"))
    turned = lambda k, *names: at.select(F.pmod(F.col("node") - k, F.lit(25)).alias("search"), "lon", "lat").toDF("search", *names)
    searches = at.select(F.col("node").alias("search"), F.lit(0).alias("region"), F.col("node").alias("vid"))
    searches = searches.join(turned(7, "prefer_lon", "prefer_lat"), "search").join(turned(3, "aim_lon", "aim_lat"), "search")
    targets = searches.select("search").join(at.withColumnRenamed("node", "target"), F.pmod("search", F.lit(2)) == 1 - F.pmod("target", F.lit(2)))
    arcs = t.city_arcs(spark, d).withColumn("region", F.lit(0))
    return chains.entry_points(searches, targets, arcs, "region", bias=0.05, prefer_m=300_000, most=40.0)


@register("rail_graph", f"WITH {_SERVED}, {_CITY} SELECT DISTINCT x.anchor AS src, y.anchor AS dst, round({t.haversine_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')} / 1000, 4) AS cost FROM served x JOIN served y ON x.route = y.route AND x.anchor <> y.anchor JOIN cities a ON a.anchor = x.anchor JOIN cities b ON b.anchor = y.anchor")
def rail_graph(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("anchor"))
    served = table(spark, d, "lineitem").join(s, "l_suppkey").select("anchor", F.pmod("l_orderkey", F.lit(40)).alias("route")).distinct()
    k = F.col("n_nationkey").cast("long")
    cities = table(spark, d, "nation").select(k.alias("anchor"), t.lon_of("n_nationkey").alias("lon"), t.lat_of("n_nationkey").alias("lat"))
    return chains.rail_graph(served, cities).select("src", "dst", F.round("cost", 4).alias("cost"))


@register("fast_route", f"WITH {t.CITY_ARCS}, legs AS (SELECT c_custkey % 50 AS route, c_custkey AS pos, c_nationkey::BIGINT AS city FROM customer), n AS (SELECT *, lead(city) OVER (PARTITION BY route ORDER BY pos) AS nxt FROM legs) SELECT route, round(sum(cost) * 1.2::DOUBLE / 1000, 6) AS km FROM n JOIN arcs ON city = src AND nxt = dst GROUP BY 1")
def fast_route(spark, d):
    chain = table(spark, d, "customer").select(F.pmod("c_custkey", F.lit(50)).alias("route"), F.col("c_custkey").alias("pos"), F.col("c_nationkey").cast("long").alias("city"))
    return chains.fast_route_km(chain, t.city_arcs(spark, d)).select("route", F.round("km", 6).alias("km"))


@register("stitched_walks")
def stitched_walks(spark, d):
    o = table(spark, d, "orders")
    pos = lambda k: F.row_number().over(Window.partitionBy("trip").orderBy(k)) - 1
    rows = o.select(F.col("o_custkey").alias("trip"), "o_orderkey", F.pmod("o_orderkey", F.lit(9)).alias("vid"))
    up = graph.best_by(rows.where(F.pmod("o_orderkey", F.lit(2)) == 0), ["trip", "vid"], ["o_orderkey"]).withColumn("pos", pos("o_orderkey"))
    down = graph.best_by(rows.where(F.pmod("o_orderkey", F.lit(2)) == 1), ["trip", "vid"], ["o_orderkey"]).withColumn("pos", pos("o_orderkey"))
    return chains.stitch(up.select("trip", "pos", "vid"), down.select("trip", "pos", "vid"))


@register("ordered_lookup", "SELECT o_orderkey, k::INT AS ord, p_brand FROM (SELECT o_orderkey, unnest(range(3)) AS k FROM orders) JOIN part ON p_partkey = (o_orderkey * 7 + k * 13) % 200")
def ordered_lookup(spark, d):
    k = F.col("o_orderkey")
    ids = table(spark, d, "orders").select("o_orderkey", F.posexplode(F.array(*[F.pmod(k * 7 + i * 13, F.lit(200)) for i in range(3)])).alias("ord", "p_partkey"))
    return ids.join(table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey").select("o_orderkey", "ord", "p_brand")


@register("rounded_match", f"WITH {t.STATIONS}, {t.VERTICES} SELECT s.id AS station, min(v.id) AS vertex FROM stations s JOIN vertices v ON round(s.lon, 1) = round(v.lon, 1) AND round(s.lat, 1) = round(v.lat, 1) GROUP BY 1")
def rounded_match(spark, d):
    place = lambda df, n: df.select(F.col("id").alias(n), F.round("lon", 1).alias("x"), F.round("lat", 1).alias("y"))
    return place(t.stations(spark, d), "station").join(place(t.vertices(spark, d), "vertex"), ["x", "y"]).groupBy("station").agg(F.min("vertex").alias("vertex"))


@register("either_direction", f"WITH {t.EDGES}, w AS (SELECT l_orderkey AS ord, l_suppkey AS u, l_partkey AS v FROM lineitem WHERE l_linenumber = 1) SELECT ord, min(gid) AS gid FROM (SELECT ord, gid FROM w JOIN edges ON source = u AND target = v UNION ALL SELECT ord, gid FROM w JOIN edges ON source = v AND target = u) GROUP BY 1")
def either_direction(spark, d):
    e = t.edges(spark, d).select("gid", "source", "target")
    w = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("ord"), F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v"))
    one = w.join(e, (w["u"] == e["source"]) & (w["v"] == e["target"])).select("ord", "gid")
    return one.unionByName(w.join(e, (w["v"] == e["source"]) & (w["u"] == e["target"])).select("ord", "gid")).groupBy("ord").agg(F.min("gid").alias("gid"))


@register("day_offsets", "SELECT o_custkey, o_orderkey, coalesce(sum(n) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS days_before FROM (SELECT o_custkey, o_orderkey, 1 + o_orderkey % 4 AS n FROM orders)")
def day_offsets(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    n = 1 + F.pmod("o_orderkey", F.lit(4))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.coalesce(F.sum(n).over(w), F.lit(0)).alias("days_before"))


@register("plan_totals", "SELECT o_custkey, sum(coalesce(nullif(o_orderkey % 3, 0), greatest(0, o_orderkey % 5 - 1)))::BIGINT AS days, count(*) FILTER (o_orderstatus = 'F') AS failed FROM orders GROUP BY 1")
def plan_totals(spark, d):
    k = F.col("o_orderkey")
    days = F.coalesce(F.nullif(F.pmod(k, F.lit(3)), F.lit(0)), F.greatest(F.lit(0), F.pmod(k, F.lit(5)) - 1))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(days).alias("days"), F.count_if(F.col("o_orderstatus") == "F").alias("failed"))


@register("made_lines", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS line, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def made_lines(spark, d):
    seq = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey")))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(seq, lambda x: x["o_orderkey"].cast("string")), ",").alias("line"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("trapped_culled", "SELECT l_suppkey AS vertex FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 60")
def trapped_culled(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("vertex")).agg(F.countDistinct("l_partkey").alias("n")).where("n >= 60").select("vertex")


@register("redone_replaced", "SELECT s_suppkey AS ref, s_name AS name FROM supplier WHERE s_suppkey % 4 <> 0 UNION ALL SELECT s_suppkey, upper(s_name) FROM supplier WHERE s_suppkey % 4 = 0")
def redone_replaced(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("ref"), F.col("s_name").alias("name"))
    redone = s.where(F.pmod("ref", F.lit(4)) == 0).withColumn("name", F.upper("name"))
    return s.join(redone.select("ref"), "ref", "left_anti").unionByName(redone)


@register("last_shared_vertex", "SELECT o_custkey, max(o_orderkey) AS last FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) GROUP BY 1")
def last_shared_vertex(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    walk = o.join(table(spark, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    nxt = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return walk.join(nxt, "o_orderkey", "left_semi").groupBy("o_custkey").agg(F.max("o_orderkey").alias("last"))


@register("directed_weights", f"WITH {t.CITY_ARCS}, tree AS (SELECT src, dst, cost * 0.9::DOUBLE AS tcost FROM arcs WHERE (src + dst) % 3 = 0) SELECT a.src, a.dst, least(a.cost, coalesce(tcost, a.cost)) AS weight FROM arcs a LEFT JOIN tree USING (src, dst)")
def directed_weights(spark, d):
    arcs = t.city_arcs(spark, d)
    tree = arcs.where(F.pmod(F.col("src") + F.col("dst"), F.lit(3)) == 0).select("src", "dst", (F.col("cost") * 0.9).alias("tcost"))
    return arcs.join(tree, ["src", "dst"], "left").select("src", "dst", F.least("cost", F.coalesce("tcost", "cost")).alias("weight"))


@register("proximity_chain")
def proximity_chain(spark, d):
    a = t.anchors(spark, d).select("anchor", "lon", "lat")
    pairs = proximity.sector_neighbours(a, "anchor", 150_000).select("a", "b")

    def straight(todo):
        ends = todo.join(a.toDF("a", "x1", "y1"), "a").join(a.toDF("b", "x2", "y2"), "b")
        f = lambda p, q: lambda k: F.col(p) + (F.col(q) - F.col(p)) * k / 20
        x, y = f("x1", "x2"), f("y1", "y2")
        path = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.struct(x(k).alias("lon"), y(k).alias("lat")))
        from terrane.functions import geo

        return ends.select("a", "b", (geo.haversine_m("x1", "y1", "x2", "y2") * 1.2).alias("cost"), path.alias("path"))

    return chains.proximity_chain(pairs, a, straight)
