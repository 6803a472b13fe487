"""Table maintenance, roll-ups and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import text
from terrane.operators import graph, relational
from terrane.plans import tables as t
from terrane.plans.catalog import register
from terrane.session import table


@register("tag_backfill", "SELECT l_orderkey, l_linenumber, coalesce(nullif(CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END, ''), l_returnflag) AS tag FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def tag_backfill(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.when(F.pmod("p_size", F.lit(2)) == 0, "").otherwise(F.col("p_brand")).alias("side"))
    j = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").join(p, "l_partkey", "left")
    return j.select("l_orderkey", "l_linenumber", relational.filled(F.col("side"), F.col("l_returnflag")).alias("tag"))


@register("tag_upsert", "SELECT o_custkey, status, ts FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY ts DESC, side DESC, o_orderkey DESC) AS r FROM (SELECT o_custkey, o_orderstatus AS status, o_orderdate AS ts, o_orderkey, 0 AS side FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, o_orderpriority, o_orderdate, o_orderkey, 1 FROM orders WHERE o_orderkey % 2 = 1)) WHERE r = 1")
def tag_upsert(spark, d):
    o = table(spark, d, "orders")
    of = lambda k, c: graph.best_by(o.where(F.pmod("o_orderkey", F.lit(2)) == k).select("o_custkey", F.col(c).alias("status"), F.col("o_orderdate").alias("ts"), "o_orderkey"), ["o_custkey"], [F.desc("ts"), F.desc("o_orderkey")])
    return relational.upsert(of(0, "o_orderstatus"), of(1, "o_orderpriority"), ["o_custkey"], "ts").select("o_custkey", "status", "ts")


@register("vertex_dedup", f"SELECT l_partkey AS osm_id, min({t.lon_sql('l_orderkey')}) AS lon, min({t.lat_sql('l_orderkey')}) AS lat FROM lineitem GROUP BY 1")
def vertex_dedup(spark, d):
    nodes = table(spark, d, "lineitem").select(F.col("l_partkey").alias("osm_id"), t.lon_of("l_orderkey").alias("lon"), t.lat_of("l_orderkey").alias("lat"))
    return relational.first_positions(nodes, "osm_id")


@register("insert_missing", "SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 = 0 UNION SELECT o_custkey FROM orders")
def insert_missing(spark, d):
    have = table(spark, d, "customer").where(F.pmod("c_custkey", F.lit(3)) == 0).select(F.col("c_custkey").alias("id"))
    return relational.insert_missing(have, table(spark, d, "orders").select(F.col("o_custkey").alias("id")), ["id"])


@register("resolved_edges", "WITH v AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS vid FROM part) SELECT l_orderkey, l_linenumber, a.vid AS source, b.vid AS target FROM lineitem JOIN v a ON l_partkey = a.p_partkey JOIN v b ON l_suppkey = b.p_partkey")
def resolved_edges(spark, d):
    v = relational.surrogate_ids(table(spark, d, "part").select("p_partkey"), "p_partkey", "vid")
    e = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return relational.resolve_ids(e, v, "p_partkey", "vid").select("l_orderkey", "l_linenumber", "source", "target")


@register("way_segments", "WITH s AS (SELECT l_orderkey AS way_id, l_linenumber AS n, l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS seq FROM lineitem) SELECT way_id, seq::INT AS seq, src, dst FROM s WHERE dst IS NOT NULL AND src <> dst")
def way_segments(spark, d):
    li = table(spark, d, "lineitem")
    ways = li.groupBy(F.col("l_orderkey").alias("way_id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    return relational.segments(ways.select("way_id", F.transform("x", lambda s: s["l_partkey"]).alias("nodes")))


@register("edge_duplicates", f"WITH {t.EDGES} SELECT source, target, count(*) AS n, min(gid) AS keep, max(length) AS length, array_to_string(list_sort(list(gid)), ',') AS gids FROM edges GROUP BY 1, 2 HAVING count(*) > 1")
def edge_duplicates(spark, d):
    g = relational.duplicate_groups(t.edges(spark, d), ["source", "target"], "gid", ["length"])
    return g.select("source", "target", "n", "keep", "length", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("gids"))


@register("edges_dropped", f"WITH {t.EDGES} SELECT gid FROM edges EXCEPT SELECT min(gid) FROM edges GROUP BY source, target")
def edges_dropped(spark, d):
    e = t.edges(spark, d)
    kept = e.groupBy("source", "target").agg(F.min("gid").alias("gid")).select("gid")
    return e.select("gid").distinct().join(kept, "gid", "left_anti")


@register("staged_update", "SELECT c_custkey, coalesce(s.v, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS v FROM orders GROUP BY 1) s ON c_custkey = o_custkey")
def staged_update(spark, d):
    staged = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return relational.apply_staged(table(spark, d, "customer").select("c_custkey", "c_acctbal"), staged, "c_custkey", ["c_acctbal"])


@register("in_graph_flags", "SELECT s_suppkey, s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49) AS in_graph FROM supplier")
def in_graph_flags(spark, d):
    used = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey")).distinct().withColumn("hit", F.lit(True))
    return table(spark, d, "supplier").select("s_suppkey").join(used, "s_suppkey", "left").select("s_suppkey", F.col("hit").isNotNull().alias("in_graph"))


@register("signal_summary", "SELECT count(*) AS n, count(*) FILTER (l_discount > 0) AS nonzero, count(*) FILTER (l_discount > 0.05) AS above, round(avg(l_discount), 6) AS mean, min(l_discount) AS low, max(l_discount) AS high FROM lineitem")
def signal_summary(spark, d):
    x = F.col("l_discount")
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"), F.count_if(x > 0).alias("nonzero"), F.count_if(x > 0.05).alias("above"), F.round(F.avg(x), 6).alias("mean"), F.min(x).alias("low"), F.max(x).alias("high"))


_AB = "ab AS (SELECT l_discount AS a, l_tax AS b, abs(l_discount - l_tax) AS diff FROM lineitem)"


def _ab(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_discount").alias("a"), F.col("l_tax").alias("b"), F.abs(F.col("l_discount") - F.col("l_tax")).alias("diff"))


@register("compare_stats", f"WITH {_AB} SELECT round(avg(diff), 8) AS mean_diff, round(stddev(diff), 8) AS dev_diff, max(diff) AS max_diff, round(corr(a, b), 6) AS corr FROM ab")
def compare_stats(spark, d):
    return _ab(spark, d).agg(F.round(F.avg("diff"), 8).alias("mean_diff"), F.round(F.stddev("diff"), 8).alias("dev_diff"), F.max("diff").alias("max_diff"), F.round(F.corr("a", "b"), 6).alias("corr"))


@register("compare_percentiles", f"WITH {_AB} SELECT round(quantile_cont(diff, 0.5), 8) AS p50, round(quantile_cont(diff, 0.9), 8) AS p90, round(quantile_cont(diff, 0.99), 8) AS p99 FROM ab")
def compare_percentiles(spark, d):
    return _ab(spark, d).agg(*[F.round(F.percentile("diff", p), 8).alias(n) for n, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))])


@register("compare_buckets", f"WITH {_AB} SELECT count(*) FILTER (diff < 0.01) AS tight, count(*) FILTER (diff BETWEEN 0.01 AND 0.03) AS near, count(*) FILTER (diff BETWEEN 0.03 AND 0.06) AS far, count(*) FILTER (diff > 0.06) AS off FROM ab")
def compare_buckets(spark, d):
    x = F.col("diff")
    return _ab(spark, d).agg(F.count_if(x < 0.01).alias("tight"), F.count_if(x.between(0.01, 0.03)).alias("near"), F.count_if(x.between(0.03, 0.06)).alias("far"), F.count_if(x > 0.06).alias("off"))


@register("compare_contingency", f"WITH {_AB} SELECT a > 0.05 AS a_high, b > 0.04 AS b_high, count(*) AS n FROM ab GROUP BY 1, 2")
def compare_contingency(spark, d):
    return _ab(spark, d).groupBy((F.col("a") > 0.05).alias("a_high"), (F.col("b") > 0.04).alias("b_high")).agg(F.count("*").alias("n"))


@register("route_breakdown", f"WITH {t.EDGES} SELECT highway, surface, tracktype, count(*) AS n, sum(length) AS length, sum(greatest(0, grade * length / 100)) AS climb FROM edges GROUP BY GROUPING SETS ((highway), (surface), (tracktype), ())")
def route_breakdown(spark, d):
    e = t.edges(spark, d)
    climb = F.greatest(F.lit(0.0), F.col("grade") * F.col("length") / 100)
    return e.groupingSets([[F.col("highway")], [F.col("surface")], [F.col("tracktype")], []], "highway", "surface", "tracktype").agg(F.count("*").alias("n"), F.sum("length").alias("length"), F.round(F.sum(climb), 6).alias("climb"))


@register("variant_metrics", f"WITH {t.EDGES} SELECT bicycle AS variant, round(sum(length * canopy_frac) / sum(length), 8) AS canopy, round(100 * sum(length) FILTER (surface = 'gravel') / sum(length), 6) AS gravel_pct FROM edges GROUP BY 1")
def variant_metrics(spark, d):
    n = F.sum("length")
    return t.edges(spark, d).groupBy(F.col("bicycle").alias("variant")).agg(F.round(F.sum(F.col("length") * F.col("canopy_frac")) / n, 8).alias("canopy"), F.round(100 * F.sum(F.when(F.col("surface") == "gravel", F.col("length"))) / n, 6).alias("gravel_pct"))


@register("corridor_totals", f"WITH {t.EDGES} SELECT source % 10 AS leg, sum(length) AS length, round(sum(greatest(0, CASE WHEN oneway THEN -grade ELSE grade END) * length / 100), 6) AS climb, round(sum(length) FILTER (highway = 'cycleway') / sum(length), 8) AS cycle_share FROM edges GROUP BY 1")
def corridor_totals(spark, d):
    up = F.greatest(F.lit(0.0), F.when(F.col("oneway"), -F.col("grade")).otherwise(F.col("grade"))) * F.col("length") / 100
    share = F.sum(F.when(F.col("highway") == "cycleway", F.col("length"))) / F.sum("length")
    return t.edges(spark, d).groupBy(F.pmod("source", F.lit(10)).alias("leg")).agg(F.sum("length").alias("length"), F.round(F.sum(up), 6).alias("climb"), F.round(share, 8).alias("cycle_share"))


@register("extent", f"WITH {t.STATIONS} SELECT min(lon) AS x0, min(lat) AS y0, max(lon) AS x1, max(lat) AS y1 FROM stations")
def extent(spark, d):
    return t.stations(spark, d).agg(F.min("lon").alias("x0"), F.min("lat").alias("y0"), F.max("lon").alias("x1"), F.max("lat").alias("y1"))


@register("category_counts", "SELECT c_mktsegment AS category, count(*) AS n FROM customer GROUP BY 1")
def category_counts(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("category")).agg(F.count("*").alias("n"))


@register("rank_quantile", "SELECT c_mktsegment AS kind, (list_sort(list(c_acctbal)))[count(*) // 2 + 1] AS middle FROM customer GROUP BY 1")
def rank_quantile(spark, d):
    vals = F.sort_array(F.collect_list("c_acctbal"))
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("kind")).agg(F.element_at(vals, (F.floor(F.count("*") / 2) + 1).cast("int")).alias("middle"))


@register("route_sets", "SELECT l_suppkey AS stop, count(DISTINCT l_orderkey) FILTER (l_returnflag = 'R') AS n_rail, count(DISTINCT l_orderkey) FILTER (l_returnflag <> 'R') AS n_bus FROM lineitem GROUP BY 1")
def route_sets(spark, d):
    r, k = F.col("l_returnflag") == "R", F.col("l_orderkey")
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("stop")).agg(F.countDistinct(F.when(r, k)).alias("n_rail"), F.countDistinct(F.when(~r, k)).alias("n_bus"))


@register("route_shared_pairs", "SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(DISTINCT x.l_orderkey) AS n_shared FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY 1, 2")
def route_shared_pairs(spark, d):
    return graph.co_members(table(spark, d, "lineitem").select("l_suppkey", "l_orderkey"), "l_suppkey", "l_orderkey")


@register("direct_service", "SELECT a.s_nationkey AS pair, array_to_string(list_sort(list(DISTINCT x.l_orderkey)), ',') AS routes FROM supplier a JOIN lineitem x ON x.l_suppkey = a.s_suppkey JOIN lineitem y ON x.l_orderkey = y.l_orderkey JOIN supplier b ON y.l_suppkey = b.s_suppkey WHERE b.s_nationkey = (a.s_nationkey + 1) % 25 GROUP BY 1")
def direct_service(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("stop"), "s_nationkey")
    stops = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("stop"), F.col("l_orderkey").alias("route"))
    left = s.select(F.col("s_nationkey").alias("pair"), "stop")
    right = s.select(F.pmod(F.col("s_nationkey") + 24, F.lit(25)).alias("pair"), "stop")
    return relational.shared_services(stops, left, right).select("pair", F.array_join(F.transform("routes", lambda r: r.cast("string")), ",").alias("routes"))


@register("station_names", "SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(regexp_replace(p_name || ' Hbf g2', '\\s+g?\\d+\\s*$', '', 'i'))), '\\bhbf\\b', 'hauptbahnhof', 'g'), '\\bbhf\\b', 'bahnhof', 'g') AS name_key FROM part")
def station_names(spark, d):
    return table(spark, d, "part").select("p_partkey", text.station_key(F.concat("p_name", F.lit(" Hbf g2"))).alias("name_key"))


@register("station_modes", "SELECT mode, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 7 = 0 THEN 'unknown' WHEN p_partkey % 3 = 0 THEN 'bus' WHEN p_partkey % 3 = 1 THEN 'rail' ELSE 'unknown' END AS mode FROM part) GROUP BY 1")
def station_modes(spark, d):
    k = F.col("p_partkey")
    name = F.when(F.pmod(k, F.lit(7)) == 0, "").when(F.pmod(k, F.lit(3)) == 0, F.concat("p_brand", F.lit(", Hbf"))).when(F.pmod(k, F.lit(3)) == 1, F.concat("p_brand", F.lit(" hauptbahnhof"))).otherwise(F.col("p_brand"))
    return table(spark, d, "part").groupBy(text.station_mode(name).alias("mode")).agg(F.count("*").alias("n"))


@register("gtfs_modes", "SELECT CASE WHEN p_size = 2 THEN 'rail' WHEN p_size IN (3, 11) THEN 'bus' ELSE 'other' END AS mode, count(*) AS n FROM part GROUP BY 1")
def gtfs_modes(spark, d):
    return table(spark, d, "part").groupBy(text.gtfs_mode(F.col("p_size")).alias("mode")).agg(F.count("*").alias("n"))


@register("bus_mislabels", "SELECT s_suppkey, s_suppkey % 5 = 0 OR (s_nationkey = 3 AND s_suppkey % 2 = 0) AS is_bus FROM supplier")
def bus_mislabels(spark, d):
    k = F.col("s_suppkey")
    agency = F.when(F.pmod(k, F.lit(5)) == 0, "Verkehrsverbund X").otherwise("Rail")
    country = F.when(F.col("s_nationkey") == 3, "czech-republic").otherwise("austria")
    short = F.when(F.pmod(k, F.lit(2)) == 0, "V12").otherwise("R1")
    return table(spark, d, "supplier").select("s_suppkey", text.mislabelled_bus(country, short, agency, ["integrovaná doprava", "verkehrsverbund", "moravskoslezský kraj", "středočeská"]).alias("is_bus"))


@register("booking_links", "SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 3 ELSE 2 END::INT AS n_links, 'https://www.google.com/maps/dir/?api=1&origin=' || replace(url_encode(s_name), '%20', '+') || '&destination=Linz&travelmode=transit' AS last_url FROM supplier")
def booking_links(spark, d):
    home = F.when(F.pmod("s_nationkey", F.lit(2)) == 0, "austria").otherwise("germany")
    links = text.booking_links(F.col("s_name"), F.lit("Linz"), home, F.lit("denmark"), F.lit("2024-05-01"))
    return table(spark, d, "supplier").select("s_suppkey", F.size(links).alias("n_links"), F.element_at(links, -1)["url"].alias("last_url"))


@register("miles_guard", "SELECT p_partkey, round(CASE WHEN p_size BETWEEN 15 AND 50 THEN p_size * 1.60934::DOUBLE ELSE p_size END, 5) AS km FROM part")
def miles_guard(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(text.miles_guard(F.col("p_size").cast("double")), 5).alias("km"))


@register("poi_categories", "SELECT CASE p_size % 5 WHEN 0 THEN 'lodging' WHEN 1 THEN 'food' WHEN 2 THEN 'water' WHEN 3 THEN 'bike_service' END AS category, count(*) AS n FROM part GROUP BY 1")
def poi_categories(spark, d):
    m = F.pmod("p_size", F.lit(5))
    poi = text.poi_category(F.when(m == 0, "hotel"), F.when(m == 1, "cafe").when(m == 2, "drinking_water"), F.when(m == 3, "bicycle"))
    return table(spark, d, "part").groupBy(poi["category"].alias("category")).agg(F.count("*").alias("n"))


@register("landcover_classes", "SELECT CASE p_size % 4 WHEN 0 THEN 'forest' WHEN 1 THEN 'water' WHEN 2 THEN 'vineyard' END AS class, count(*) AS n FROM part GROUP BY 1")
def landcover_classes(spark, d):
    m = F.pmod("p_size", F.lit(4))
    return table(spark, d, "part").groupBy(text.landcover_class(F.when(m == 2, "vineyard"), F.when(m == 0, "wood").when(m == 1, "water")).alias("class")).agg(F.count("*").alias("n"))


@register("ref_parts", "SELECT s_suppkey, 'db' AS kind, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey END AS id FROM supplier")
def ref_parts(spark, d):
    ref = F.concat(F.lit("db:"), F.when(F.pmod("s_suppkey", F.lit(3)) == 0, "x").otherwise(F.col("s_suppkey").cast("string")))
    kind, id_ = text.ref_parts(ref)
    return table(spark, d, "supplier").select("s_suppkey", kind.alias("kind"), id_.alias("id"))
