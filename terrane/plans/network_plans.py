"""Filters, chains, polygons, layouts and summaries of networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import geo, text
from terrane.operators import chains, graph, ordered, proximity, raster, relational, signals
from terrane.plans import tables as t
from terrane.plans.catalog import register
from terrane.session import materialize, parts_for, table
from terrane.sources import files

_ENDS = f"{t.EDGES}, {t.VERTICES}, ends AS (SELECT edges.*, s.lon AS x1, s.lat AS y1, x.lon AS x2, x.lat AS y2 FROM edges JOIN vertices s ON source = s.id JOIN vertices x ON target = x.id)"


def _ends(spark, d):
    v = t.vertices(spark, d).select("id", "lon", "lat")
    return t.edges(spark, d).join(v.toDF("source", "x1", "y1"), "source").join(v.toDF("target", "x2", "y2"), "target")


@register("edges_touching_box", f"WITH {_ENDS} SELECT gid FROM ends WHERE (x1 BETWEEN 8 AND 12 AND y1 BETWEEN 48 AND 51) OR (x2 BETWEEN 8 AND 12 AND y2 BETWEEN 48 AND 51)")
def edges_touching_box(spark, d):
    return _ends(spark, d).where(geo.touches_box("x1", "y1", "x2", "y2", (8, 48, 12, 51))).select("gid")


@register("way_seeds", f"WITH {t.EDGES} SELECT gid FROM edges WHERE length > 0 AND (highway IN ('primary', 'cycleway') OR surface = 'dirt' OR (highway IN ('residential', 'track') AND (coalesce(tracktype, '') <> '' OR coalesce(bicycle, '') <> '')))")
def way_seeds(spark, d):
    e = t.edges(spark, d).withColumns({"is_ferry": F.col("surface") == "dirt", "name": F.col("tracktype"), "ref": F.col("bicycle")})
    return relational.way_seeds(e, ["primary", "cycleway"], ["residential", "track"]).select("gid")


@register("ferry_legs", f"WITH {t.EDGES} SELECT gid, length * 10 AS length FROM edges WHERE surface = 'sand' AND bicycle <> 'no' AND grade <> 0 AND length * 10 >= 100")
def ferry_legs(spark, d):
    e = t.edges(spark, d).withColumns({"is_ferry": F.col("surface") == "sand", "excluded": F.col("bicycle") == "no", "cost": F.when(F.col("grade") != 0, F.col("grade")), "length": F.col("length") * 10})
    return relational.ferry_legs(e).select("gid", "length")


@register("oriented_steps", f"WITH {_ENDS} SELECT gid, CASE WHEN source = greatest(source, target) THEN x1 ELSE x2 END AS from_lon, CASE WHEN source = greatest(source, target) THEN x2 ELSE x1 END AS to_lon FROM ends")
def oriented_steps(spark, d):
    forward = F.col("source") == F.greatest("source", "target")
    line = geo.oriented(forward, F.struct(F.col("x1").alias("lon"), F.col("y1").alias("lat")), F.struct(F.col("x2").alias("lon"), F.col("y2").alias("lat")))
    return _ends(spark, d).withColumn("line", line).select("gid", F.col("line")[0]["lon"].alias("from_lon"), F.col("line")[1]["lon"].alias("to_lon"))


@register("cheapest_trunks", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 200")
def cheapest_trunks(spark, d):
    return relational.cheapest(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 200, "o_orderkey")


@register("trunks_up_to", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice <= 50000")
def trunks_up_to(spark, d):
    return relational.cheapest(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 200, "o_orderkey", 50_000)


@register("spatial_layout", f"WITH {t.STATIONS}, c AS (SELECT id, floor(lon / 0.5)::BIGINT + 360 AS x, floor(lat / 0.5)::BIGINT + 180 AS y FROM stations) SELECT id, list_sum(list_transform(range(0, 16), lambda k: (((x >> k) & 1) << (2 * k)) + (((y >> k) & 1) << (2 * k + 1))))::BIGINT AS z FROM c")
def spatial_layout(spark, d):
    return relational.clustered(t.stations(spark, d), 0.5).select("id", "z")


@register("excluded_dropped", f"WITH {t.STATIONS} SELECT id FROM stations WHERE id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def excluded_dropped(spark, d):
    out = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("id"))
    return t.stations(spark, d).join(out, "id", "left_anti").select("id")


@register("best_rail_count", "SELECT n_nationkey AS nation, coalesce(max(s_acctbal), 0.0) AS best FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 9000) s ON n_nationkey = s_nationkey GROUP BY 1")
def best_rail_count(spark, d):
    some = table(spark, d, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("nation"), "s_acctbal")
    return relational.best_or(table(spark, d, "nation").select(F.col("n_nationkey").alias("nation")), some, "nation", "s_acctbal", 0.0)


@register("box_counts", f"WITH {t.STATIONS} SELECT count(*) AS n, count(*) FILTER (lon BETWEEN 8 AND 12 AND lat BETWEEN 48 AND 51) AS n_inside, count(*) FILTER (NOT (lon BETWEEN 8 AND 12 AND lat BETWEEN 48 AND 51)) AS n_outside FROM stations")
def box_counts(spark, d):
    return relational.box_counts(t.stations(spark, d), (8, 48, 12, 51))


_TRUNKS = "trunks AS (SELECT o_custkey AS src, l_orderkey AS dst, l_linenumber AS vid, CASE WHEN l_linestatus = 'O' THEN l_linenumber + 1 END AS succ FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R'), whole AS (SELECT o_custkey AS src, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)"


@register(
    "trunk_totals",
    f"WITH {_TRUNKS}, e AS (SELECT src, dst, count(*) AS n, count(*) FILTER (succ IS NULL) AS ends FROM trunks GROUP BY 1, 2) SELECT count(*) AS n_trunks, sum(e.n)::BIGINT AS n_vertices, {t.rounded_sql('avg(e.n)', 6)} AS mean_vertices, {t.rounded_sql('avg(ends)', 6)} AS mean_ends, {t.rounded_sql('100.0::DOUBLE * sum(e.n) / sum(w.n)', 6)} AS kept_percent FROM e JOIN whole w USING (src)",
)
def trunk_totals(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("src")), "l_orderkey")
    kept = rows.where("l_returnflag <> 'R'").select("src", F.col("l_orderkey").alias("dst"), F.col("l_linenumber").alias("vid"), F.when(F.col("l_linestatus") == "O", F.col("l_linenumber") + 1).alias("succ"))
    found = chains.trunk_totals(kept, rows.groupBy("src").agg(F.count("*").alias("n")))
    return found.select("n_trunks", "n_vertices", *[t.rounded(c, 6).alias(c) for c in ("mean_vertices", "mean_ends", "kept_percent")])


@register("line_totals", f"WITH {t.LINES}, {t.STEPS}, k AS (SELECT pos, count(*) OVER (PARTITION BY line) AS n FROM steps) SELECT (SELECT count(*) FROM steps) AS n_before, (SELECT round(sum(step_m) / 1000, 1) FROM steps) AS km, count(*) AS n_after FROM k WHERE (pos - 1) % greatest(1, ceil(n / 4)) = 0 OR pos = n")
def line_totals(spark, d):
    lines = t.lines(spark, d)
    return ordered.totals(lines, "line", t.ORDER, ordered.strided(lines, "line", t.ORDER, 4)).select("n_before", F.round(F.col("metres") / 1000, 1).alias("km"), "n_after")


_LINKS = "links AS (SELECT DISTINCT o_custkey AS a, 1000000 + l_suppkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@register("largest_component", f"WITH RECURSIVE {_LINKS}, arcs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), r AS (SELECT DISTINCT a AS node, a AS root FROM arcs UNION SELECT arcs.b, r.root FROM r JOIN arcs ON r.node = arcs.a WHERE r.root < arcs.b), c AS (SELECT node, min(root) AS root FROM r GROUP BY 1) SELECT root, count(*) AS n FROM c GROUP BY 1 ORDER BY n DESC, root LIMIT 1")
def largest_component(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return graph.largest(graph.connected_components(li.select(F.col("o_custkey").alias("a"), (F.col("l_suppkey") + 1_000_000).alias("b")).distinct()))


@register("chord_lengths", f"WITH {t.STATIONS} SELECT id, {t.rounded_sql('6371000.0 * cos(radians(lat)) * cos(radians(lon))', 3)} AS x, {t.rounded_sql('6371000.0 * sin(radians(lat))', 3)} AS z, {t.rounded_sql('2 * 6371000.0 * sin(weight / 12742000.0)', 3)} AS chord FROM stations")
def chord_lengths(spark, d):
    s = t.stations(spark, d).withColumn("p", geo.unit_sphere("lon", "lat"))
    return s.select("id", t.rounded(F.col("p")["x"], 3).alias("x"), t.rounded(F.col("p")["z"], 3).alias("z"), t.rounded(geo.chord_m("weight"), 3).alias("chord"))


@register("bearing_differences", f"WITH {_ENDS} SELECT gid, {t.rounded_sql('abs((curv - grade + 540) % 360 - 180)', 4)} AS turn FROM ends")
def bearing_differences(spark, d):
    return _ends(spark, d).select("gid", t.rounded(geo.bearing_difference("grade", "curv"), 4).alias("turn"))


_K = "cos(radians(lat))"
_T = f"greatest(0.0, least(1.0, coalesce((((lon - x1) * {_K}) * ((x2 - x1) * {_K}) + (lat - y1) * (y2 - y1)) / nullif(pow((x2 - x1) * {_K}, 2) + pow(y2 - y1, 2), 0), 0.0)))"


@register("segment_distances", f"WITH {_ENDS}, {t.ANCHORS}, p AS (SELECT gid, lon, lat, x1, y1, x2, y2, {_T} AS f FROM ends JOIN anchors ON target = anchor) SELECT gid, {t.rounded_sql(f'111.0 * sqrt(pow((lon - x1) * {_K} - f * (x2 - x1) * {_K}, 2) + pow(lat - y1 - f * (y2 - y1), 2))', 4)} AS km FROM p")
def segment_distances(spark, d):
    rows = _ends(spark, d).join(t.anchors(spark, d).select(F.col("anchor").alias("target"), "lon", "lat"), "target")
    return rows.select("gid", t.rounded(geo.point_segment_km("lon", "lat", "x1", "y1", "x2", "y2"), 4).alias("km"))


@register("circle_points", f"WITH {t.ANCHORS} SELECT anchor, k::INT AS k, {t.rounded_sql('lon + 5000.0 / (111320.0 * cos(radians(lat))) * cos(k * (2 * 3.141592653589793::DOUBLE / 8))', 6)} AS lon, {t.rounded_sql('lat + 5000.0 / 111320.0 * sin(k * (2 * 3.141592653589793::DOUBLE / 8))', 6)} AS lat FROM anchors, range(8) g(k)")
def circle_points(spark, d):
    ring = t.anchors(spark, d).select("anchor", F.posexplode(geo.circle("lon", "lat", 5_000.0, 8)).alias("k", "p"))
    return ring.select("anchor", "k", t.rounded(F.col("p")["lon"], 6).alias("lon"), t.rounded(F.col("p")["lat"], 6).alias("lat"))


def _boxes(spark, d):
    box = F.struct(F.col("lon").alias("x0"), F.col("lat").alias("y0"), (F.col("lon") + 0.75).alias("x1"), (F.col("lat") + 0.6).alias("y1"))
    return t.anchors(spark, d).select("anchor", box.alias("box"))


@register("tile_grid", f"WITH {t.ANCHORS}, b AS (SELECT anchor, lon AS x0, lat AS y0, lon + 0.75 AS x1, lat + 0.6 AS y1, floor(lon / 0.25) * 0.25 AS xl, floor(lat / 0.25) * 0.25 AS yl FROM anchors), g AS (SELECT *, unnest(range(ceil((x1 - xl) / 0.25)::BIGINT)) AS i FROM b), h AS (SELECT *, unnest(range(ceil((y1 - yl) / 0.25)::BIGINT)) AS j FROM g) SELECT anchor, round(xl + i * 0.25, 6) AS x0, round(yl + j * 0.25, 6) AS y0 FROM h")
def tile_grid(spark, d):
    return _boxes(spark, d).select("anchor", F.explode(geo.tiles_of(F.col("box"), 0.25)).alias("x")).select("anchor", "x.x0", "x.y0")


@register("grown_boxes", f"WITH {t.ANCHORS} SELECT anchor, {t.rounded_sql('lon - 20000.0 / 111000.0 / cos(radians((lat + lat + 0.6) / 2))', 6)} AS x0, {t.rounded_sql('lat + 0.6 + 20000.0 / 111000.0', 6)} AS y1 FROM anchors")
def grown_boxes(spark, d):
    grown = _boxes(spark, d).select("anchor", geo.grown_box(F.col("box"), 20_000.0).alias("x"))
    return grown.select("anchor", t.rounded(F.col("x")["x0"], 6).alias("x0"), t.rounded(F.col("x")["y1"], 6).alias("y1"))


@register("metre_grid", f"WITH {t.ANCHORS} SELECT anchor, ceil(0.75 / (900.5 / 111320.0 / cos(radians((lat + lat + 0.6) / 2))))::BIGINT AS cols, ceil(0.6 / (900.5 / 111320.0))::BIGINT AS rows FROM anchors")
def metre_grid(spark, d):
    grid = _boxes(spark, d).select("anchor", geo.metre_grid(F.col("box"), 900.5).alias("g"))
    return grid.select("anchor", "g.cols", "g.rows")


@register("bilinear_samples", f"WITH {t.GRID}, p AS (SELECT DISTINCT (l_partkey * 7 % 600) * 1000 + l_suppkey * 11 % 500 AS id, (l_partkey * 7 % 600) / 10.0::DOUBLE AS lat, (l_suppkey * 11 % 500) / 10.0::DOUBLE AS lon FROM lineitem), q AS (SELECT id, floor(lat)::BIGINT AS r, floor(lon)::BIGINT AS c, lat - floor(lat) AS fr, lon - floor(lon) AS fc FROM p), g AS (SELECT * FROM grid WHERE value <> 7) SELECT id, {t.rounded_sql('a.value * ((1 - fr) * (1 - fc)) + b.value * ((1 - fr) * fc) + c.value * (fr * (1 - fc)) + e.value * (fr * fc)', 4)} AS sample FROM q LEFT JOIN g a ON a.row = r AND a.col = q.c LEFT JOIN g b ON b.row = r AND b.col = q.c + 1 LEFT JOIN g c ON c.row = r + 1 AND c.col = q.c LEFT JOIN g e ON e.row = r + 1 AND e.col = q.c + 1")
def bilinear_samples(spark, d):
    li = table(spark, d, "lineitem")
    y, x = F.pmod(F.col("l_partkey") * 7, F.lit(600)), F.pmod(F.col("l_suppkey") * 11, F.lit(500))
    at = li.select((y * 1000 + x).alias("id"), (y / 10.0).alias("lat"), (x / 10.0).alias("lon")).distinct()
    return raster.sample_bilinear(at, t.grid(spark, d), 1.0, "id", 7.0).select("id", t.rounded("sample", 4).alias("sample"))


_BAKED = "blur AS (SELECT row, col, sum(value) / 9 AS value FROM (SELECT row + dr AS row, col + dc AS col, value FROM grid, range(-1, 2) a(dr), range(-1, 2) b(dc)) GROUP BY 1, 2)"


@register(
    "signal_bake",
    f"WITH {t.GRID}, seg AS (SELECT o_orderkey AS edge, (o_orderkey * 3 % 50)::DOUBLE AS x1, (o_custkey * 7 % 60)::DOUBLE AS y1, (o_custkey * 11 % 50)::DOUBLE AS x2, (o_orderkey * 13 % 60)::DOUBLE AS y2 FROM orders), {_BAKED}, m AS (SELECT edge, floor((y1 + y2) / 2)::BIGINT AS row, floor((x1 + x2) / 2)::BIGINT AS col FROM seg) SELECT edge, coalesce(grid.value, 0.0) AS plain, {t.rounded_sql('coalesce(blur.value, 0.0)', 4)} AS near FROM m LEFT JOIN grid USING (row, col) LEFT JOIN blur USING (row, col)",
)
def signal_bake(spark, d):
    at = lambda c, m, k: F.pmod(F.col(c) * k, F.lit(m)).cast("double")
    seg = table(spark, d, "orders").select(F.col("o_orderkey").alias("edge"), at("o_orderkey", 50, 3).alias("x1"), at("o_custkey", 60, 7).alias("y1"), at("o_custkey", 50, 11).alias("x2"), at("o_orderkey", 60, 13).alias("y2"))
    registry = [signals.Signal("plain", "cover", "none", 0.0, "midpoint"), signals.Signal("near", "cover", "blur", 30.0, "midpoint")]
    return signals.bake(seg, {"cover": t.grid(spark, d)}, registry, 30.0, 1.0).select("edge", "plain", t.rounded("near", 4).alias("near"))


@register("mosaic_cells", "SELECT l_partkey % 90 AS row, l_suppkey % 70 AS col, max(l_quantity)::DOUBLE AS value FROM lineitem GROUP BY 1, 2")
def mosaic_cells(spark, d):
    li = table(spark, d, "lineitem")
    return raster.mosaic(li.select(F.pmod("l_linenumber", F.lit(3)).alias("tile"), F.pmod("l_partkey", F.lit(90)).alias("row"), F.pmod("l_suppkey", F.lit(70)).alias("col"), F.col("l_quantity").cast("double").alias("value")))


_RAIL = "rail AS (SELECT l_orderkey * 10 + l_linenumber AS way, CASE l_linenumber WHEN 1 THEN 'tram' WHEN 2 THEN 'light_rail' ELSE 'rail' END AS railway, CASE l_orderkey % 4 WHEN 0 THEN 'main' WHEN 1 THEN 'branch' WHEN 2 THEN 'industrial' END AS usage, CASE l_returnflag WHEN 'R' THEN 'siding' WHEN 'A' THEN 'express' END AS service, CASE WHEN l_suppkey % 5 = 0 THEN 'yes' END AS disused, CASE WHEN l_suppkey % 7 = 0 THEN 'yes' END AS abandoned, CASE WHEN l_partkey % 4 = 0 THEN 'rail' END AS construction FROM lineitem)"


@register("rail_ways", f"WITH {_RAIL} SELECT way FROM rail WHERE railway IN ('rail', 'light_rail') AND usage IN ('main', 'branch') AND coalesce(service, '') NOT IN ('spur', 'siding', 'yard', 'crossover') AND disused IS NULL AND abandoned IS NULL AND construction IS NULL")
def rail_ways(spark, d):
    li, mode, flag = table(spark, d, "lineitem"), F.pmod("l_orderkey", F.lit(4)), F.col("l_returnflag")
    tags = {
        "railway": F.when(F.col("l_linenumber") == 1, "tram").when(F.col("l_linenumber") == 2, "light_rail").otherwise("rail"),
        "usage": F.when(mode == 0, "main").when(mode == 1, "branch").when(mode == 2, "industrial"), "service": F.when(flag == "R", "siding").when(flag == "A", "express"),
        "disused": F.when(F.pmod("l_suppkey", F.lit(5)) == 0, "yes"), "abandoned": F.when(F.pmod("l_suppkey", F.lit(7)) == 0, "yes"), "construction": F.when(F.pmod("l_partkey", F.lit(4)) == 0, "rail"),
    }
    return files.rail_ways(li.withColumns(tags)).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("way"))


@register("rail_stops", "SELECT p_partkey AS id FROM part WHERE p_partkey % 4 < 3 AND NOT (p_size % 2 = 0 AND p_size % 3 <> 0)")
def rail_stops(spark, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("station", "halt", "stop", "signal")]), (F.pmod("p_partkey", F.lit(4)) + 1).cast("int"))
    tags = {"railway": kind, "bus": F.when(F.col("p_size") % 2 == 0, "yes"), "train": F.when(F.col("p_size") % 3 == 0, "yes")}
    return files.rail_stops(table(spark, d, "part").withColumns(tags)).select(F.col("p_partkey").alias("id"))


@register("open_waterways", "SELECT p_partkey AS id FROM part WHERE p_partkey % 4 < 3 AND p_size % 5 <> 0 AND (p_size % 4 = 0 OR (p_size % 4 <> 3 AND p_size % 3 <> 2)) AND p_size % 7 <> 0")
def open_waterways(spark, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("river", "canal", "stream", "ditch")]), (F.pmod("p_partkey", F.lit(4)) + 1).cast("int"))
    layer = F.when(F.col("p_size") % 4 == 0, None).when(F.col("p_size") % 4 == 3, "x").otherwise((1 - F.col("p_size") % 3).cast("string"))
    tags = {"waterway": kind, "tunnel": F.when(F.col("p_size") % 5 == 0, "culvert"), "layer": layer, "intermittent": F.when(F.col("p_size") % 7 == 0, "yes")}
    return files.waterways(table(spark, d, "part").withColumns(tags)).select(F.col("p_partkey").alias("id"))


@register("admin_areas", "SELECT p_partkey AS id FROM part WHERE p_partkey % 2 = 0 AND p_size % 10 IN (6, 7, 8)")
def admin_areas(spark, d):
    tags = {"boundary": F.when(F.pmod("p_partkey", F.lit(2)) == 0, "administrative").otherwise("postal"), "admin_level": (F.col("p_size") % 10).cast("string")}
    return files.boundaries(table(spark, d, "part").withColumns(tags)).select(F.col("p_partkey").alias("id"))


@register("village_features", f"WITH {t.STATIONS} SELECT id, (CASE WHEN id % 2 = 0 THEN 3 ELSE 2 END)::INT AS n_properties, 'node/' || id AS feature FROM stations WHERE kind = 'BUILDING'")
def village_features(spark, d):
    nodes = t.stations(spark, d).select("id", "name", F.when(F.col("kind") == "BUILDING", "village").otherwise("town").alias("place"), F.when(F.col("id") % 2 == 0, "99").otherwise("").alias("population"), F.lit("").alias("wikidata"), "lon", "lat")
    made = files.place_features(nodes)
    feature = F.get_json_object("value", "$.id")
    return made.select(F.split_part(feature, F.lit("/"), F.lit(2)).cast("long").alias("id"), F.size(F.json_object_keys(F.get_json_object("value", "$.properties"))).alias("n_properties"), feature.alias("feature"))


_AREAS = f"areas AS (SELECT anchor AS area, lon + 0.00123 - 0.3 - (anchor % 4) * 0.2 AS x0, lat + 0.00077 - 0.2 - (anchor % 3) * 0.2 AS y0, lon + 0.00123 + 0.3 + (anchor % 4) * 0.2 AS x1, lat + 0.00077 + 0.2 + (anchor % 3) * 0.2 AS y1 FROM anchors), held AS (SELECT id, kind, area, (x1 - x0) * (y1 - y0) / 2 AS size FROM stations JOIN areas ON lon > x0 AND lat > y0 AND (lon - x0) / (x1 - x0) + (lat - y0) / (y1 - y0) < 1)"


def _areas(spark, d):
    """A right triangle around each anchor, shifted by a little so that no station lies on a side."""
    w, h = 0.3 + F.pmod("anchor", F.lit(4)) * 0.2, 0.2 + F.pmod("anchor", F.lit(3)) * 0.2
    corner = lambda dx, dy: F.struct((F.col("lon") + 0.00123 + dx).alias("lon"), (F.col("lat") + 0.00077 + dy).alias("lat"))
    return t.anchors(spark, d).select(F.col("anchor").alias("area"), F.array(corner(-w, -h), corner(w, -h), corner(-w, h)).alias("ring"))


@register("smallest_polygon", f"WITH {t.STATIONS}, {t.ANCHORS}, {_AREAS} SELECT id, min_by(area, {{'s': round(size, 9), 'a': area}}) AS area FROM held GROUP BY 1")
def smallest_polygon(spark, d):
    return proximity.smallest_polygon(t.stations(spark, d), _areas(spark, d), "id", "area", 0.5)


@register("polygons_holding_all", f"WITH {t.STATIONS}, {t.ANCHORS}, {_AREAS}, g AS (SELECT id // 2 AS grp, id FROM stations), n AS (SELECT grp, count(*) AS n FROM g GROUP BY 1), m AS (SELECT grp, area, count(*) AS m FROM g JOIN held USING (id) GROUP BY 1, 2) SELECT grp, area FROM m JOIN n USING (grp) WHERE m = n")
def polygons_holding_all(spark, d):
    s = t.stations(spark, d).select(F.floor(F.col("id") / 2).alias("grp"), "id", "lon", "lat")
    return proximity.holding_all(s, _areas(spark, d), "grp", "id", "area", 0.5)


_SV = t.haversine_sql("s.lon", "s.lat", "a.lon", "a.lat")


@register("served_stations", f"WITH {t.STATIONS}, {t.ANCHORS}, ok AS (SELECT count(*) >= 100 AND sum(l_quantity) * 100 >= 500000 AS judged FROM lineitem) SELECT id FROM stations s, ok WHERE NOT judged OR EXISTS (SELECT 1 FROM anchors a WHERE {_SV} <= 40000)")
def served_stations(spark, d):
    lines = table(spark, d, "lineitem").select((F.col("l_quantity") * 100).alias("length"))
    return proximity.served_stations(t.stations(spark, d), t.anchors(spark, d), "id", 40_000, lines).select("id")


_AA = t.haversine_sql("a.lon", "a.lat", "b.lon", "b.lat")
_WAY = t.bearing_sql("a.lon", "a.lat", "b.lon", "b.lat")
_DISC = f"""pairs AS (SELECT a.anchor AS a, b.anchor AS b, {_AA} AS d, {_WAY} AS way FROM anchors a, anchors b WHERE a.anchor <> b.anchor),
 s AS (SELECT *, unnest(range(16)) AS sector FROM pairs WHERE d <= 90000),
 n AS (SELECT DISTINCT a, min_by(b, {{'d': d, 'b': b}}) AS b, min(d) AS d FROM s WHERE abs((sector * 22.5::DOUBLE - way + 540) % 360 - 180) <= 22.5 + degrees(asin(least(1.0, 5000 / greatest(d, 1.0)))) GROUP BY a, sector)"""


@register("disc_sector_neighbours", f"WITH {t.ANCHORS}, {_DISC} SELECT a, b, round(d, 1) AS dist_m FROM n")
def disc_sector_neighbours(spark, d):
    return proximity.disc_sector_neighbours(t.anchors(spark, d), "anchor", 90_000).select("a", "b", F.round("dist_m", 1).alias("dist_m"))


@register(
    "direct_chain",
    f"""WITH {t.ANCHORS}, {_DISC}, e AS (SELECT least(a, b) AS a, greatest(a, b) AS b, min(d) AS cost FROM n GROUP BY 1, 2),
 p AS (SELECT e.a, e.b, k, x.lon + (y.lon - x.lon) * k / 6 AS lon, x.lat + (y.lat - x.lat) * k / 6 AS lat FROM e JOIN anchors x ON e.a = x.anchor JOIN anchors y ON e.b = y.anchor, range(1, 6) g(k)),
 t AS (SELECT p.a, p.b, k, anchor AS c, row_number() OVER (PARTITION BY p.a, p.b, k ORDER BY {t.haversine_sql('p.lon', 'p.lat', 'q.lon', 'q.lat')}, anchor) AS r, {t.haversine_sql('p.lon', 'p.lat', 'q.lon', 'q.lat')} AS d FROM p JOIN anchors q ON abs(q.lat - p.lat) < 1),
 ind AS (SELECT DISTINCT t.a, t.b FROM t WHERE r = 1 AND t.d <= 20000 AND c <> t.a AND c <> t.b AND EXISTS (SELECT 1 FROM n WHERE n.a = t.a AND n.b = t.c) AND EXISTS (SELECT 1 FROM n WHERE n.a = t.b AND n.b = t.c)),
 kept AS (SELECT * FROM e ANTI JOIN ind USING (a, b)), gone AS (SELECT * FROM e SEMI JOIN ind USING (a, b)),
 ends AS (SELECT a AS anchor, a, b, cost FROM gone UNION ALL SELECT b, a, b, cost FROM gone), lonely AS (SELECT * FROM ends WHERE anchor NOT IN (SELECT a FROM kept UNION SELECT b FROM kept)),
 back AS (SELECT DISTINCT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY anchor ORDER BY cost, a, b) AS r FROM lonely) WHERE r = 1) SELECT a, b FROM kept UNION ALL SELECT a, b FROM back""",
)
def direct_chain(spark, d):
    at = t.anchors(spark, d)
    # read by the edges, their paths and both tests of neighbours
    near = materialize(proximity.disc_sector_neighbours(at, "anchor", 90_000), "chain-near")
    edges = proximity.canonical_pairs(near, "dist_m").withColumnRenamed("dist_m", "cost")
    ends = edges.join(at.select(F.col("anchor").alias("a"), F.col("lon").alias("x1"), F.col("lat").alias("y1")), "a").join(at.select(F.col("anchor").alias("b"), F.col("lon").alias("x2"), F.col("lat").alias("y2")), "b")
    k = ends.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(5))))
    paths = k.select("a", "b", (F.col("x1") + (F.col("x2") - F.col("x1")) * F.col("k") / 6).alias("lon"), (F.col("y1") + (F.col("y2") - F.col("y1")) * F.col("k") / 6).alias("lat"))
    return chains.drop_indirect(edges, paths, near, at, 20_000).select("a", "b")


_FERRY = "pairs AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_suppkey <> l_partkey), ferries AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_quantity > 45)"


@register("pier_pairs", f"WITH {_FERRY} SELECT a, b FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM ferries f WHERE (f.a = p.a AND f.b = p.b) OR (f.a = p.b AND f.b = p.a)) OR (a % 3 = 0 AND b % 3 = 0)")
def pier_pairs(spark, d):
    li = table(spark, d, "lineitem")
    pairs = li.where("l_suppkey <> l_partkey").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
    ferries = li.where("l_quantity > 45").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    piers = table(spark, d, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("anchor"))
    return chains.without_ferries(pairs, ferries, piers)


_NV = t.haversine_sql("v.lon", "v.lat", "a.lon", "a.lat")


@register("ferry_owners", f"WITH {t.VERTICES}, {t.ANCHORS}, owned AS (SELECT l_partkey AS vid, min_by(l_suppkey, {{'c': l_extendedprice, 's': l_suppkey}}) AS city FROM lineitem WHERE l_quantity > 40 GROUP BY 1), rest AS (SELECT id AS vid, lon, lat FROM vertices WHERE id NOT IN (SELECT vid FROM owned)), near AS (SELECT v.vid, anchor, row_number() OVER (PARTITION BY v.vid ORDER BY {_NV}, anchor) AS r FROM rest v, anchors a) SELECT vid, city FROM owned UNION ALL SELECT vid, anchor FROM near WHERE r = 1")
def ferry_owners(spark, d):
    trees = table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_suppkey").alias("city"), F.col("l_partkey").alias("vid"), F.col("l_extendedprice").alias("cost"))
    return chains.ferry_owners(t.vertices(spark, d).select(F.col("id").alias("vid"), "lon", "lat"), trees, t.anchors(spark, d))


@register(
    "ferry_city_edges",
    f"WITH {t.ANCHORS}, owned AS (SELECT l_partkey AS vid, min_by(l_suppkey, {{'c': l_extendedprice, 's': l_suppkey}}) AS city FROM lineitem GROUP BY 1), rides AS (SELECT o_custkey AS source, o_custkey + 13 AS target, CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE 1 END AS cost, CASE WHEN o_orderkey % 3 = 0 THEN 1e15 ELSE 1 END AS reverse_cost FROM orders), "
    f"ends AS (SELECT u.city AS a, v.city AS b, cost, reverse_cost, {t.rounded_sql('20000 + ' + t.haversine_sql('x.lon', 'x.lat', 'y.lon', 'y.lat'), 3)} AS far FROM rides JOIN owned u ON u.vid = source JOIN owned v ON v.vid = target JOIN anchors x ON x.anchor = u.city JOIN anchors y ON y.anchor = v.city WHERE u.city <> v.city) "
    "SELECT a, b, far AS cost FROM ends WHERE cost >= 0 AND cost < 1e14 UNION ALL SELECT b, a, far FROM ends WHERE reverse_cost >= 0 AND reverse_cost < 1e14",
)
def ferry_city_edges(spark, d):
    """A ferry for every order, its ends owned by the cities whose line items reach them at least cost."""
    trees = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("city"), F.col("l_partkey").alias("vid"), F.col("l_extendedprice").alias("cost"))
    owners = trees.groupBy("vid").agg(F.min(F.struct("cost", "city")).alias("x")).select("vid", F.col("x.city").alias("city"))
    k = F.col("o_orderkey")
    rides = table(spark, d, "orders").select(F.col("o_custkey").alias("source"), (F.col("o_custkey") + 13).alias("target"), F.when(k % 5 == 0, -1.0).otherwise(1.0).alias("cost"), F.when(k % 3 == 0, 1e15).otherwise(1.0).alias("reverse_cost"))
    found = chains.ferry_city_edges(rides, owners, t.anchors(spark, d))
    return found.select("a", "b", t.rounded(F.col("cost"), 3).alias("cost"))


@register("docked_piers")
def docked_piers(spark, d):
    return chains.dock_once(t.stations(spark, d).select(F.col("id").alias("pier"), "lon", "lat"), 60_000).select("pier")


@register("multi_stop_chain", "WITH l AS (SELECT o_custkey AS trip, o_orderkey AS leg, l_linenumber AS pos, min(l_suppkey) AS city FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3), w AS (SELECT *, lag(leg) OVER v AS pl, lag(city) OVER v AS pc FROM l WINDOW v AS (PARTITION BY trip ORDER BY leg, pos)) SELECT trip, (row_number() OVER (PARTITION BY trip ORDER BY leg, pos) - 1)::INT AS pos, city FROM w WHERE pl IS NULL OR NOT (pl <> leg AND pc = city)")
def multi_stop_chain(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("trip")), "l_orderkey")
    legs = li.groupBy("trip", F.col("l_orderkey").alias("leg"), F.col("l_linenumber").alias("pos")).agg(F.min("l_suppkey").alias("city"))
    return chains.joined_legs(legs)


@register("cluster_summary", "WITH s AS (SELECT o_orderkey AS stop, o_custkey AS cluster FROM orders), r AS (SELECT DISTINCT l_orderkey AS stop, l_returnflag || l_linestatus AS route FROM lineitem) SELECT s.cluster, min(s.stop) AS gtfs_id, count(DISTINCT s.stop) AS n_members, string_agg(DISTINCT route, ',' ORDER BY route) AS routes FROM s LEFT JOIN r USING (stop) GROUP BY 1")
def cluster_summary(spark, d):
    routes = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("stop")).agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("routes"))
    stops = table(spark, d, "orders").select(F.col("o_orderkey").alias("stop")).join(routes, "stop", "left")
    found = chains.cluster_summary(table(spark, d, "orders").select(F.col("o_orderkey").alias("stop"), F.col("o_custkey").alias("cluster")), stops)
    return found.select("cluster", "gtfs_id", "n_members", F.when(F.size("routes") > 0, F.array_join("routes", ",")).alias("routes"))


@register("lazy_reach", f"WITH RECURSIVE {t.CITY_ARCS}, r AS (SELECT 3::BIGINT AS city, 0 AS step UNION SELECT dst, step + 1 FROM r JOIN arcs ON city = src WHERE step < 25) SELECT city, min(step)::INT AS step FROM r GROUP BY 1")
def lazy_reach(spark, d):
    arcs = t.city_arcs(spark, d).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return chains.lazy_reach(spark.createDataFrame([(3,)], "city long"), arcs)


@register("bracketed_paths", "WITH w AS (SELECT DISTINCT o_custkey AS src, l_orderkey AS dst, l_linenumber AS pos, 100 + l_linenumber AS vid FROM lineitem JOIN orders ON l_orderkey = o_orderkey), m AS (SELECT src, dst, min(pos) AS low, max(pos) AS high FROM w GROUP BY 1, 2), a AS (SELECT * FROM w UNION ALL SELECT src, dst, low - 1, -2 - src FROM m UNION ALL SELECT src, dst, high + 1, -2 - dst FROM m) SELECT src, dst, vid, lead(vid) OVER (PARTITION BY src, dst ORDER BY pos) AS succ FROM a")
def bracketed_paths(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    n = parts_for(spark, li.count())
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("src")).repartition(n, "l_orderkey").distinct()
    walks = li.repartition(n, "l_orderkey").distinct().join(o, "l_orderkey")
    return chains.bracketed_path(walks.select("src", F.col("l_orderkey").alias("dst"), F.col("l_linenumber").cast("long").alias("pos"), (F.col("l_linenumber") + 100).cast("long").alias("vid")))


@register("tree_progress", "SELECT s_suppkey AS city, s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50) AS done FROM supplier")
def tree_progress(spark, d):
    done = table(spark, d, "lineitem").where("l_quantity = 50").select(F.col("l_suppkey").alias("city"))
    return relational.progress(table(spark, d, "supplier").select(F.col("s_suppkey").alias("city")), done, "city")


@register("open_tiles", "SELECT DISTINCT l_partkey % 40 AS tile FROM lineitem WHERE l_partkey % 40 NOT IN (SELECT l_partkey % 40 FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.1)")
def open_tiles(spark, d):
    li = table(spark, d, "lineitem").withColumn("tile", F.pmod("l_partkey", F.lit(40)))
    done = li.where("l_quantity = 50 AND l_discount = 0.1").select("tile")
    return relational.progress(li.select("tile").distinct(), done, "tile").where("NOT done").select("tile")


@register("shortened_values", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '…' ELSE text END AS text, least(20, len(string_split(text, ' ')))::INT AS n FROM documents")
def shortened_values(spark, d):
    return table(spark, d, "documents").select("doc_id", text.truncated(F.col("text")).alias("text"), F.when(F.col("text").isNotNull(), F.size(text.shortened(F.split("text", " ", -1)))).alias("n"))


@register("scope_words", "SELECT conv_id, turn, contains(lower(text), 'ent') AS scoped, coalesce(array_to_string(list_distinct_kept, ','), '') AS words FROM (SELECT conv_id, turn, text, list_filter(regexp_extract_all(lower(text), '\\b(the|of|and|de)\\b', 1), lambda x, i: list_position(regexp_extract_all(lower(text), '\\b(the|of|and|de)\\b', 1), x) = i) AS list_distinct_kept FROM conversations)")
def scope_words(spark, d):
    words = text.mentioned(F.col("text"), ["the", "of", "and", "de"])
    return table(spark, d, "conversations").select("conv_id", "turn", text.in_scope(F.col("text"), ["ent"]).alias("scoped"), F.coalesce(F.array_join(words, ","), F.lit("")).alias("words"))


@register("renumbered_days", "SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN 'Day ' || (o_custkey % 9) || E'\\n| ' || (o_custkey % 30) || ' | 12 |' ELSE 'Day ' || CASE WHEN o_custkey % 9 BETWEEN 1 AND 8 THEN o_custkey % 9 + o_custkey % 4 ELSE o_custkey % 9 END || E'\\n| ' || CASE WHEN o_custkey % 30 BETWEEN 1 AND 8 THEN o_custkey % 30 + o_custkey % 4 ELSE o_custkey % 30 END || ' | 12 |' END AS plan FROM orders")
def renumbered_days(spark, d):
    key = F.col("o_custkey")
    plan = F.concat(F.lit("Day "), F.pmod(key, F.lit(9)).cast("string"), F.lit("\n| "), F.pmod(key, F.lit(30)).cast("string"), F.lit(" | 12 |"))
    return table(spark, d, "orders").select("o_orderkey", text.days_moved(plan, F.pmod(key, F.lit(4)).cast("int"), F.lit(3)).alias("plan"))


@register("output_digests", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'error: no' WHEN 1 THEN (o_custkey % 3) || ' hits' WHEN 2 THEN o_custkey || ' km, 2 stops' ELSE 'ok' END AS digest FROM orders")
def output_digests(spark, d):
    kind, n = F.pmod("o_orderkey", F.lit(4)), F.pmod("o_custkey", F.lit(3)).cast("int")
    tool = F.when(kind == 1, "search_anchors").when(kind == 2, "route").otherwise("other")
    hits = F.to_json(F.struct(F.array_repeat(F.lit("x"), n).alias("results")))
    out = F.when(kind == 0, '{"error": "no"}').when(kind == 1, hits).when(kind == 2, F.concat(F.lit('{"total_km": '), F.col("o_custkey").cast("string"), F.lit(', "chain_stops": [1, 2]}'))).otherwise("{}")
    return table(spark, d, "orders").select("o_orderkey", text.output_digest(tool, out).alias("digest"))


@register("parsed_points", "SELECT o_orderkey, (o_custkey / 10.0)::DOUBLE AS lon, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey / 4.0)::DOUBLE END AS lat FROM orders")
def parsed_points(spark, d):
    shown = F.concat((F.col("o_custkey") / 10.0).cast("string"), F.lit(","), F.when(F.pmod("o_orderkey", F.lit(3)) == 0, "north").otherwise((F.col("o_orderkey") / 4.0).cast("string")))
    lon, lat = text.lon_lat(shown)
    return table(spark, d, "orders").select("o_orderkey", lon.alias("lon"), lat.alias("lat"))


@register(
    "via_stages",
    f"""WITH {t.LINES}, {t.STEPS}, v AS (SELECT c_custkey AS line, {t.lon_sql('c_custkey')} AS vx, {t.lat_sql('c_custkey')} AS vy FROM customer),
 n AS (SELECT line, max(pos) AS n FROM cums GROUP BY 1), near AS (SELECT c.line, c.pos, row_number() OVER (PARTITION BY c.line ORDER BY {t.haversine_sql('vx', 'vy', 'lon', 'lat')}, c.pos) AS r FROM cums c JOIN v USING (line)),
 b AS (SELECT line, 1 AS pos FROM n UNION SELECT line, pos FROM near WHERE r = 1 UNION SELECT line, n FROM n),
 p AS (SELECT line, lag(cum_m) OVER w AS a, cum_m AS z, pos AS zpos, lag(pos) OVER w AS apos FROM b JOIN cums USING (line, pos) WINDOW w AS (PARTITION BY line ORDER BY pos)),
 dd AS (SELECT *, greatest(1, CAST(round_even((z - a) / 1000 / 900, 0) AS BIGINT)) AS days FROM p WHERE a IS NOT NULL),
 cuts AS (SELECT line, zpos, i, a + (z - a) * i / days AS cut_m FROM (SELECT *, unnest(range(1, days)) AS i FROM dd)),
 one AS (SELECT line, pos FROM (SELECT c.line, pos, row_number() OVER (PARTITION BY c.line, zpos, i ORDER BY abs(cum_m - cut_m), pos DESC) AS r FROM cuts c JOIN cums USING (line)) WHERE r = 1 AND pos > 1),
 stops AS (SELECT line, pos FROM one UNION SELECT line, zpos FROM dd)
 SELECT line, (row_number() OVER x)::INT AS stage, pos::INT AS pos, round((cum_m - coalesce(lag(cum_m) OVER x, 0.0)) / 1000, 1) AS stage_km FROM stops JOIN cums USING (line, pos) WINDOW x AS (PARTITION BY line ORDER BY pos)""",
)
def via_stages(spark, d):
    vias = table(spark, d, "customer").select(F.col("c_custkey").alias("line"), F.lit(0).alias("k"), t.lon_of("c_custkey").alias("lon"), t.lat_of("c_custkey").alias("lat"))
    return ordered.stage_ends(t.lines(spark, d), "line", t.ORDER, 900.0, vias)
