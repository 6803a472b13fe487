"""Graph queries: components, paths, redundancy, trees and trunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import graph, proximity, trees
from terrane.plans import tables as t
from terrane.plans.catalog import register
from terrane.session import table

_PAIRS = f"pairs AS (SELECT a.id AS a, b.id AS b FROM stations a JOIN stations b ON a.id < b.id AND {t.haversine_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 9000)"


def _clusters(spark, d):
    return proximity.clusters_within(t.stations(spark, d), "id", 9_000)


@register(
    "components",
    f"WITH RECURSIVE {t.STATIONS}, {_PAIRS}, arcs AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), r AS (SELECT DISTINCT a AS node, a AS root FROM arcs UNION SELECT arcs.b, r.root FROM r JOIN arcs ON r.node = arcs.a WHERE r.root < arcs.b) SELECT node, min(root) AS root FROM r GROUP BY 1",
)
def components(spark, d):
    return _clusters(spark, d)


@register("component_sizes", f"WITH RECURSIVE {t.STATIONS}, {_PAIRS}, arcs AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), r AS (SELECT DISTINCT a AS node, a AS root FROM arcs UNION SELECT arcs.b, r.root FROM r JOIN arcs ON r.node = arcs.a WHERE r.root < arcs.b), c AS (SELECT node, min(root) AS root FROM r GROUP BY 1) SELECT root, count(*) AS n, round(sum(weight), 2) AS total, max(weight) AS top, max(weight) >= 5000 AS is_sea FROM c JOIN stations ON node = id GROUP BY 1")
def component_sizes(spark, d):
    c = _clusters(spark, d)
    return c.hint("merge").join(t.stations(spark, d).select(F.col("id").alias("node"), "weight"), "node").groupBy("root").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 2).alias("total"), F.max("weight").alias("top")).withColumn("is_sea", F.col("top") >= 5000)


@register("rail_closure", f"WITH RECURSIVE {t.CITY_ARCS}, r AS (SELECT 0::BIGINT AS node UNION SELECT dst FROM r JOIN arcs ON node = src) SELECT node FROM r")
def rail_closure(spark, d):
    return graph.closure(spark.createDataFrame([(0,)], "node long"), t.city_arcs(spark, d))


@register("flood_fill", "WITH RECURSIVE w AS (SELECT l_orderkey AS way, l_suppkey AS vertex, l_returnflag || l_linestatus || (l_orderkey % 9) AS name FROM lineitem), arcs AS (SELECT DISTINCT x.way AS s, y.way AS d FROM w x JOIN w y ON x.vertex = y.vertex AND x.name = y.name), r AS (SELECT DISTINCT way FROM w WHERE way <= 3 UNION SELECT d FROM r JOIN arcs ON way = s) SELECT way FROM r")
def flood_fill(spark, d):
    name = F.concat("l_returnflag", "l_linestatus", F.pmod("l_orderkey", F.lit(9)).cast("string"))
    w = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("way"), F.col("l_suppkey").alias("vertex"), name.alias("name"))
    return graph.flood_fill(w, w.where("way <= 3").select("way").distinct())


_HOPS = f"""WITH RECURSIVE {t.CITY_ARCS}, p AS (SELECT s AS node, s AS label, 0.0::DOUBLE AS dist, 0 AS hops FROM (VALUES (0::BIGINT), (7::BIGINT), (12::BIGINT)) v(s)
 UNION SELECT dst, label, min(dist + cost), hops + 1 FROM p JOIN arcs ON node = src WHERE hops < 8 GROUP BY dst, label, hops + 1)"""


@register("voronoi_labels", f"{_HOPS} SELECT node, min(dist) AS dist, arg_min(label, (dist, label)) AS label FROM p GROUP BY node")
def voronoi_labels(spark, d):
    seeds = spark.createDataFrame([(0, 0), (7, 7), (12, 12)], "node long, label long")
    return graph.shortest_paths(seeds, t.city_arcs(spark, d)).select("node", "dist", "label")


@register("chain_edges", f"{_HOPS}, best AS (SELECT node, min(dist) AS dist, arg_min(label, (dist, label)) AS label FROM p GROUP BY node) SELECT least(u.label, v.label) AS a, greatest(u.label, v.label) AS b, min(u.dist + cost + v.dist) AS cost FROM arcs JOIN best u ON src = u.node JOIN best v ON dst = v.node WHERE u.label <> v.label GROUP BY 1, 2")
def chain_edges(spark, d):
    seeds = spark.createDataFrame([(0, 0), (7, 7), (12, 12)], "node long, label long")
    arcs = t.city_arcs(spark, d)
    return graph.boundary_edges(graph.shortest_paths(seeds, arcs), arcs)


@register("city_route", f"WITH RECURSIVE {t.CITY_ARCS}, p AS (SELECT 0::BIGINT AS node, 0.0::DOUBLE AS dist, 0 AS hops UNION SELECT dst, min(dist + cost), hops + 1 FROM p JOIN arcs ON node = src WHERE hops < 10 GROUP BY dst, hops + 1) SELECT node, min(dist) AS dist FROM p GROUP BY 1")
def city_route(spark, d):
    return graph.shortest_paths(spark.createDataFrame([(0, 0)], "node long, label long"), t.city_arcs(spark, d)).select("node", "dist")


_UND = f"{t.CITY_ARCS}, edges AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(cost) AS cost FROM arcs GROUP BY 1, 2)"


def _undirected(spark, d):
    return proximity.canonical_pairs(t.city_arcs(spark, d).select(F.col("src").alias("a"), F.col("dst").alias("b"), "cost"), "cost")


@register("pair_argmin", f"WITH {_UND} SELECT a, b, cost FROM edges")
def pair_argmin(spark, d):
    return _undirected(spark, d)


@register("triangle_dedup", f"WITH {_UND}, two AS (SELECT a, b, cost FROM edges UNION ALL SELECT b, a, cost FROM edges) SELECT a, b, cost FROM edges e WHERE NOT EXISTS (SELECT 1 FROM two x JOIN two y ON x.b = y.a WHERE x.a = e.a AND y.b = e.b AND x.cost + y.cost <= 1.1::DOUBLE * e.cost)")
def triangle_dedup(spark, d):
    return graph.drop_triangles(_undirected(spark, d))


@register("orphan_anchors", f"WITH {t.ANCHORS}, {_UND} SELECT anchor FROM anchors WHERE anchor NOT IN (SELECT a FROM edges UNION SELECT b FROM edges)")
def orphan_anchors(spark, d):
    return graph.orphans(t.anchors(spark, d), _undirected(spark, d), "anchor").select("anchor")


@register("walk_to_root", "WITH RECURSIVE p AS (SELECT c_custkey AS node, CASE WHEN c_custkey % 40 = 0 THEN NULL ELSE c_custkey - 1 - (c_custkey % 40) // 3 END AS parent FROM customer), r AS (SELECT node, node AS cur, 0 AS steps FROM p UNION ALL SELECT r.node, p.parent, steps + 1 FROM r JOIN p ON r.cur = p.node WHERE p.parent IS NOT NULL) SELECT node, arg_max(cur, steps) AS root, max(steps)::INT AS steps FROM r GROUP BY 1")
def walk_to_root(spark, d):
    k = F.col("c_custkey")
    parent = F.when(F.pmod(k, F.lit(40)) != 0, k - 1 - F.floor(F.pmod(k, F.lit(40)) / 3))
    return graph.walk_to_root(table(spark, d, "customer").select(k.alias("node"), parent.alias("parent")))


@register("leaf_nodes", "SELECT c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT c_custkey + 1 + c_custkey % 3 FROM customer)")
def leaf_nodes(spark, d):
    k = F.col("c_custkey")
    return graph.leaf_chains(table(spark, d, "customer").select(k.alias("node"), (k + 1 + F.pmod(k, F.lit(3))).alias("succ"))).select("node")


@register("adjacency", f"WITH {t.EDGES} SELECT src, count(*) AS n, sum(cost) AS cost FROM (SELECT source AS src, length AS cost FROM edges UNION ALL SELECT target, CASE WHEN oneway THEN -1 ELSE length END FROM edges) WHERE cost >= 0 GROUP BY 1")
def adjacency(spark, d):
    e = t.edges(spark, d).select("source", "target", F.col("length").alias("cost"), F.when(F.col("oneway"), -1.0).otherwise(F.col("length")).alias("reverse_cost"))
    return graph.both_ways(e).groupBy("src").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))


#: Vertices that a city's polygon reaches from its seed, along the lattice's rows and columns.
_REACH = 12


def seeds_of(spark, d):
    """(city, vid): every supplier's place on the lattice; the next one's lies some twenty vertices on."""
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("city"), (F.col("s_suppkey") * 20 + 10).alias("vid")).hint("merge").join(table(spark, d, "part").select(F.col("p_partkey").alias("vid")), "vid").select("city", "vid")


def trees_of(spark, d):
    """Trees of all cities, each inside the square of vertices around its seed."""
    p = table(spark, d, "part")
    wide = p.agg(F.ceil(F.sqrt(F.count("*").cast("double"))).alias("wide"))
    near = F.sequence(F.lit(-_REACH), F.lit(_REACH))
    x, y = F.pmod("vid", "wide"), F.floor(F.col("vid") / F.col("wide"))
    around = seeds_of(spark, d).join(F.broadcast(wide)).select("city", "wide", x.alias("x"), y.alias("y"), F.explode(near).alias("dx"))
    around = around.withColumn("dy", F.explode(near)).withColumns({"x": F.col("x") + F.col("dx"), "y": F.col("y") + F.col("dy")}).where("x >= 0 AND x < wide AND y >= 0")
    members = around.select("city", (F.col("y") * F.col("wide") + F.col("x")).alias("vid")).hint("merge").join(p.select(F.col("p_partkey").alias("vid")), "vid").select("city", "vid")
    return trees.bounded_trees(members, seeds_of(spark, d), t.lattice(spark, d)[1])


def pairs_of(spark, d):
    """(src, dst): neighbouring cities, both ways."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    near = s.hint("merge").join(s.select((F.col("k") - 1).alias("k"), F.col("k").alias("other")), "k")
    return near.select(F.col("k").alias("src"), F.col("other").alias("dst")).unionByName(near.select(F.col("other").alias("src"), F.col("k").alias("dst")))


def trunks_of(spark, d):
    from terrane.session import materialize

    grown, pairs = materialize(trees_of(spark, d), "trees"), materialize(pairs_of(spark, d), "pairs")
    built = materialize(trees.build_trunks(grown, pairs), "trunks")
    return built.unionByName(trees.direct_trunks(pairs, built))


_TREES = f"""{t.LATTICE}, seeds AS (SELECT s_suppkey AS city, s_suppkey * 20 + 10 AS vid FROM supplier WHERE s_suppkey * 20 + 10 IN (SELECT p_partkey FROM part)),
members AS MATERIALIZED (SELECT city, p_partkey AS vid FROM seeds, wide, part WHERE abs(p_partkey % wide - vid % wide) <= {_REACH} AND abs(p_partkey // wide - vid // wide) <= {_REACH}),
own AS MATERIALIZED (SELECT m.city, src, dst, cost FROM arcs JOIN members m ON m.vid = src JOIN members n ON n.city = m.city AND n.vid = dst),
walk AS (SELECT city, vid, 0.0::DOUBLE AS dist, 0 AS hops FROM seeds UNION ALL SELECT walk.city, dst, min(dist + cost), hops + 1 FROM walk JOIN own ON own.city = walk.city AND src = vid WHERE hops < 100 GROUP BY walk.city, dst, hops + 1),
best AS MATERIALIZED (SELECT city, vid, min(dist) AS cost FROM walk GROUP BY 1, 2),
trees AS MATERIALIZED (SELECT b.city, b.vid, min(u.vid) AS parent, b.cost, coalesce(bool_or(x.out), false) AS is_frontier FROM best b LEFT JOIN own ON own.city = b.city AND own.dst = b.vid LEFT JOIN best u ON u.city = b.city AND u.vid = own.src AND u.cost + own.cost = b.cost
 LEFT JOIN (SELECT m.city, m.vid, true AS out FROM members m JOIN arcs ON src = m.vid LEFT JOIN members n ON n.city = m.city AND n.vid = dst WHERE n.vid IS NULL GROUP BY 1, 2) x ON x.city = b.city AND x.vid = b.vid GROUP BY b.city, b.vid, b.cost)"""
_TRUNKS = f"""{_TREES}, pairs AS (SELECT a.s_suppkey AS src, b.s_suppkey AS dst FROM supplier a JOIN supplier b ON abs(a.s_suppkey - b.s_suppkey) = 1),
held AS MATERIALIZED (SELECT src, dst, a.vid, a.parent, a.is_frontier, b.vid IS NOT NULL AS in_b FROM pairs JOIN trees a ON a.city = src LEFT JOIN trees b ON b.city = dst AND b.vid = a.vid),
climb AS (SELECT src, dst, vid FROM held WHERE NOT in_b AND is_frontier UNION SELECT h.src, h.dst, h.parent FROM climb c JOIN held h ON h.src = c.src AND h.dst = c.dst AND h.vid = c.vid WHERE h.parent IS NOT NULL),
kept AS MATERIALIZED (SELECT src, dst, vid, parent FROM held JOIN climb USING (src, dst, vid) WHERE NOT in_b
 UNION SELECT h.src, h.dst, h.vid, h.parent FROM held h JOIN held c ON c.src = h.src AND c.dst = h.dst AND c.parent = h.vid WHERE h.in_b AND NOT c.in_b),
trunks AS MATERIALIZED (SELECT k.src, k.dst, k.vid, o.vid AS succ FROM kept k LEFT JOIN kept o ON o.src = k.src AND o.dst = k.dst AND o.vid = k.parent
 UNION ALL SELECT src, dst, unnest([-2 - src, -2 - dst]), unnest([-2 - dst, NULL]) FROM pairs ANTI JOIN kept USING (src, dst))"""


@register("spt_trees", f"WITH RECURSIVE {_TREES} SELECT city, vid, parent, cost, is_frontier FROM trees")
def spt_trees(spark, d):
    return trees_of(spark, d)


@register("trunk_build", f"WITH RECURSIVE {_TRUNKS} SELECT src, dst, vid, succ FROM trunks")
def trunk_build(spark, d):
    return trunks_of(spark, d)


@register("trunk_prune")
def trunk_prune(spark, d):
    return trees.prune_trunks(trunks_of(spark, d), spark.createDataFrame([(0,)], "city long"))


@register("trunk_walk", f"WITH RECURSIVE {_TRUNKS}, steps AS (SELECT src, dst, 0::BIGINT AS pos, max(vid) AS vid FROM trunks GROUP BY 1, 2 UNION ALL SELECT s.src, s.dst, pos + 1, succ FROM steps s JOIN trunks t ON t.src = s.src AND t.dst = s.dst AND t.vid = s.vid WHERE succ IS NOT NULL) SELECT src, dst, pos, vid FROM steps")
def trunk_walk(spark, d):
    from terrane.session import materialize

    tr = materialize(trunks_of(spark, d), "trunks")
    return trees.walk(tr, tr.groupBy("src", "dst").agg(F.max("vid").alias("vid")))


@register("corridor_overlap", f"WITH RECURSIVE {_TREES} SELECT a.city AS a, b.city AS b, a.vid, a.cost AS cost_a, b.cost AS cost_b FROM trees a JOIN trees b ON b.city = a.city + 1 AND b.vid = a.vid")
def corridor_overlap(spark, d):
    """The vertices that a city's tree shares with the next one's, with both costs."""
    from terrane.session import materialize

    g = materialize(trees_of(spark, d), "trees")
    a = g.select(F.col("city").alias("a"), "vid", F.col("cost").alias("cost_a"))
    b = g.select((F.col("city") - 1).alias("a"), F.col("city").alias("b"), "vid", F.col("cost").alias("cost_b"))
    return a.join(b, ["a", "vid"]).select("a", "b", "vid", "cost_a", "cost_b")


@register("hull_polygons")
def hull_polygons(spark, d):
    return trees.convex_hulls(t.anchors(spark, d).select("nation", "lon", "lat"), "nation")


@register("chain_polygons")
def chain_polygons(spark, d):
    """Every city's polygon over the chain of its neighbours in number; every seventh is a pier."""
    a = t.anchors(spark, d).select("anchor", "lon", "lat", (F.col("anchor") % 7 == 0).alias("is_pier"))
    ahead = a.select((F.col("anchor") - 1).alias("anchor"), F.col("anchor").alias("b"), F.col("lon").alias("x2"), F.col("lat").alias("y2"))
    step = lambda k: F.struct((F.col("lon") + (F.col("x2") - F.col("lon")) * k / 4).alias("lon"), (F.col("lat") + (F.col("y2") - F.col("lat")) * k / 4).alias("lat"))
    lines = a.join(ahead, "anchor").select(F.col("anchor").alias("a"), "b", F.array(*[step(k) for k in range(5)]).alias("path"))
    return trees.chain_polygons(a, lines)


@register("multi_hop_redundancy")
def multi_hop_redundancy(spark, d):
    return trees.drop_detours(_undirected(spark, d))


@register("pier_absorb", f"WITH {t.ANCHORS}, {t.STATIONS}, p AS (SELECT anchor AS pier, s.id, s.name, s.weight FROM anchors a JOIN stations s ON {t.haversine_sql('a.lon', 'a.lat', 's.lon', 's.lat')} <= 15000) SELECT anchor AS pier, x.name AS place_name FROM anchors LEFT JOIN (SELECT pier, name, row_number() OVER (PARTITION BY pier ORDER BY weight DESC, id) AS r FROM p) x ON anchor = pier AND r = 1")
def pier_absorb(spark, d):
    a, s = t.anchors(spark, d), t.stations(spark, d)
    places = s.select(F.col("id").alias("place"), "name", F.col("weight").alias("population"), "lon", "lat")
    return trees.absorb_within(a.select(F.col("anchor").alias("pier"), "lon", "lat"), places, 15_000).select("pier", "place_name")
