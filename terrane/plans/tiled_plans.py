"""Shortest paths on a road-like lattice over all parts: tiles, overlays, vias and path geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import tiled
from terrane.plans import tables as t
from terrane.plans.catalog import register
from terrane.session import release, table

#: Arcs that the SQL follows at most; shortest paths of the lattice have far fewer.
_HOPS = "(SELECT 4 * wide FROM wide)"


def _network(spark, d):
    return tiled.network(*t.lattice(spark, d), size_deg=t.LATTICE_TILE)


def _sources(spark, d):
    """A source for every supplier: the part of a number that its own gives."""
    s, n = table(spark, d, "supplier"), table(spark, d, "part").agg(F.count("*").alias("n"))
    return s.join(F.broadcast(n)).select(F.lit(0).cast("long").alias("search"), F.pmod(F.col("s_suppkey") * 7919 + 3, F.col("n")).alias("node"), F.col("s_suppkey").alias("label"))


_LABELS = f"""{t.LATTICE}, seeds AS (SELECT (s_suppkey * 7919 + 3) % (SELECT count(*) FROM part) AS node, min(s_suppkey) AS label FROM supplier GROUP BY 1),
walk AS (SELECT node, {{'d': 0.0::DOUBLE, 'l': label}} AS k, 0::BIGINT AS hops FROM seeds
 UNION ALL SELECT dst, min({{'d': k.d + cost, 'l': k.l}}), hops + 1 FROM walk JOIN arcs ON node = src WHERE hops < {_HOPS} GROUP BY dst, hops + 1),
best AS MATERIALIZED (SELECT node, m.d AS dist, m.l AS label, m.h AS hops FROM (SELECT node, min({{'d': k.d, 'l': k.l, 'h': hops}}) AS m FROM walk GROUP BY node))"""


@register("lattice_labels", f"WITH RECURSIVE {_LABELS} SELECT node, label, dist, hops FROM best")
def lattice_labels(spark, d):
    return tiled.tiled_paths(_sources(spark, d), _network(spark, d)).select("node", "label", "dist", "hops")


@register("lattice_chain_edges", f"WITH RECURSIVE {_LABELS} SELECT least(u.label, v.label) AS a, greatest(u.label, v.label) AS b, min(u.dist + cost + v.dist) AS cost FROM arcs JOIN best u ON src = u.node JOIN best v ON dst = v.node WHERE u.label <> v.label GROUP BY 1, 2")
def lattice_chain_edges(spark, d):
    net = _network(spark, d)
    return tiled.boundary_edges(tiled.tiled_paths(_sources(spark, d), net), net)


@register(
    "lattice_paths",
    f"""WITH RECURSIVE {_LABELS}, up AS (SELECT v.node, min(u.node) AS parent FROM best v JOIN arcs ON dst = v.node JOIN best u ON u.node = src AND u.dist + cost = v.dist AND u.label = v.label AND u.hops + 1 = v.hops GROUP BY v.node),
 path AS (SELECT node AS target, hops AS pos, node AS vid FROM best UNION ALL SELECT target, pos - 1, parent FROM path JOIN up ON vid = up.node WHERE pos > 0) SELECT target, pos, vid FROM path""",
)
def lattice_paths(spark, d):
    """The path of every vertex from the source that is nearest to it."""
    trees = tiled.tiled_paths(_sources(spark, d), _network(spark, d))
    return tiled.tree_paths(trees.select("search", F.col("node").alias("target")), trees).select("target", "pos", "vid")


def _stops(spark, d):
    """Three stops for every nation's trip."""
    n = table(spark, d, "part").agg(F.count("*").alias("n"))
    trip = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("trip")).join(F.broadcast(n))
    at = lambda seq, k, c: F.struct(F.lit(seq).alias("seq"), F.pmod(F.col("trip") * k + c, F.col("n")).alias("vid"))
    return trip.select("trip", F.explode(F.array(at(1, 7919, 5), at(2, 104_729, 77), at(3, 1_299_709, 11))).alias("x")).select("trip", "x.seq", "x.vid")


_LEGS = f"""{t.LATTICE}, n AS (SELECT count(*) AS n FROM part), trips AS (SELECT n_nationkey::BIGINT AS trip FROM nation),
stops AS (SELECT trip, 1 AS seq, (trip * 7919 + 5) % n AS vid FROM trips, n UNION ALL SELECT trip, 2, (trip * 104729 + 77) % n FROM trips, n UNION ALL SELECT trip, 3, (trip * 1299709 + 11) % n FROM trips, n),
legs AS (SELECT trip, seq::BIGINT AS leg, vid AS src, lead(vid) OVER (PARTITION BY trip ORDER BY seq) AS dst FROM stops),
walk AS (SELECT DISTINCT src AS s, src AS node, 0.0::DOUBLE AS dist, 0::BIGINT AS hops FROM legs WHERE dst IS NOT NULL
 UNION ALL SELECT s, arcs.dst, min(dist + cost), hops + 1 FROM walk JOIN arcs ON node = arcs.src WHERE hops < {_HOPS} GROUP BY s, arcs.dst, hops + 1),
costs AS MATERIALIZED (SELECT s, node, min(dist) AS cost FROM walk GROUP BY s, node)"""


@register("route_via", f"WITH RECURSIVE {_LEGS} SELECT trip, leg, src, dst, cost, CASE WHEN count(cost) OVER w = leg THEN sum(cost) OVER w END AS agg_cost FROM legs LEFT JOIN costs ON s = src AND node = dst WHERE dst IS NOT NULL WINDOW w AS (PARTITION BY trip ORDER BY leg)")
def route_via(spark, d):
    net = _network(spark, d)
    return tiled.route_via(_stops(spark, d), net, tiled.overlay(net))


@register("astar_costs", f"WITH RECURSIVE {_LEGS} SELECT trip AS search, src, dst, cost FROM legs JOIN costs ON s = src AND node = dst WHERE leg = 1 AND src <> dst")
def astar_costs(spark, d):
    net = _network(spark, d)
    pairs = tiled.via_legs(_stops(spark, d)).where("leg = 1 AND src <> dst").select(F.col("trip").alias("search"), "src", "dst")
    return tiled.astar_costs(pairs, net, tiled.overlay(net))


@register(
    "pair_paths",
    f"""WITH RECURSIVE {_LEGS}, pairs AS (SELECT trip AS search, src, dst FROM legs WHERE leg = 1 AND src <> dst),
 best AS MATERIALIZED (SELECT s, node, m.d AS dist, m.h AS hops FROM (SELECT s, node, min({{'d': dist, 'h': hops}}) AS m FROM walk GROUP BY s, node)),
 up AS MATERIALIZED (SELECT v.s, v.node, min(u.node) AS parent FROM best v JOIN arcs ON arcs.dst = v.node JOIN best u ON u.s = v.s AND u.node = arcs.src AND u.dist + cost = v.dist AND u.hops + 1 = v.hops GROUP BY v.s, v.node),
 path AS (SELECT search, src, hops AS pos, dst AS vid FROM pairs JOIN best ON s = src AND node = dst UNION ALL SELECT search, src, pos - 1, parent FROM path JOIN up ON s = src AND node = vid WHERE pos > 0) SELECT search, pos, vid FROM path""",
)
def pair_paths(spark, d):
    net = _network(spark, d)
    pairs = tiled.via_legs(_stops(spark, d)).where("leg = 1 AND src <> dst").select(F.col("trip").alias("search"), "src", "dst")
    over = tiled.overlay(net)
    found = tiled.pair_paths(pairs, net, tiled.astar_costs(pairs, net, over))
    release(over)
    return found


@register(
    "first_targets",
    f"""WITH RECURSIVE {t.LATTICE}, n AS (SELECT count(*) AS n FROM part), starts AS (SELECT n_nationkey::BIGINT AS search, (n_nationkey * 7919 + 5) % n AS vid FROM nation, n),
targets AS (SELECT DISTINCT (s_suppkey * 7919 + 3) % n AS target FROM supplier, n),
walk AS (SELECT search, vid AS node, 0.0::DOUBLE AS dist, 0::BIGINT AS hops FROM starts UNION ALL SELECT search, dst, min(dist + cost), hops + 1 FROM walk JOIN arcs ON node = src WHERE hops < {_HOPS} GROUP BY search, dst, hops + 1),
best AS (SELECT search, node, min(dist) AS dist FROM walk GROUP BY 1, 2)
SELECT search, arg_min(node, (dist, node)) AS target, min(dist) AS cost FROM best JOIN targets ON node = target WHERE dist <= 2000 GROUP BY search""",
)
def first_targets(spark, d):
    """The supplier's place that every nation's trip reaches first."""
    starts = _stops(spark, d).where("seq = 1").select(F.col("trip").alias("search"), "vid", F.lit(None).cast("double").alias("aim_lon"), F.lit(None).cast("double").alias("aim_lat"))
    # the searches are one a nation; every place is a target of each
    targets = _sources(spark, d).select(F.col("node").alias("target")).distinct().join(F.broadcast(starts.select("search")))
    return tiled.first_targets(starts, targets, _network(spark, d), first=60.0, most=2000.0).select("search", "target", "cost")


@register("split_costs")
def split_costs(spark, d):
    """Costs from every supplier's place to the next eight ones', batches divided where their boxes hold too many vertices."""
    places, arcs = t.lattice(spark, d)
    s = _sources(spark, d).select("label", "node").hint("merge").join(places.withColumnRenamed("vid", "node"), "node")
    ahead = s.select(F.explode(F.sequence(F.col("label") - 8, F.col("label") - 1)).alias("label"), F.col("node").alias("dst"), F.col("lon").alias("x2"), F.col("lat").alias("y2"))
    pairs = s.select("label", F.col("node").alias("src"), F.col("lon").alias("x1"), F.col("lat").alias("y1")).hint("merge").join(ahead, "label").where("src <> dst").select("src", "dst", "x1", "y1", "x2", "y2").distinct()
    at = lambda c: F.floor(F.col(c) / t.LATTICE_TILE).cast("long")
    loads = places.groupBy(at("lon").alias("cx"), at("lat").alias("cy")).agg(F.count("*").alias("n"))
    batches = tiled.split_batches(pairs, loads, 1_000.0, t.LATTICE_TILE, t.LATTICE_TILE)
    return tiled.batch_costs(batches, places, arcs, t.LATTICE_TILE, t.LATTICE_TILE)
