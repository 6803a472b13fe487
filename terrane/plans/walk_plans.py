"""Walks of many trips: along chains of cities, along legs of trunks, and where a trip best enters its chain."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrane.operators import walks
from terrane.plans import graph_plans
from terrane.plans import tables as t
from terrane.plans.catalog import register
from terrane.session import materialize, table


def _chains(spark, d):
    """Trips of six neighbouring cities; every third city begins one."""
    n = table(spark, d, "supplier").agg(F.count("*").alias("n"))
    trip = table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("trip")).join(F.broadcast(n))
    rows = trip.select("trip", "n", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("pos"))
    return rows.select("trip", F.col("pos").cast("long").alias("pos"), (F.col("trip") + F.col("pos")).alias("city"), "n").where("city < n").drop("n")


@register("chain_walks")
def chain_walks(spark, d):
    """One row a trip: from its first city's seed along the trees of the others to its last city's seed."""
    grown, seeds, chains = materialize(graph_plans.trees_of(spark, d), "trees"), graph_plans.seeds_of(spark, d), _chains(spark, d)
    ends = chains.groupBy("trip").agg(F.min("city").alias("first"), F.max("city").alias("last"))
    at = lambda c: ends.select("trip", F.col(c).alias("city")).join(seeds, "city").select("trip", "vid")
    return walks.chain_walks(chains, grown, at("first"), at("last"))[1]


@register("leg_walks")
def leg_walks(spark, d):
    """One row for each leg of a trip: whether it is skipped, how far the walk went straight, and the vertices walked."""
    places, _ = t.lattice(spark, d)
    trunks = materialize(graph_plans.trunks_of(spark, d).join(places, "vid"), "trunks")
    chains = _chains(spark, d)
    legs = chains.join(chains.select("trip", (F.col("pos") - 1).alias("pos"), F.col("city").alias("dst")), ["trip", "pos"])
    legs = legs.select("trip", (F.col("pos") + 1).alias("leg"), F.col("city").alias("src"), "dst")
    first = chains.where("pos = 0").join(graph_plans.seeds_of(spark, d), "city").join(places, "vid")
    walked, notes = walks.leg_walks(legs, trunks, first.select("trip", F.lit(1).cast("long").alias("leg"), "vid", "lon", "lat"))
    n = walked.groupBy("trip", "leg").agg(F.count("*").alias("n_vertices"))
    return notes.join(n, ["trip", "leg"], "left").select("trip", "leg", "skipped", "gap_m", F.coalesce("n_vertices", F.lit(0)).alias("n_vertices"))


@register(
    "entry_legs",
    """WITH scores AS (SELECT l_orderkey AS trip, CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) AS leg FROM lineitem),
 known AS (SELECT *, lag(score) OVER (PARTITION BY trip ORDER BY leg) AS before FROM scores WHERE leg <= 5 AND score IS NOT NULL),
 looked AS (SELECT *, max(CASE WHEN score > before THEN 1 ELSE 0 END) OVER (PARTITION BY trip ORDER BY leg) AS risen FROM known)
 SELECT trip, arg_min(leg, (score, leg)) AS leg, min(score) AS score FROM looked WHERE risen = 0 GROUP BY trip""",
)
def entry_legs(spark, d):
    """An order's lines as the candidate legs of a trip; those returned have no score."""
    score = F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice"))
    leg = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")).cast("long")
    return walks.first_rise(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("trip"), leg.alias("leg"), score.alias("score")))
