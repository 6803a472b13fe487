"""Walks of many trips at once: chains of trees with a switch of gradient, legs that are skipped or cut, scored entries.

A walk in a tree or trunk is a climb over its parents. Jumps of 1, 2, 4, ... steps are joined to themselves once and then
used by all rounds, so a climb takes joins by the logarithm of its length. Rounds go over the legs of chains, with all
trips in each; every round writes its state to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import geo
from terrane.operators import tiled
from terrane.operators.graph import best_by
from terrane.session import materialize, release

#: Jumps of up to this power of two: more steps than any walk may have.
_MOST_JUMPS = 40
LOOK_AHEAD = 4


def jump_tables(parents: DataFrame, keys: list[str]) -> list[DataFrame]:
    """Jumps (keys, vid, up) of 1, 2, 4, ... steps over parents (keys, vid, parent), each written once."""
    tables = [materialize(parents.where("parent IS NOT NULL").select(*keys, "vid", F.col("parent").alias("up")), "jumps")]
    while not tables[-1].isEmpty():
        if len(tables) > _MOST_JUMPS:
            raise ValueError("the parents go round in a circle")
        first, then = tables[-1].withColumnRenamed("up", "mid"), tables[-1].withColumnRenamed("vid", "mid")
        tables.append(materialize(first.join(then, [*keys, "mid"]).select(*keys, "vid", "up"), "jumps"))
    release(tables.pop())
    return tables


def climbs(starts: DataFrame, jumps: list[DataFrame], keys: list[str]) -> DataFrame:
    """``starts`` (keys, vid and others) with a row for every vertex up to the root, ``k`` steps above; the starts have 0."""
    found = starts.withColumn("k", F.lit(0).cast("long"))
    others = [c for c in found.columns if c not in ("vid", "k")]
    for n in reversed(range(len(jumps))):
        more = found.join(jumps[n], [*keys, "vid"]).select(*others, F.col("up").alias("vid"), (F.col("k") + 2**n).alias("k"))
        longer = materialize(found.select(*others, "vid", "k").unionByName(more), "climbs")
        release(found)
        found = longer
    return found.select(*others, "vid", "k")


def chain_walks(chains: DataFrame, trees: DataFrame, starts: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Walks along chains of cities (trip, pos, city), each following one city's tree after the other.

    From its start (trip, vid) a walk follows the parents in the tree (city, vid, parent, cost) of the farthest city of its
    chain that holds the vertex (the first city never counts), and changes to a farther city's tree at the first vertex that
    is in one. At the root of a tree its city leaves the chain. A walk ends at the first vertex among ``ends`` (trip, vid),
    "arrived"; without a city left, "exhausted"; or at a vertex that no tree left holds, "lost".

    Gives the steps (trip, step, vid, city, cost), step 0 being the start (city null), and the outcomes (trip, outcome,
    n_steps, n_switches, vid, cost); a switch is any change of the city followed, the first included. A round takes a walk
    up one tree, and either a farther tree comes next or a city leaves the chain.
    """
    first = chains.groupBy("trip").agg(F.min("pos").alias("first"))
    active = materialize(chains.join(first, "trip").where("pos > first").select("trip", "pos", "city"), "walk-active")
    used = materialize(trees.join(active.select("city").distinct(), "city", "left_semi").select("city", "vid", "parent", "cost"), "walk-trees")
    jumps = jump_tables(used, ["city"])
    number = lambda c: F.lit(0).cast("long").alias(c)
    current = materialize(starts.select("trip", "vid", number("step"), F.lit(0.0).alias("cost"), number("switches"), F.lit(None).cast("long").alias("at_pos")), "walk-current")
    steps = [current.select("trip", "step", "vid", F.lit(None).cast("long").alias("city"), "cost")]
    done = []
    state = ["trip", "vid", "step", "cost", "switches"]
    while True:
        arrived = current.join(ends, ["trip", "vid"], "left_semi")
        left = current.join(ends, ["trip", "vid"], "left_anti")
        choices = left.join(active, "trip").join(used.select("city", "vid", "parent", F.col("cost").alias("here")), ["city", "vid"])
        switch = F.coalesce(F.col("at_pos") != F.col("pos"), F.lit(True)).cast("long")
        best = materialize(best_by(choices, ["trip"], [F.desc("pos")]).withColumn("switches", F.col("switches") + switch), "walk-best")
        rest = left.join(best.select("trip"), "trip", "left_anti")
        open_ = active.select("trip").distinct().withColumn("some", F.lit(True))
        rest = rest.join(open_, "trip", "left").withColumn("outcome", F.when(F.col("some"), "lost").otherwise("exhausted"))
        done.append(materialize(arrived.withColumn("outcome", F.lit("arrived")).select(*state, "outcome").unionByName(rest.select(*state, "outcome")), "walk-done"))
        if best.isEmpty():
            break
        # a city whose root is reached leaves the chain; its trip stays where it is
        at_root = best.where("parent IS NULL")
        active_now = materialize(active.join(at_root.select("trip", "pos"), ["trip", "pos"], "left_anti"), "walk-active")
        moving = best.where("parent IS NOT NULL")
        path = climbs(moving.select("trip", "city", "pos", "step", "cost", "here", "switches", "vid"), jumps, ["city"])
        path = path.join(used.select("city", "vid", F.col("cost").alias("there"), F.col("parent").isNull().alias("root")), ["city", "vid"])
        ahead = path.select("trip", "vid", "k", "pos").join(active_now.select("trip", F.col("pos").alias("far"), F.col("city").alias("other")), "trip").where("far > pos")
        ahead = ahead.join(used.select(F.col("city").alias("other"), "vid"), ["other", "vid"], "left_semi").select("trip", "k")
        stops = path.where("root").select("trip", "k").unionByName(path.join(ends, ["trip", "vid"], "left_semi").select("trip", "k")).unionByName(ahead)
        stop = stops.where("k > 0").groupBy("trip").agg(F.min("k").alias("stop"))
        walked = path.join(stop, "trip").where("k > 0 AND k <= stop").withColumn("cost", F.col("cost") + F.col("here") - F.col("there"))
        walked = materialize(walked.select("trip", (F.col("step") + F.col("k")).alias("step"), "vid", "city", "cost", "switches", "pos", (F.col("k") == F.col("stop")).alias("last")), "walk-steps")
        steps.append(walked.select("trip", "step", "vid", "city", "cost"))
        stayed = at_root.select(*state, F.col("pos").alias("at_pos"))
        then = materialize(walked.where("last").select(*state, F.col("pos").alias("at_pos")).unionByName(stayed), "walk-current")
        if len(steps) > 2:
            release(current)
        release(active, best)
        current, active = then, active_now
    release(*jumps)
    out, outcomes = steps[0], done[0]
    for more in steps[1:]:
        out = out.unionByName(more)
    for more in done[1:]:
        outcomes = outcomes.unionByName(more)
    return out, outcomes.select("trip", "outcome", F.col("step").alias("n_steps"), F.col("switches").alias("n_switches"), "vid", "cost")


def leg_walks(legs: DataFrame, trunks: DataFrame, starts: DataFrame, look_ahead: int = LOOK_AHEAD) -> tuple[DataFrame, DataFrame]:
    """Walks along the legs (trip, leg, src, dst) of chains, ``leg`` counting up by 1, over trunks (src, dst, vid, succ, lon, lat).

    A walk enters a leg's trunk with the vertex it has reached (the start: (trip, leg, vid, lon, lat)). If the trunk lacks
    it, the nearest of the next ``look_ahead`` legs whose trunk has it is taken and the legs before are skipped (a leg
    without a trunk ends the look ahead); if none has it, the walk goes over to the trunk's vertex nearest to it. It follows
    ``succ`` to the end, but turns off at the last vertex that the next leg's trunk has too. A trip ends before a leg that
    has no trunk.

    Gives the vertices walked (trip, leg, k, vid) and the legs (trip, leg, skipped, gap_m): how far the walk went straight.
    """
    pairs = legs.select("src", "dst").distinct()
    used = materialize(trunks.join(pairs, ["src", "dst"], "left_semi").select("src", "dst", "vid", F.col("succ").alias("parent"), "lon", "lat"), "leg-trunks")
    jumps = jump_tables(used, ["src", "dst"])
    there = used.select("src", "dst").distinct().withColumn("there", F.lit(True))
    plan = materialize(legs.join(there, ["src", "dst"], "left").select("trip", "leg", "src", "dst", F.coalesce("there", F.lit(False)).alias("there")), "leg-plan")
    current = materialize(starts.select("trip", "leg", "vid", "lon", "lat"), "leg-current")
    walked, told = [], []
    while not current.isEmpty():
        at = plan.withColumnRenamed("leg", "to_leg")
        ahead = current.join(at, "trip").where((F.col("to_leg") >= F.col("leg")) & (F.col("to_leg") <= F.col("leg") + look_ahead))
        upto = ahead.where("NOT there").groupBy("trip").agg(F.min("to_leg").alias("wall"))
        seen = ahead.join(used.select("src", "dst", "vid"), ["src", "dst", "vid"], "left_semi").join(upto, "trip", "left").where("wall IS NULL OR to_leg < wall")
        entry = seen.groupBy("trip").agg(F.min("to_leg").alias("to_leg"))
        held = current.join(entry, "trip", "left").withColumn("to_leg", F.coalesce("to_leg", "leg"))
        held = held.join(plan.where("there").withColumnRenamed("leg", "to_leg"), ["trip", "to_leg"])
        held = materialize(held.join(used.select("src", "dst", "vid", F.lit(True).alias("inside")), ["src", "dst", "vid"], "left"), "leg-held")
        # without an entry the walk goes over to the nearest vertex of the trunk
        far = held.where("inside IS NULL").select("trip", "to_leg", "src", "dst", F.col("lon").alias("x"), F.col("lat").alias("y")).join(used.select("src", "dst", F.col("vid").alias("other"), "lon", "lat"), ["src", "dst"])
        near = far.groupBy("trip").agg(F.min(F.struct(geo.haversine_m("x", "y", "lon", "lat").alias("gap_m"), "other")).alias("n"))
        entered = held.join(near, "trip", "left").select("trip", F.col("leg").alias("from_leg"), F.col("to_leg").alias("leg"), "src", "dst", F.coalesce("n.other", "vid").alias("vid"), F.coalesce("n.gap_m", F.lit(0.0)).alias("gap_m"))
        entered = materialize(entered, "leg-entered")
        skipped = entered.where("leg > from_leg").select("trip", F.explode(F.sequence("from_leg", F.col("leg") - 1)).alias("leg"), F.lit(True).alias("skipped"), F.lit(0.0).alias("gap_m"))
        told.append(entered.select("trip", "leg", F.lit(False).alias("skipped"), "gap_m").unionByName(skipped))
        path = climbs(entered.select("trip", "leg", "src", "dst", "vid"), jumps, ["src", "dst"])
        following = plan.select("trip", (F.col("leg") - 1).alias("leg"), F.col("src").alias("s2"), F.col("dst").alias("d2"))
        shared = path.join(following, ["trip", "leg"]).join(used.select(F.col("src").alias("s2"), F.col("dst").alias("d2"), "vid"), ["s2", "d2", "vid"], "left_semi")
        cut = path.groupBy("trip").agg(F.max("k").alias("whole")).join(shared.groupBy("trip").agg(F.max("k").alias("shared")), "trip", "left").select("trip", F.coalesce("shared", "whole").alias("last"))
        kept = materialize(path.join(cut, "trip").where("k <= last").select("trip", "leg", "src", "dst", "k", "vid", (F.col("k") == F.col("last")).alias("end")), "leg-walked")
        walked.append(kept.select("trip", "leg", "k", "vid"))
        then = kept.where("end").join(used.select("src", "dst", "vid", "lon", "lat"), ["src", "dst", "vid"]).select("trip", (F.col("leg") + 1).alias("leg"), "vid", "lon", "lat")
        before = current
        current = materialize(then.join(plan.select("trip", "leg"), ["trip", "leg"], "left_semi"), "leg-current")
        release(before, held)
    release(*jumps)
    none = starts.where("false")
    out = none.select("trip", "leg", F.lit(0).cast("long").alias("k"), "vid")
    notes = none.select("trip", "leg", F.lit(False).alias("skipped"), F.lit(0.0).alias("gap_m"))
    for more in walked:
        out = out.unionByName(more)
    for more in told:
        notes = notes.unionByName(more)
    return out, notes


def first_rise(scores: DataFrame, most: int = LOOK_AHEAD + 1) -> DataFrame:
    """(trip, leg, score): the least score (the first of equal ones) among the scores (trip, leg, score) of the ``most``
    first legs of a trip, which are looked at in order until one is above the one before; null scores are passed over."""
    order = Window.partitionBy("trip").orderBy("leg")
    known = scores.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= most).where("score IS NOT NULL")
    rises = known.withColumn("rise", (F.col("score") > F.lag("score").over(order)).cast("int"))
    looked = rises.withColumn("risen", F.coalesce(F.sum(F.coalesce("rise", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).where("risen = 0")
    return best_by(looked, ["trip"], ["score", "leg"]).select("trip", "leg", "score")


def entry_legs(trips: DataFrame, targets: DataFrame, net: tiled.Network, bias: float = 1000.0, most: float = 200_000.0, most_legs: int = LOOK_AHEAD + 1) -> DataFrame:
    """(trip, leg, target, score): the leg at which each trip best enters its chain.

    ``trips`` has (trip, vid, end_lon, end_lat), ``targets`` (trip, leg, target) the vertices of each candidate leg's trunk.
    A leg is entered where the cost of the way plus ``bias`` times the kilometres left to the trip's end is least; its score
    is the length of that way plus the distance left, in km. Legs are looked at in order until a score rises. Ways cost
    ``most`` at most; legs out of reach have no score, trips without one no row.
    """
    sources = trips.select(F.col("trip").alias("search"), F.col("vid").alias("node"), F.lit(0).cast("long").alias("label"), F.lit(float(most)).alias("most"))
    trees = tiled.tiled_paths(sources, net)
    at = net.vertices.select(F.col("vid"), "lon", "lat")
    reached = targets.join(trees.select(F.col("search").alias("trip"), F.col("node").alias("target"), "dist"), ["trip", "target"])
    reached = reached.join(at.withColumnRenamed("vid", "target"), "target").join(trips.select("trip", "end_lon", "end_lat"), "trip")
    left = geo.haversine_m("lon", "lat", "end_lon", "end_lat") / 1000
    ranked = reached.withColumn("left_km", left).withColumn("rank", F.col("dist") + bias * F.col("left_km"))
    chosen = materialize(best_by(ranked, ["trip", "leg"], ["rank", "target"]).select("trip", "leg", "target", "left_km"), "entry-targets")
    paths = tiled.tree_paths(chosen.select(F.col("trip").alias("search"), "target").distinct(), trees).join(at, "vid")
    before = Window.partitionBy("search", "target").orderBy("pos")
    steps = paths.withColumns({"x": F.lag("lon").over(before), "y": F.lag("lat").over(before)})
    km = steps.groupBy(F.col("search").alias("trip"), "target").agg((F.coalesce(F.sum(geo.haversine_m("x", "y", "lon", "lat")), F.lit(0.0)) / 1000).alias("km"))
    scores = materialize(chosen.join(km, ["trip", "target"]).select("trip", "leg", "target", (F.col("km") + F.col("left_km")).alias("score")), "entry-scores")
    # every candidate leg is counted in the order, those out of reach without a score
    legs = targets.select("trip", "leg").distinct().join(scores, ["trip", "leg"], "left")
    won = first_rise(legs, most_legs)
    release(trees, chosen)
    return won.join(scores.select("trip", "leg", "target"), ["trip", "leg"]).select("trip", "leg", "target", "score")
