"""Graph operators as joins: components, closures, shortest paths, redundancy, pointer chasing.

Iterations write their state to the shared folder, so that lineages stay short and a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.session import materialize, parts_for, release


def both_ways(edges: DataFrame) -> DataFrame:
    """Arcs (src, dst, cost) of edges (source, target, cost, reverse_cost); a negative or null cost closes a direction."""
    there = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"), F.col("cost"))
    back = edges.select(F.col("target").alias("src"), F.col("source").alias("dst"), F.col("reverse_cost").alias("cost"))
    return there.unionByName(back).where("cost >= 0")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for undirected links (a, b); ``root`` is the least node of the component.

    Every node hooks to its least neighbour and the links are contracted; rounds grow with the logarithm of the nodes.
    """
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    roots = materialize(nodes.withColumn("root", F.col("node")), "cc-roots")
    links = materialize(links.where("a <> b").select("a", "b").distinct(), "cc-links")
    while not links.isEmpty():
        arcs = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = materialize(arcs.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")), "cc-hooks")
        # hooks point to smaller nodes; following them twice shortens the chains
        twice = first.join(first.toDF("p", "q"), "p").select("a", F.col("q").alias("p"))
        hooks = materialize(twice.join(first.toDF("p", "q"), "p").select("a", F.col("q").alias("p")), "cc-hooks")
        before = roots, links, first, hooks
        roots = materialize(roots.join(hooks.toDF("root", "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root")), "cc-roots")
        moved = links.join(hooks.toDF("a", "pa"), "a").join(hooks.toDF("b", "pb"), "b")
        links = materialize(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a <> b").distinct(), "cc-links")
        release(*before)
    return roots


def spanning_forest(edges: DataFrame, order: list[str]) -> DataFrame:
    """The edges (u, v and others) of the least spanning forest, by the columns of ``order``, which no two edges of a component
    share. Every part takes its least edge and is contracted, so rounds grow with the logarithm of the nodes."""
    rest = materialize(edges.withColumns({"p": F.col("u"), "q": F.col("v")}), "forest-rest")
    kept = None
    while not rest.isEmpty():
        key = F.struct(*order)
        both = rest.select(F.col("p").alias("x"), F.col("q").alias("y"), key.alias("key"), F.struct(*edges.columns).alias("edge"))
        both = both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"), "key", "edge"))
        least = materialize(both.groupBy("x").agg(F.min_by(F.struct("y", "edge"), "key").alias("m")).select("x", "m.y", "m.edge"), "forest-least")
        taken = materialize(least.select("edge.*").distinct(), "forest-kept")
        kept = taken if kept is None else kept.unionByName(taken)
        roots = connected_components(least.select(F.col("x").alias("a"), F.col("y").alias("b")))
        moved = rest.join(roots.toDF("p", "np"), "p").join(roots.toDF("q", "nq"), "q").where("np <> nq")
        # of the edges between two parts only the least can be taken
        moved = moved.withColumns({"p": F.least("np", "nq"), "q": F.greatest("np", "nq")}).groupBy("p", "q").agg(F.min_by(F.struct(*edges.columns), key).alias("edge"))
        following = materialize(moved.select("edge.*", "p", "q"), "forest-rest")
        release(rest, least, roots)
        rest = following
    return edges.where("false") if kept is None else kept


def closure(seeds: DataFrame, arcs: DataFrame, most_rounds: int = 1000, parts: int | None = None) -> DataFrame:
    """Nodes reached from ``seeds`` (node) over arcs (src, dst), the seeds included. The arcs are worked out once, in
    ``parts`` partitions if that is given."""
    spread = [F.col("src")] if parts is None else [parts, F.col("src")]
    arcs = materialize(arcs.select("src", "dst").repartition(*spread).distinct(), "closure-arcs")
    seen = frontier = materialize(seeds.select("node").distinct(), "closure")
    for _ in range(most_rounds):
        step = arcs.join(frontier.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = materialize(step.join(seen, "node", "left_anti"), "closure-step")
        if frontier.isEmpty():
            release(arcs)
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError("the closure has not ended")


def flood_fill(ways: DataFrame, seeds: DataFrame) -> DataFrame:
    """Ways (way, vertex, name) reached from seed ways by steps between ways that share a vertex and a non-empty name
    (or, if there is such a column, ``ref``)."""
    label = [F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("name", "ref") if c in ways.columns]
    parts = parts_for(ways.sparkSession, ways.count() * len(label))
    named = ways.select("way", "vertex", F.explode(F.array(*label)).alias("x")).where("x.value <> ''").select("way", "vertex", "x").repartition(parts, "vertex", "x")
    # links to the least way of each vertex and label, both ways, reach as far as links between all pairs and are linear
    hub = F.min("way").over(Window.partitionBy("vertex", "x"))
    star = named.withColumn("hub", hub).where("way <> hub")
    arcs = star.select(F.explode(F.array(F.struct(F.col("way").alias("src"), F.col("hub").alias("dst")), F.struct(F.col("hub").alias("src"), F.col("way").alias("dst")))).alias("x")).select("x.*")
    return closure(seeds.withColumnRenamed("way", "node"), arcs, parts=2 * parts).withColumnRenamed("node", "way")


def shortest_paths(sources: DataFrame, arcs: DataFrame, limit: float | None = None, most_rounds: int = 1000, target: int | None = None) -> DataFrame:
    """(node, label, dist, parent): the nearest source of each node, its distance and the node before it.

    ``sources`` has (node, label). Bellman-Ford by frontier: only nodes that got better in a round go on in the next.
    Ties: the least label, then the least parent. The arcs are worked out once, the cheapest of parallel ones. With a
    ``target`` (a node) only nodes that are no farther than it are returned, and once a way to it is known nothing beyond
    its cost is followed, so rounds grow with the way and not with the graph. For road networks, whose paths have thousands of arcs, ``tiled.tiled_paths`` takes a round for each tile instead.
    """
    arcs = materialize(arcs.groupBy("src", "dst").agg(F.min("cost").alias("cost")).repartition("src"), "paths-arcs")
    best = materialize(sources.select("node", "label", F.lit(0.0).alias("dist"), F.lit(None).cast("long").alias("parent")), "paths")
    frontier, bound = best, None
    if target is not None and not best.where(F.col("node") == target).isEmpty():
        bound = 0.0
    for _ in range(most_rounds):
        step = frontier.join(arcs, frontier["node"] == arcs["src"]).select(F.col("dst").alias("node"), "label", (F.col("dist") + F.col("cost")).alias("dist"), F.col("src").alias("parent"))
        if limit is not None:
            step = step.where(F.col("dist") <= limit)
        if bound is not None:
            step = step.where(F.col("dist") <= bound)
        step = step.groupBy("node").agg(F.min(F.struct("dist", "label", "parent")).alias("x")).select("node", "x.label", "x.dist", "x.parent")
        old = best.select("node", F.col("dist").alias("old"))
        before = frontier
        frontier = materialize(step.join(old, "node", "left").where("old IS NULL OR dist < old").drop("old"), "paths-step")
        if before is not best:
            release(before)
        if frontier.isEmpty():
            release(arcs)
            return best if bound is None else best.where(F.col("dist") <= bound)
        if target is not None and (met := frontier.where(F.col("node") == target).first()):
            bound = met["dist"]
        best, held = materialize(best.join(frontier.select("node"), "node", "left_anti").unionByName(frontier), "paths"), best
        release(held)
    raise RuntimeError("the paths have not ended")


def boundary_edges(best: DataFrame, arcs: DataFrame) -> DataFrame:
    """Links between the regions of ``shortest_paths``: (a, b, cost), the cheapest crossing of each unordered pair."""
    u = best.select(F.col("node").alias("src"), F.col("label").alias("lu"), F.col("dist").alias("du"))
    v = best.select(F.col("node").alias("dst"), F.col("label").alias("lv"), F.col("dist").alias("dv"))
    crossing = arcs.join(u, "src").join(v, "dst").where("lu <> lv")
    return crossing.groupBy(F.least("lu", "lv").alias("a"), F.greatest("lu", "lv").alias("b")).agg(F.min(F.col("du") + F.col("cost") + F.col("dv")).alias("cost"))


def drop_triangles(edges: DataFrame, tolerance: float = 1.1) -> DataFrame:
    """Undirected edges (a, b, cost), a < b, without those that a way over one other node matches within a tolerance."""
    arcs = edges.select("a", "b", "cost").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "cost"))
    first = arcs.select("a", F.col("b").alias("mid"), F.col("cost").alias("c1"))
    second = arcs.select(F.col("a").alias("mid"), "b", F.col("cost").alias("c2"))
    beaten = edges.join(first, "a").join(second, ["mid", "b"]).where(F.col("c1") + F.col("c2") <= tolerance * F.col("cost")).select("a", "b").distinct()
    return edges.join(beaten, ["a", "b"], "left_anti")


def orphans(nodes: DataFrame, edges: DataFrame, id_col: str) -> DataFrame:
    """Nodes without an edge (a, b)."""
    ends = edges.select(F.col("a").alias(id_col)).unionByName(edges.select(F.col("b").alias(id_col))).distinct()
    return nodes.join(ends, id_col, "left_anti")


def walk_to_root(parents: DataFrame, rounds: int = 20) -> DataFrame:
    """(node, root, steps) by pointer doubling over (node, parent); a node without a parent is a root."""
    state = parents.select("node", F.coalesce("parent", "node").alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("steps"))
    for _ in range(rounds):
        nxt = state.select(F.col("node").alias("root"), F.col("root").alias("r2"), F.col("steps").alias("s2"))
        new = materialize(state.join(nxt, "root").select("node", F.col("r2").alias("root"), (F.col("steps") + F.col("s2")).alias("steps"), (F.col("s2") > 0).alias("moved")), "walk")
        state = new.drop("moved")
        if new.where("moved").isEmpty():
            return state
    raise RuntimeError("a cycle, or a chain longer than 2 ** rounds")


def co_members(rows: DataFrame, member: str, group: str) -> DataFrame:
    """Pairs (a < b) of members that share a group, with the number of groups shared.

    The pairs are counted before they are made, so that they are dealt to as many tasks as they need.
    """
    spark = rows.sparkSession
    own = rows.select(member, group).where(F.col(member).isNotNull() & F.col(group).isNotNull()).repartition(parts_for(spark, rows.count()), group).distinct()
    x, y = own.select(F.col(member).alias("a"), group), own.select(F.col(member).alias("b"), group)
    k = F.col("count")
    n = own.groupBy(group).count().agg(F.sum(k * (k - 1) / 2)).first()[0] or 0
    pairs = x.join(y, group).where("a < b").select("a", "b").repartition(parts_for(spark, int(n)), "a", "b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n_shared"))


def leaf_chains(successors: DataFrame) -> DataFrame:
    """Leaves of (node, succ): nodes that no other one leads to."""
    led = successors.where("succ IS NOT NULL").select(F.col("succ").alias("node")).distinct()
    return successors.join(led, "node", "left_anti")


def best_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("best_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("best_rank = 1").drop("best_rank")


def largest(roots: DataFrame) -> DataFrame:
    """One row (root, n): the component of most nodes; of equal ones the least root."""
    return roots.groupBy("root").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root").limit(1)
