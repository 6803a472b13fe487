"""Tiled searches against plain Dijkstra over the whole graph."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from terrane.operators import listings, tiled


def plain(arcs, sources):
    """(dist, label, hops, parent) by node: the least such."""
    table, best = {}, {}
    for s, d, c in arcs:
        table.setdefault(s, []).append((d, c))
    heap = [(0.0, label, 0, 0, node) for node, label in sources]
    heapq.heapify(heap)
    while heap:
        *key, node = heapq.heappop(heap)
        if node not in best:
            best[node] = tuple(key)
            for d, c in table.get(node, ()):
                heapq.heappush(heap, (key[0] + c, key[1], key[2] + 1, node, d))
    return best


@pytest.fixture(scope="module")
def graph(spark):
    """A random plane graph with zero costs, parallel arcs, one-way streets, negative ids and a part of its own."""
    r = random.Random(7)
    at = {k - 60: (r.uniform(0, 1), r.uniform(0, 1)) for k in range(240)}
    arcs = []
    for v, (x, y) in at.items():
        near = sorted(at, key=lambda w: (at[w][0] - x) ** 2 + (at[w][1] - y) ** 2)[1:5]
        arcs += [(v, w, float(r.choice([0, 1, 1, 2, 3, 3, 7]))) for w in near if v < 150 or w >= 150]
    arcs += [(arcs[0][0], arcs[0][1], 50.0), (5, 5, 1.0), (7, 999, 1.0), (8, 9, -1.0)]
    net = tiled.network(spark.createDataFrame([(v, *p) for v, p in at.items()], "vid long, lon double, lat double"), spark.createDataFrame(arcs, "src long, dst long, cost double"), 0.23)
    return at, [(s, d, c) for s, d, c in arcs if c >= 0 and d in at], net


def test_tiled_paths(spark, graph):
    at, arcs, net = graph
    seeds = {1: [(-60, 4), (20, 2), (100, 4)], 2: [(20, 0)], 3: [(170, 1)]}
    found = tiled.tiled_paths(spark.createDataFrame([(s, v, label) for s, x in seeds.items() for v, label in x], "search long, node long, label long"), net).collect()
    for s, x in seeds.items():
        got = {r["node"]: (r["dist"], r["label"], r["hops"], 0 if r["parent"] is None else r["parent"]) for r in found if r["search"] == s}
        assert got == plain(arcs, x)
        assert all((r["parent"] is None) == (r["hops"] == 0) for r in found)
    edges = tiled.boundary_edges(tiled.tiled_paths(spark.createDataFrame([(1, *x) for x in seeds[1]], "search long, node long, label long"), net), net).collect()
    best, expected = plain(arcs, seeds[1]), {}
    for s, d, c in arcs:
        if s in best and d in best and best[s][1] != best[d][1]:
            key = tuple(sorted((best[s][1], best[d][1])))
            expected[key] = min(expected.get(key, 1e9), best[s][0] + c + best[d][0])
    assert {(r["a"], r["b"]): r["cost"] for r in edges} == expected


def test_limit(spark, graph):
    at, arcs, net = graph
    found = tiled.tiled_paths(spark.createDataFrame([(1, 20, 0, 4.0), (2, 20, 0, 0.0)], "search long, node long, label long, most double"), net).collect()
    best = plain(arcs, [(20, 0)])
    assert {r["node"] for r in found if r["search"] == 1} == {v for v, k in best.items() if k[0] <= 4}
    assert {r["node"] for r in found if r["search"] == 2} == {v for v, k in best.items() if k[0] <= 0}


def test_astar_and_paths(spark, graph):
    at, arcs, net = graph
    r = random.Random(8)
    ids = sorted(at)
    pairs = [(k, r.choice(ids), r.choice(ids)) for k in range(60)]
    pairs = [(k, a, b) for k, a, b in pairs if a != b] + [(100, 170, -60), (101, 0, 200)]
    table = spark.createDataFrame(pairs, "search long, src long, dst long")
    over = tiled.overlay(net)
    costs = tiled.astar_costs(table, net, over)
    trees = {a: plain(arcs, [(a, 0)]) for _, a, _ in pairs}
    assert {x["search"]: x["cost"] for x in costs.collect()} == {k: trees[a][b][0] for k, a, b in pairs if b in trees[a]}
    got = {}
    for x in tiled.pair_paths(table, net, costs).collect():
        got.setdefault(x["search"], []).append((x["pos"], x["vid"]))
    for k, a, b in pairs:
        if b in trees[a]:
            path, v = [b], b
            while trees[a][v][2]:
                v = trees[a][v][3]
                path.append(v)
            assert [v for _, v in sorted(got[k])] == path[::-1] and sorted(got[k])[0][1] == a
        else:
            assert k not in got


def test_route_via(spark, graph):
    at, arcs, net = graph
    trips = {1: [20, 30, 30, -60], 2: [20, 170], 3: [170, 20, 30], 4: [5]}
    stops = spark.createDataFrame([(t, 10 * k, v) for t, x in trips.items() for k, v in enumerate(x)], "trip long, seq long, vid long")
    found = {(r["trip"], r["leg"]): (r["cost"], r["agg_cost"]) for r in tiled.route_via(stops, net, tiled.overlay(net)).collect()}
    expected = {}
    for t, x in trips.items():
        total = 0.0
        for k, (a, b) in enumerate(zip(x, x[1:], strict=False), 1):
            cost = plain(arcs, [(a, 0)]).get(b, (None,))[0]
            total = None if cost is None or total is None else total + cost
            expected[t, k] = (cost, total)
    assert found == expected


def test_overlay_steps_are_never_cheaper_than_paths(spark, graph):
    at, arcs, net = graph
    rows = tiled.overlay(net).collect()
    trees = {r["src"]: plain(arcs, [(r["src"], 0)]) for r in rows}
    assert rows and all(r["cost"] >= trees[r["src"]][r["dst"]][0] for r in rows)
    assert tiled.cost_rate(net) >= 0


def test_tree_paths_of_a_long_line(spark):
    parents = spark.range(0, 1000).select(F.lit(1).cast("long").alias("search"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.col("id").alias("hops"))
    found = tiled.tree_paths(spark.createDataFrame([(1, 999), (1, 0), (1, 512)], "search long, target long"), parents).collect()
    assert sorted((r["target"], r["pos"]) for r in found) == sorted((t, p) for t in (999, 0, 512) for p in range(t + 1))
    assert all(r["pos"] == r["vid"] for r in found)


@pytest.mark.parametrize("bias", [0.0, 0.05])
def test_first_targets_equal_a_whole_search(spark, graph, bias):
    from terrane.functions import geo  # noqa: F401 - the same distance is written plainly below
    from tests.test_walks import haversine

    at, arcs, net = graph
    r = random.Random(10)
    searches = [(k, r.choice(sorted(at)), *((None, None) if k % 5 == 0 else (r.random(), r.random()))) for k in range(20)]
    targets = [(k, v) for k, *_ in searches for v in r.sample(sorted(at), r.randrange(1, 6))]
    found = tiled.first_targets(spark.createDataFrame(searches, "search long, vid long, aim_lon double, aim_lat double"), spark.createDataFrame(targets, "search long, target long"), net, bias=bias, first=2.0, most=15.0, growth=2.0)
    got = {x["search"]: (x["target"], x["cost"]) for x in found.collect()}
    for k, v, x, y in searches:
        best = plain(arcs, [(v, 0)])
        scores = [(best[w][0] + (bias * haversine(*at[w], x, y) / 1000 if x is not None else 0.0), w) for s, w in targets if s == k and w in best and best[w][0] <= 15.0]
        assert (k in got) == bool(scores)
        if scores:
            assert got[k] == (min(scores)[1], best[min(scores)[1]][0])


def test_split_batches(spark, graph):
    """A crowded place: batches stay below the bound, and costs are those of the batches that aren't split."""
    at, arcs, net = graph
    r = random.Random(11)
    ids = sorted(v for v in at if v < 150)
    pairs = [(s, d, *at[s], *at[d]) for s in ids[:8] for d in r.sample(ids, 25) if s != d]
    table = spark.createDataFrame(pairs, "src long, dst long, x1 double, y1 double, x2 double, y2 double")
    cell, loads = 0.1, {}
    for x, y in at.values():
        key = (int(x // cell), int(y // cell))
        loads[key] = loads.get(key, 0) + (40 if x < 0.5 and y < 0.5 else 1)
    load = spark.createDataFrame([(*k, n) for k, n in loads.items()], "cx long, cy long, n long")
    split = tiled.split_batches(table, load, 1500.0, cell).collect()
    assert sorted((x["src"], x["dst"]) for x in split) == sorted(p[:2] for p in pairs)
    groups = {}
    for x in split:
        groups.setdefault(x["batch"], []).append(x)
    for batch, xs in groups.items():
        w, e = min(min(x["x1"], x["x2"]) for x in xs), max(max(x["x1"], x["x2"]) for x in xs)
        s, n = min(min(x["y1"], x["y2"]) for x in xs), max(max(x["y1"], x["y2"]) for x in xs)
        whole = sum(v for (cx, cy), v in loads.items() if w // cell <= cx <= e // cell and s // cell <= cy <= n // cell)
        assert {x["load"] for x in xs} == {whole} and (whole <= 1500 or len(xs) == 1 or batch.count("/") == 4)
    assert max(b.count("/") for b in groups) >= 1
    vertices = spark.createDataFrame([(v, *p) for v, p in at.items()], "vid long, lon double, lat double")
    roads = spark.createDataFrame(arcs, "src long, dst long, cost double")
    cost = lambda bound: {(x["src"], x["dst"]): x["cost"] for x in tiled.batch_costs(tiled.split_batches(table, load, bound, cell, 1.0), vertices, roads, cell, 1.0).collect()}
    trees = {s: plain(arcs, [(s, 0)]) for s in ids[:8]}
    assert cost(1500.0) == cost(1e9) == {(s, d): trees[s][d][0] for s, d, *_ in pairs if d in trees[s]}


@pytest.mark.parametrize("bits", [1])
def test_astar_costs_over_many_blocks(spark, graph, monkeypatch, bits):
    """Searches that pass between blocks of two tiles by two."""
    at, arcs, net = graph
    monkeypatch.setattr(tiled, "_BLOCK_BITS", bits)
    r = random.Random(12)
    pairs = [(k, *r.sample(sorted(at), 2)) for k in range(40)]
    costs = tiled.astar_costs(spark.createDataFrame(pairs, "search long, src long, dst long"), net, tiled.overlay(net)).collect()
    trees = {a: plain(arcs, [(a, 0)]) for _, a, _ in pairs}
    assert {x["search"]: x["cost"] for x in costs} == {k: trees[a][b][0] for k, a, b in pairs if b in trees[a]}


def test_a_round_takes_a_block_and_not_a_tile(spark):
    """A line of 48 tiles in three blocks, searched from both ends: few rounds, where there was one for every other tile."""
    n = 96
    net = tiled.network(spark.range(n).select(F.col("id").alias("vid"), (F.col("id") * 0.01 + 0.005).alias("lon"), F.lit(0.005).alias("lat")), spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(2.0).alias("cost")), 0.02)
    pair = spark.createDataFrame([(1, 0, n - 1)], "search long, src long, dst long")
    assert [x["cost"] for x in tiled.astar_costs(pair, net, tiled.overlay(net), most_rounds=5).collect()] == [2.0 * (n - 1)]


def test_batch_costs_stay_in_their_boxes_and_write_no_vertices_of_batches(spark, graph, monkeypatch):
    """Every pair costs what plain Dijkstra finds inside its batch's cells; what is written doesn't grow with batches times vertices."""
    at, arcs, _ = graph
    r = random.Random(13)
    ids, cell, margin = sorted(at), 0.1, 0.05
    pairs = [(s, d, *at[s], *at[d]) for s in r.sample(ids, 40) for d in [*r.sample(ids, 3), s]]
    table = spark.createDataFrame(pairs, "src long, dst long, x1 double, y1 double, x2 double, y2 double")
    batches = tiled.split_batches(table, spark.createDataFrame([(0, 0, 1)], "cx long, cy long, n long"), 1e9, cell).drop("batch").withColumn("batch", F.concat_ws("-", "src", "dst"))
    written = []
    keep = tiled.materialize
    monkeypatch.setattr(tiled, "materialize", lambda df, label: written.append(keep(df, label)) or written[-1])
    vertices, roads = spark.createDataFrame([(v, *p) for v, p in at.items()], "vid long, lon double, lat double"), spark.createDataFrame(arcs, "src long, dst long, cost double")
    got = {(x["src"], x["dst"]): x["cost"] for x in tiled.batch_costs(batches, vertices, roads, cell, margin).collect()}
    expected = {}
    for s, d, x1, y1, x2, y2 in pairs:
        (w, e), (low, high) = (((min(p, q) - margin) // cell, (max(p, q) + margin) // cell) for p, q in ((x1, x2), (y1, y2)))
        inside = {v for v, (x, y) in at.items() if w <= x // cell <= e and low <= y // cell <= high}
        tree = plain([a for a in arcs if a[0] in inside and a[1] in inside], [(s, 0)])
        if d in tree:
            expected[s, d] = tree[d][0]
    whole = {s: plain(arcs, [(s, 0)]) for s, *_ in pairs}
    assert got == expected and any(whole[s][d][0] < cost for (s, d), cost in got.items())
    assert max(df.count() for df in written) <= len(arcs)


def test_split_batches_and_batch_costs_broadcast_no_table(spark, graph, monkeypatch):
    """Tables that are small as files are joined by sorts."""
    at, arcs, _ = graph
    r, cell, plans = random.Random(14), 0.02, []
    pairs = [(s, d, *at[s], *at[d]) for s in r.sample(sorted(at), 20) for d in r.sample(sorted(at), 4)]
    loads = {}
    for x, y in at.values():
        key = (int(x // cell), int(y // cell))
        loads[key] = loads.get(key, 0) + 1
    keep = tiled.materialize
    table, load, vertices, roads = (keep(spark.createDataFrame(rows, kind), "made") for rows, kind in (
        (pairs, "src long, dst long, x1 double, y1 double, x2 double, y2 double"), ([(*k, n) for k, n in loads.items()], "cx long, cy long, n long"),
        ([(v, *p) for v, p in at.items()], "vid long, lon double, lat double"), (arcs, "src long, dst long, cost double")))
    monkeypatch.setattr(tiled, "materialize", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, label))
    split = tiled.split_batches(table, load, 20.0, cell)
    plans.append(tiled.batch_costs(split, vertices, roads, cell, cell)._jdf.queryExecution().executedPlan().toString())
    assert not any("BroadcastHashJoin" in p for p in plans)


def test_row_sums_count_gaps_and_nothing_before_a_row(spark):
    loads = spark.createDataFrame([(3, 0, 2), (5, 0, 7), (9, 0, 1), (-4, 1, 6)], "cx long, cy long, n long")
    assert {x["cy"]: (x["base"], x["sums"]) for x in tiled._row_sums(loads).collect()} == {0: (3, [2, 2, 9, 9, 9, 9, 10]), 1: (-4, [6])}
    pairs = [(1, k, x1, 0.5, x2, y2) for k, (x1, x2, y2) in enumerate([(0.5, 2.5, 0.5), (0.5, 4.5, 0.5), (-9.5, 40.5, 1.5), (9.5, 40.5, 0.5), (10.5, 40.5, 1.5), (-9.5, 40.5, 3.5)])]
    found = tiled.split_batches(spark.createDataFrame([(10 + k, k, *p[2:]) for k, p in enumerate(pairs)], "src long, dst long, x1 double, y1 double, x2 double, y2 double"), loads, 1e9, 1.0)
    assert {x["dst"]: x["load"] for x in found.collect()} == {0: 0, 1: 2, 2: 16, 3: 1, 4: 0, 5: 16}


@pytest.mark.parametrize("part", [0.0, 1 / 3])
def test_costs_between_all_points(spark, graph, monkeypatch, part):
    """Whole costs and others, over many tiles and in two parts: least cost, then fewest arcs, and the links of ferries with and
    without their lines."""
    at, arcs, _ = graph
    r = random.Random(15)
    kept = sorted(at)[: len(at) * 2 // 3]
    roads = [(a, b, float(r.randrange(1, 4)) + part) for a, b, _ in arcs if (a in kept) == (b in kept) and a < b]
    points = r.sample(sorted(at), 40)
    vertices = spark.createDataFrame([(v, *p) for v, p in at.items()], "vid long, lon double, lat double")
    ferries, piers = spark.createDataFrame(roads, "a long, b long, len_m double"), spark.createDataFrame([(v,) for v in points], "vid long")
    monkeypatch.setattr(tiled, "costs_between", lambda points, net, make=tiled.costs_between: make(points, net, 16))
    got = {(x["a"], x["b"]): (x["cost"], x["n_points"]) for x in listings.ferry_costs(vertices, ferries, piers, 0.2).collect()}
    both = [(a, b, c) for a, b, c in roads] + [(b, a, c) for a, b, c in roads]
    out = {}
    for a, b, c in both:
        out.setdefault(a, []).append((b, c))
    expected = {}
    for s in points:
        best, heap = {}, [(0.0, 0, s)]
        while heap:
            d, hops, v = heapq.heappop(heap)
            if v not in best:
                best[v] = (d, hops)
                for w, c in out.get(v, ()):
                    heapq.heappush(heap, (d + c, hops + 1, w))
        expected |= {(s, t): best[t] for t in points if s < t and t in best}
    assert len(got) > 50
    assert set(got) == set(expected)
    assert all(got[k][0] == pytest.approx(d, abs=1e-9) for k, (d, _) in expected.items())
    if not part:
        assert got == {k: (d, hops + 1) for k, (d, hops) in expected.items()}
        lines = listings.ferry_links(vertices, ferries, piers, 0.2).select("a", "b", "cost", F.size("path").alias("n")).collect()
        assert {(x["a"], x["b"]): (x["cost"], x["n"]) for x in lines} == got

