"""Operators that SQL can't express, against the same work done step by step in Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terrane import session
from terrane.operators import chains, graph, trees
from tests.test_walks import haversine


def test_prune_trunks(spark):
    r = random.Random(1)
    trunks = {}
    for a in range(7):
        for b in range(7):
            if a != b and r.random() < 0.6:
                vids = r.sample(range(40), r.randrange(2, 14))
                trunks[a, b] = {v: (None if k == 0 or r.random() < 0.1 else vids[r.randrange(k)]) for k, v in enumerate(vids)}
    rows = spark.createDataFrame([(*k, v, s) for k, x in trunks.items() for v, s in x.items()], "src long, dst long, vid long, succ long")
    got = {(x["src"], x["dst"], x["vid"], x["succ"]) for x in trees.prune_trunks(rows, spark.createDataFrame([(2,)], "city long")).collect()}
    current = {k: dict(x) for k, x in trunks.items()}
    for _ in range(10):
        ends = {}
        for (_, b), x in current.items():
            ends.setdefault(b, set()).update(v for v, s in x.items() if s is None)
        following = {}
        for (a, b), x in current.items():
            marked = set(x) & ends.get(a, set()) if a != 2 else set()
            seen = set()
            for v in marked:
                while v is not None and v not in seen:
                    seen.add(v)
                    v = x.get(v)
            following[a, b] = {v: s for v, s in x.items() if v in seen} if marked else x
        if following == current:
            break
        current = following
    expected = {(*k, v, s) for k, x in current.items() for v, s in x.items()}
    assert got == expected and len(expected) < sum(map(len, trunks.values()))


def test_prune_trunks_goes_on_until_nothing_is_lost(spark):
    # every pass takes the way over 100 + k from one more trunk, as the one before it still ended there
    starts = [(k, v + k) for k in range(12) for v in (0, 100) if k or not v]
    rows = [(k, k + 1, v, v + 1) for k, v in starts] + [(k, k + 1, v + 1, None) for k, v in starts]
    trunks = spark.createDataFrame(rows, "src long, dst long, vid long, succ long")
    pruned = trees.prune_trunks(trunks, spark.createDataFrame([(0,)], "city long"))
    assert {tuple(r) for r in pruned.collect()} == {r for r in rows if r[2] < 100}


def test_bridge_gaps(spark):
    r = random.Random(2)
    nodes = [(k, r.choice(["A", "B", "", None]), 10 + r.random() * 0.01, 47 + r.random() * 0.01) for k in range(90)]
    roots = {k: k // 3 * 3 for k, *_ in nodes}
    ways = spark.createDataFrame(nodes, "node long, name string, lon double, lat double")
    got = {(x["a"], x["b"]) for x in chains.bridge_gaps(ways, spark.createDataFrame(list(roots.items()), "node long, root long"), 250.0).collect()}
    expected, parents = set(), {}

    def find(name, x):
        while parents.setdefault((name, x), x) != x:
            x = parents[name, x]
        return x

    near = [(haversine(*p[2:], *q[2:]), p[0], q[0], p[1]) for p in nodes for q in nodes if p[0] < q[0] and p[1] and p[1] == q[1]]
    for d, a, b, name in sorted(x for x in near if x[0] <= 250.0):
        x, y = find(name, roots[a]), find(name, roots[b])
        if x != y:
            parents[name, x] = y
            expected.add((a, b))
    assert got == expected and len(expected) > 5


def test_proximity_chain(spark):
    r = random.Random(3)
    anchors = {k: (10 + r.random() * 0.4, 47 + r.random() * 0.4) for k in range(14)}

    def line(a, b):
        """A path in five straight steps, on the longer side for some pairs."""
        (x1, y1), (x2, y2) = anchors[a], anchors[b]
        return [(x1 + (x2 - x1) * k / 5, y1 + (y2 - y1) * k / 5 + (0.03 if (a + b) % 4 == 0 and 0 < k < 5 else 0.0)) for k in range(6)]

    cost = lambda a, b: haversine(*anchors[a], *anchors[b]) * (6.0 if (a * b) % 7 == 3 else 0.9)
    known = [(a, b, cost(a, b), line(a, b)) for a in anchors for b in anchors if a < b and (a + 2 * b) % 11]
    table = spark.createDataFrame(known, "a long, b long, cost double, path array<struct<lon:double,lat:double>>")
    wanted = [(a, b) for a in anchors for b in anchors if a < b and r.random() < 0.5]
    found = chains.proximity_chain(spark.createDataFrame(wanted + [(b, a) for a, b in wanted[:5]] + [(3, 3)], "a long, b long"), spark.createDataFrame([(k, *p) for k, p in anchors.items()], "anchor long, lon double, lat double"), lambda pairs: pairs.join(table, ["a", "b"]), radius_m=4_000.0)
    got = {(x["a"], x["b"]): x["cost"] for x in found.collect()}
    paths = {(a, b): (c, p) for a, b, c, p in known}
    todo, seen, kept = list(wanted), set(wanted), {}
    while todo:
        a, b = todo.pop()
        if (a, b) not in paths:
            continue
        c, path = paths[a, b]
        hits = [(k, d, v) for k, (x, y) in enumerate(path) for v, at in anchors.items() if v not in (a, b) and (d := haversine(x, y, *at)) <= 4_000.0]
        if hits:
            via = min(hits)[2]
            halves = {tuple(sorted(h)) for h in ((a, via), (via, b))}
            todo += [h for h in halves - seen]
            seen |= halves
        else:
            crow = haversine(*anchors[a], *anchors[b])
            if max(c, crow) / crow <= 4.0:
                kept[a, b] = max(c, crow)
    assert got == {k: pytest.approx(v) for k, v in kept.items()} and len(kept) > 5


def test_drop_detours(spark):
    r = random.Random(4)
    edges = {}
    for _ in range(60):
        a, b = sorted(r.sample(range(16), 2))
        edges[a, b] = float(r.randrange(1, 40))
    got = {(x["a"], x["b"], x["cost"]) for x in trees.drop_detours(spark.createDataFrame([(*k, c) for k, c in edges.items()], "a long, b long, cost double")).collect()}
    left = dict(edges)
    for (a, b), c in sorted(edges.items(), key=lambda e: (-e[1], *e[0])):
        del left[a, b]
        far = {v: math.inf for v in range(16)} | {a: 0.0}
        for _ in range(16):
            for (x, y), d in left.items():
                far[y], far[x] = min(far[y], far[x] + d), min(far[x], far[y] + d)
        degree = lambda v: sum(v in e for e in left)  # noqa: B023, E731
        if not (degree(a) and degree(b) and far[b] <= 1.3 * c):
            left[a, b] = c
    assert got == {(*k, c) for k, c in left.items()} and len(left) < len(edges)


def test_hulls(spark):
    r = random.Random(5)
    points = [(g, float(r.randrange(12)), float(r.randrange(12))) for g in range(4) for _ in range(2 + g * 15)] + [(9, 1.0, 1.0), (9, 1.0, 1.0), (10, 0.0, 0.0), (10, 1.0, 1.0), (10, 2.0, 2.0)]
    rows = trees.convex_hulls(spark.createDataFrame(points, "city long, lon double, lat double"), "city").orderBy("pos").collect()
    for g in {p[0] for p in points}:
        ring, own = [(x["lon"], x["lat"]) for x in rows if x["city"] == g], {p[1:] for p in points if p[0] == g}
        assert set(ring) <= own and ring[0] == min(own)
        if len(ring) > 2:
            sides = list(zip(ring, ring[1:] + ring[:1], strict=True))
            turn = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
            assert all(turn(a, b, p) >= 0 for a, b in sides for p in own)
            assert all(turn(a, b, c) > 0 for (a, b), (_, c) in zip(sides, sides[1:] + sides[:1], strict=True))


def test_searches_release_what_they_wrote(spark, tmp_path, monkeypatch):
    """Rounds leave their last tables only, however many there were."""
    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}")
    line = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert graph.connected_components(line).select("root").distinct().count() == 1
    arcs = line.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("cost")).where("a < 12")
    assert graph.shortest_paths(spark.createDataFrame([(0, 0)], "node long, label long"), arcs).count() == 13
    assert len(list((tmp_path / "terrane").iterdir())) <= 6


def test_a_shared_folder_is_made_once_where_none_is_set(spark, monkeypatch):
    class Unset:
        def get(self, *_):
            return None

    class Session:
        conf, sparkContext = Unset(), spark.sparkContext

    monkeypatch.setattr(session, "_OWN", {})
    first = session.shared_dir(Session())
    assert first.startswith("file:///") and session.shared_dir(Session()) == first


def test_chain_polygon_points(spark):
    r = random.Random(6)
    anchors = {k: (10 + r.random(), 47 + r.random(), k % 4 == 1) for k in range(12)}
    lines = {}
    for a in anchors:
        for b in r.sample(sorted(anchors), 3):
            if a < b:
                (x1, y1, _), (x2, y2, _) = anchors[a], anchors[b]
                n = r.randrange(1, 6)
                lines[a, b] = [(x1 + (x2 - x1) * (k / n) ** 2, y1 + (y2 - y1) * k / n) for k in range(n + 1)]
    own = {}
    for (a, b), path in lines.items():
        own.setdefault(a, []).append((b, path))
        own.setdefault(b, []).append((a, path[::-1]))

    def disc(x, y):
        step = 2 * math.pi / 32
        return {(round(x + math.cos(step * k) * 5000 / (111_320 * math.cos(math.radians(y))), 7), round(y + math.sin(step * k) * 5000 / 111_320, 7)) for k in range(32)}

    def half(path):
        steps, total = [haversine(*p, *q) for p, q in zip(path, path[1:], strict=False)], 0.0
        for k, s in enumerate(steps):
            total += s
            if total >= sum(steps) / 2:
                return path[: k + 2]
        return path

    low = lambda ps: {(round(x, 7), round(y, 7)) for x, y in ps}
    expected = {}
    for a, (x, y, pier) in anchors.items():
        points = disc(x, y)
        for b, path in own.get(a, []):
            if anchors[b][2]:
                points |= set() if pier else low(path[-1:])
                continue
            points |= low(path) | disc(*path[-1])
            for c, more in own.get(b, []):
                if c != a and not anchors[c][2]:
                    points |= low(half(more))
        expected[a] = points
    places = spark.createDataFrame([(k, *v) for k, v in anchors.items()], "anchor long, lon double, lat double, is_pier boolean")
    table = spark.createDataFrame([(a, b, p) for (a, b), p in lines.items()], "a long, b long, path array<struct<lon:double,lat:double>>")
    got = {}
    for x in trees.chain_polygon_points(places, table).collect():
        got.setdefault(x["anchor"], set()).add((round(x["lon"], 7), round(x["lat"], 7)))
    assert got == expected
    assert {x["anchor"] for x in trees.chain_polygons(places, table).collect()} == set(anchors)
