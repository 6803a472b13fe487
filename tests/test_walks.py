"""Walks of many trips against the same walks taken step by step in Python."""

import math
import random

import pytest

from terrane.operators import tiled, walks
from terrane.plans import catalog


def haversine(x1, y1, x2, y2):
    a = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * 6371000.0 * math.asin(min(1.0, math.sqrt(a)))


def chain_walk(chain, trees, start, ends):
    """The vertices, the outcome and the switches of one trip."""
    left, vid, cost, followed, switches, steps = list(chain[1:]), start, 0.0, None, 0, [(start, None, 0.0)]
    while vid not in ends:
        if not left:
            return steps, "exhausted", switches
        city = next((c for c in reversed(left) if vid in trees[c]), None)
        if city is None:
            return steps, "lost", switches
        switches, followed = switches + (city != followed), city
        parent, here = trees[city][vid]
        if parent is None:
            left.remove(city)
            continue
        cost += here - trees[city][parent][1]
        vid = parent
        steps.append((vid, city, cost))
    return steps, "arrived", switches


def random_trees(r, n_cities, n_vertices):
    trees = {}
    for c in range(n_cities):
        vids = r.sample(range(n_vertices), r.randrange(3, n_vertices // 2))
        trees[c] = {vids[0]: (None, 0.0)}
        for k, v in enumerate(vids[1:], 1):
            parent = vids[r.randrange(max(0, k - 3), k)]
            trees[c][v] = (parent, trees[c][parent][1] + r.randrange(1, 9))
    return trees


def test_chain_walks(spark):
    r = random.Random(3)
    trees = random_trees(r, 9, 60)
    trips = {t: (r.sample(range(9), r.randrange(1, 7)), r.randrange(60), set(r.sample(range(60), r.randrange(12)))) for t in range(40)}
    chains = spark.createDataFrame([(t, k * 10, c) for t, (x, _, _) in trips.items() for k, c in enumerate(x)], "trip long, pos long, city long")
    rows = spark.createDataFrame([(c, v, p, d) for c, x in trees.items() for v, (p, d) in x.items()], "city long, vid long, parent long, cost double")
    starts = spark.createDataFrame([(t, v) for t, (_, v, _) in trips.items()], "trip long, vid long")
    ends = spark.createDataFrame([(t, v) for t, (_, _, x) in trips.items() for v in x], "trip long, vid long")
    steps, outcomes = walks.chain_walks(chains, rows, starts, ends)
    got, ended = {}, {x["trip"]: x for x in outcomes.collect()}
    for x in steps.collect():
        got.setdefault(x["trip"], []).append((x["step"], x["vid"], x["city"], x["cost"]))
    seen = set()
    for t, (chain, start, targets) in trips.items():
        expected, outcome, switches = chain_walk(chain, trees, start, targets)
        assert sorted(got[t]) == [(k, *s) for k, s in enumerate(expected)]
        e = ended[t]
        assert (e["outcome"], e["n_steps"], e["n_switches"], e["vid"], e["cost"]) == (outcome, len(expected) - 1, switches, expected[-1][0], expected[-1][2])
        seen.add(outcome)
    assert seen == {"arrived", "lost", "exhausted"} and len(ended) == len(trips)


def test_circles_are_an_error(spark):
    with pytest.raises(ValueError):
        walks.jump_tables(spark.createDataFrame([(1, 1, 2), (1, 2, 1)], "city long, vid long, parent long"), ["city"])


def leg_walk(legs, trunks, vid, lon, lat, leg):
    """Vertices by leg and the notes of one trip; ``trunks`` has {vid: (succ, lon, lat)} by (src, dst)."""
    walked, notes = [], []
    while leg in legs and legs[leg] in trunks:
        trunk, gap = trunks[legs[leg]], 0.0
        if vid not in trunk:
            for k in range(leg + 1, leg + 1 + walks.LOOK_AHEAD):
                if k not in legs or legs[k] not in trunks:
                    break
                if vid in trunks[legs[k]]:
                    notes += [(j, True, 0.0) for j in range(leg, k)]
                    leg, trunk = k, trunks[legs[k]]
                    break
            else:
                k = None
            if vid not in trunk:
                gap, vid = min((haversine(lon, lat, x, y), v) for v, (_, x, y) in trunk.items())
        path = [vid]
        while trunk[path[-1]][0] is not None:
            path.append(trunk[path[-1]][0])
        after = trunks.get(legs.get(leg + 1))
        shared = [k for k, v in enumerate(path) if after and v in after]
        path = path[: shared[-1] + 1] if shared else path
        walked += [(leg, k, v) for k, v in enumerate(path)]
        notes.append((leg, False, gap))
        vid, (_, lon, lat), leg = path[-1], trunk[path[-1]], leg + 1
    return walked, notes


def test_leg_walks(spark):
    r = random.Random(4)
    at = {v: (10 + r.random(), 47 + r.random()) for v in range(50)}
    trunks = {}
    for a in range(12):
        for b in range(12):
            if a != b and r.random() < 0.9:
                vids = r.sample(range(50), r.randrange(2, 9))
                trunks[a, b] = {v: (vids[k + 1] if k + 1 < len(vids) else None, *at[v]) for k, v in enumerate(vids)}
    trips = {}
    for t in range(30):
        cities = r.sample(range(12), r.randrange(2, 9))
        trips[t] = ({k + 1: (cities[k], cities[k + 1]) for k in range(len(cities) - 1)}, r.randrange(50))
    legs = spark.createDataFrame([(t, k, *x) for t, (ls, _) in trips.items() for k, x in ls.items()], "trip long, leg long, src long, dst long")
    rows = spark.createDataFrame([(*k, v, *x) for k, trunk in trunks.items() for v, x in trunk.items()], "src long, dst long, vid long, succ long, lon double, lat double")
    starts = spark.createDataFrame([(t, 1, v, *at[v]) for t, (_, v) in trips.items()], "trip long, leg long, vid long, lon double, lat double")
    walked, notes = walks.leg_walks(legs, rows, starts)
    got, told = {t: [] for t in trips}, {t: [] for t in trips}
    for x in walked.collect():
        got[x["trip"]].append((x["leg"], x["k"], x["vid"]))
    for x in notes.collect():
        told[x["trip"]].append((x["leg"], x["skipped"], round(x["gap_m"], 3)))
    skips = 0
    for t, (ls, v) in trips.items():
        expected, noted = leg_walk(ls, trunks, v, *at[v], 1)
        assert sorted(got[t]) == sorted(expected)
        assert sorted(told[t]) == sorted((a, b, round(c, 3)) for a, b, c in noted)
        skips += sum(b for _, b, _ in noted)
    assert skips > 3


def looked_at(scores):
    best = before = None
    for leg, score in scores[:5]:
        if score is None:
            continue
        if best is None or score < best[0]:
            best = (score, leg)
        if before is not None and score > before:
            break
        before = score
    return best


def test_first_rise(spark):
    r = random.Random(5)
    trips = {t: [(k + 1, r.choice([None, *map(float, range(6))])) for k in range(r.randrange(1, 9))] for t in range(80)}
    rows = spark.createDataFrame([(t, *x) for t, xs in trips.items() for x in xs], "trip long, leg long, score double")
    got = {x["trip"]: (x["score"], x["leg"]) for x in walks.first_rise(rows).collect()}
    assert got == {t: b for t, xs in trips.items() if (b := looked_at(xs))}


def test_entry_legs(spark):
    r = random.Random(6)
    at = {v: (10 + (v % 9) * 0.01, 47 + (v // 9) * 0.01) for v in range(81)}
    roads = [(v, w, float(r.randrange(1, 9))) for v in at for w in (v + 1, v + 9, v - 1, v - 9) if w in at and abs(at[w][0] - at[v][0]) < 0.02]
    net = tiled.network(spark.createDataFrame([(v, *p) for v, p in at.items()], "vid long, lon double, lat double"), spark.createDataFrame(roads, "src long, dst long, cost double"), 0.035)
    trips = {t: (r.randrange(81), 10 + r.random() * 0.1, 47 + r.random() * 0.1) for t in range(6)}
    targets = [(t, k, v) for t in trips for k in range(1, 7) for v in r.sample(range(81), 4)]
    found = walks.entry_legs(spark.createDataFrame([(t, *x) for t, x in trips.items()], "trip long, vid long, end_lon double, end_lat double"), spark.createDataFrame(targets, "trip long, leg long, target long"), net, bias=3.0, most=25.0)
    got = {x["trip"]: x for x in found.collect()}
    from tests.test_tiled import plain

    for t, (start, x, y) in trips.items():
        best = plain(roads, [(start, 0)])
        scores, chosen = [], {}
        for leg in range(1, 7):
            near = [(best[v][0] + 3.0 * haversine(*at[v], x, y) / 1000, v) for a, k, v in targets if (a, k) == (t, leg) and best[v][0] <= 25.0]
            if not near:
                scores.append((leg, None))
                continue
            v = chosen[leg] = min(near)[1]
            km, w = 0.0, v
            while best[w][2]:
                km += haversine(*at[w], *at[best[w][3]]) / 1000
                w = best[w][3]
            scores.append((leg, km + haversine(*at[v], x, y) / 1000))
        expected = looked_at(scores)
        assert (t in got) == (expected is not None)
        if expected:
            assert got[t]["leg"] == expected[1] and got[t]["target"] == chosen[expected[1]] and got[t]["score"] == pytest.approx(expected[0])


def test_queries_are_there():
    assert {"chain_walks", "leg_walks", "entry_legs"} <= set(catalog.queries())
