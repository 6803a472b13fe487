"""Crossings and overlaps of segments against plain geometry, and versioned tables against failures half way."""

import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrane.operators import segments
from terrane.sources import files
from terrane.sources.store import VersionedTable


def meets(p, q):
    def side(a, b, c):
        d = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        return (d > 0) - (d < 0)

    (a, b), (c, d) = p, q
    boxes = all(min(a[i], b[i]) <= max(c[i], d[i]) and min(c[i], d[i]) <= max(a[i], b[i]) for i in (0, 1))
    return boxes and side(a, b, c) * side(a, b, d) <= 0 and side(c, d, a) * side(c, d, b) <= 0


@pytest.fixture(scope="module")
def tracks():
    """On a grid of eighths, so that touching, collinear, upright, level and point-like ones occur and are exact."""
    r = random.Random(12)
    at = lambda: (r.randrange(-20, 20) / 8, r.randrange(-20, 20) / 8)
    rows = []
    for k in range(120):
        a = at()
        b = at() if k % 6 == 0 else (a[0] + r.randrange(-3, 4) / 8, a[1] + r.randrange(-3, 4) / 8)
        rows.append((k // 2, a, b))
    return rows


def frame(spark, tracks):
    return spark.createDataFrame([(line, k, *a, *b) for k, (line, a, b) in enumerate(tracks)], "line long, seg long, x1 double, y1 double, x2 double, y2 double")


@pytest.mark.parametrize("cell", [0.125, 0.3, 50.0])
def test_crossing_lines(spark, tracks, cell):
    got = {(r["a"], r["b"]) for r in segments.crossing_lines(frame(spark, tracks), cell).collect()}
    assert got == {(p[0], q[0]) for p in tracks for q in tracks if p[0] < q[0] and meets(p[1:], q[1:])}


def test_touching_closure(spark, tracks):
    some = [x for x in tracks if x[0] % 3 == 0]
    pairs = [(p[0], q[0]) for p in some for q in some if p[0] != q[0] and meets(p[1:], q[1:])]
    reached, todo = {0}, [0]
    while todo:
        a = todo.pop()
        for b in {y for x, y in pairs if x == a} - reached:
            reached.add(b)
            todo.append(b)
    found = segments.touching_closure(frame(spark, some), spark.createDataFrame([(0,)], "line long"), 0.4)
    assert {r["line"] for r in found.collect()} == reached


def test_overlaps_of_a_hollow_ring_against_sampling(spark, tracks):
    ring = [(-2.1, -2.2), (2.3, -2.1), (2.2, 2.3), (0.05, -0.9), (-2.2, 2.1)]  # a notch from above

    def inside(x, y):
        hit = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            hit ^= (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay)
        return hit

    areas = spark.createDataFrame([(1, ring), (2, [(50.0, 50.0), (51.0, 50.0), (51.0, 51.0)])], "area long, ring array<struct<lon:double,lat:double>>")
    got = {(r["seg"], r["area"]): r["share"] for r in segments.overlap_lengths(frame(spark, tracks), areas, "seg", "area", 0.3).collect()}
    for k, (_, (x1, y1), (x2, y2)) in enumerate(tracks):
        share = sum(inside(x1 + (i + 0.5) / 2000 * (x2 - x1), y1 + (i + 0.5) / 2000 * (y2 - y1)) for i in range(2000)) / 2000 if (x1, y1) != (x2, y2) else None
        if share is not None:
            assert got.get((k, 1), 0.0) == pytest.approx(share, abs=0.003)
    assert all(area == 1 for _, area in got)


def test_overlaps_of_a_square(spark):
    rows = spark.createDataFrame([(1, -1.0, 0.5, 3.0, 0.5), (2, 0.25, 0.25, 0.75, 0.75), (3, 5.0, 5.0, 6.0, 6.0), (4, 0.5, -1.0, 0.5, 1.0)], "seg long, x1 double, y1 double, x2 double, y2 double")
    area = spark.createDataFrame([(9, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])], "area long, ring array<struct<lon:double,lat:double>>")
    assert {r["seg"]: r["share"] for r in segments.overlap_lengths(rows, area, "seg", "area").collect()} == {1: 0.25, 2: 1.0, 4: 0.5}


class Killed(Exception):
    pass


def test_a_killed_append_leaves_nothing_and_a_retry_adds_once(spark, tmp_path, monkeypatch):
    store = VersionedTable(spark, f"file://{tmp_path}/t")
    rows = spark.range(5).select(F.col("id").alias("src"), (F.col("id") % 2).alias("dst"), F.lit("x").alias("v"))
    assert store.latest() == (0, []) and store.read("src long").count() == 0

    def killed(*_):
        raise Killed

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_commit", killed)
        with pytest.raises(Killed):
            store.append_missing(rows, ["src", "dst"])
    assert store.latest() == (0, []) and store.vacuum() == 1
    assert [store.append_missing(rows, ["src", "dst"]) for _ in range(3)] == [5, 0, 0]
    more = rows.unionByName(spark.createDataFrame([(9, 1, "y"), (9, 1, "z")], rows.schema))
    assert store.append_missing(more, ["src", "dst"]) == 2 and store.read().count() == 7 and store.latest()[0] == 2


def test_a_reader_sees_the_old_rows_or_the_new_ones(spark, tmp_path, monkeypatch):
    store = VersionedTable(spark, f"file://{tmp_path}/t")
    store.replace(spark.range(3))
    before = store.read()
    seen = []
    commit = VersionedTable._commit

    def watched(self, *args):
        seen.append(store.read().count())  # the new rows are written, and not there yet
        commit(self, *args)

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_commit", watched)
        store.replace(store.read().unionByName(spark.range(10, 20)))
    assert seen == [3] and store.read().count() == 13 and before.count() == 3 and store.read(version=1).count() == 3
    assert store.vacuum() == 1 and store.read().count() == 13
    with pytest.raises(ValueError):
        store.read(version=7)


def test_a_manifest_that_was_not_finished_is_none(spark, tmp_path):
    store = VersionedTable(spark, f"file://{tmp_path}/t")
    store.replace(spark.range(3))
    (tmp_path / "t/manifests/000000000002").mkdir()
    assert store.latest()[0] == 1 and store.read().count() == 3


def test_trunk_store(spark, tmp_path):
    trunks = spark.createDataFrame([(1, 2, 5, None), (1, 2, 6, 5)], "src long, dst long, vid long, succ long")
    assert [files.append_trunks(trunks, f"{tmp_path}/t") for _ in range(2)] == [2, 0]
    assert files.append_trunks(trunks.unionByName(trunks.withColumn("dst", F.lit(3).cast("long"))), f"{tmp_path}/t") == 2
    assert VersionedTable(spark, f"{tmp_path}/t").read().count() == 4


def test_a_pair_in_many_cells_is_measured_once_and_not_shuffled(spark):
    r = random.Random(5)
    rows = [(k, *[r.randrange(-40, 40) / 8 for _ in range(4)]) for k in range(60)] + [(60, 0.5, -5.0, 0.5, 5.0), (61, -5.0, 1.0, 5.0, 1.0), (62, 0.25, -5.0, 0.25 + 1e-12, 5.0)]
    ring = [(-3.0, -3.1), (3.2, -2.9), (3.1, 3.0), (-3.1, 3.3)]
    areas = spark.createDataFrame([(k, [(x + k / 16, y - k / 16) for x, y in ring]) for k in range(20)], "area long, ring array<struct<lon:double,lat:double>>")
    lines = spark.createDataFrame(rows, "seg long, x1 double, y1 double, x2 double, y2 double")
    by_cells = {c: sorted(map(tuple, segments.overlap_lengths(lines, areas, "seg", "area", c).collect())) for c in (0.25, 0.7, 100.0)}
    assert by_cells[0.25] == by_cells[0.7] == by_cells[100.0] and len({x[:2] for x in by_cells[0.25]}) == len(by_cells[0.25]) > 500
    plan = segments.overlap_lengths(lines, areas, "seg", "area", 0.25)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Join") and "Aggregate" not in plan[: plan.index("Join")] and "Join" not in plan[: plan.index("MapInArrow")]


def test_lines_from_one_place_are_not_paired(spark, monkeypatch):
    """3,000 lines from one place and a few that only cross: a pair each would be 4.5 million."""
    rows = [(k, 0.01, 0.01, 0.01 + (k % 50) / 1e4, 0.01 + (k // 50) / 1e4) for k in range(1, 3001)]
    rows += [(5000, 0.012, 0.0, 0.012, 0.04), (5001, 0.0, 0.039, 0.04, 0.039), (5002, 0.5, 0.5, 0.5, 0.6), (5003, 0.45, 0.55, 0.55, 0.55), (5004, 0.011, 0.05, 0.012, 0.06)]
    lines = spark.createDataFrame(rows, "line long, x1 double, y1 double, x2 double, y2 double")
    monkeypatch.setattr(segments, "crossing_lines", None)
    reach = lambda seed: {r["line"] for r in segments.touching_closure(lines, spark.createDataFrame([(seed,)], "line long")).collect()}
    assert reach(7) == reach(5001) == {*range(1, 3001), 5000, 5001} and reach(5003) == {5002, 5003} and reach(5004) == {5004} and reach(9) == reach(7)


def test_pairs_of_lines_are_made_once_and_not_shuffled(spark, tracks):
    """Lines that meet in many cells and by many segments, in many groups: a pair comes once, with nothing after the task that finds it."""
    rows = [(line % 23 - 9, k, *a, *b) for k, (line, a, b) in enumerate(tracks)] + [(50, 500, -3.0, 0.0, 3.0, 0.0), (51, 501, -3.0, 0.0, 3.0, 0.0), (51, 502, 3.0, 0.0, -3.0, 0.0), (52, 503, None, 0.0, 0.0, 0.0)]
    lines = spark.createDataFrame(rows, "line int, seg long, x1 double, y1 double, x2 double, y2 double")
    found = segments.crossing_lines(lines, 0.1, segments_a_group=9)
    expected = sorted({(p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and None not in p + q and meets((p[2:4], p[4:]), (q[2:4], q[4:]))})
    assert sorted(map(tuple, found.collect())) == expected and (50, 51) in expected and found.schema["a"].dataType.simpleString() == "int"
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Aggregate") and "Join" not in plan
    packs = [segments._pack(lines.dropna().toPandas().assign(own=0))["pack"][0]]
    few = [set(zip(a.tolist(), b.tolist(), strict=True)) for a, b in segments._pairs_that_meet(packs[0], None, 0.1, at_once=40)]
    assert len(few) > 5 and sorted(set().union(*few)) == expected and sum(map(len, few)) == len(expected)


def test_areas_with_one_ring_are_measured_once(spark, monkeypatch):
    """300 areas at two rings: the task that works out shares gets two rings, and every area has its row."""
    rings = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)], [(0.5, 0.0), (2.0, 0.0), (2.0, 2.0)]]
    areas = spark.createDataFrame([(f"a{k}", rings[k % 2]) for k in range(300)] + [("a0", rings[0])], "area string, ring array<struct<lon:double,lat:double>>")
    lines = spark.createDataFrame([(k, -1.0, 0.25 + k / 64, 3.0, 0.25 + k / 64) for k in range(5)], "seg int, x1 double, y1 double, x2 double, y2 double")
    monkeypatch.setattr(segments, "_PACKED", 2)
    found = segments.overlap_lengths(lines, areas, "seg", "area")
    got = sorted((r["seg"], r["area"], r["share"]) for r in found.collect())
    share = lambda k, ring: 0.25 if ring == 0 else (2.0 - (0.5 + (0.25 + k / 64) * 0.75)) / 4
    assert [x[:2] for x in got] == sorted([(k, f"a{n}") for k in range(5) for n in range(300)] + [(k, "a0") for k in range(5)])
    assert all(x[2] == pytest.approx(share(x[0], int(x[1][1:]) % 2)) for x in got) and found.dtypes[:2] == [("seg", "int"), ("area", "string")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(areas") < plan.index("MapInArrow")


def test_pairs_are_found_in_little_memory():
    """100,000 segments against as many others: beside them and their cells a task holds some candidates at a time."""
    k = np.arange(100_000) * 7
    x, y = 5 + (k * 37) % 1400 / 100, 46 + (k * 53) % 1200 / 100
    ends = {"x1": x, "y1": y, "x2": x + ((k * 7) % 31 - 15) / 128, "y2": y + ((k * 11) % 29 - 14) / 128}
    one, two = (segments._pack(pd.DataFrame({"own": 0, "line": k // 10 + first, **ends}))["pack"].iloc[0] for first in (0, 1 << 40))
    found = segments._pairs_that_meet(one, two, 0.05)
    tracemalloc.start()
    assert all(len(next(found)[0]) for _ in range(3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6

