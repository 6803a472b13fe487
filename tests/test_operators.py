"""Operators against plain Python on small inputs."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from terrane.functions import cost, geo, text
from terrane.operators import chains, graph, ordered, proximity, raster, trees
from terrane.plans import catalog
from terrane.session import parts_for
from terrane.sources import files
from terrane.streaming import sessions


def haversine(a, b):
    (x1, y1), (x2, y2) = a, b
    h = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(min(1, h)))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("grade, factor", [(1, 1.028), (3, 1.252), (5, 1.700), (6, 2.008), (9, 3.268), (12, 5.032), (-1, 0.955), (-3, 0.895), (-5, 0.875), (-8, 0.920), (-10, 1.000), (-15, 1.375)])
def test_slope_calibration(spark, grade, factor):
    assert one(spark, cost.slope_factor(F.lit(float(grade)), F.lit(0.0), cost.PROFILES["direct"])) == pytest.approx(factor, abs=6e-4)


@pytest.mark.parametrize("curv, at5, at10", [(45, 0.973, 1.225), (90, 1.072, 1.450), (180, 1.269, 1.900), (540, 2.056, 3.700)])
def test_curve_calibration(spark, curv, at5, at10):
    for grade, factor in ((-5.0, at5), (-10.0, at10)):
        assert one(spark, cost.slope_factor(F.lit(grade), F.lit(float(curv)), cost.PROFILES["direct"])) == pytest.approx(factor, abs=6e-4)


def test_soften_and_ferry(spark):
    assert one(spark, cost.soften(F.lit(1.5), F.lit(0.5))) == 1.25
    rows = spark.createDataFrame([(True, "no"), (True, "yes"), (False, "no")], "is_ferry boolean, bicycle string").withColumn("highway", F.lit("residential"))
    got = [r["f"] for r in rows.select(cost.edge_factor(cost.Edge(rows.columns)).alias("f")).collect()]
    assert got == [None, 8.0, None]


def test_distances_match_brute_force(spark):
    r = random.Random(3)
    left = [(i, r.uniform(5, 8), r.uniform(46, 49)) for i in range(60)]
    right = [(i, r.uniform(5, 8), r.uniform(46, 49)) for i in range(80)]
    a, b = spark.createDataFrame(left, "a long, lon double, lat double"), spark.createDataFrame(right, "b long, lon double, lat double")
    found = {(x["a"], x["b"]) for x in proximity.radius_join(a, b, 40_000).collect()}
    assert found == {(i, j) for i, x, y in left for j, u, v in right if haversine((x, y), (u, v)) <= 40_000}
    near = {x["a"]: x["b"] for x in proximity.nearest(a, b, "a", "b", first_m=5_000).collect()}
    assert near == {i: min(right, key=lambda q: (haversine((x, y), q[1:]), q[0]))[0] for i, x, y in left}
    assert one(spark, geo.haversine_m(7.0, 47.0, 7.0, 47.0)) == 0


def test_components_closure_paths(spark):
    r = random.Random(5)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(45)]
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    found = {x["node"]: x["root"] for x in graph.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {n: find(n) for n in {v for e in links for v in e}}
    arcs = [(a, b, float(r.randrange(1, 9))) for a, b in itertools.product(range(12), range(12)) if a != b and r.random() < 0.25]
    table = {}
    for a, b, c in arcs:
        table.setdefault(a, []).append((b, c))
    expected = trees.dijkstra(table, [0])
    got = {x["node"]: x["dist"] for x in graph.shortest_paths(spark.createDataFrame([(0, 0)], "node long, label long"), spark.createDataFrame(arcs, "src long, dst long, cost double")).collect()}
    assert got == {v: d for v, (d, _) in expected.items()}


def test_triangle_on_the_tolerance_goes(spark):
    edges = spark.createDataFrame([(1, 2, 5.5), (2, 3, 5.5), (1, 3, 10.0), (3, 4, 1.0)], "a long, b long, cost double")
    assert {(r["a"], r["b"]) for r in graph.drop_triangles(edges).collect()} == {(1, 2), (2, 3), (3, 4)}


def test_sentinels_close_directions(spark):
    edges = spark.createDataFrame([(1, 2, 3.0, -1.0), (2, 3, -1.0, 4.0), (3, 4, 1.0, 1.0), (4, 5, None, 2.0)], "source long, target long, cost double, reverse_cost double")
    assert {(r["src"], r["dst"]) for r in graph.both_ways(edges).collect()} == {(1, 2), (3, 2), (3, 4), (4, 3), (5, 4)}


def test_trunk_pruning_is_idempotent(spark):
    rows = [(0, 1, 10, 11), (0, 1, 11, None), (1, 2, 11, 12), (1, 2, 99, 12), (1, 2, 12, None), (2, 3, 12, 13), (2, 3, 13, None)]
    trunks = spark.createDataFrame(rows, "src long, dst long, vid long, succ long")
    border = spark.createDataFrame([(0,)], "city long")
    once = trees.prune_trunks(trunks, border)
    assert {r["vid"] for r in once.where("src = 1").collect()} == {11, 12}
    assert sorted(trees.prune_trunks(once, border).collect()) == sorted(once.collect())
    walked = trees.walk(once, spark.createDataFrame([(0, 1, 10)], "src long, dst long, vid long")).orderBy("pos").collect()
    assert [r["vid"] for r in walked] == [10, 11]


def test_decimation_keeps_ends_and_spacing(spark):
    line = [(7.0 + i * 0.001, 47.0) for i in range(50)]
    df = spark.createDataFrame([([{"lon": x, "lat": y} for x, y in line],)], "line array<struct<lon:double,lat:double>>")
    got = [(p["lon"], p["lat"]) for p in df.select(ordered.decimated(F.col("line"), 300.0).alias("t")).first()["t"]]
    kept = [line[0]]
    for p in line[1:]:
        if haversine(kept[-1], p) >= 300:
            kept.append(p)
    assert got == (kept if kept[-1] == line[-1] else [*kept, line[-1]])


def test_distance_to_high_has_no_greatest_distance(spark):
    high = [(0, 0), (3, 40), (290, 7), (291, 7), (150, 150)]
    cells = [(r, c, float((r, c) in high)) for r in range(0, 300, 1) for c in range(0, 200, 7)] + [(r, c, 1.0) for r, c in high if c % 7]
    grid = spark.createDataFrame(cells, "row long, col long, value double")
    got = {(x["row"], x["col"]): x["value"] for x in raster.distance_to_high(grid, 0.5, 30.0).collect()}
    assert len(got) == len(cells) and max(got.values()) > 64 * 30.0
    for (r, c), v in got.items():
        assert v == pytest.approx(30.0 * min(((r - y) ** 2 + (c - x) ** 2) ** 0.5 for y, x in high))
    assert {x["value"] for x in raster.distance_to_high(grid, 5.0, 30.0).collect()} == {float("inf")}


def test_distance_to_high_matches_brute_force(spark):
    r = random.Random(9)
    cells = [(i, j, float(r.randrange(100))) for i in range(20) for j in range(20)]
    got = {(x["row"], x["col"]): x["value"] for x in raster.distance_to_high(spark.createDataFrame(cells, "row long, col long, value double"), 95, 30.0, tile=8, halo=6).collect()}
    high = [(i, j) for i, j, v in cells if v > 95]
    for i, j, _ in cells:
        assert got[i, j] == pytest.approx(30 * min(6.0, min(math.dist((i, j), h) for h in high)))


def test_station_names_and_modes(spark):
    names = ["Leoben Hauptbahnhof 3", "Wörgl Hbf", "X g2", "Kolín,Tatradomy", ""]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(text.station_key(F.col("n")).alias("k"), text.station_mode(F.col("n")).alias("m")).collect()
    assert [r["k"] for r in rows] == ["leoben hauptbahnhof", "wörgl hauptbahnhof", "x", "kolín,tatradomy", ""]
    assert [r["m"] for r in rows] == ["rail", "rail", "unknown", "bus", "unknown"]


def test_miles_guard(spark):
    got = [r["x"] for r in spark.createDataFrame([(14.9,), (15.0,), (50.0,), (50.1,)], "k double").select(text.miles_guard(F.col("k")).alias("x")).collect()]
    assert got == pytest.approx([14.9, 15 * 1.60934, 50 * 1.60934, 50.1])


def test_files_round_trip(spark, tmp_path):
    points = spark.createDataFrame([(7.5, 47.5, "a", 1), (8.5, 47.5, "b", 2)], "lon double, lat double, name string, n long")
    files.write_geojson_lines(points, f"{tmp_path}/g")
    back = files.read_geojson_lines(spark, f"{tmp_path}/g", "name string, n long")
    assert {(r["name"], r["n"], r["geometry_type"]) for r in back.collect()} == {("a", 1, "Point"), ("b", 2, "Point")}
    files.write_cells(points, f"{tmp_path}/c")
    assert [r["name"] for r in files.read_cells(spark, f"{tmp_path}/c", (8.0, 47.0, 9.0, 48.0)).collect()] == ["b"]
    (tmp_path / "log").write_text('x [chat-trace] {"event": "round_end", "ms": 5}\nnothing\n[chat-trace] {bad\n')
    assert [r["ms"] for r in files.read_traces(spark, f"file://{tmp_path}/log", "event string, ms long").collect()] == [5]
    (tmp_path / "stops.csv").write_text('﻿stop_id,stop_name\n1,"A, B"\n', encoding="utf-8")
    assert files.read_gtfs(spark, f"file://{tmp_path}/stops.csv", "stop_name stop_id stop_lat").collect()[0][:3] == ("A, B", "1", None)
    trunks = spark.createDataFrame([(0, 1, 5, None)], "src long, dst long, vid long, succ long")
    assert [files.append_trunks(trunks, f"{tmp_path}/t") for _ in range(2)] == [1, 0]


def test_stream_equals_table(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    stream = sessions.windowed_counts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    run = stream.writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    key = lambda df: sorted((r["w"]["start"], r["event_type"], r["n"]) for r in df.collect())
    assert key(spark.table("windowed")) == key(sessions.windowed_counts(spark.read.parquet(f"{tmp_path}/in")))


def test_first_steps_are_zero(spark):
    """A line starts at 0 metres: the distance from a point that isn't there is null, not half the globe."""
    from terrane.functions import geo
    from terrane.operators import ordered

    line = spark.createDataFrame([(1, 0, 10.0, 50.0), (1, 1, 10.0, 51.0), (2, 0, 5.0, 5.0)], "line long, seq long, lon double, lat double")
    found = {(r["line"], r["seq"]): r["cum_m"] for r in ordered.with_steps(line, "line", ["seq"]).collect()}
    assert found[1, 0] == found[2, 0] == 0 and abs(found[1, 1] - 111_194.9) < 1
    assert line.select(geo.haversine_m(F.lit(None).cast("double"), 1.0, 2.0, 3.0).alias("d")).first()["d"] is None


def test_trunks_keep_what_the_pair_needs(spark):
    """10 <- 11 <- 12 with 12 on the frontier: where the other tree holds 12, nothing leads there and the pair has no trunk."""
    from terrane.operators import trees

    tree = spark.createDataFrame([(1, 10, None, 0.0, False), (1, 11, 10, 1.0, False), (1, 12, 11, 2.0, True), (2, 12, None, 0.0, False), (3, 99, None, 0.0, False)], trees.TREE)
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "src long, dst long")
    found = {tuple(r) for r in trees.build_trunks(tree, pairs).collect()}
    assert found == {(1, 3, 10, None), (1, 3, 11, 10), (1, 3, 12, 11)}
    assert {r["src"] for r in trees.direct_trunks(pairs, trees.build_trunks(tree, pairs)).collect()} == {1}


def test_stages_end_at_stops_on_the_way(spark):
    from terrane.operators import ordered

    line = spark.createDataFrame([(1, k, k * 0.1, 0.0) for k in range(101)], "line long, seq long, lon double, lat double")
    plain = [r["pos"] for r in ordered.stage_ends(line, "line", ["seq"], 400.0).orderBy("stage").collect()]
    assert plain == [34, 68, 101]
    vias = spark.createDataFrame([(1, 0, 2.01, 0.05), (1, 1, 1.0, 0.0)], "line long, k long, lon double, lat double")
    stops = [r["pos"] for r in ordered.stage_ends(line, "line", ["seq"], 400.0, vias).orderBy("stage").collect()]
    assert stops == [21, 61, 101]
    known = spark.createDataFrame([(1, 2200.0)], "line long, km double")
    longer = ordered.stage_ends(line, "line", ["seq"], 400.0, None, known).orderBy("stage").collect()
    assert len(longer) == 6 and abs(sum(r["stage_km"] for r in longer) - 2200) < 1


def test_piers_dock_once(spark):
    """The least pier stays and takes those near it; what only a lost pier was near to stays."""
    from terrane.operators import chains

    r = random.Random(4)
    rows = [(k, 10 + r.random() * 0.05, 50 + r.random() * 0.05) for k in range(120)]
    kept: list = []
    metres = lambda a, b: 2 * 6_371_000 * math.asin(math.sqrt(math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2))
    for p in rows:
        if all(metres(p, q) > 500 for q in kept):
            kept.append(p)
    found = chains.dock_once(spark.createDataFrame(rows, "pier long, lon double, lat double"))
    assert sorted(x["pier"] for x in found.collect()) == [p[0] for p in kept] and 5 < len(kept) < 120


def test_station_clusters_look_around(spark):
    """A cluster that has drifted is found from the buckets around a stop; the order of ids decides."""
    from terrane.operators import chains

    r = random.Random(9)
    rows = [(k, "x", 10 + r.random() * 0.01, 50 + r.random() * 0.01) for k in range(80)]
    clusters: list = []
    expected = {}
    for k, _, lon, lat in rows:
        fits = [c for c in clusters if abs(c[0] - lon) < 0.001 and abs(c[1] - lat) < 0.001 and abs(int(c[4] / 0.001) - int(lon / 0.001)) < 3 and abs(int(c[5] / 0.001) - int(lat / 0.001)) < 3]
        if len(fits) > 1:  # the search order over buckets decides
            at = lambda c: min((j, i, clusters.index(c)) for j in (-1, 0, 1) for i in (-1, 0, 1) if abs(int(lon / 0.001) + i - int(c[4] / 0.001)) < 2 and abs(int(lat / 0.001) + j - int(c[5] / 0.001)) < 2)
            fits.sort(key=at)
        if fits:
            c = fits[0]
            c[0], c[1], c[2] = (c[0] * c[2] + lon) / (c[2] + 1), (c[1] * c[2] + lat) / (c[2] + 1), c[2] + 1
        else:
            c = [lon, lat, 1, k, lon, lat]
            clusters.append(c)
        expected[k] = c[3]
    found = {x["stop"]: x["cluster"] for x in chains.cluster_stations(spark.createDataFrame(rows, "stop long, name_key string, lon double, lat double")).collect()}
    assert found == expected


def test_generated_cost_methods_are_small(spark):
    """Methods above 8,000 bytes are never compiled by the JVM."""
    from terrane.plans import catalog

    debug = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$")
    for name in ("cost_direct", "cost_scenic", "cost_direct_multi"):
        stages = debug.codegenStringSeq(catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan())
        assert all(stages.apply(i)._3().maxMethodCodeSize() < 8000 for i in range(stages.size()))


def test_bracketed_paths_are_sorted_once(spark):
    walks = spark.createDataFrame([(1, 2, 5, 70), (1, 2, 3, 71), (1, 2, 9, 72), (4, 2, 1, 70)], "src long, dst long, pos long, vid long")
    found = chains.bracketed_path(walks)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, 2, -3, 71), (1, 2, 71, 70), (1, 2, 70, 72), (1, 2, 72, -4), (1, 2, -4, None), (4, 2, -6, 70), (4, 2, 70, -4), (4, 2, -4, None)], key=str)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Aggregate" not in plan
    assert parts_for(spark, 10) == 4 and parts_for(spark, 10_000_001) == 11


def test_pairs_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(graph, "parts_for", lambda _, n: asked.append(n) or max(4, -(-n // 20)))
    rows = [(m, g) for g in range(6) for m in range(g + 3)] * 2 + [(None, 1), (3, None)]
    found = graph.co_members(spark.createDataFrame(rows, "m long, g long"), "m", "g")
    n_pairs = sum((g + 3) * (g + 2) // 2 for g in range(6))
    assert {(x["a"], x["b"]): x["n_shared"] for x in found.collect()} == {(a, b): sum(b < g + 3 for g in range(6)) for a in range(8) for b in range(a + 1, 8)}
    assert asked == [len(rows), n_pairs] and f"{-(-n_pairs // 20)}" in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_fill_deals_its_rows_to_as_many_tasks_as_they_need(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(graph, "parts_for", lambda _, n: asked.append(n) or 7)
    rows = [(w, w // 3, "a") for w in range(30)] + [(w + 1, w // 3, "a") for w in range(0, 12)] + [(40, 1, ""), (41, 1, None), (42, 1, "b")]
    ways = spark.createDataFrame(rows, "way long, vertex long, name string")
    found = graph.flood_fill(ways, spark.createDataFrame([(0,)], "way long"))
    assert {x["way"] for x in found.collect()} == set(range(15)) and asked == [len(rows)]


@pytest.mark.parametrize("name", ["corridor_edges", "corridor_sizes", "spt_trees"])
def test_trees_and_corridors_broadcast_no_table(spark, sf, name):
    # whatever the files' sizes; the one row with the lattice's width is joined by a nested loop
    plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
