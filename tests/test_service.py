"""The tools and the whole build on a small network."""

import pytest
from pyspark.sql import functions as F

from terrane import service
from terrane.plans import rebuild


@pytest.fixture(scope="module")
def net(spark):
    anchors = spark.createDataFrame(
        [(1, "db:1", "Wien", 1900000, "austria", 16.37, 48.21), (2, "db:2", "Linz", 200000, "austria", 14.29, 48.30), (3, "db:3", "Praha", 1300000, "czech-republic", 14.42, 50.09), (4, "db:4", "Linzgau", None, "germany", 9.2, 47.8)],
        "anchor long, ref string, name string, population long, country string, lon double, lat double",
    )
    stations = spark.createDataFrame([(10, "Wien Hbf", 5, None, 16.38, 48.19), (11, "Linz Hauptbahnhof", 9, 4, 14.29, 48.29), (12, "Linz, Markt", 9, 0, 14.28, 48.30)], "station long, name string, n_routes long, n_routes_rail long, lon double, lat double")
    services = spark.createDataFrame([(10, "RJ"), (11, "RJ"), (11, "S1"), (12, "B1")], "station long, route string")
    pois = spark.createDataFrame([(1, "lodging", "hotel", "H", '{"contact:website": "http://h"}', 16.371, 48.211), (2, "food", "cafe", "C", "{}", 16.38, 48.22)], "poi long, category string, subtype string, name string, tags string, lon double, lat double")
    chain = spark.createDataFrame([(1, 2, 180000.0), (2, 1, 180000.0), (2, 3, 230000.0), (3, 2, 230000.0), (1, 3, 500000.0)], "src long, dst long, cost double")
    return service.Network(anchors, stations, services, pois, chain)


def test_search_by_other_names(net):
    assert [r["ref"] for r in service.call(net, "search_anchors", query=" Vienna ").collect()] == ["db:1"]
    assert [r["ref"] for r in service.call(net, "search_anchors", query="linz").collect()] == ["db:2", "db:4"]
    assert service.call(net, "search_anchors", query=" ").count() == 0


def test_near_and_lodging(net):
    assert [(r["station"], r["mode"]) for r in service.call(net, "stations_near", lon=14.29, lat=48.30, min_routes=1).collect()] == [(11, "rail")]
    assert service.call(net, "search_lodging", lon=16.37, lat=48.21).first()["website"] == "http://h"
    assert [r["poi"] for r in service.call(net, "pois_near_anchor", ref="db:1", category="food").collect()] == [2]
    assert service.call(net, "pois_near_anchor", ref="db:9", category="food").columns == ["error"]
    assert service.call(net, "nothing").columns == ["error"]


def test_routes(net):
    got = service.call(net, "route", from_ref="db:1", to_ref="db:3").collect()
    assert [r["anchor"] for r in got] == [1, 2, 3] and got[0]["km"] == pytest.approx(410 * 1.2)
    direct = service.call(net, "direct_rail_service", pairs=[("db:1", "db:2"), ("db:1", "db:3")]).collect()
    assert [(r["direct"], r["routes"]) for r in direct] == [(True, ["RJ"]), (False, None)]
    assert [r["anchor"] for r in service.call(net, "rail_path", from_ref="db:1", to_ref="db:2").collect()] == [1, 2]
    links = service.call(net, "train_booking_links", from_ref="db:1", to_ref="db:2", date="2024-05-01").collect()
    assert links[0]["operator"] == "ÖBB Scotty" and "date=01.05.2024" in links[0]["url"] and len(links) == 3


def test_a_route_is_not_lost_in_a_long_chain(spark, net):
    """A way of two arcs at the head of a chain that takes more rounds than a search may have."""
    arcs = spark.range(1, 3000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(7.0).alias("cost")).where("src <> 2")
    arcs = arcs.unionByName(spark.createDataFrame([(1, 3, 21.0), (2, 3, 13.0), (2, 3, 15.0)], "src long, dst long, cost double"))
    long = service.Network(net.anchors, net.stations, net.services, net.pois, arcs)
    assert [(r["anchor"], r["dist_m"]) for r in service.call(long, "route", from_ref="db:1", to_ref="db:3").collect()] == [(1, 0.0), (2, 7.0), (3, 20.0)]
    assert [(r["anchor"], r["dist_m"]) for r in service.call(long, "route", from_ref="db:2", to_ref="db:2").collect()] == [(2, 0.0)]


def test_along_a_line(spark, net):
    line = spark.createDataFrame([(1, k, 16.37 - k * 0.02, 48.21) for k in range(105)], "line long, seq long, lon double, lat double")
    assert [r["station"] for r in service.call(net, "stations_along_route", line=line, corridor_km=12.0, min_routes=1).collect()] == [10, 11]
    assert [r["poi"] for r in service.call(net, "pois_along_route", line=line, category="lodging").collect()] == [1]
    stages = service.call(net, "split_into_stages", line=line, target_km=52.0).collect()
    assert [r["stage"] for r in stages] == [1, 2, 3] and stages[-1]["overnight"] == "Linz"


def test_stages_end_at_vias(spark, net):
    line = spark.createDataFrame([(1, k, 16.37 - k * 0.02, 48.21) for k in range(105)], "line long, seq long, lon double, lat double")
    anchors = net.anchors.unionByName(spark.createDataFrame([(5, "db:5", "Melk", 5000, "austria", 15.33, 48.22)], net.anchors.schema))
    more = service.Network(anchors, net.stations, net.services, net.pois, net.chain)
    stages = service.call(more, "split_into_stages", line=line, target_km=52.0, via_refs=("db:5",)).collect()
    assert [r["overnight"] for r in stages if abs(sum(x["stage_km"] for x in stages if x["stage"] <= r["stage"]) - 77.1) < 2] == ["Melk"]
    assert sum(r["stage_km"] for r in service.call(more, "split_into_stages", line=line, target_km=52.0, known_km=200.0).collect()) == pytest.approx(200.0, abs=0.3)
    assert service.call(more, "split_into_stages", line=line, target_km=52.0, via_refs=("db:77",)).first()["error"] == "unknown ref: db:77"


def test_failures_are_values(net):
    assert "TypeError" in service.call(net, "route", wrong=1).first()["error"]
    assert service.call(net, "stations_near", lon="a column that isn't there", lat=1.0).columns == ["error"]


def test_whole_build(spark):
    n = 24
    vertices = spark.createDataFrame([(i * n + j, 10 + i * 0.02, 48 + j * 0.02, 0.0) for i in range(n) for j in range(n)], "id long, lon double, lat double, elev double")
    links = [(a, b) for i in range(n) for j in range(n) for a, b in ((i * n + j, (i + 1) * n + j if i + 1 < n else -1), (i * n + j, i * n + j + 1 if j + 1 < n else -1)) if b >= 0]
    edges = spark.createDataFrame([(k, a, b, 1500.0 + (k % 7), "residential") for k, (a, b) in enumerate(links)], "gid long, source long, target long, length double, highway string")
    places = vertices.where(F.col("id").isin(100, 101, 320, 130, 445)).select(F.col("id").alias("place"), (F.col("id") * 10).alias("population"), "lon", "lat")
    out = rebuild.build(vertices, edges, places, spacing_m=5_000.0, reach_m=60_000.0, polygon_m=25_000.0)
    assert {r["place"] for r in out["anchors"].collect()} == {101, 320, 130, 445}
    tree = {(r["city"], r["vid"]): r for r in out["trees"].collect()}
    assert all(r["parent"] is None or tree[r["city"], r["parent"]]["cost"] < r["cost"] for r in tree.values())
    trunks, pruned = out["trunks"], out["pruned"]
    assert pruned.join(trunks, ["src", "dst", "vid"], "left_anti").count() == 0
    assert pruned.select("src", "dst").distinct().count() == trunks.select("src", "dst").distinct().count() == 2 * out["chain"].count()
