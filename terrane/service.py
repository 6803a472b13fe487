"""The query service: named tools over a network's tables. Each gives a DataFrame; unknown names give an error as a value."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import geo, text
from terrane.operators import chains, graph, ordered, proximity, relational


@dataclass
class Network:
    """What the tools read.

    anchors (anchor, ref, name, population, country, lon, lat); stations (station, name, n_routes, n_routes_rail, lon, lat);
    services (station, route); pois (poi, category, subtype, name, tags, lon, lat), tags being a JSON text; chain (src, dst,
    cost in metres) between anchors.
    """

    anchors: DataFrame
    stations: DataFrame
    services: DataFrame
    pois: DataFrame
    chain: DataFrame


def _anchor(net: Network, ref: str) -> dict[str, Any] | None:
    row = net.anchors.where(F.col("ref") == ref).limit(1).collect()
    return row[0].asDict() if row else None


def _error(net: Network, message: str) -> DataFrame:
    return net.anchors.sparkSession.createDataFrame([(message,)], "error string")


def search_anchors(net: Network, query: str, limit: int = 10) -> DataFrame:
    """Anchors whose name begins with the query (or its form in another language), then those that contain it; the most
    populous first."""
    variants, low = text.query_variants(query), F.lower("name")
    if not variants:
        return net.anchors.limit(0)
    prefix = contains = F.lit(False)
    for v in variants:
        prefix, contains = prefix | F.startswith(low, F.lit(v)), contains | F.contains(low, F.lit(v))
    return net.anchors.where(contains).orderBy(F.when(prefix, 0).otherwise(1), F.desc(F.coalesce("population", F.lit(0))), "ref").limit(limit)


def stations_near(net: Network, lon: float, lat: float, radius_km: float = 5.0, limit: int = 20, min_routes: int = 0) -> DataFrame:
    dist = geo.haversine_m(lon, lat, "lon", "lat")
    rail = F.coalesce("n_routes_rail", "n_routes")
    near = net.stations.where((dist <= radius_km * 1000) & (rail >= min_routes)).withColumns({"dist_m": F.round(dist, 0), "mode": text.station_mode(F.col("name"))})
    return near.orderBy("dist_m", "station").limit(limit)


def pois_near_anchor(net: Network, ref: str, category: str, radius_km: float = 5.0, limit: int = 15) -> DataFrame:
    at = _anchor(net, ref)
    if at is None:
        return _error(net, f"unknown anchor ref: {ref}")
    dist = geo.haversine_m(at["lon"], at["lat"], "lon", "lat")
    return net.pois.where((F.col("category") == category) & (dist <= radius_km * 1000)).withColumn("dist_m", F.round(dist, 0)).orderBy("dist_m", "poi").limit(limit)


def search_lodging(net: Network, lon: float, lat: float, radius_km: float = 1.5, limit: int = 12, subtypes: tuple[str, ...] = text.LODGING) -> DataFrame:
    dist = geo.haversine_m(lon, lat, "lon", "lat")
    tag = lambda *names: F.coalesce(*[F.get_json_object("tags", f"$['{n}']") for n in names])
    near = net.pois.where((F.col("category") == "lodging") & F.col("subtype").isin(*subtypes) & (dist <= radius_km * 1000))
    return near.select("poi", "name", "subtype", F.round(dist, 0).alias("dist_m"), tag("website", "contact:website").alias("website"), tag("phone", "contact:phone").alias("phone")).orderBy("dist_m", "poi").limit(limit)


def route(net: Network, from_ref: str, to_ref: str) -> DataFrame:
    """(anchor, dist_m) of the cheapest chain between two anchors, in order, with ``km`` for the whole."""
    a, b = _anchor(net, from_ref), _anchor(net, to_ref)
    if a is None or b is None:
        return _error(net, f"unknown ref: {from_ref if a is None else to_ref}")
    spark = net.anchors.sparkSession
    best = graph.shortest_paths(spark.createDataFrame([(a["anchor"], a["anchor"])], "node long, label long"), net.chain, target=b["anchor"])
    back = graph.closure(spark.createDataFrame([(b["anchor"],)], "node long"), best.where("parent IS NOT NULL").select(F.col("node").alias("src"), F.col("parent").alias("dst")))
    found = best.join(back, "node", "left_semi").select(F.col("node").alias("anchor"), F.col("dist").alias("dist_m"))
    total = F.max("dist_m").over(Window.partitionBy()) * 1.20 / 1000
    return found.withColumn("km", F.round(total, 1)).orderBy("dist_m")


def stations_along_route(net: Network, line: DataFrame, corridor_km: float = 8.0, min_routes: int = 2, limit: int = 20) -> DataFrame:
    """Stations near a polyline (line, seq, lon, lat) by the kilometre at which they are nearest."""
    steps = ordered.with_steps(line, "line", ["seq"]).select("line", "seq", "cum_m", "lon", "lat")
    some = net.stations.where(F.coalesce("n_routes_rail", "n_routes") >= min_routes).select("station", "name", "lon", "lat")
    pairs = proximity.radius_join(steps, some, corridor_km * 1000)
    at = pairs.groupBy("line", "station", "name").agg(F.min_by(F.struct("cum_m", "dist_m"), F.struct("dist_m", "seq")).alias("x"))
    return at.select("line", "station", "name", F.round(F.col("x.cum_m") / 1000, 1).alias("km"), F.round("x.dist_m", 0).alias("off_m")).orderBy("line", "km", "station").limit(limit)


def pois_along_route(net: Network, line: DataFrame, category: str, buffer_km: float = 3.0, limit: int = 30) -> DataFrame:
    """Points of a category by their distance to the nearest vertex of a polyline."""
    some = net.pois.where(F.col("category") == category).select("poi", "name", "lon", "lat")
    near = proximity.radius_join(line.select("seq", "lon", "lat"), some, buffer_km * 1000).groupBy("poi", "name").agg(F.round(F.min("dist_m"), 0).alias("off_m"))
    return near.orderBy("off_m", "poi").limit(limit)


def split_into_stages(net: Network, line: DataFrame, target_km: float, via_refs: tuple[str, ...] = (), known_km: float | None = None) -> DataFrame:
    """Stages of about ``target_km`` (values from 15 to 50 are taken as miles), each with the anchor nearest to its end.

    Every anchor of ``via_refs``, in their order, ends a stage where the line is nearest to it; ``known_km`` is the length
    that the line's own is scaled to.
    """
    km = target_km * 1.60934 if 15 <= target_km <= 50 else target_km
    spark, lines = net.anchors.sparkSession, line.select("line").distinct()
    wanted = spark.createDataFrame([(k, ref) for k, ref in enumerate(via_refs)], "k int, ref string")
    stops = wanted.join(net.anchors.select("ref", F.col("lon").alias("v_lon"), F.col("lat").alias("v_lat")), "ref", "left")
    if via_refs and (lost := stops.where("v_lon IS NULL").first()):
        return _error(net, f"unknown ref: {lost['ref']}")
    # the vias are what the caller names: a handful
    vias = lines.join(F.broadcast(stops)).select("line", "k", F.col("v_lon").alias("lon"), F.col("v_lat").alias("lat")) if via_refs else None
    lengths = lines.withColumn("km", F.lit(float(known_km))) if known_km else None
    ends = ordered.stage_ends(line, "line", ["seq"], km, vias, lengths)
    place = line.withColumn("pos", F.row_number().over(Window.partitionBy("line").orderBy("seq"))).join(ends, ["line", "pos"])
    at = place.select(F.struct("line", "stage").alias("end"), "lon", "lat", "line", "stage", "stage_km")
    near = proximity.nearest(at, net.anchors, "end", "anchor").select("end", "anchor")
    return at.join(near, "end", "left").join(net.anchors.select("anchor", F.col("name").alias("overnight")), "anchor", "left").select("line", "stage", "stage_km", "overnight").orderBy("line", "stage")


def direct_rail_service(net: Network, pairs: list[tuple[str, str]], radius_km: float = 5.0, min_routes: int = 1) -> DataFrame:
    """For each pair of anchor refs, in order: the routes that serve a station near both."""
    spark = net.anchors.sparkSession
    wanted = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "pair long, from_ref string, to_ref string")
    some = net.stations.where(F.coalesce("n_routes_rail", "n_routes") >= min_routes).select(F.col("station").alias("stop"), "lon", "lat")

    def side(ref: str) -> DataFrame:
        at = wanted.join(net.anchors.select(F.col("ref").alias(ref), "lon", "lat"), ref).select("pair", "lon", "lat")
        return proximity.radius_join(at, some, radius_km * 1000).select("pair", "stop")

    shared = relational.shared_services(net.services.select(F.col("station").alias("stop"), "route"), side("from_ref"), side("to_ref"))
    found = wanted.join(shared, "pair", "left")
    return found.select("pair", "from_ref", "to_ref", F.coalesce(F.size("routes") > 0, F.lit(False)).alias("direct"), F.slice("routes", 1, 20).alias("routes")).orderBy("pair")


def rail_path(net: Network, from_ref: str, to_ref: str, radius_km: float = 5.0) -> DataFrame:
    """As ``route``, over the graph of anchors that share a route."""
    near = proximity.radius_join(net.anchors.select("anchor", "lon", "lat"), net.stations.select("station", "lon", "lat"), radius_km * 1000).select("anchor", "station")
    served = near.join(net.services, "station").select("anchor", "route").distinct()
    arcs = chains.rail_graph(served, net.anchors).withColumn("cost", F.col("cost") * 1000)
    return route(Network(net.anchors, net.stations, net.services, net.pois, arcs), from_ref, to_ref)


def train_booking_links(net: Network, from_ref: str, to_ref: str, date: str | None = None) -> DataFrame:
    a, b = _anchor(net, from_ref), _anchor(net, to_ref)
    if a is None or b is None:
        return _error(net, f"unknown ref: {from_ref if a is None else to_ref}")
    day = F.lit(date) if date else None
    links = text.booking_links(F.lit(a["name"]), F.lit(b["name"]), F.lit(a["country"]), F.lit(b["country"]), day)
    return net.anchors.sparkSession.range(1).select(F.explode(links).alias("x")).select("x.operator", "x.url")


TOOLS: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in (search_anchors, stations_near, pois_near_anchor, search_lodging, route, stations_along_route, pois_along_route, split_into_stages, direct_rail_service, rail_path, train_booking_links)
}


def call(net: Network, tool: str, **arguments: Any) -> DataFrame:
    """A tool by its name. What goes wrong while it is planned (a wrong argument, an unknown column) is told as a row
    (error), as an unknown name is."""
    if tool not in TOOLS:
        return _error(net, f"unknown tool: {tool}")
    try:
        return TOOLS[tool](net, **arguments)
    except Exception as e:  # noqa: BLE001 - the caller gets every failure as a value
        return _error(net, f"{type(e).__name__}: {e}".splitlines()[0])
