"""Stand-ins: the driver's tables read as stations, edges, polylines and grids, and the same in SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.session import table

R = "6371000.0"


def rounded(value: Column | str, digits: int) -> Column:
    """Rounded half up by the same steps in every engine; built-in roundings differ on ties."""
    size = float(10**digits)
    return F.floor((F.col(value) if isinstance(value, str) else value) * size + 0.5).cast("double") / size


def rounded_sql(value: str, digits: int) -> str:
    return f"(floor(({value}) * {10**digits}::DOUBLE + 0.5::DOUBLE) / {10**digits}::DOUBLE)"


def lon_of(k: str) -> Column:
    return F.lit(5.0) + F.pmod(F.col(k) * 37, F.lit(1400)) / 100.0


def lat_of(k: str) -> Column:
    return F.lit(46.0) + F.pmod(F.col(k) * 53, F.lit(1200)) / 100.0


def lon_sql(k: str) -> str:
    return f"(5.0::DOUBLE + (({k} * 37) % 1400)::DOUBLE / 100.0::DOUBLE)"


def lat_sql(k: str) -> str:
    return f"(46.0::DOUBLE + (({k} * 53) % 1200)::DOUBLE / 100.0::DOUBLE)"


def haversine_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    h = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"(2 * {R}::DOUBLE * asin(sqrt(CASE WHEN {h} > 1 THEN 1.0 ELSE {h} END)))"


def bearing_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return (
        f"((degrees(atan2(sin(radians({lon2} - {lon1})) * cos(radians({lat2})), cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) "
        f"* cos(radians({lat2})) * cos(radians({lon2} - {lon1})))) + 360) % 360)"
    )


def stations(spark: SparkSession, d: str) -> DataFrame:
    """customer as stations: id, name, kind, routes."""
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"), F.col("c_acctbal").alias("weight"), lon_of("c_custkey").alias("lon"), lat_of("c_custkey").alias("lat"))


STATIONS = f"stations AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS kind, c_acctbal AS weight, {lon_sql('c_custkey')} AS lon, {lat_sql('c_custkey')} AS lat FROM customer)"


def anchors(spark: SparkSession, d: str) -> DataFrame:
    """supplier as anchors: ref, name, population."""
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("anchor"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("population"), F.col("s_nationkey").alias("nation"), lon_of("s_suppkey").alias("lon"), lat_of("s_suppkey").alias("lat"))


ANCHORS = f"anchors AS (SELECT s_suppkey AS anchor, s_name AS name, s_acctbal AS population, s_nationkey AS nation, {lon_sql('s_suppkey')} AS lon, {lat_sql('s_suppkey')} AS lat FROM supplier)"


def vertices(spark: SparkSession, d: str) -> DataFrame:
    """part as vertices: id, elevation."""
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("elev"), lon_of("p_partkey").alias("lon"), lat_of("p_partkey").alias("lat"))


VERTICES = f"vertices AS (SELECT p_partkey AS id, p_size::DOUBLE AS elev, {lon_sql('p_partkey')} AS lon, {lat_sql('p_partkey')} AS lat FROM part)"

_CLASSES = ("cycleway", "residential", "track", "path", "primary", "motorway", "footway", "unknown")
_SURFACES = ("", "asphalt", "gravel", "sand", "dirt")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as edges between parts: gid, source, target, tags, length, signals; one-way where the status is F."""
    li = table(spark, d, "lineitem")
    pick = lambda names, k: F.element_at(F.array(*[F.lit(x) for x in names]), (F.pmod(k, F.lit(len(names))) + 1).cast("int"))
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("gid"),
        F.col("l_partkey").alias("source"),
        F.col("l_suppkey").alias("target"),
        pick(_CLASSES, F.col("l_partkey")).alias("highway"),
        pick(_SURFACES, F.col("l_suppkey")).alias("surface"),
        F.when(F.pmod(F.col("l_partkey"), F.lit(3)) == 0, "grade3").otherwise("").alias("tracktype"),
        F.when(F.col("l_returnflag") == "R", "no").when(F.col("l_returnflag") == "A", "yes").otherwise("").alias("bicycle"),
        (F.col("l_linestatus") == "F").alias("oneway"),
        F.col("l_quantity").cast("double").alias("length"),
        F.col("l_discount").cast("double").alias("forest_local"),
        F.col("l_tax").cast("double").alias("water_local"),
        (F.col("l_quantity") * 3).cast("double").alias("local_relief"),
        (F.col("l_discount") * 10).cast("double").alias("canopy_frac"),
        (F.pmod(F.col("l_orderkey"), F.lit(25)) - 12).cast("double").alias("grade"),
        (F.pmod(F.col("l_orderkey"), F.lit(7)) * 30).cast("double").alias("curv"),
    )


def _case(names: tuple[str, ...], k: str) -> str:
    return "CASE " + " ".join(f"WHEN {k} % {len(names)} = {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


EDGES = f"""edges AS (SELECT l_orderkey * 10 + l_linenumber AS gid, l_partkey AS source, l_suppkey AS target, {_case(_CLASSES, 'l_partkey')} AS highway,
 {_case(_SURFACES, 'l_suppkey')} AS surface, CASE WHEN l_partkey % 3 = 0 THEN 'grade3' ELSE '' END AS tracktype,
 CASE WHEN l_returnflag = 'R' THEN 'no' WHEN l_returnflag = 'A' THEN 'yes' ELSE '' END AS bicycle, l_linestatus = 'F' AS oneway, l_quantity::DOUBLE AS length,
 l_discount::DOUBLE AS forest_local, l_tax::DOUBLE AS water_local, (l_quantity * 3)::DOUBLE AS local_relief, (l_discount * 10)::DOUBLE AS canopy_frac,
 ((l_orderkey % 25) - 12)::DOUBLE AS grade, ((l_orderkey % 7) * 30)::DOUBLE AS curv FROM lineitem)"""


def city_arcs(spark: SparkSession, d: str) -> DataFrame:
    """Directed arcs between nations: the customer's to the supplier's, cost by the number of shared line items."""
    o, c, li, s = (table(spark, d, t) for t in ("orders", "customer", "lineitem", "supplier"))
    j = li.select("l_orderkey", "l_suppkey").join(o.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey")
    j = j.join(c.select("c_custkey", "c_nationkey"), "c_custkey").join(s.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    arcs = j.where("c_nationkey <> s_nationkey").groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.count("*").alias("n"))
    # costs are whole numbers, so sums are exact in any order
    return arcs.select("src", "dst", (F.col("n") % 97 + F.lit(1)).cast("double").alias("cost"))


CITY_ARCS = """arcs AS (SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, (count(*) % 97 + 1)::DOUBLE AS cost FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2)"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    """The orders of a customer in time as a polyline: line, seq, lon, lat."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("line"), "o_orderdate", F.col("o_orderkey").alias("seq"), lon_of("o_orderkey").alias("lon"), lat_of("o_orderkey").alias("lat"), (F.col("o_totalprice") / 1000).alias("elev"))


LINES = f"lines AS (SELECT o_custkey AS line, o_orderdate, o_orderkey AS seq, {lon_sql('o_orderkey')} AS lon, {lat_sql('o_orderkey')} AS lat, o_totalprice / 1000 AS elev FROM orders)"


def tracks(spark: SparkSession, d: str) -> DataFrame:
    """Every order as a short straight track: line (its customer), seg, x1, y1, x2, y2."""
    k = F.col("seg")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("line"), F.col("o_orderkey").alias("seg")).withColumns({"x1": lon_of("seg"), "y1": lat_of("seg")})
    return o.select("line", "seg", "x1", "y1", (F.col("x1") + (F.pmod(k * 7, F.lit(31)) - 15) / 128.0).alias("x2"), (F.col("y1") + (F.pmod(k * 11, F.lit(29)) - 14) / 128.0).alias("y2"))


TRACKS = f"""tracks AS MATERIALIZED (SELECT line, seg, x1, y1, x1 + ((seg * 7) % 31 - 15)::DOUBLE / 128.0::DOUBLE AS x2, y1 + ((seg * 11) % 29 - 14)::DOUBLE / 128.0::DOUBLE AS y2
 FROM (SELECT o_custkey AS line, o_orderkey AS seg, {lon_sql('o_orderkey')} AS x1, {lat_sql('o_orderkey')} AS y1 FROM orders))"""
STEPS = f"""steps AS (SELECT *, coalesce({haversine_sql('plon', 'plat', 'lon', 'lat')}, 0.0) AS step_m FROM (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat, row_number() OVER w AS pos
 FROM lines WINDOW w AS (PARTITION BY line ORDER BY o_orderdate, seq))),
 cums AS (SELECT *, sum(step_m) OVER (PARTITION BY line ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cum_m FROM steps)"""
ORDER = ["o_orderdate", "seq"]


def grid(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as a raster: row and column by part and supplier, the value a whole number."""
    li = table(spark, d, "lineitem")
    return li.groupBy(F.pmod("l_partkey", F.lit(60)).alias("row"), F.pmod("l_suppkey", F.lit(50)).alias("col")).agg(F.max("l_quantity").cast("double").alias("value"))


GRID = "grid AS (SELECT l_partkey % 60 AS row, l_suppkey % 50 AS col, max(l_quantity)::DOUBLE AS value FROM lineitem GROUP BY 1, 2)"


#: Degrees between neighbours of the lattice, and of a tile of it.
LATTICE_STEP, LATTICE_TILE = 0.01, 0.16


def lattice(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A road-like lattice over all parts, about as wide as it is long: vertices (vid, lon, lat) and arcs (src, dst, cost).

    Costs are whole numbers and differ by direction; where the part's number says so, a road is missing. A table of parts is
    small as a file and not in memory, so it is never broadcast.
    """
    p = table(spark, d, "part")
    wide = p.agg(F.ceil(F.sqrt(F.count("*").cast("double"))).alias("wide"))
    k = F.col("vid")
    v = p.select(F.col("p_partkey").alias("vid")).join(F.broadcast(wide))  # one row
    places = v.select("vid", "wide", (10 + F.pmod(k, F.col("wide")) * LATTICE_STEP).alias("lon"), (47 + F.floor(k / F.col("wide")) * LATTICE_STEP).alias("lat"))
    steps = [F.when(F.pmod(k + 1, F.col("wide")) != 0, F.struct((k + 1).alias("other"), F.pmod(k * 31, F.lit(11)).alias("gone"))), F.struct((k + F.col("wide")).alias("other"), F.pmod(k * 17, F.lit(13)).alias("gone"))]
    roads = places.select("vid", F.explode(F.array(*steps)).alias("x")).where("x.gone <> 0").select("vid", "x.other").hint("merge").join(p.select(F.col("p_partkey").alias("other")), "other")
    there = roads.select(k.alias("src"), F.col("other").alias("dst"), (20 + F.pmod(k * 37, F.lit(17))).cast("double").alias("cost"))
    back = roads.select(F.col("other").alias("src"), k.alias("dst"), (20 + F.pmod(k * 29, F.lit(19))).cast("double").alias("cost"))
    return places.select("vid", "lon", "lat"), there.unionByName(back)


LATTICE = """wide AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS wide FROM part),
roads AS (SELECT p_partkey AS a, p_partkey + 1 AS b FROM part, wide WHERE (p_partkey + 1) % wide <> 0 AND (p_partkey * 31) % 11 <> 0 UNION ALL SELECT p_partkey, p_partkey + wide FROM part, wide WHERE (p_partkey * 17) % 13 <> 0),
arcs AS MATERIALIZED (SELECT a AS src, b AS dst, (20 + (a * 37) % 17)::DOUBLE AS cost FROM roads WHERE b IN (SELECT p_partkey FROM part) UNION ALL SELECT b, a, (20 + (a * 29) % 19)::DOUBLE FROM roads WHERE b IN (SELECT p_partkey FROM part))"""
