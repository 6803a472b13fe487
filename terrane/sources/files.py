"""Readers and writers of the file kinds that networks come in, all through Spark's own sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.sources.store import VersionedTable

#: Tags of railways, stops, waterways and administrative levels.
RAIL_KINDS, RAIL_USAGE, RAIL_SIDE = ("rail", "light_rail"), ("main", "branch"), ("spur", "siding", "yard", "crossover")
RAIL_STOPS = ("station", "halt", "stop")
WATERWAYS = ("river", "canal", "stream")
ADMIN_LEVELS = ("6", "7", "8")


def read_geojson_lines(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of a GeoJSON text sequence (record separators allowed): geometry type, coordinates as JSON, properties."""
    schema = f"type string, geometry struct<type:string, coordinates:string>, properties struct<{properties}>"
    text = F.regexp_replace("value", "\x1e", "")
    rows = spark.read.text(path).select(F.from_json(text, schema).alias("f")).where("f.type = 'Feature'")
    return rows.select(F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"), "f.properties.*")


def write_geojson_lines(points: DataFrame, path: str) -> None:
    """Points (lon, lat) with their other columns as properties, one feature a line."""
    other = [c for c in points.columns if c not in ("lon", "lat")]
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
        F.struct(*other).alias("properties"),
    )
    points.select(F.to_json(feature).alias("value")).write.text(path)


def read_gtfs(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A GTFS table: quoted CSV with a header, a byte-order mark allowed, columns in any order; absent ones are null."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8")
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    have = set(raw.columns)
    return raw.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns.split()])


def read_traces(spark: SparkSession, path: str, schema: str, mark: str = "[chat-trace] ") -> DataFrame:
    """Events of a log: what follows the mark in lines that have it, as JSON; lines that don't parse are left out."""
    lines = spark.read.text(path).where(F.col("value").contains(mark))
    rows = lines.select(F.from_json(F.substring_index("value", mark, -1), f"{schema}, bad string", {"columnNameOfCorruptRecord": "bad"}).alias("e"))
    return rows.where("e IS NOT NULL AND e.bad IS NULL").select("e.*").drop("bad")


def write_cells(edges: DataFrame, path: str, size: float = 1.0) -> None:
    """Edges in folders by the cell of their source (lon, lat), so that a box reads its cells alone."""
    cells = {"cx": F.floor(F.col("lon") / size).cast("int"), "cy": F.floor(F.col("lat") / size).cast("int")}
    edges.withColumns(cells).repartition("cx", "cy").write.partitionBy("cx", "cy").parquet(path)


def read_cells(spark: SparkSession, path: str, box: tuple[float, float, float, float], size: float = 1.0) -> DataFrame:
    """Edges whose source lies in the box; only the folders of its cells are read."""
    x0, y0, x1, y1 = box
    rows = spark.read.parquet(path)
    pruned = rows.where(F.col("cx").between(int(x0 // size), int(x1 // size)) & F.col("cy").between(int(y0 // size), int(y1 // size)))
    return pruned.where((F.col("lon") >= x0) & (F.col("lon") < x1) & (F.col("lat") >= y0) & (F.col("lat") < y1))


def append_trunks(trunks: DataFrame, path: str) -> int:
    """Append the trunks of pairs that the store (a ``VersionedTable``) lacks; the number of rows written."""
    return VersionedTable(trunks.sparkSession, path).append_missing(trunks, ["src", "dst"])


def rail_ways(ways: DataFrame) -> DataFrame:
    """Ways of passenger railways by their tags (railway, usage, service, disused, abandoned, construction): main and
    branch lines in use; sidings and the like, and whatever is being built, are left out."""
    flag = lambda c: F.coalesce(F.col(c), F.lit("")) == "yes"
    lines = F.col("railway").isin(*RAIL_KINDS) & F.col("usage").isin(*RAIL_USAGE)
    side = F.coalesce(F.col("service"), F.lit("")).isin(*RAIL_SIDE)
    return ways.where(lines & ~side & ~flag("disused") & ~flag("abandoned") & F.col("construction").isNull())


def rail_stops(nodes: DataFrame) -> DataFrame:
    """Nodes (railway, bus, train) of rail stops; those of buses without trains are left out."""
    yes = lambda c: F.coalesce(F.col(c), F.lit("")) == "yes"
    return nodes.where(F.col("railway").isin(*RAIL_STOPS) & ~(yes("bus") & ~yes("train")))


def waterways(ways: DataFrame) -> DataFrame:
    """Ways (waterway, tunnel, layer, intermittent) of open, lasting waterways on or above the ground."""
    layer = F.expr("try_cast(layer AS INT)")
    above = F.col("layer").isNull() | F.coalesce(layer >= 0, F.lit(False))
    dry = F.coalesce(F.col("intermittent"), F.lit("")) == "yes"
    return ways.where(F.col("waterway").isin(*WATERWAYS) & (F.coalesce(F.col("tunnel"), F.lit("")) == "") & above & ~dry)


def boundaries(areas: DataFrame) -> DataFrame:
    """Administrative areas (boundary, admin_level) of districts and municipalities."""
    return areas.where((F.col("boundary") == "administrative") & F.col("admin_level").isin(*ADMIN_LEVELS))


def place_features(nodes: DataFrame, place: str = "village") -> DataFrame:
    """(value): a GeoJSON feature a line for the nodes (id, place, name, population, wikidata, lon, lat) of a kind of
    place; empty properties are left out."""
    filled = [F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("name", "place", "population", "wikidata")]
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.concat(F.lit("node/"), "id").alias("id"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
        F.struct(*filled).alias("properties"),
    )
    return nodes.where(F.col("place") == place).select(F.to_json(feature).alias("value"))
