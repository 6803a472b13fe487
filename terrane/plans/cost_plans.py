"""Edge costs for all routing profiles, and the predicates around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import cost, text
from terrane.operators import relational
from terrane.plans import tables as t
from terrane.plans.catalog import register
from terrane.session import table


def _case(key: str, values: dict, default: float) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in values.items()) + f" ELSE {default}::DOUBLE END"


def factor_sql(profile: str, grade: str, curv: str) -> str:
    """The cost per metre of the stand-in edges as SQL, written from the definition of the model."""
    p = cost.PROFILES[profile]
    relief = "greatest(0.0, least(1.0, local_relief / 120))"
    values = {"forest_local": "forest_local", "water_local": "water_local", "relief": relief}
    total = " + ".join(f"{cost.WEIGHT[k]}::DOUBLE * {v}" for k, v in values.items())
    score = f"(({total}) * {p.mult}::DOUBLE)" if p.mult > 0 else "0.0::DOUBLE"
    soft = f"{p.softening}::DOUBLE" if p.soft_from <= 0 else f"(1 - (1 - {p.softening}::DOUBLE) * greatest(0.0, least(1.0, ({score} - {p.soft_from}) / {p.soft_from})))"
    soften = lambda f: f"(CASE WHEN {f} <= 1 THEN {f} ELSE 1 + ({f} - 1) * {soft} END)"
    base = f"(CASE WHEN bicycle IN ('designated', 'yes', 'permissive') THEN {_case('highway', {k: v[0] for k, v in cost.BASE.items()}, 2.0)} ELSE {_case('highway', {k: v[1] for k, v in cost.BASE.items()}, 2.0)} END)"
    track = f"(CASE WHEN highway IN ('track', 'path', 'footway', 'road') THEN {soften(_case('tracktype', cost.TRACKTYPE, 1.0))} ELSE 1.0 END)"
    surface = soften(_case("surface", cost.SURFACE, 1.0))
    up = f"(CASE WHEN {p.threshold} > 0 AND {grade} <= {p.threshold} THEN 1.0 ELSE 1 + 0.028::DOUBLE * pow(greatest(0.0, {grade} - {p.offset}), 2) END)"
    down = f"((1 + 0.05::DOUBLE * {grade} + 0.005::DOUBLE * {grade} * {grade}) * (CASE WHEN {curv} > 0 THEN 1 - 0.0005::DOUBLE * {curv} * {grade} ELSE 1.0 END))"
    slope = f"(CASE WHEN {grade} > 0 THEN {up} WHEN {grade} < 0 THEN {down} ELSE 1.0 END)"
    if p.per_signal:
        scenic = " * ".join(f"(1 - {k}::DOUBLE * tanh({cost.WEIGHT[n]}::DOUBLE * {values[n]} * {p.mult}))" for n, k in p.per_signal.items() if n in values) or "1.0"
    else:
        scenic = f"(1 - {p.k}::DOUBLE * tanh({score} - 0.5))" if p.k > 0 else "1.0"
    canopy = "(1 - 0.1::DOUBLE * canopy_frac)"
    closed = "highway = '' OR highway = 'motorway' OR bicycle = 'no'"
    return f"CASE WHEN {closed} THEN NULL ELSE {base} * {track} * {surface} * {slope} * {canopy} * {scenic} END"


def _register(profile: str) -> None:
    forward, back = factor_sql(profile, "grade", "curv"), factor_sql(profile, "(-grade)", "curv")
    sql = f"WITH {t.EDGES} SELECT gid, {t.rounded_sql(f'({forward}) * length', 4)} AS cost, {t.rounded_sql(f'CASE WHEN oneway THEN -1.0 ELSE coalesce(({back}) * length, -1.0) END', 4)} AS reverse_cost FROM edges"

    @register(f"cost_{profile}", sql)
    def plan(spark, d):
        rows = t.edges(spark, d)
        found = cost.with_costs(rows, profile, "length", "grade", "curv", "curv", "oneway")
        return found.select("gid", t.rounded("cost", 4).alias("cost"), t.rounded("reverse_cost", 4).alias("reverse_cost"))


for _name in cost.PROFILES:
    _register(_name)


@register(
    "drivable_kept",
    f"WITH {t.EDGES} SELECT highway, (highway IN ('motorway', 'primary') AND ({factor_sql('direct', 'grade', 'curv')}) IS NULL) AS bike_excluded, count(*) AS n FROM edges WHERE ({factor_sql('direct', 'grade', 'curv')}) IS NOT NULL OR highway IN ('motorway', 'primary') GROUP BY 1, 2",
)
def drivable_kept(spark, d):
    rows = t.edges(spark, d)
    factor = cost.edge_factor(cost.Edge(rows.columns), "direct", F.col("grade"), F.col("curv"))
    drivable = F.col("highway").isin("motorway", "primary")
    kept = rows.select("highway", factor.alias("f")).where(F.col("f").isNotNull() | drivable)
    return kept.groupBy("highway", (drivable & F.col("f").isNull()).alias("bike_excluded")).agg(F.count("*").alias("n"))


@register("oneway_direction", "SELECT (CASE l_returnflag WHEN 'R' THEN -1 WHEN 'A' THEN 1 ELSE 0 END)::INT AS direction, count(*) AS n FROM lineitem GROUP BY 1")
def oneway_direction(spark, d):
    tag = F.when(F.col("l_returnflag") == "R", "Reverse").when(F.col("l_returnflag") == "A", "YES")
    return table(spark, d, "lineitem").groupBy(text.oneway_direction(tag).alias("direction")).agg(F.count("*").alias("n"))


@register("paved_edges", f"WITH {t.EDGES}, {t.VERTICES} SELECT gid, source, target, s.lon AS slon, s.lat AS slat, x.lon AS tlon, x.lat AS tlat FROM edges JOIN vertices s ON source = s.id JOIN vertices x ON target = x.id WHERE highway IN ('cycleway', 'residential', 'primary')")
def paved_edges(spark, d):
    v = t.vertices(spark, d)
    e = t.edges(spark, d).where(F.col("highway").isin("cycleway", "residential", "primary")).select("gid", "source", "target")
    return e.join(v.select(F.col("id").alias("source"), F.col("lon").alias("slon"), F.col("lat").alias("slat")), "source").join(v.select(F.col("id").alias("target"), F.col("lon").alias("tlon"), F.col("lat").alias("tlat")), "target")


@register("grade_of_edges", f"WITH {t.EDGES}, {t.VERTICES} SELECT gid, round(coalesce((x.elev - s.elev) * 100 / nullif(length, 0), 0.0), 6) AS grade_pct FROM edges JOIN vertices s ON source = s.id JOIN vertices x ON target = x.id")
def grade_of_edges(spark, d):
    from terrane.functions import geo

    v = t.vertices(spark, d).select("id", "elev")
    e = t.edges(spark, d).select("gid", "source", "target", "length").join(v.toDF("source", "e1"), "source").join(v.toDF("target", "e2"), "target")
    return e.select("gid", F.round(geo.grade_percent("e1", "e2", "length"), 6).alias("grade_pct"))


_DD = t.haversine_sql("s.lon", "s.lat", "x.lon", "x.lat")


@register("detour_edges", f"WITH {t.EDGES}, {t.VERTICES} SELECT gid FROM edges JOIN vertices s ON source = s.id JOIN vertices x ON target = x.id WHERE length > 0 AND {_DD} > 0 AND length * 40000 / {_DD} > 4.0")
def detour_edges(spark, d):
    from terrane.functions import geo

    v = t.vertices(spark, d)
    e = t.edges(spark, d).select("gid", "source", "target", "length").join(v.select(F.col("id").alias("source"), F.col("lon").alias("l1"), F.col("lat").alias("b1")), "source").join(v.select(F.col("id").alias("target"), F.col("lon").alias("l2"), F.col("lat").alias("b2")), "target")
    dist = geo.haversine_m("l1", "b1", "l2", "b2")
    return e.where((F.col("length") > 0) & (dist > 0) & (F.col("length") * 40000 / dist > 4.0)).select("gid")


@register("routable_vertices", f"WITH {t.EDGES}, {t.VERTICES} SELECT id FROM vertices WHERE EXISTS (SELECT 1 FROM edges WHERE (source = id OR target = id) AND highway NOT IN ('motorway', 'unknown'))")
def routable_vertices(spark, d):
    e = t.edges(spark, d).where(~F.col("highway").isin("motorway", "unknown"))
    return relational.touching(t.vertices(spark, d), e, "id").select("id")
