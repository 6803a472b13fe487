"""Bicycle edge costs as one column expression per profile, so that a whole network is priced in one projection."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.session import fresh_names

# Road classes with their cost per metre with and without bicycle infrastructure.
BASE = {
    "cycleway": (0.9, 0.9), "residential": (1.0, 1.0), "living_street": (1.0, 1.0), "service": (1.3, 1.3), "track": (1.1, 1.1),
    "path": (1.1, 2.0), "footway": (1.1, 5.0), "pedestrian": (2.2, 3.0), "bridleway": (5.0, 5.0), "unclassified": (1.0, 1.3),
    "tertiary": (1.0, 1.4), "secondary": (1.1, 1.8), "primary": (1.3, 4.0), "trunk": (1.5, 10.0), "trunk_link": (1.5, 10.0),
    "primary_link": (1.3, 4.0), "secondary_link": (1.1, 1.8), "tertiary_link": (1.0, 1.4),
}
EXCLUDED = ("abandoned", "construction", "elevator", "motorway", "motorway_link", "platform", "proposed", "raceway")
TRACKTYPE = {"grade1": 1.0, "grade2": 1.4, "grade3": 2.0, "grade4": 4.0, "grade5": 100.0}
SURFACE = {
    "asphalt": 1.0, "paved": 1.0, "concrete": 1.0, "paving_stones": 1.0, "compacted": 1.0, "fine_gravel": 1.1, "gravel": 1.3,
    "pebblestone": 1.3, "sett": 1.3, "cobblestone": 1.7, "dirt": 1.5, "earth": 1.5, "ground": 1.5, "unpaved": 1.5, "grass": 3.0,
    "woodchips": 3.0, "sand": 10.0, "mud": 10.0, "ice": 10.0, "snow": 10.0,
}
#: Weights of the scenic signals.
WEIGHT = {
    "forest_local": 0.5, "vineyard_local": 0.5, "water_local": 0.7, "wetland_local": 0.3, "waterway": 0.8, "relief": 0.6, "regional": 0.3,
    "vista_forest": 0.5, "vista_water": 0.7, "vista_sea": 1.5, "vista_drama": 0.8, "viewpoint_local": 200.0, "viewpoint_regional": 500.0,
    "waterway_local": 0.3,
}
FERRY, UNKNOWN_CLASS, BICYCLE_ROAD = 8.0, 2.0, 0.9
UPHILL, DOWN_LINEAR, DOWN_QUADRATIC, CURVE, CANOPY, MIDPOINT = 0.028, 0.05, 0.005, 0.0005, 0.1, 0.5
RELIEF_NORM, REGIONAL_NORM, VIEW_NORM, DRAMA_SCALE = 120.0, 250.0, 200.0, 5000.0
#: Columns of a priced edge, besides its length; absent ones take the neutral value.
TAGS = ("highway", "surface", "tracktype", "access", "bicycle", "cycleway", "bicycle_road")
SIGNALS = (
    "forest_local", "forest_wide", "vineyard_local", "water_local", "water_wide", "sea_local", "sea_wide", "waterway_along_edge", "waterway_local",
    "wetland_local", "view_dominance", "local_relief", "regional_relief", "distance_to_drama", "viewpoint_local", "viewpoint_regional",
)
NEUTRAL = {"distance_to_drama": 99_999.0}


@dataclass(frozen=True)
class Profile:
    k: float = 0.0
    mult: float = 0.0
    softening: float = 1.0
    threshold: float = 0.0
    offset: float = 0.0
    soft_from: float = 0.0
    per_signal: dict[str, float] = field(default_factory=dict)


_MULTI = {
    "forest_local": 0.25, "vineyard_local": 0.25, "water_local": 0.25, "wetland_local": 0.15, "waterway": 0.35, "relief": 0.25, "regional": 0.15,
    "vista_forest": 0.25, "vista_water": 0.25, "vista_sea": 0.35, "vista_drama": 0.25, "viewpoint_local": 0.25, "viewpoint_regional": 0.15,
    "waterway_local": 0.15,
}
#: The routing profiles.
PROFILES = {
    "direct": Profile(),
    "balanced": Profile(k=0.25, mult=1.0, softening=0.7),
    "scenic": Profile(k=0.4, mult=1.0, softening=0.5),
    "direct_thresh5": Profile(threshold=5.0),
    "direct_minus3": Profile(offset=3.0),
    "direct_scenic_2x": Profile(k=0.4, mult=2.0),
    "direct_scenic_5x": Profile(k=0.4, mult=5.0),
    "direct_scenic_10x": Profile(k=0.4, mult=10.0),
    "direct_interactive": Profile(k=0.3, mult=3.0, softening=0.5, soft_from=0.5),
    "direct_interactive_vp": Profile(k=0.3, mult=3.0, softening=0.5, soft_from=0.5),
    "vineyard_lover": Profile(mult=3.0, offset=3.0, per_signal={"vineyard_local": 0.4, "relief": 0.2, "regional": 0.1, "forest_local": 0.05, "waterway": 0.1}),
    "forest_lover": Profile(mult=3.0, offset=3.0, per_signal={"forest_local": 0.3, "vista_forest": 0.3, "relief": 0.1, "waterway": 0.1, "wetland_local": 0.1}),
    "views": Profile(mult=3.0, offset=3.0, per_signal={"viewpoint_local": 0.4, "viewpoint_regional": 0.2, "vista_drama": 0.3, "vista_forest": 0.15, "vista_water": 0.15, "relief": 0.2}),
    "water": Profile(mult=3.0, offset=3.0, per_signal={"waterway": 0.5, "water_local": 0.3, "waterway_local": 0.2, "vista_water": 0.2, "forest_local": 0.1, "wetland_local": 0.05}),
    "direct_minus3_multi": Profile(mult=3.0, softening=0.5, offset=3.0, soft_from=0.5, per_signal=_MULTI),
    "direct_multi": Profile(mult=3.0, softening=0.5, soft_from=0.5, per_signal=_MULTI),
}


def _lookup(key: Column, values: dict[str, float], default) -> Column:
    """The value of a key in a literal map, which is folded to one object; a CASE over all keys makes methods too large
    for the JVM to compile."""
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), default if isinstance(default, Column) else F.lit(default))


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


class Edge:
    """Names of an edge's columns, with neutral values for those that a table lacks."""

    def __init__(self, columns: list[str], **given: Column):
        self.columns, self.given = set(columns), given

    def __getitem__(self, name: str) -> Column:
        if name in self.given:
            return self.given[name]
        default = "" if name in TAGS else False if name == "is_ferry" else NEUTRAL.get(name, 0.0)
        return F.coalesce(F.col(name), F.lit(default)) if name in self.columns else F.lit(default)


def has_infrastructure(e: Edge) -> Column:
    return (e["bicycle_road"] == "yes") | e["bicycle"].isin("designated", "yes", "permissive") | ~e["cycleway"].isin("", "no", "none")


def is_excluded(e: Edge) -> Column:
    closed = e["access"].isin("private", "no") & ~e["bicycle"].isin("yes", "designated", "permissive")
    return (e["highway"] == "") | e["highway"].isin(*EXCLUDED) | closed | e["bicycle"].isin("no", "private", "dismount")


def signal_values(e: Edge) -> dict[str, Column]:
    """The 14 scenic values of an edge."""
    view = F.greatest(e["view_dominance"], F.lit(0.0)) / VIEW_NORM
    relief, regional = _unit(e["local_relief"] / RELIEF_NORM), _unit(e["regional_relief"] / REGIONAL_NORM)
    around = 0.5 + 0.5 * relief + 0.5 * e["forest_local"]
    plain = {k: e[k] for k in ("forest_local", "vineyard_local", "water_local", "wetland_local", "viewpoint_local", "viewpoint_regional", "waterway_local")}
    return plain | {
        "waterway": e["waterway_along_edge"] * around, "relief": relief, "regional": regional, "vista_forest": view * e["forest_wide"],
        "vista_water": view * e["water_wide"], "vista_sea": view * e["sea_wide"], "vista_drama": view * F.exp(-e["distance_to_drama"] / DRAMA_SCALE),
    }


def scenic_score(e: Edge, p: Profile) -> Column:
    if p.mult <= 0:
        return F.lit(0.0)
    values = signal_values(e)
    total = F.lit(0.0)
    for k in WEIGHT:
        total = total + WEIGHT[k] * values[k]
    return total * p.mult


def softening(score: Column, p: Profile) -> Column:
    """What is left of a surface penalty; under ``soft_from`` it ramps in with the scenic score."""
    if p.soft_from <= 0:
        return F.lit(p.softening)
    return 1 - (1 - p.softening) * _unit((score - p.soft_from) / p.soft_from)


def soften(factor: Column, share: Column) -> Column:
    return F.when(factor <= 1, factor).otherwise(1 + (factor - 1) * share)


def scenic_factor(e: Edge, p: Profile) -> Column:
    if p.per_signal:
        out, values = F.lit(1.0), signal_values(e)
        for name, k in p.per_signal.items():
            out = out * (1 - k * F.tanh(WEIGHT[name] * values[name] * p.mult))
        return out
    return 1 - p.k * F.tanh(scenic_score(e, p) - MIDPOINT) if p.k > 0 else F.lit(1.0)


def slope_factor(grade: Column, curvature: Column, p: Profile) -> Column:
    rise = F.greatest(F.lit(0.0), grade - p.offset)
    up = F.when((F.lit(p.threshold) > 0) & (grade <= p.threshold), 1.0).otherwise(1 + UPHILL * rise * rise)
    fall = -grade
    down = (1 - DOWN_LINEAR * fall + DOWN_QUADRATIC * fall * fall) * F.when(curvature > 0, 1 + CURVE * curvature * fall).otherwise(1.0)
    return F.when(grade > 0, up).when(grade < 0, down).otherwise(1.0)


def edge_factor(e: Edge, profile: str = "direct", grade: Column | None = None, curvature: Column | None = None) -> Column:
    """Cost per metre of an edge; null where it is closed to bicycles."""
    p = PROFILES[profile]
    grade = F.lit(0.0) if grade is None else F.coalesce(grade, F.lit(0.0))
    curvature = F.lit(0.0) if curvature is None else F.coalesce(curvature, F.lit(0.0))
    base = F.when(has_infrastructure(e), _lookup(e["highway"], {k: v[0] for k, v in BASE.items()}, UNKNOWN_CLASS)).otherwise(
        _lookup(e["highway"], {k: v[1] for k, v in BASE.items()}, UNKNOWN_CLASS)
    )
    share = softening(scenic_score(e, p), p)
    track = F.when(e["highway"].isin("track", "path", "footway", "road"), soften(_lookup(e["tracktype"], TRACKTYPE, 1.0), share)).otherwise(1.0)
    surface = soften(_lookup(e["surface"], SURFACE, 1.0), share)
    road = F.when(e["bicycle_road"] == "yes", BICYCLE_ROAD).otherwise(1.0)
    canopy = F.when(e["canopy_frac"] > 0, 1 - CANOPY * e["canopy_frac"]).otherwise(1.0)
    cost = base * track * surface * road * slope_factor(grade, curvature, p) * canopy * scenic_factor(e, p)
    ferry = F.when(e["bicycle"].isin("no", "private"), F.lit(None).cast("double")).otherwise(FERRY)
    return F.when(e["is_ferry"], ferry).when(is_excluded(e), F.lit(None).cast("double")).otherwise(cost)


def edge_costs(e: Edge, profile: str, length: Column, grade: Column, curv_fwd: Column, curv_rev: Column, oneway: Column) -> tuple[Column, Column]:
    """(cost, reverse_cost): the reverse is -1 on one-way edges and where it is closed; cost is null where it is closed."""
    forward = edge_factor(e, profile, grade, curv_fwd) * length
    back = edge_factor(e, profile, -grade, curv_rev) * length
    return forward, F.when(oneway, -1.0).otherwise(F.coalesce(back, F.lit(-1.0)))


def with_costs(edges: DataFrame, profile: str, length: str, grade: str, curv_fwd: str, curv_rev: str, oneway: str) -> DataFrame:
    """``edges`` with ``cost`` and ``reverse_cost`` as ``edge_costs`` has them, in place of any of these names.

    Scores, look-ups and slopes are worked out in projections of their own: each becomes a method of its own in the
    generated code, small enough for the JVM to compile, and none is worked out for both directions anew.
    """
    p, e = PROFILES[profile], Edge(edges.columns)
    score, scenic, share, base, road, closed, up, down = fresh_names(edges, 8)
    state = F.when(e["is_ferry"], F.when(e["bicycle"].isin("no", "private"), 3).otherwise(2)).when(is_excluded(e), 1).otherwise(0)
    out = edges.withColumns({score: scenic_score(e, p), closed: state})
    if p.per_signal:
        factor = scenic_factor(e, p)
    else:
        factor = 1 - p.k * F.tanh(F.col(score) - MIDPOINT) if p.k > 0 else F.lit(1.0)
    out = out.withColumns({scenic: factor, share: softening(F.col(score), p), base: F.when(has_infrastructure(e), _lookup(e["highway"], {k: v[0] for k, v in BASE.items()}, UNKNOWN_CLASS)).otherwise(_lookup(e["highway"], {k: v[1] for k, v in BASE.items()}, UNKNOWN_CLASS))})
    track = F.when(e["highway"].isin("track", "path", "footway", "road"), soften(_lookup(e["tracktype"], TRACKTYPE, 1.0), F.col(share))).otherwise(1.0)
    surface = soften(_lookup(e["surface"], SURFACE, 1.0), F.col(share))
    out = out.withColumn(road, F.col(base) * track * surface * F.when(e["bicycle_road"] == "yes", BICYCLE_ROAD).otherwise(1.0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = out.withColumns({up: slope_factor(zero(grade), zero(curv_fwd), p), down: slope_factor(-zero(grade), zero(curv_rev), p)})
    canopy = F.when(e["canopy_frac"] > 0, 1 - CANOPY * e["canopy_frac"]).otherwise(1.0)
    one_way = lambda slope: F.when(F.col(closed) == 0, F.col(road) * F.col(slope) * canopy * F.col(scenic)).when(F.col(closed) == 2, FERRY) * F.col(length)
    out = out.withColumns({"cost": one_way(up), "reverse_cost": F.when(F.col(oneway), -1.0).otherwise(F.coalesce(one_way(down), F.lit(-1.0)))})
    return out.drop(score, scenic, share, base, road, closed, up, down)
