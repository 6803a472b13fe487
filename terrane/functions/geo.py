"""Geographic scalars as column expressions; every function takes and returns columns (degrees, metres)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x)) if isinstance(x, (int, float)) else F.col(x)


def haversine_m(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle metres, null where a coordinate is; the arcsine's argument is clamped to 1 (``least`` would make a
    null half the globe)."""
    lon1, lat1, lon2, lat2 = map(_col, (lon1, lat1, lon2, lat2))
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def bearing(lon1, lat1, lon2, lat2) -> Column:
    """Initial bearing in [0, 360)."""
    lon1, lat1, lon2, lat2 = map(_col, (lon1, lat1, lon2, lat2))
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def bearing_difference(b1, b2) -> Column:
    """The smaller angle between two bearings, in [0, 180]."""
    return F.abs(F.pmod(_col(b2) - _col(b1) + 540, F.lit(360.0)) - 180)


def cross_track_m(plon, plat, alon, alat, blon, blat) -> Column:
    """Distance of a point from the great circle through a and b."""
    d = haversine_m(alon, alat, plon, plat) / EARTH_M
    turn = F.radians(bearing(alon, alat, plon, plat) - bearing(alon, alat, blon, blat))
    return F.abs(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(d) * F.sin(turn)))) * EARTH_M)


def along_track_m(plon, plat, alon, alat, blon, blat) -> Column:
    """Signed distance along a to b of the point's foot; negative behind a."""
    d = haversine_m(alon, alat, plon, plat) / EARTH_M
    off = cross_track_m(plon, plat, alon, alat, blon, blat) / EARTH_M
    ratio = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.cos(d) / F.cos(off)))
    ahead = bearing_difference(bearing(alon, alat, plon, plat), bearing(alon, alat, blon, blat)) <= 90
    return F.when(ahead, F.acos(ratio) * EARTH_M).otherwise(-F.acos(ratio) * EARTH_M)


def point_segment_km(plon, plat, alon, alat, blon, blat) -> Column:
    """Distance of a point from a segment in degrees scaled by the cosine of the latitude, times 111 km."""
    plon, plat, alon, alat, blon, blat = map(_col, (plon, plat, alon, alat, blon, blat))
    k = F.cos(F.radians(plat))
    dx, dy = (blon - alon) * k, blat - alat
    px, py = (plon - alon) * k, plat - alat
    norm = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(px * dx + py * dy, norm), F.lit(0.0))))
    return F.sqrt(F.pow(px - t * dx, 2) + F.pow(py - t * dy, 2)) * 111.0


def bend_degrees(alon, alat, blon, blat, clon, clat) -> Column:
    """Turn at b on the way from a to c, in [0, 180]; 0 where one of both steps has no length."""
    alon, alat, blon, blat, clon, clat = map(_col, (alon, alat, blon, blat, clon, clat))
    k = F.cos(F.radians(blat))
    x1, y1, x2, y2 = (blon - alon) * k, blat - alat, (clon - blon) * k, clat - blat
    still = ((x1 == 0) & (y1 == 0)) | ((x2 == 0) & (y2 == 0))
    return F.when(still, 0.0).otherwise(F.abs(F.degrees(F.atan2(x1 * y2 - y1 * x2, x1 * x2 + y1 * y2))))


def unit_sphere(lon, lat) -> Column:
    """Point on the earth's sphere as struct(x, y, z) in metres."""
    lon, lat = F.radians(_col(lon)), F.radians(_col(lat))
    return F.struct((EARTH_M * F.cos(lat) * F.cos(lon)).alias("x"), (EARTH_M * F.cos(lat) * F.sin(lon)).alias("y"), (EARTH_M * F.sin(lat)).alias("z"))


def chord_m(arc_m) -> Column:
    """Straight-line length of an arc."""
    return 2 * EARTH_M * F.sin(_col(arc_m) / (2 * EARTH_M))


def cell(lon, lat, size: float = 1.0) -> tuple[Column, Column]:
    """Column and row of the grid cell that holds the point."""
    return F.floor(_col(lon) / size).cast("long"), F.floor(_col(lat) / size).cast("long")


def in_box(lon, lat, box: tuple[float, float, float, float], closed: bool = False) -> Column:
    """Point in (min_lon, min_lat, max_lon, max_lat): half-open, so that tiles own their points, or closed."""
    lon, lat = _col(lon), _col(lat)
    if closed:
        return lon.between(box[0], box[2]) & lat.between(box[1], box[3])
    return (lon >= box[0]) & (lon < box[2]) & (lat >= box[1]) & (lat < box[3])


def mercator_tile(lon, lat, zoom: int) -> tuple[Column, Column]:
    """Web-Mercator tile numbers."""
    lon, lat = _col(lon), F.radians(_col(lat))
    n = float(2**zoom)
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.asinh(F.tan(lat)) / F.lit(3.141592653589793)) / 2 * n)
    return x.cast("long"), y.cast("long")


def grade_percent(elev_from, elev_to, length_m) -> Column:
    """Rise in percent; 0 where an elevation is unknown or the length is 0."""
    return F.coalesce(F.try_divide((_col(elev_to) - _col(elev_from)) * 100, _col(length_m)), F.lit(0.0))


def circle(lon, lat, radius_m: float, vertices: int = 32) -> Column:
    """A circle's vertices as array<struct(lon, lat)>, open."""
    lon, lat = _col(lon), _col(lat)
    dy = radius_m / 111_320.0
    dx = F.lit(radius_m) / (111_320.0 * F.cos(F.radians(lat)))
    angle = lambda k: k * (2 * 3.141592653589793 / vertices)
    return F.transform(F.sequence(F.lit(0), F.lit(vertices - 1)), lambda k: F.struct((lon + dx * F.cos(angle(k))).alias("lon"), (lat + dy * F.sin(angle(k))).alias("lat")))


def in_ring(lon, lat, ring: Column) -> Column:
    """Point in polygon by ray casting over array<struct(lon, lat)>."""
    lon, lat = _col(lon), _col(lat)
    n = F.size(ring)

    def crossing(acc: Column, k: Column) -> Column:
        a, b = F.element_at(ring, k), F.element_at(ring, F.when(k == n, 1).otherwise(k + 1))
        over = (a["lat"] > lat) != (b["lat"] > lat)
        x = a["lon"] + F.coalesce(F.try_divide((lat - a["lat"]) * (b["lon"] - a["lon"]), b["lat"] - a["lat"]), F.lit(0.0))
        return acc != (over & (lon < x))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(False), crossing)


def touches_box(lon1, lat1, lon2, lat2, box: tuple[float, float, float, float]) -> Column:
    """Either end of an edge lies in the closed box."""
    return in_box(lon1, lat1, box, closed=True) | in_box(lon2, lat2, box, closed=True)


def oriented(forward: Column, first: Column, last: Column) -> Column:
    """The two ends of an edge in the order in which it is travelled."""
    return F.when(forward, F.array(first, last)).otherwise(F.array(last, first))


def grown_box(box: Column, by_m: float) -> Column:
    """A box struct(x0, y0, x1, y1) widened by metres at its middle latitude."""
    dy = by_m / 111_000.0
    dx = dy / F.greatest(F.cos(F.radians((box["y0"] + box["y1"]) / 2)), F.lit(0.01))
    return F.struct((box["x0"] - dx).alias("x0"), (box["y0"] - dy).alias("y0"), (box["x1"] + dx).alias("x1"), (box["y1"] + dy).alias("y1"))


def tiles_of(box: Column, size: float) -> Column:
    """The tiles of a grid of multiples of ``size`` that cover a box, as array<struct(x0, y0, x1, y1)>, rows from the south."""
    x_lo, y_lo = F.floor(box["x0"] / size) * size, F.floor(box["y0"] / size) * size
    counts = lambda hi, lo: F.sequence(F.lit(0).cast("long"), F.ceil((hi - lo) / size) - 1)
    edge = lambda lo, k: F.round(lo + k * size, 6)
    tile = lambda i, j: F.struct(edge(x_lo, i).alias("x0"), edge(y_lo, j).alias("y0"), edge(x_lo, i + 1).alias("x1"), edge(y_lo, j + 1).alias("y1"))
    return F.flatten(F.transform(counts(box["y1"], y_lo), lambda j: F.transform(counts(box["x1"], x_lo), lambda i: tile(i, j))))


def z_order(x: Column, y: Column, bits: int = 16) -> Column:
    """One number of two cell numbers, their bits taken in turn, so that near cells get near numbers."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        out = out + F.shiftleft(F.shiftright(x, k).bitwiseAND(F.lit(1)), 2 * k) + F.shiftleft(F.shiftright(y, k).bitwiseAND(F.lit(1)), 2 * k + 1)
    return out


def metre_grid(box: Column, size_m: float) -> Column:
    """Columns and rows of a grid of squares of ``size_m`` metres over a box, and their sizes in degrees."""
    dy = F.lit(size_m / 111_320.0)
    dx = dy / F.cos(F.radians((box["y0"] + box["y1"]) / 2))
    return F.struct(F.ceil((box["x1"] - box["x0"]) / dx).alias("cols"), F.ceil((box["y1"] - box["y0"]) / dy).alias("rows"), dx.alias("dx"), dy.alias("dy"))


def ring_area(ring: Column) -> Column:
    """Area of an open ring array<struct(lon, lat)> in square degrees."""
    n = F.size(ring)
    part = lambda k: F.element_at(ring, k)["lon"] * F.element_at(ring, F.when(k == n, 1).otherwise(k + 1))["lat"] - F.element_at(ring, F.when(k == n, 1).otherwise(k + 1))["lon"] * F.element_at(ring, k)["lat"]
    return F.abs(F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda acc, k: acc + part(k))) / 2
