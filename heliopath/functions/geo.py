"""Spherical and planar geometry as Column expressions.

Angles are degrees, lengths metres. Arguments may be column names, Columns or
numbers. Geometry arrays hold structs, either ``(lat, lng)`` or planar ``(x, y)``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values shared by every distance and grid in the package.
EARTH_RADIUS_M = 6371000.0
METERS_PER_DEGREE = 111320.0
TILE_SIZE_M = 5000.0
RAD = math.pi / 180.0
DEG = 180.0 / math.pi


def col(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(float(value))


def rad(value) -> Column:
    return col(value) * F.lit(RAD)


def half_up(value, digits: int = 0) -> Column:
    """Round half towards +infinity, for values whose sign may be negative."""
    scale = float(10**digits)
    return F.floor(col(value) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def clamp(value, low, high) -> Column:
    """Limit to low..high; NULL stays NULL (greatest and least skip it)."""
    return F.when(col(value).isNotNull(), F.greatest(col(low), F.least(col(high), col(value))))


def haversine_m(lat1, lng1, lat2, lng2) -> Column:
    """Great-circle metres; NULL when any coordinate is NULL."""
    d_lat, d_lng = rad(col(lat2) - col(lat1)), rad(col(lng2) - col(lng1))
    a = F.pow(F.sin(d_lat / 2), 2) + F.cos(rad(lat1)) * F.cos(rad(lat2)) * F.pow(F.sin(d_lng / 2), 2)
    return F.lit(2.0 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def distance_m(lat1, lng1, lat2, lng2) -> Column:
    """Route arithmetic counts an unusable coordinate as no movement."""
    return F.coalesce(haversine_m(lat1, lng1, lat2, lng2), F.lit(0.0))


def bearing_deg(lat1, lng1, lat2, lng2) -> Column:
    phi1, phi2, d_lng = rad(lat1), rad(lat2), rad(col(lng2) - col(lng1))
    y = F.sin(d_lng) * F.cos(phi2)
    x = F.cos(phi1) * F.sin(phi2) - F.sin(phi1) * F.cos(phi2) * F.cos(d_lng)
    return (F.atan2(y, x) * F.lit(DEG) + 360.0) % F.lit(360.0)


def angle_between(a, b) -> Column:
    """Smallest angle between two headings, 0..180."""
    return F.abs(((col(a) - col(b)) % F.lit(360.0) + 540.0) % F.lit(360.0) - 180.0)


def destination(lat, lng, bearing, meters) -> tuple[Column, Column]:
    """(lat, lng) reached from a point along a bearing."""
    angular, phi, theta = col(meters) / F.lit(EARTH_RADIUS_M), rad(lat), rad(bearing)
    sin_lat = F.sin(phi) * F.cos(angular) + F.cos(phi) * F.sin(angular) * F.cos(theta)
    d_lng = F.atan2(F.sin(theta) * F.sin(angular) * F.cos(phi), F.cos(angular) - F.sin(phi) * sin_lat)
    return F.asin(sin_lat) * F.lit(DEG), col(lng) + d_lng * F.lit(DEG)


def project(lat, lng, lat0, lng0, cos_lat=None) -> tuple[Column, Column]:
    """Planar (x, y) metres around an origin."""
    scale = F.cos(rad(lat0)) if cos_lat is None else col(cos_lat)
    x = rad(col(lng) - col(lng0)) * F.lit(EARTH_RADIUS_M) * scale
    y = rad(col(lat) - col(lat0)) * F.lit(EARTH_RADIUS_M)
    return x, y


def unproject(x, y, lat0, lng0, cos_lat=None) -> tuple[Column, Column]:
    """(lat, lng) of planar metres around an origin."""
    scale = F.cos(rad(lat0)) if cos_lat is None else col(cos_lat)
    lat = col(lat0) + col(y) / F.lit(EARTH_RADIUS_M) * F.lit(DEG)
    lng = col(lng0) + col(x) / (F.lit(EARTH_RADIUS_M) * scale) * F.lit(DEG)
    return lat, lng


def reproject(x, y, from_origin, to_origin) -> tuple[Column, Column]:
    """Move planar metres from one (lat0, lng0) origin to another."""
    lat, lng = unproject(x, y, *from_origin)
    return project(lat, lng, *to_origin)


def tile_of(lat, lng, grid: tuple[float, float, float] = (41.0, -74.0, math.cos(42.0 * RAD)),
            size_m: float = TILE_SIZE_M) -> tuple[Column, Column]:
    """Integer tile (tx, ty) of a coordinate on grid (lat0, lng0, cos_lat)."""
    x, y = project(lat, lng, grid[0], grid[1], grid[2])
    return F.floor(x / size_m).cast("long"), F.floor(y / size_m).cast("long")


def tile_key(tx, ty) -> Column:
    return F.concat_ws(":", col(tx).cast("string"), col(ty).cast("string"))


def parse_tile_key(key) -> tuple[Column, Column]:
    """(tx, ty) of an ``x:y`` key; NULL for malformed keys."""
    good = col(key).rlike(r"^-?\d+:-?\d+$")
    parts = F.split(col(key), ":")
    return (F.when(good, parts[0].cast("long")), F.when(good, parts[1].cast("long")))


def tile_bounds(tx, ty, grid=(41.0, -74.0, math.cos(42.0 * RAD)), size_m: float = TILE_SIZE_M):
    """(south, west, north, east) of a tile."""
    south, west = unproject(col(tx) * size_m, col(ty) * size_m, *grid)
    north, east = unproject((col(tx) + 1) * size_m, (col(ty) + 1) * size_m, *grid)
    return south, west, north, east


def lng_scale(lat) -> Column:
    """Metres per degree of longitude at a latitude, never quite zero."""
    return F.greatest(F.lit(0.01), F.cos(rad(lat))) * METERS_PER_DEGREE


def segment_fraction(lat, lng, lat1, lng1, lat2, lng2, scale=None) -> Column:
    """Where along a short segment the foot of a point lies, clamped to 0..1."""
    scale = lng_scale(lat) if scale is None else col(scale)
    ax, ay = (col(lng1) - col(lng)) * scale, (col(lat1) - col(lat)) * METERS_PER_DEGREE
    dx, dy = (col(lng2) - col(lng1)) * scale, (col(lat2) - col(lat1)) * METERS_PER_DEGREE
    length_sq = dx * dx + dy * dy
    return F.when(length_sq > 0, clamp(-(ax * dx + ay * dy) / length_sq, 0.0, 1.0)).otherwise(F.lit(0.0))


def along(a, b, t) -> Column:
    return col(a) + (col(b) - col(a)) * col(t)


def point_segment_m(lat, lng, lat1, lng1, lat2, lng2) -> Column:
    t = segment_fraction(lat, lng, lat1, lng1, lat2, lng2)
    return haversine_m(lat, lng, along(lat1, lat2, t), along(lng1, lng2, t))


def _edges(polygon) -> Column:
    ring = col(polygon)
    n = F.size(ring)
    return F.transform(F.sequence(F.lit(0), n - 1),
                       lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, (i + 1) % n).alias("b")))


def point_in_polygon(x, y, polygon, px: str = "x", py: str = "y") -> Column:
    """Even-odd test against an array of point structs."""
    x, y = col(x), col(y)

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        dy = b[py] - a[py]
        safe = F.when(dy == 0, F.lit(2.220446049250313e-16)).otherwise(dy)
        return ((a[py] > y) != (b[py] > y)) & (x < (b[px] - a[px]) * (y - a[py]) / safe + a[px])

    hits = F.size(F.filter(_edges(polygon), crosses))
    return F.when(F.size(col(polygon)) < 3, F.lit(False)).otherwise(hits % 2 == 1)


def ray_segment_m(x, y, dir_x, dir_y, ax, ay, bx, by) -> Column:
    """Distance along a unit ray to a segment, NULL when it misses."""
    sx, sy = col(bx) - col(ax), col(by) - col(ay)
    det = col(dir_x) * sy - col(dir_y) * sx
    ox, oy = col(ax) - col(x), col(ay) - col(y)
    t = (ox * sy - oy * sx) / det
    u = (ox * col(dir_y) - oy * col(dir_x)) / det
    return F.when((F.abs(det) >= 1e-9) & (t >= 0) & (u >= 0) & (u <= 1), t)


def ray_polygon_m(x, y, dir_x, dir_y, polygon, max_m: float) -> Column:
    """First hit of a unit ray on an (x, y) polygon: 0 inside, NULL for a miss."""
    hits = F.transform(_edges(polygon), lambda e: ray_segment_m(
        x, y, dir_x, dir_y, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]))
    nearest = F.array_min(F.filter(hits, lambda d: d <= max_m))
    return (F.when(F.size(col(polygon)) < 3, F.lit(None).cast("double"))
            .when(point_in_polygon(x, y, polygon), F.lit(0.0)).otherwise(nearest))


def planar_segment_m(x, y, ax, ay, bx, by) -> Column:
    dx, dy = col(bx) - col(ax), col(by) - col(ay)
    length_sq = dx * dx + dy * dy
    t = F.when(length_sq > 0, clamp(((col(x) - col(ax)) * dx + (col(y) - col(ay)) * dy) / length_sq, 0.0, 1.0)
               ).otherwise(F.lit(0.0))
    return F.hypot(col(x) - (col(ax) + dx * t), col(y) - (col(ay) + dy * t))


def polyline_m(x, y, line) -> Column:
    """Planar distance to an array of (x, y) points; NULL below two points."""
    path = col(line)
    pairs = F.zip_with(F.slice(path, 1, F.size(path) - 1), F.slice(path, 2, F.size(path) - 1),
                       lambda a, b: planar_segment_m(x, y, a["x"], a["y"], b["x"], b["y"]))
    return F.when(F.size(path) >= 2, F.array_min(pairs))


def way_distance_m(lat, lng, line) -> Column:
    """Distance to an array of (lat, lng) points; NULL below two points."""
    path = col(line)
    pairs = F.zip_with(F.slice(path, 1, F.size(path) - 1), F.slice(path, 2, F.size(path) - 1),
                       lambda a, b: point_segment_m(lat, lng, a["lat"], a["lng"], b["lat"], b["lng"]))
    return F.when(F.size(path) >= 2, F.array_min(pairs))


def way_bearing(line) -> Column:
    first, last = F.element_at(col(line), 1), F.element_at(col(line), -1)
    return F.when(F.size(col(line)) >= 2,
                  bearing_deg(first["lat"], first["lng"], last["lat"], last["lng"]))
