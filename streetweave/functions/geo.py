"""Column builders for positions, bearings and polygons (degrees, metres, WGS84)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean Earth radius; WGS84 semi-major axis and first eccentricity squared.
EARTH_RADIUS_M = 6371008.8
WGS84_A, WGS84_E2 = 6378137.0, 0.0066943799901413165


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), F.lit(2.0))
    return F.asin(F.least(F.sqrt(a), F.lit(1.0))) * F.lit(2 * EARTH_RADIUS_M)


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from the first to the second position, [0, 360)."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y, x = F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)
    return wrap_360(F.degrees(F.atan2(y, x)))


def destination(lat: Column, lon: Column, bearing: Column, distance_m: Column) -> tuple[Column, Column]:
    """(lat, lon) that many metres off in a direction."""
    p, b, d = F.radians(lat), F.radians(bearing), distance_m / F.lit(EARTH_RADIUS_M)
    p2 = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    lon2 = F.radians(lon) + F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(p2))
    return F.degrees(p2), wrap_180(F.degrees(lon2))


def wrap_360(angle: Column) -> Column:
    return F.pmod(angle, F.lit(360.0))


def wrap_180(angle: Column) -> Column:
    """(-180, 180] as [-180, 180)."""
    return F.pmod(angle + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def angle_between(a: Column, b: Column) -> Column:
    return F.abs(wrap_180(a - b))


def interval_width(start: Column, end: Column) -> Column:
    """Degrees clockwise from start to end."""
    return wrap_360(end - start)


def interval_centre(start: Column, end: Column) -> Column:
    return wrap_360(start + interval_width(start, end) / 2)


def in_interval(angle: Column, start: Column, end: Column) -> Column:
    return interval_width(start, angle) <= interval_width(start, end)


def local_metres(lat0: Column, lon0: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """(east, north) of a position in a metric frame at (lat0, lon0), from the ellipsoid's local radii."""
    s = F.sin(F.radians(lat0))
    w2 = F.lit(1.0) - F.lit(WGS84_E2) * s * s
    prime = F.lit(WGS84_A) / F.sqrt(w2)
    meridian = prime * F.lit(1.0 - WGS84_E2) / w2
    return F.radians(wrap_180(lon - lon0)) * prime * F.cos(F.radians(lat0)), F.radians(lat - lat0) * meridian


def ecef_to_wgs84(x: Column, y: Column, z: Column, steps: int = 8) -> tuple[Column, Column, Column]:
    """(lat, lon, height) of an Earth-centred position, by a fixed number of iterations."""
    p = F.sqrt(x * x + y * y)
    start = F.atan2(z, p * (1 - WGS84_E2))

    def better(phi: Column, _: Column) -> Column:
        n = F.lit(WGS84_A) / F.sqrt(1 - F.lit(WGS84_E2) * F.pow(F.sin(phi), F.lit(2.0)))
        return F.atan2(z + F.lit(WGS84_E2) * n * F.sin(phi), p)

    phi = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, better)
    n = F.lit(WGS84_A) / F.sqrt(1 - F.lit(WGS84_E2) * F.pow(F.sin(phi), F.lit(2.0)))
    return F.degrees(phi), F.degrees(F.atan2(y, x)), p / F.cos(phi) - n


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point to a segment in the plane."""
    dx, dy = x2 - x1, y2 - y1
    along = ((px - x1) * dx + (py - y1) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-12))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return F.sqrt(F.pow(px - x1 - t * dx, F.lit(2.0)) + F.pow(py - y1 - t * dy, F.lit(2.0)))


def crossing_fraction(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Where along a-b it crosses c-d: a share in [0, 1], or null where it doesn't."""
    rx, ry, sx, sy = bx - ax, by - ay, dx - cx, dy - cy
    det = rx * sy - ry * sx
    t = ((cx - ax) * sy - (cy - ay) * sx) / det
    u = ((cx - ax) * ry - (cy - ay) * rx) / det
    return F.when((F.abs(det) > 1e-12) & t.between(0, 1) & u.between(0, 1), t)


def ring_area(ring: Column) -> Column:
    """Signed area of a closed ring of [x, y] points."""
    pairs = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: a[0] * b[1] - b[0] * a[1])
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / 2


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """Mean of a closed ring's vertices, the closing one left out."""
    points = F.slice(ring, 1, F.size(ring) - 1)
    n = F.size(points).cast("double")
    return _mean(points, n, 0), _mean(points, n, 1)


def _mean(points: Column, n: Column, k: int) -> Column:
    return F.aggregate(F.transform(points, lambda p: p[k]), F.lit(0.0), lambda s, x: s + x) / n


def normal_polygons(polygons: Column) -> Column:
    """polygons -> rings -> [lon, lat] points: without points that aren't finite, with rings closed,
    and without rings of fewer than three distinct corners or polygons without an outer ring."""

    def fine(point: Column) -> Column:
        return (F.size(point) >= 2) & ~F.exists(point, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))

    def closed(ring: Column) -> Column:
        return F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))

    rings = F.transform(polygons, lambda rs: F.transform(rs, lambda r: F.filter(r, fine)))
    kept = F.transform(rings, lambda rs: F.transform(F.filter(rs, lambda r: F.size(F.array_distinct(r)) >= 3), closed))
    return F.filter(kept, lambda rs: F.size(rs) > 0)


def tile_bounds(z: Column, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """(west, south, east, north) of a web-map tile."""
    n = F.pow(F.lit(2.0), z)

    def lat(row: Column) -> Column:
        return F.degrees(F.atan(F.sinh(F.lit(3.141592653589793) * (1 - 2 * row / n))))

    return x / n * 360 - 180, lat(y + 1), (x + 1) / n * 360 - 180, lat(y.cast("double"))


def tile_of(z: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """(x, y) of the web-map tile that holds a position."""
    n, p = F.pow(F.lit(2.0), z), F.radians(lat)
    y = (1 - F.log(F.tan(p) + 1 / F.cos(p)) / F.lit(3.141592653589793)) / 2 * n
    return F.floor((lon + 180) / 360 * n), F.floor(y)
