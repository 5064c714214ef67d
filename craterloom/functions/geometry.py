"""Spherical geometry, illumination and scoring expressions over columns (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 1737.4


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = RADIUS_KM) -> Column:
    """Great-circle distance in km."""
    s, t = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = s * s + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * t * t
    return 2 * radius * F.atan2(F.sqrt(clamp(a, 0.0, 1.0)), F.sqrt(clamp(1 - a, 0.0, 1.0)))


def solar_separation_deg(az1: Column, el1: Column, az2: Column, el2: Column) -> Column:
    """Angle between two sun directions; null where one is unknown."""
    a1, e1, a2, e2 = map(F.radians, (az1, el1, az2, el2))
    dot = F.cos(e1) * F.cos(e2) * (F.sin(a1) * F.sin(a2) + F.cos(a1) * F.cos(a2)) + F.sin(e1) * F.sin(e2)
    known = az1.isNotNull() & el1.isNotNull() & az2.isNotNull() & el2.isNotNull()
    return F.when(known, F.degrees(F.acos(clamp(dot, -1.0, 1.0))))


def azimuth_delta_deg(a: Column, b: Column) -> Column:
    """Smallest turn between two azimuths."""
    return F.abs(F.pmod(a - b + 180, F.lit(360.0)) - 180)


def unwrapped(longitudes: Column) -> Column:
    """Longitudes in order, each shifted by whole turns to within half a turn of the one before (as shifted)."""
    def step(done: Column, lon: Column) -> Column:
        last = F.element_at(done, -1)
        turns = F.when(lon - last > 180, F.ceil((lon - last - 180) / 360)).when(lon - last < -180, -F.ceil((last - lon - 180) / 360)).otherwise(0)
        return F.when(F.size(done) == 0, F.array(lon)).otherwise(F.concat(done, F.array(lon - 360 * turns)))

    return F.aggregate(longitudes, F.array().cast("array<double>"), step)


def polygon_area_km2(lons: Column, lats: Column, radius: float = RADIUS_KM) -> Column:
    """Area of a spherical polygon as a fan of triangles from its first corner; 0 below three corners."""
    points = F.zip_with(unwrapped(lons), lats, lambda lon, lat: F.struct(
        (F.cos(F.radians(lat)) * F.cos(F.radians(lon))).alias("x"), (F.cos(F.radians(lat)) * F.sin(F.radians(lon))).alias("y"), F.sin(F.radians(lat)).alias("z")))
    dot = lambda a, b: a.x * b.x + a.y * b.y + a.z * b.z

    def triangle(a: Column, b: Column, c: Column) -> Column:
        det = F.abs(a.x * (b.y * c.z - b.z * c.y) + a.y * (b.z * c.x - b.x * c.z) + a.z * (b.x * c.y - b.y * c.x))
        return 2 * F.atan2(det, F.greatest(1 + dot(a, b) + dot(b, c) + dot(c, a), F.lit(1e-15)))

    fan = F.transform(F.sequence(F.lit(1), F.size(points) - 2), lambda i: triangle(F.get(points, F.lit(0)), F.get(points, i), F.get(points, i + 1)))
    area = F.aggregate(fan, F.lit(0.0), lambda acc, x: acc + x) * (radius * radius)
    return F.when(F.size(lons) < 3, F.lit(0.0)).otherwise(area)


def footprint_class(lons: Column, lats: Column, authoritative: Column) -> Column:
    finite = lambda v, lo, hi: F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= lo) & (x <= hi))
    return (
        F.when(lons.isNull() | (F.size(lons) == 0), "GEOMETRY_UNAVAILABLE")
        .when((F.size(lons) < 3) | ~finite(lats, -90, 90) | ~finite(lons, -360, 720), "INVALID_GEOMETRY")
        .when(authoritative, "VALIDATED_GEOSPATIAL").otherwise("APPROXIMATE_GEOGRAPHIC")
    )


def gsd_ratio(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.greatest(a, b) / F.least(a, b))


def metadata_quality(footprint: Column, gsd: Column, sun_az: Column, sun_el: Column, time: Column, located: Column) -> Column:
    """Share of five facts that are known, to two places."""
    tests = (footprint.isNotNull(), F.coalesce(gsd > 0, F.lit(False)), sun_az.isNotNull() & sun_el.isNotNull(), time.isNotNull(), located)
    return F.bround(sum((t.cast("int") for t in tests), F.lit(0)) / 5, 2)


def illumination_score(delta: Column) -> Column:
    return F.when(delta.isNull(), 0.5).when(delta <= 90, 1 - delta / 90 * 0.5).otherwise(F.greatest(F.lit(0.1), 1 - delta / 180))


def scale_score(ratio: Column, limit: float = 320.0) -> Column:
    return F.when(ratio.isNull() | (ratio <= 0), 0.5).when(ratio <= 4, 1.0).when(ratio <= 20, 0.8).when(ratio <= limit, 0.5).otherwise(0.1)


def geometry_score(status: Column) -> Column:
    return F.when(status == "CONFIRMED_OVERLAP", 1.0).when(status == "OVERLAP_UNKNOWN", 0.6).when(status == "NON_OVERLAPPING", 0.0).otherwise(0.5)


def candidate_score(overlap: Column, illumination: Column, ratio: Column, status: Column) -> Column:
    return 0.40 * F.least(F.lit(1.0), F.coalesce(overlap, F.lit(0.0))) + 0.25 * illumination_score(illumination) + 0.20 * scale_score(ratio) + 0.15 * geometry_score(status)


def seconds_between(a: Column, b: Column) -> Column:
    """Seconds between two ISO-8601 strings; null where one can't be read."""
    at = lambda t: F.unix_micros(F.try_to_timestamp(t))
    return F.abs(at(a) - at(b)) / 1e6
