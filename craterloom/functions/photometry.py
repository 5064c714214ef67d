"""Photometric and peak-fit expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lommel_seeliger(cos_i: Column, cos_e: Column) -> Column:
    return F.greatest(cos_i, F.lit(0.0)) / F.greatest(cos_i + cos_e, F.lit(1e-6))


def minnaert(cos_i: Column, cos_e: Column, k: float = 0.8, eps: float = 1e-6) -> Column:
    return F.greatest(F.pow(F.greatest(cos_i, F.lit(eps)), F.lit(k)) * F.pow(F.greatest(cos_e, F.lit(eps)), F.lit(k - 1)), F.lit(0.0))


def correction(reference: Column, acquired: Column, most: float = 5.0) -> Column:
    """Factor from the acquired to the reference geometry, within [0.1, most]."""
    raw = F.when(acquired > 1e-4, reference / F.greatest(acquired, F.lit(1e-4))).otherwise(1.0)
    return F.least(F.greatest(raw, F.lit(0.1)), F.lit(most))


def sun_vector(azimuth: Column, elevation: Column) -> tuple[Column, Column, Column]:
    a, e = F.radians(azimuth), F.radians(elevation)
    return F.cos(e) * F.sin(a), F.cos(e) * F.cos(a), F.sin(e)


def stretched(value: Column, low: Column, high: Column, least: float = 1e-5) -> Column:
    """value from [low, high] to [0, 1], clipped."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / F.greatest(high - low, F.lit(least))))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.2989 * r + 0.5870 * g + 0.1140 * b


def paraboloid_peak(s: dict[tuple[int, int], Column]) -> dict[str, Column]:
    """Peak of the quadratic through a 3 x 3 surface by finite differences; keys (dy, dx) from -1 to 1.

    dx, dy and the peak value are null where the surface has no maximum within one pixel.
    """
    gx, gy = (s[0, 1] - s[0, -1]) / 2, (s[1, 0] - s[-1, 0]) / 2
    a, b = s[0, 1] - 2 * s[0, 0] + s[0, -1], s[1, 0] - 2 * s[0, 0] + s[-1, 0]
    c = (s[1, 1] - s[1, -1] - s[-1, 1] + s[-1, -1]) / 4
    det = a * b - c * c
    dx, dy = -(b * gx - c * gy) / det, -(a * gy - c * gx) / det
    ok = (det > 1e-9) & (a < 0) & (b < 0) & (F.abs(dx) <= 1) & (F.abs(dy) <= 1)
    peak = s[0, 0] + 0.5 * (gx * dx + gy * dy)
    return {"dx": F.when(ok, dx), "dy": F.when(ok, dy), "peak": F.when(ok, peak), "det": det}
