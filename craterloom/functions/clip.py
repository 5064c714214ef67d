"""Intersection of spherical polygons: clipping needs loops, so it is an Arrow-batched UDF; the rest is columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from craterloom.functions.geometry import RADIUS_KM


def clip(subject: list[tuple[float, float]], window: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The part of a polygon inside a convex, counter-clockwise window (half-plane by half-plane)."""
    out = subject
    for (ax, ay), (bx, by) in zip(window, window[1:] + window[:1]):
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in out]
        cut = []
        for i, (p, s) in enumerate(zip(out, side)):
            q, t = out[i - 1], side[i - 1]
            if (s >= 0) != (t >= 0) and abs(s - t) > 1e-12:
                r = t / (t - s)
                cut.append((q[0] + r * (p[0] - q[0]), q[1] + r * (p[1] - q[1])))
            if s >= 0:
                cut.append(p)
        out = cut
        if not out:
            break
    return out


def sphere_area_km2(polygon: list[tuple[float, float]], radius: float = RADIUS_KM) -> float:
    if len(polygon) < 3:
        return 0.0
    lon, lat = np.radians(np.array(polygon)).T
    v = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], 1)
    a, b, c = v[0][None], v[1:-1], v[2:]
    det = np.abs((a * np.cross(b, c)).sum(1))
    dots = 1 + (a * b).sum(1) + (b * c).sum(1) + (c * a).sum(1)
    return float((2 * np.arctan2(det, np.maximum(dots, 1e-15))).sum() * radius * radius)


def _sound(lon, lat) -> bool:
    return lon is not None and lat is not None and len(lon) >= 3 and bool(np.isfinite(lon).all() and np.isfinite(lat).all() and (np.abs(lat) <= 90).all() and (np.array(lon) >= -360).all() and (np.array(lon) <= 720).all())


def intersection_area_km2(lon_a, lat_a, lon_b, lat_b):
    """Area that two polygons (columns of arrays) share; 0 where one is not a sound polygon."""
    @F.pandas_udf(DoubleType())
    def area(la: pd.Series, pa: pd.Series, lb: pd.Series, pb: pd.Series) -> pd.Series:
        out = []
        for a, b, c, d in zip(la, pa, lb, pb):
            if not (_sound(a, b) and _sound(c, d)):
                out.append(0.0)
                continue
            middle = float(np.mean(a))
            near = lambda x: middle + (np.asarray(x, float) - middle + 180) % 360 - 180  # noqa: E731, B023
            out.append(sphere_area_km2(clip(list(zip(near(a).tolist(), map(float, b))), list(zip(near(c).tolist(), map(float, d))))))
        return pd.Series(out)

    array = ArrayType(DoubleType())
    return area(*(c.cast(array) for c in (lon_a, lat_a, lon_b, lat_b)))
