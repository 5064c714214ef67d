"""Coordinate frames, cameras, uncertainty and small routing rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from craterloom.functions.transforms import singular_values

# Modality of each instrument.
MODALITY = {"OHRC": "OPTICAL", "OHR": "OPTICAL", "LROC_NAC": "OPTICAL", "NAC": "OPTICAL", "TC": "STEREO", "IIRS": "HYPERSPECTRAL", "HYSI": "HYPERSPECTRAL"}


def local_to_full(x: Column, y: Column, pyramid: float = 1.0, resampling: float = 1.0, tile=(0.0, 0.0), window=(0.0, 0.0)) -> tuple[Column, Column]:
    return x * resampling / pyramid + tile[0] + window[0], y * resampling / pyramid + tile[1] + window[1]


def full_to_local(x: Column, y: Column, pyramid: float = 1.0, resampling: float = 1.0, tile=(0.0, 0.0), window=(0.0, 0.0)) -> tuple[Column, Column]:
    return (x - tile[0] - window[0]) * pyramid / resampling, (y - tile[1] - window[1]) * pyramid / resampling


def pinhole(x: Column, y: Column, z: Column, focal: float, cx: float, cy: float) -> tuple[Column, Column]:
    """Image coordinates of a point in the camera's frame; null at a depth of 1 or less."""
    ok = z > 1
    return F.when(ok, cx + focal * x / z), F.when(ok, cy + focal * y / z)


def propagated(r0: Column, r1: Column, a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column, Column, Column]:
    """Covariance after two stages of isotropic errors r0, r1 with the second's linear part ((a, b), (c, d)), and a scalar bound."""
    v0, v1 = r0 * r0, r1 * r1
    large, _ = singular_values(a, b, c, d)
    return v0 * (a * a + b * b) + v1, v0 * (a * c + b * d), v0 * (c * c + d * d) + v1, F.sqrt(F.pow(large * r0, 2) + v1)


def sensor_modality(instrument: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in MODALITY.items() for x in kv))
    return F.coalesce(F.element_at(names, F.upper(F.trim(instrument))), F.lit("UNKNOWN"))


def fits_memory(width: Column, height: Column, limit: int) -> Column:
    """Whether a source and a reference tile of this size, four float arrays each, stay below a number of bytes."""
    pixels = width.cast("long") * height
    return 4 * (4 * pixels + 4 * pixels) <= limit
