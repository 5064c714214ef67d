"""Planar transforms as nine columns h00 .. h22 (source to reference), closed forms only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

H = [f"h{i}{j}" for i in range(3) for j in range(3)]


def guarded(w: Column, eps: float = 1e-12) -> Column:
    """A denominator: null where it is too near zero."""
    return F.when(F.abs(w) >= eps, w)


def applied(x: Column, y: Column, prefix: str = "") -> tuple[Column, Column]:
    """The transform's image of a point."""
    h = lambda i, j: F.col(f"{prefix}h{i}{j}")
    w = guarded(h(2, 0) * x + h(2, 1) * y + h(2, 2))
    return (h(0, 0) * x + h(0, 1) * y + h(0, 2)) / w, (h(1, 0) * x + h(1, 1) * y + h(1, 2)) / w


def residual(x: Column, y: Column, rx: Column, ry: Column, prefix: str = "") -> Column:
    px, py = applied(x, y, prefix)
    return F.sqrt(F.pow(px - rx, 2) + F.pow(py - ry, 2))


def det3(prefix: str = "") -> Column:
    h = lambda i, j: F.col(f"{prefix}h{i}{j}")
    return (
        h(0, 0) * (h(1, 1) * h(2, 2) - h(1, 2) * h(2, 1)) - h(0, 1) * (h(1, 0) * h(2, 2) - h(1, 2) * h(2, 0))
        + h(0, 2) * (h(1, 0) * h(2, 1) - h(1, 1) * h(2, 0))
    )


def inverse(prefix: str = "") -> dict[str, Column]:
    """Adjugate over determinant; null where the transform has no inverse."""
    h = lambda i, j: F.col(f"{prefix}h{i}{j}")
    d = guarded(det3(prefix))
    minor = lambda i, j: h((i + 1) % 3, (j + 1) % 3) * h((i + 2) % 3, (j + 2) % 3) - h((i + 1) % 3, (j + 2) % 3) * h((i + 2) % 3, (j + 1) % 3)
    return {f"h{i}{j}": minor(j, i) / d for i in range(3) for j in range(3)}


def composed(first: str, then: str) -> dict[str, Column]:
    """then after first, scaled to h22 = 1 where that can be."""
    f, t = (lambda i, j: F.col(f"{first}h{i}{j}")), (lambda i, j: F.col(f"{then}h{i}{j}"))
    raw = {(i, j): sum((t(i, k) * f(k, j) for k in range(3)), F.lit(0.0)) for i in range(3) for j in range(3)}
    scale = F.when(F.abs(raw[2, 2]) > 1e-12, raw[2, 2]).otherwise(1.0)
    return {f"h{i}{j}": raw[i, j] / scale for i in range(3) for j in range(3)}


def singular_values(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """Larger and smaller singular value of ((a, b), (c, d))."""
    f, det = a * a + b * b + c * c + d * d, a * d - b * c
    root = F.sqrt(F.greatest(f * f - 4 * det * det, F.lit(0.0)))
    large = F.sqrt((f + root) / 2)
    return large, F.when(large > 0, F.abs(det) / large).otherwise(0.0)


def plausibility(low: float = 0.05, high: float = 20.0, shear: float = 2.0, tilt: float = 0.05) -> Column:
    """The first rule that a transform breaks, or PLAUSIBLE."""
    s = F.col("h22") + 1e-12
    large, small = singular_values(*(F.col(c) / s for c in ("h00", "h01", "h10", "h11")))
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in H]
    all_finite = finite[0]
    for x in finite[1:]:
        all_finite = all_finite & x
    return (
        F.when(~all_finite, "DEGENERATE_TRANSFORM").when(det3() <= 1e-7, "NON_POSITIVE_DETERMINANT").when((small < low) | (large > high), "SCALE_OUT_OF_BOUNDS")
        .when(large / (small + 1e-12) > 1 + shear, "EXCESSIVE_SHEAR").when((F.abs(F.col("h20") / s) > tilt) | (F.abs(F.col("h21") / s) > tilt), "EXCESSIVE_TILT").otherwise("PLAUSIBLE")
    )


def effective_scale(a: Column, b: Column, c: Column, d: Column) -> Column:
    det = a * d - b * c
    return F.when(det > 0, F.sqrt(det)).otherwise(F.sqrt(a * a + b * b + c * c + d * d) / F.sqrt(F.lit(2.0)))


def bic(n: Column, rmse: Column, k: Column) -> Column:
    return n * F.ln(rmse * rmse + 1e-6) + k * F.ln(F.greatest(n, F.lit(1)))
