"""Ordered rules that turn metrics into status codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the strategies, statuses and claims.
SPECTRAL = ("IIRS", "HYSI")
FAILED = ("IMPLAUSIBLE_TRANSFORM", "NO_CORRESPONDENCE", "DEGENERATE_TRANSFORM", "WARP_FAILURE", "OUTPUT_VERIFICATION_FAILED")


def strategy(source: Column, reference: Column, ratio: Column, solar_deg: Column, weights: Column) -> Column:
    return (
        F.when(F.upper(source).isin(*SPECTRAL) | F.upper(reference).isin(*SPECTRAL), "classical_rift")
        .when(solar_deg > 45, F.when(weights, "dense_loftr").otherwise("classical_rift")).when(ratio > 4, "hybrid_cascade").when(weights, "dense_loftr").otherwise("classical_rift")
    )


def strategy_reason(solar_deg: Column, ratio: Column, weights: Column, spectral: Column) -> Column:
    return (
        F.when(spectral, "spectral").when(solar_deg > 45, F.format_string("illumination %.1f", solar_deg)).when(ratio > 4, F.format_string("ratio %.1fx", ratio))
        .when(weights, "default").otherwise("no weights")
    )


def modality(source: Column, reference: Column, ratio: Column) -> Column:
    return (
        F.when(F.coalesce(source == "IIRS", F.lit(False)) | F.coalesce(reference == "IIRS", F.lit(False)), "SPECTRAL_TO_2D").when(source == reference, "SAME_MODALITY").when(ratio > 3, "MULTIRESOLUTION").otherwise("CROSS_MODALITY")
    )


def pre_registration(a: dict[str, Column], b: dict[str, Column], overlap: Column, min_dim: int = 16, min_valid: float = 0.15, max_extreme: float = 0.95, min_variance: float = 1e-4) -> Column:
    """a, b: width, height, valid, extreme and variance of two images (width null: no image)."""
    least = lambda c: F.least(a[c], b[c])
    return (
        F.when(a["width"].isNull() | b["width"].isNull() | (a["width"] * a["height"] == 0) | (b["width"] * b["height"] == 0), "DATA_REQUIRED")
        .when((least("width") < min_dim) | (least("height") < min_dim), "INVALID_GEOMETRY").when(overlap < 0.05, "NON_OVERLAPPING").when(least("valid") < min_valid, "INSUFFICIENT_VALID_AREA")
        .when(least("variance") < min_variance, "LOW_TEXTURE").when(F.greatest(a["extreme"], b["extreme"]) > max_extreme, "EXCESSIVE_SHADOW_SATURATION").otherwise("PASSED")
    )


def claims(status: Column, held_out: Column, held_out_rmse: Column, subpixel_rmse: Column, coverage: Column, reopened: Column, scale_ratio: Column, illuminated: Column, kind: Column) -> dict[str, Column]:
    """Graded claims; held_out: status of the held-out metrics, kind: modality class."""
    ok = F.coalesce(status == "SUCCESS", F.lit(False))
    ready = F.coalesce((held_out == "READY") & held_out_rmse.isNotNull(), F.lit(False))
    # a subpixel error of exactly 0 counts as not given
    best = F.coalesce(F.nullif(subpixel_rmse, F.lit(0.0)), held_out_rmse)
    broken = F.coalesce(status.isin("IMPLAUSIBLE_TRANSFORM", "NO_CORRESPONDENCE"), F.lit(False))
    graded = lambda own: F.when(ok & own & ready, "PROVEN").when(ok & own, "SUPPORTED").when(broken, "FAILED").otherwise("DATA_REQUIRED")
    given = lambda c: F.coalesce(c, F.lit(False))
    return {
        "real_registration": F.when(ok & reopened, "PROVEN").when(status.isin(*FAILED), "FAILED").when(status == "PARTIAL", "PARTIAL").otherwise("DATA_REQUIRED"),
        "independent_validation": F.when(ready, "PROVEN").when(held_out == "CHECKPOINT_VALIDATION_FAILED", "FAILED").otherwise("DATA_REQUIRED"),
        "subpixel_accuracy": F.when(ready & given(best < 0.5), "PROVEN").when(ready & given(best < 1.0), "SUPPORTED").when(ready, "FAILED").otherwise("DATA_REQUIRED"),
        "uniform_distribution": F.when(ok & given(coverage >= 0.5), F.when(ready, "PROVEN").otherwise("SUPPORTED")).when(ok & given(coverage >= 0.2), "PARTIAL").when(ok, "FAILED").otherwise("DATA_REQUIRED"),
        "scale_robustness": F.when(ok & given(scale_ratio >= 2) & ready, "PROVEN").when(ok & scale_ratio.isNotNull(), "SUPPORTED").when(broken, "FAILED").otherwise("DATA_REQUIRED"),
        "illumination_robustness": graded(illuminated),
        "cross_modal": graded(given(kind.isin("CROSS_MODALITY", "SPECTRAL_TO_2D", "MULTIRESOLUTION"))),
    }


def compatibility_claims(status: Column, reopened: Column, held_out: Column, held_out_rmse: Column, subpixel_count: Column, coverage: Column, scale_ratio: Column, illuminated: Column, scope: Column, inlier_ratio: Column) -> dict[str, Column]:
    """The two-valued claims under their older names."""
    ok = F.coalesce(status == "SUCCESS", F.lit(False))
    ready = F.coalesce((held_out == "READY") & held_out_rmse.isNotNull(), F.lit(False))
    proven = lambda c: F.when(F.coalesce(c, F.lit(False)), "PROVEN").otherwise("DATA_REQUIRED")
    return {
        "real_registration_supported": proven(ok & reopened), "independent_accuracy_supported": proven(ready), "subpixel_accuracy_supported": proven(ready & (subpixel_count > 0)),
        "uniform_distribution_supported": proven(coverage >= 0.5), "scale_robustness_supported": proven(scale_ratio.isNotNull() & ok), "illumination_robustness_supported": proven(illuminated & ok),
        "validation_scope": F.coalesce(F.nullif(scope, F.lit("")), F.lit("DATA_REQUIRED")), "inlier_ratio_available": F.when(inlier_ratio.isNotNull(), "AVAILABLE").otherwise("NOT_AVAILABLE"),
    }


def validation_status(has_pair: Column, has_checkpoints: Column, n_checkpoints: Column, has_transform: Column, rmse: Column) -> Column:
    return (
        F.when(~has_pair, "NOT_VALIDATED").when(~has_checkpoints, "PENDING_CHECKPOINTS").when(~has_transform, "PENDING_REGISTRATION").when(n_checkpoints < 4, "INSUFFICIENT_CHECKPOINTS")
        .when(rmse < 0.40, "PASS").otherwise("FAIL")
    )


def registration_status(has_data: Column, spectral_uncertain: Column, inliers: Column, plausible: Column, spatial_ok: Column, warped: Column, verified: Column) -> Column:
    return (
        F.when(~has_data, "DATA_REQUIRED").when(spectral_uncertain, "IIRS_REPRESENTATION_UNCERTAIN").when(F.coalesce(inliers, F.lit(0)) < 4, "NO_CORRESPONDENCE").when(~plausible, "IMPLAUSIBLE_TRANSFORM")
        .when(~spatial_ok, "MODEL_MISMATCH").when(~warped, "WARP_FAILURE").when(~verified, "OUTPUT_VERIFICATION_FAILED").otherwise("SUCCESS")
    )
