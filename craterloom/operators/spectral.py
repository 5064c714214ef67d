"""Spectral cubes in long form (cube_id, band, y, x, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from craterloom.functions import photometry as P


def nanometres(wavelengths: Column) -> Column:
    """Wavelengths below 50 are micrometres."""
    return F.when(F.array_max(wavelengths) < 50, F.transform(wavelengths, lambda w: w * 1000)).otherwise(wavelengths)


def clean_bands(cube: DataFrame, max_empty: float = 0.40, min_variance: float = 1e-7) -> DataFrame:
    """Bands with enough valid, varying pixels; empty pixels take the band's median."""
    stats = cube.groupBy("cube_id", "band").agg((1 - F.count("value") / F.count("*")).alias("empty"), F.var_pop("value").alias("var"), F.percentile("value", 0.5).alias("median"))
    good = stats.where((F.col("empty") <= max_empty) & (F.col("var") >= min_variance)).select("cube_id", "band", "median")
    return cube.join(good, ["cube_id", "band"]).withColumn("value", F.coalesce("value", "median")).drop("median")


def band_mean(cube: DataFrame) -> DataFrame:
    return cube.groupBy("cube_id", "y", "x").agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("value"))


def continuum(cube: DataFrame, wavelengths: DataFrame, low: float = 1000.0, high: float = 1250.0) -> DataFrame:
    """Mean over the bands in a wavelength range, or the nearest band to its middle, then a 1-99 % stretch.

    wavelengths: band, nm.
    """
    clean = clean_bands(cube)
    bands = clean.select("cube_id", "band").distinct().join(wavelengths, "band")
    middle = (low + high) / 2
    pick = bands.groupBy("cube_id").agg(F.max(F.col("nm").between(low, high)).alias("any"), F.min_by("band", F.struct(F.abs(F.col("nm") - middle), F.col("band"))).alias("near"))
    used = bands.join(pick, "cube_id").where((F.col("any") & F.col("nm").between(low, high)) | (~F.col("any") & (F.col("band") == F.col("near")))).select("cube_id", "band")
    image = clean.join(used, ["cube_id", "band"]).groupBy("cube_id", "y", "x").agg(F.avg("value").alias("value"))
    cuts = image.groupBy("cube_id").agg(F.percentile("value", 0.01).alias("low"), F.percentile("value", 0.99).alias("high"))
    return image.join(cuts, "cube_id").select("cube_id", "y", "x", P.stretched(F.col("value"), F.col("low"), F.col("high")).alias("value"))


def covariance(cube: DataFrame) -> DataFrame:
    """Sample covariance of each pair of bands a <= b over a cube's pixels."""
    clean = clean_bands(cube)
    a, b = (clean.select("cube_id", "y", "x", F.col("band").alias(p), F.col("value").alias(f"v{p}")) for p in "ab")
    return a.join(b, ["cube_id", "y", "x"]).where("a <= b").groupBy("cube_id", "a", "b").agg(F.covar_samp("va", "vb").alias("cov"))


def structural_band(cube: DataFrame, stretch: bool = True) -> DataFrame:
    """First principal component of each cube, its sign that of its correlation with the band mean.

    stretch: to [0, 1] between its 1st and 99th percentile.  All pixels fix the component, none are left out.
    """
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index=["y", "x"], columns="band", values="value").sort_index()
        v = wide.to_numpy()
        centred = v - v.mean(0)
        if v.shape[1] == 1:
            score = centred[:, 0]
        else:
            _, vectors = np.linalg.eigh(np.cov(centred, rowvar=False))
            score = centred @ vectors[:, -1]
            if (score * (v.mean(1) - v.mean())).sum() < 0:
                score = -score
        if stretch:
            low, high = np.percentile(score, [1, 99])
            score = np.clip((score - low) / max(high - low, 1e-5), 0, 1)
        return pd.DataFrame({"cube_id": pdf["cube_id"].iloc[0], "y": wide.index.get_level_values(0), "x": wide.index.get_level_values(1), "value": score})

    return clean_bands(cube).groupBy("cube_id").applyInPandas(run, "cube_id long, y int, x int, value double")


def band_axis(d0: Column, d1: Column, d2: Column, bands: Column) -> Column:
    """Which axis of a cube holds its bands: the one of that size (first, last, middle), else the odd one out or the short last one."""
    return (
        F.when(d0 == bands, 0).when(d2 == bands, 2).when(d1 == bands, 1).when((d0 == d1) & (d2 != d0), 2).when((d2 < d0) & (d2 < d1), 2).otherwise(0)
    )


def representation(bands: Column, has_wavelengths: Column) -> Column:
    """How a product becomes one image: as it is, by its continuum, or by its first principal component."""
    return F.when(F.coalesce(bands, F.lit(1)) <= 1, "single_band").when(has_wavelengths, "continuum").otherwise("pca")


def registration_windows(products: DataFrame) -> DataFrame:
    """The whole image of each product with known size as one window; overlap stays unknown until geometry says more."""
    c = F.col
    known = products.where((c("width") > 0) & (c("height") > 0))
    return known.select(
        "k", F.lit(0).alias("row_off"), F.lit(0).alias("col_off"), c("height").alias("h"), c("width").alias("w"), representation(c("band_count"), c("gsd_m").isNotNull()).alias("representation"),
        F.lit("OVERLAP_UNKNOWN").alias("overlap_status"))
