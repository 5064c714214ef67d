"""Registration from rasters: overview, coarse overlap, tile windows, matching, seam suppression, fit, evaluation, cascade.

Pixels are rows (pair_id, side, y, x, value), side 0 the source and 1 the reference.  The coarse step sees block
averages of at most OVERVIEW x OVERVIEW pixels of each image; every other task holds one pair of tiles.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from craterloom.functions import transforms as T
from craterloom.operators import estimation as E
from craterloom.operators import kernels as K
from craterloom.operators import thinning as N
from craterloom.operators import warping as W
from craterloom.operators.matching import nearest_two
from craterloom.sources.scratch import ensure_checkpoint_dir

OVERVIEW, CELL = 512, 64
#: A tile's matcher: source tile, reference tile -> rows (source x, y, reference x, y, confidence, subpixel).
Matcher = Callable[[np.ndarray, np.ndarray], list[tuple]]


def rift_matches(source: np.ndarray, reference: np.ndarray, scales: int = 3, orients: int = 4, ratio: float = 0.85) -> list[tuple]:
    """Corners of the phase congruency moment, orientation-index descriptors, mutual ratio test, subpixel refinement."""
    sides = []
    for image in (source, reference):
        _, moment, _, mim = K.phase_congruency(image, scales, orients)
        held = [(p, d) for p in K.corners(moment) if (d := K.mim_descriptor(mim, *p)) is not None]
        if len(held) < 4:
            return []
        sides.append((moment, [p for p, _ in held], np.array([d for _, d in held])))
    (ms, ps, ds), (mr, pr, dr) = sides
    near, d1, d2, back = nearest_two(dr, ds)
    out = []
    for i, (y, x) in enumerate(pr):
        j = near[i]
        if not (d1[i] < ratio * d2[i] and back[j] == i):
            continue
        sy, sx, fine = *ps[j], False
        surface = K.ncc_surface(mr, ms, y, x, sy, sx)
        if surface is not None:
            py, px = np.unravel_index(surface.argmax(), surface.shape)
            if 0 < py < surface.shape[0] - 1 and 0 < px < surface.shape[1] - 1 and (fit := K.paraboloid(surface[py - 1:py + 2, px - 1:px + 2])):
                sx, sy, fine = sx + px - 2 + fit[0], sy + py - 2 + fit[1], True
        out.append((float(sx), float(sy), float(x), float(y), float(1 - d1[i] / (d2[i] + 1e-6)), fine))
    return out


def shapes(pixels: DataFrame) -> DataFrame:
    """pair_id, src_h_all, src_w_all, ref_h, ref_w."""
    size = lambda c, side: F.max(F.when(F.col("side") == side, F.col(c) + 1))
    return pixels.groupBy("pair_id").agg(size("y", 0).alias("src_h_all"), size("x", 0).alias("src_w_all"), size("y", 1).alias("ref_h"), size("x", 1).alias("ref_w"))


def coarse_similarity(pixels: DataFrame, sizes: DataFrame, overview: int = OVERVIEW) -> DataFrame:
    """pair_id, rotation, scale, dx, dy, confidence of the reference against the source, from block averages of both images.

    dx, dy: where the source's origin lies in the reference, in its pixels.
    """
    n = F.least(F.lit(overview), "src_h_all", "src_w_all", "ref_h", "ref_w")
    held = pixels.join(sizes.withColumn("n", n), "pair_id")
    along = lambda axis, src, ref: F.floor(F.col(axis) * F.col("n") / F.when(F.col("side") == 0, F.col(src)).otherwise(F.col(ref))).cast("int")
    small = held.groupBy("pair_id", "side", "n", along("y", "src_h_all", "ref_h").alias("y"), along("x", "src_w_all", "ref_w").alias("x")).agg(F.avg("value").alias("value"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["side"].nunique() < 2:
            return pd.DataFrame({c: [] for c in ("pair_id", "rotation", "scale", "odx", "ody", "confidence")})
        src, ref = (K.stretched(K.image_of(pdf[pdf["side"] == s]), 1, 99) for s in (0, 1))
        return pd.DataFrame([(int(pdf["pair_id"].iloc[0]), *K.similarity(src, ref))], columns=["pair_id", "rotation", "scale", "odx", "ody", "confidence"])

    found = small.groupBy("pair_id").applyInPandas(run, "pair_id long, rotation double, scale double, odx double, ody double, confidence double")
    moved = found.join(sizes.withColumn("n", n), "pair_id")
    return moved.select("pair_id", "rotation", "scale", (F.col("odx") * F.col("ref_w") / F.col("n")).alias("dx"), (F.col("ody") * F.col("ref_h") / F.col("n")).alias("dy"), "confidence")


def windows_of(pixels: DataFrame, tile: int, step: int, max_tiles: int | None = None, coarse: bool = True) -> DataFrame:
    """Pairs of tile windows: pair_id, number, row_off, col_off, h, w of the reference, src_row, src_col, src_h, src_w."""
    sizes = shapes(pixels)
    if coarse:
        held = sizes.join(coarse_similarity(pixels, sizes), "pair_id", "left")
        held = held.fillna({"dx": 0.0, "dy": 0.0, "scale": 1.0, "confidence": 0.0}).withColumns({"src_w": F.col("src_w_all"), "src_h": F.col("src_h_all")})
        held = held.withColumns(W.coarse_roi(tile)).drop("src_w", "src_h")
    else:
        held = sizes.withColumns({"dx": F.lit(0.0), "dy": F.lit(0.0), "confidence": F.lit(0.0), "min_x": F.lit(0), "min_y": F.lit(0), "max_x": F.col("ref_w"), "max_y": F.col("ref_h")})
    held = held.withColumns({"height": F.col("ref_h"), "width": F.col("ref_w")})
    cut = W.source_windows(W.roi_windows(held, tile, step, max_tiles), tile)
    return cut.select("pair_id", "number", "row_off", "col_off", "h", "w", "src_row", "src_col", "src_h", "src_w")


def tile_matches(pixels: DataFrame, windows: DataFrame, matcher: Matcher = rift_matches, least: int = 2) -> DataFrame:
    """Tie points of all pairs of tiles in full coordinates: pair_id, tp_id, src_x, src_y, ref_x, ref_y, confidence, subpixel.

    Pixels come to their windows by an equi-join on cells of CELL pixels.  A tile is stretched from its 1st to its 99th
    percentile, pixels without data are 0.5.  Tiles with fewer than ``least`` matches give none.
    """
    box = lambda side, row, col, h, w: F.struct(F.lit(side).alias("side"), F.col(row).cast("int").alias("top"), F.col(col).cast("int").alias("left"), F.col(h).cast("int").alias("th"), F.col(w).cast("int").alias("tw"))
    both = windows.select("pair_id", "number", F.explode(F.array(box(0, "src_row", "src_col", "src_h", "src_w"), box(1, "row_off", "col_off", "h", "w"))).alias("b")).select("pair_id", "number", "b.*")
    cells = lambda first, n: F.explode(F.sequence(F.expr(f"{first} div {CELL}"), F.expr(f"({first} + {n} - 1) div {CELL}")))
    both = both.withColumn("cy", cells("top", "th")).withColumn("cx", cells("left", "tw"))
    held = pixels.select("pair_id", "side", "y", "x", "value", F.expr(f"y div {CELL}").alias("cy"), F.expr(f"x div {CELL}").alias("cx")).join(both, ["pair_id", "side", "cy", "cx"])
    held = held.where("y >= top and y < top + th and x >= left and x < left + tw").select("pair_id", "number", "side", "top", "left", "th", "tw", "y", "x", "value")
    names = ["pair_id", "tp_id", "src_x", "src_y", "ref_x", "ref_y", "confidence", "subpixel"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pair, number = (int(k) for k in key)
        tiles = []
        for side in (0, 1):
            own = pdf[pdf["side"] == side]
            if not len(own):
                return pd.DataFrame({c: [] for c in names})
            top, left, h, w = (int(own[c].iloc[0]) for c in ("top", "left", "th", "tw"))
            image = np.full((h, w), np.nan)
            image[own["y"] - top, own["x"] - left] = own["value"]
            known = np.isfinite(image)
            out = np.full((h, w), 0.5)
            if known.any():
                out[known] = K.stretched(image[known], 1, 99)
            tiles.append((top, left, out))
        (st, sl, source), (rt, rl, reference) = tiles
        found = matcher(source, reference)
        if len(found) < least:
            found = []
        return pd.DataFrame([(pair, (number << 20) + i, sx + sl, sy + st, rx + rl, ry + rt, c, bool(fine)) for i, (sx, sy, rx, ry, c, fine) in enumerate(found)], columns=names)

    return held.groupBy("pair_id", "number").applyInPandas(run, "pair_id long, tp_id long, src_x double, src_y double, ref_x double, ref_y double, confidence double, subpixel boolean")


def registered(pixels: DataFrame, tile: int = 1024, overlap: int = 128, threshold: float = 2.0, radius: float = 4.0, max_tiles: int | None = None,
               matcher: Matcher = rift_matches, coarse: bool = True) -> tuple[DataFrame, DataFrame]:
    """(tie points kept at seams, one homography from source to reference for each pair that has one)."""
    if overlap >= tile:
        raise ValueError("the overlap must be smaller than the tile")
    ensure_checkpoint_dir(pixels.sparkSession)
    # matched once: what follows reads the tie points several times
    points = tile_matches(pixels, windows_of(pixels, tile, tile - overlap, max_tiles, coarse), matcher).checkpoint()
    kept = N.seam_survivors(points, radius)
    return kept, E.fitted(kept, ("HOMOGRAPHY",), threshold)


def report(points: DataFrame, fits: DataFrame, threshold: float = 2.0) -> DataFrame:
    """One row for each pair: matches, inliers, rmse and 95th percentile of the inliers' residuals, verdict on the transform."""
    res = points.join(fits.withColumn("verdict", T.plausibility()).drop("rmse", "n", "inliers", "bic", "model"), "pair_id")
    res = res.withColumn("res", T.residual(F.col("src_x"), F.col("src_y"), F.col("ref_x"), F.col("ref_y")))
    inside = F.when(F.col("res") <= threshold, F.col("res"))
    return res.groupBy("pair_id", "verdict").agg(F.count("*").alias("matches"), F.count(inside).alias("inliers"), F.sqrt(F.avg(inside * inside)).alias("rmse"), F.percentile(inside, 0.95).alias("p95"))


def ground_truth(keys: DataFrame) -> DataFrame:
    """pair_id and the affine part h00 .. h12 of the true transform from source to reference of the benchmark pairs of keys (k).

    A reference pixel (x, y) shows the place (a x - b y + c, b x + a y + e) of its source.
    """
    a, b, c, e = F.lit(1.0) + F.col("k") * 0.002, F.lit(0.012), F.lit(6.25) + F.col("k"), F.lit(-4.5) - F.col("k")
    n = a * a + b * b
    return keys.select(F.col("k").alias("pair_id"), (a / n).alias("h00"), (b / n).alias("h01"), (-(a * c + b * e) / n).alias("h02"), (-b / n).alias("h10"), (a / n).alias("h11"), (-(a * e - b * c) / n).alias("h12"))


def scaled(fits: DataFrame, ratio: float) -> DataFrame:
    """Fits on images resampled by ratio, in the pixels of the image before that."""
    return fits.withColumns({f"h{i}{j}": F.col(f"h{i}{j}") / ratio for i in range(3) for j in range(2)})


def cascade(fine: DataFrame, middle: DataFrame, coarse: DataFrame, sizes: dict[str, int], gsd: dict[str, float], tile: int, overlap: int, threshold: float = 2.0) -> DataFrame:
    """Two registrations and their product: for each pair_id the steps ``fine_to_middle``, ``middle_to_coarse``, ``fine_to_coarse``.

    Images are rows (pair_id, y, x, value) of sizes[name] x sizes[name] pixels.  The finer image of each step is resampled to
    the coarser one's ground sample distance; a step without a fit falls back to the bare ratio of scales.
    """
    def step(a: DataFrame, b: DataFrame, na: str, nb: str) -> DataFrame:
        ratio = gsd[nb] / gsd[na]
        small, _, _ = W.to_common_gsd(a.withColumnRenamed("pair_id", "key"), sizes[na], sizes[na], gsd[na], gsd[nb])
        both = small.select(F.col("key").alias("pair_id"), F.lit(0).alias("side"), "y", "x", "value").unionByName(b.select("pair_id", F.lit(1).alias("side"), "y", "x", "value"))
        _, fits = registered(both, tile, overlap, threshold, coarse=False)
        bare = {f"h{i}{j}": F.lit((1 / ratio if i < 2 else 1.0) if i == j else 0.0) for i in range(3) for j in range(3)}
        out = a.select("pair_id").distinct().join(scaled(fits, ratio), "pair_id", "left")
        return out.select("pair_id", F.coalesce("inliers", F.lit(0)).alias("inliers"), *(F.coalesce(F.col(c), bare[c]).alias(c) for c in T.H))

    one, two = step(fine, middle, "fine", "middle"), step(middle, coarse, "middle", "coarse")
    both = one.select("pair_id", *(F.col(c).alias(f"a_{c}") for c in T.H)).join(two.select("pair_id", *(F.col(c).alias(f"b_{c}") for c in T.H)), "pair_id")
    through = both.select("pair_id", F.lit("fine_to_coarse").alias("step"), F.lit(None).cast("long").alias("inliers"), *(c.alias(n) for n, c in T.composed("a_", "b_").items()))
    named = lambda df, name: df.select("pair_id", F.lit(name).alias("step"), "inliers", *T.H)
    return named(one, "fine_to_middle").unionByName(named(two, "middle_to_coarse")).unionByName(through)
