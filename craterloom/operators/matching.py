"""Descriptor matching within image pairs: two nearest neighbours, ratio test, mutual check, dense matcher hook."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024


def root_normalised(vector):
    """L1-normalised and square-rooted, sign kept."""
    total = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + F.abs(x))
    return F.transform(vector, lambda x: F.signum(x) * F.sqrt(F.abs(x) / F.greatest(total, F.lit(1e-7))))


def _sides(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("pair_id", "id", "v", F.lit(0).alias("side")).unionByName(b.select("pair_id", "id", "v", F.lit(1).alias("side")))


def nearest_two(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each row of x the nearest row of y, its distance and that of the second; for each row of y the nearest row of x.

    Distances are Euclidean, rounded to 9 digits; ties go to the smaller place, a missing second is infinitely far.
    One pass of blocks of products finds what can be among the nearest, in both directions; only that is measured exactly.
    """
    n, m = len(x), len(y)
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    slack = 1e-9 * (1 + xx.max(initial=0) + yy.max(initial=0))  # what the products may be off by
    two, one = np.full((n, 2), np.inf), np.full(m, np.inf)
    found = []
    for i in range(0, n, BLOCK):
        for j in range(0, m, BLOCK):
            d = xx[i:i + BLOCK, None] + yy[None, j:j + BLOCK] - 2 * x[i:i + BLOCK] @ y[j:j + BLOCK].T
            two[i:i + BLOCK] = np.partition(np.concatenate([two[i:i + BLOCK], d], 1), 1, axis=1)[:, :2]
            one[j:j + BLOCK] = np.minimum(one[j:j + BLOCK], d.min(0))
            p, q = np.nonzero((d <= two[i:i + BLOCK, 1:] + slack) | (d <= one[None, j:j + BLOCK] + slack))
            found.append((p + i, q + j, d[p, q]))
    p, q, d = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, int), np.empty(0, int), np.empty(0))
    can = (d <= two[p, 1] + slack) | (d <= one[q] + slack)
    p, q = p[can], q[can]
    d = np.concatenate([np.sqrt(((x[p[i:i + 65536]] - y[q[i:i + 65536]]) ** 2).sum(1)).round(9) for i in range(0, len(p), 65536)]) if len(p) else np.empty(0)
    order = np.lexsort((q, d, p))
    first = np.searchsorted(p[order], np.arange(n))
    near, d1, d2 = np.zeros(n, int), np.full(n, np.inf), np.full(n, np.inf)
    if m:
        near, d1 = q[order][first], d[order][first]
    if m > 1:
        d2 = d[order][first + 1]
    back = np.zeros(m, int)
    if n:
        order = np.lexsort((p, d, q))
        back = p[order][np.searchsorted(q[order], np.arange(m))]
    return near, d1, d2, back


def two_nearest(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each row of a its nearest row of b in the same pair: pair_id, id, near1, d1, d2 (to the second), mutual.

    a, b: pair_id, id, v (doubles).  The pair's rows meet in one task and are compared in blocks, both ways at
    once, so no distance becomes a row.  Ties go to the smaller id.
    """
    names = ["pair_id", "id", "near1", "d1", "d2", "mutual"]

    def run(both: pd.DataFrame) -> pd.DataFrame:
        left, right = (both[both["side"] == s].sort_values("id") for s in (0, 1))
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in names})
        near, d1, d2, back = nearest_two(np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy()))
        return pd.DataFrame({"pair_id": left["pair_id"], "id": left["id"], "near1": right["id"].to_numpy()[near], "d1": d1, "d2": d2, "mutual": back[near] == np.arange(len(near))})

    found = _sides(a, b).groupBy("pair_id").applyInPandas(run, "pair_id long, id long, near1 long, d1 double, d2 double, mutual boolean")
    return found.withColumn("d2", F.when(F.col("d2") < float("inf"), F.col("d2")))


def ratio_matches(a: DataFrame, b: DataFrame, ratio: float = 0.85, mutual: bool = True) -> DataFrame:
    """pair_id, source, target, distance, confidence of matches that pass the ratio test (and are nearest both ways)."""
    kept = two_nearest(a, b).where(F.col("d2").isNotNull() & (F.col("d1") < ratio * F.col("d2")))
    if mutual:
        kept = kept.where("mutual")
    return kept.select("pair_id", F.col("id").alias("source"), F.col("near1").alias("target"), F.col("d1").alias("distance"), (1 - F.col("d1") / (F.col("d2") + 1e-6)).alias("confidence"))


def hamming_two_nearest(a: DataFrame, b: DataFrame) -> DataFrame:
    """As two_nearest() for descriptors of 64 bits in v (long): pair_id, id, near1, d1, d2, in blocks too."""
    names = ["pair_id", "id", "near1", "d1", "d2"]

    def run(both: pd.DataFrame) -> pd.DataFrame:
        left, right = (both[both["side"] == s].sort_values("id") for s in (0, 1))
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in names})
        x, y, ids = left["v"].to_numpy(np.int64), right["v"].to_numpy(np.int64), right["id"].to_numpy()
        best = np.empty((len(x), 2), np.int64)
        for i in range(0, len(x), BLOCK):
            run_ = np.full((len(x[i:i + BLOCK]), 2), np.iinfo(np.int64).max)
            for j in range(0, len(y), 4 * BLOCK):
                # distance above, place below: the smallest two numbers are the nearest two, ties to the smaller place
                d = np.bitwise_count(x[i:i + BLOCK, None] ^ y[None, j:j + 4 * BLOCK]).astype(np.int64) << 40 | np.arange(j, min(len(y), j + 4 * BLOCK))
                run_ = np.partition(np.concatenate([run_, d], 1), 1, axis=1)[:, :2]
            best[i:i + BLOCK] = run_
        near, d = best & ((1 << 40) - 1), best >> 40
        return pd.DataFrame({"pair_id": left["pair_id"], "id": left["id"], "near1": ids[near[:, 0]], "d1": d[:, 0], "d2": d[:, 1] if len(y) > 1 else d[:, 0]})

    return _sides(a, b).groupBy("pair_id").applyInPandas(run, "pair_id long, id long, near1 long, d1 long, d2 long")


def usable(matches: DataFrame, threshold: float, width: float, height: float) -> DataFrame:
    """Matches of enough confidence with both ends inside their images."""
    inside = lambda x, y: (F.col(x) >= 0) & (F.col(x) < width) & (F.col(y) >= 0) & (F.col(y) < height)
    return matches.where((F.col("confidence") >= threshold) & inside("src_x", "src_y") & inside("ref_x", "ref_y"))


def with_matcher(tiles: DataFrame, matcher: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Any dense matcher as a table function: tiles of a pair in, matches out.  No model ships with this engine."""
    return tiles.groupBy("pair_id").applyInPandas(matcher, schema)
