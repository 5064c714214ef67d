"""Robust transform fits per group of tie points (seeded, so a retried task gives the same result)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODELS = {"TRANSLATION": (1, 2), "SIMILARITY": (2, 4), "AFFINE": (3, 6), "HOMOGRAPHY": (4, 8)}
FIT = "pair_id long, model string, inliers long, n long, rmse double, bic double, " + ", ".join(f"h{i}{j} double" for i in range(3) for j in range(3))


def fit(model: str, src: np.ndarray, ref: np.ndarray) -> np.ndarray | None:
    """Least-squares transform from src to ref, or null where the points do not fix one."""
    one, zero = np.ones(len(src)), np.zeros(len(src))
    x, y = src.T
    if model == "TRANSLATION":
        h = np.eye(3)
        h[:2, 2] = (ref - src).mean(0)
        return h
    if model == "HOMOGRAPHY":
        # both sides centred and scaled first
        def norm(p):
            c, s = p.mean(0), np.sqrt(2) / max(1e-12, np.sqrt(((p - p.mean(0)) ** 2).sum(1)).mean())
            return np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])

        a, b = norm(src), norm(ref)
        (x, y), (u, v) = (src @ a[:2, :2].T + a[:2, 2]).T, (ref @ b[:2, :2].T + b[:2, 2]).T
        rows = np.concatenate([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y, -u], 1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y, -v], 1)])
        h = np.linalg.inv(b) @ np.linalg.svd(rows, full_matrices=len(rows) < 9)[2][-1].reshape(3, 3) @ a
        return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None
    if model == "SIMILARITY":
        rows = np.concatenate([np.stack([x, -y, one, zero], 1), np.stack([y, x, zero, one], 1)])
        p, _, rank, _ = np.linalg.lstsq(rows, np.concatenate([ref[:, 0], ref[:, 1]]), rcond=None)
        return np.array([[p[0], -p[1], p[2]], [p[1], p[0], p[3]], [0, 0, 1]]) if rank == 4 else None
    p, _, rank, _ = np.linalg.lstsq(np.stack([x, y, one], 1), ref, rcond=None)
    return np.vstack([p.T, [0, 0, 1]]) if rank == 3 else None


def residuals(h: np.ndarray, src: np.ndarray, ref: np.ndarray) -> np.ndarray:
    p = np.column_stack([src, np.ones(len(src))]) @ h.T
    w = np.where(np.abs(p[:, 2:]) < 1e-12, 1e-12, p[:, 2:])
    return np.sqrt(((p[:, :2] / w - ref) ** 2).sum(1))


def draws(share: float, least: int, confidence: float) -> float:
    """Draws after which one of inliers only was met with this confidence, where this share are inliers."""
    clean = share**least
    return np.log1p(-confidence) / np.log1p(-clean) if 0 < clean < 1 else (0.0 if clean else np.inf)


def sample_fits(model: str, src: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """Transforms through many minimal samples at once: src and ref (samples, points, 2) to (samples, 3, 3), NaN where none."""
    n, k = src.shape[:2]
    h = np.zeros((n, 3, 3))
    h[:, 2, 2] = 1
    if model == "TRANSLATION":
        h[:, 0, 0] = h[:, 1, 1] = 1
        h[:, :2, 2] = (ref - src)[:, 0]
        return h
    if model == "SIMILARITY":
        z, w = src[..., 0] + 1j * src[..., 1], ref[..., 0] + 1j * ref[..., 1]
        gap = z[:, 1] - z[:, 0]
        turn = np.divide(w[:, 1] - w[:, 0], gap, out=np.full(n, np.nan, complex), where=np.abs(gap) > 1e-12)
        move = w[:, 0] - turn * z[:, 0]
        h[:, 0, 0], h[:, 0, 1], h[:, 0, 2] = turn.real, -turn.imag, move.real
        h[:, 1, 0], h[:, 1, 1], h[:, 1, 2] = turn.imag, turn.real, move.imag
        return h
    one = np.concatenate([src, np.ones((n, k, 1))], 2)
    if model == "AFFINE":
        usable = np.abs(np.linalg.det(one)) > 1e-9
        h[usable, :2] = np.swapaxes(np.linalg.solve(one[usable], ref[usable]), 1, 2)
        h[~usable] = np.nan
        return h
    rows = np.zeros((n, 2 * k, 9))
    rows[:, :k, :3] = rows[:, k:, 3:6] = one
    rows[:, :k, 6:], rows[:, k:, 6:] = -ref[..., :1] * one, -ref[..., 1:] * one
    flat = np.linalg.svd(rows)[2][:, -1]
    return (flat / np.where(np.abs(flat[:, 8:]) > 1e-12, flat[:, 8:], np.nan)).reshape(n, 3, 3)


def consensus(model: str, src: np.ndarray, ref: np.ndarray, threshold: float, rounds: int = 5000, seed: int = 7, confidence: float = 0.999, batch: int = 200):
    """Transform, inlier mask and rmse by sample consensus and refits on the inliers; null below the minimum.

    Batches of samples are drawn until the best inlier share so far gives the confidence, rounds of them at most.
    """
    least = MODELS[model][0]
    if len(src) < least:
        return None
    rng, best, count, done, needed = np.random.default_rng(seed), None, -1, 0, np.inf
    # centred and scaled, so that samples are solved well
    centre, size = [p.mean(0) for p in (src, ref)], [max(1e-12, np.abs(p - p.mean(0)).max()) for p in (src, ref)]
    a, b = (src - centre[0]) / size[0], (ref - centre[1]) / size[1]
    x = np.column_stack([a, np.ones(len(a))])
    while done < min(rounds, needed):
        pick = rng.random((batch, len(src))).argpartition(least - 1, 1)[:, :least] if len(src) < 200 else rng.integers(0, len(src), (batch, least))
        done += batch
        pick.sort(1)
        h = sample_fits(model, *(p[pick[(pick[:, 1:] != pick[:, :-1]).all(1)]] for p in (a, b)))
        h = h[np.isfinite(h).all((1, 2))]
        for i in range(0, len(h), max(1, 1_000_000 // len(src))):
            p = x @ np.swapaxes(h[i:i + max(1, 1_000_000 // len(src))], 1, 2)
            w = np.where(np.abs(p[..., 2:]) < 1e-12, 1e-12, p[..., 2:])
            inside = ((p[..., :2] / w - b) ** 2).sum(2) <= (threshold / size[1]) ** 2
            top = int(inside.sum(1).argmax())
            if inside[top].sum() > count:
                best, count = inside[top], int(inside[top].sum())
        if count > 0:
            needed = draws(count / len(src), least, confidence)
    if best is None or count < least:
        return None
    for _ in range(3):
        h = fit(model, src[best], ref[best])
        if h is None:
            return None
        r = residuals(h, src, ref)
        best = r <= threshold
        if best.sum() < least:
            return None
    return h, best, float(np.sqrt((r[best] ** 2).mean()))


def fitted(points: DataFrame, models: tuple[str, ...] = ("HOMOGRAPHY",), threshold: float = 3.0, rounds: int = 5000, confidence: float = 0.999) -> DataFrame:
    """One row for each pair and model that could be fitted; rounds and confidence bound the draws of consensus()."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tp_id")
        src, ref = pdf[["src_x", "src_y"]].to_numpy(), pdf[["ref_x", "ref_y"]].to_numpy()
        rows = []
        for m in models:
            if (got := consensus(m, src, ref, threshold, rounds, confidence=confidence)) is not None:
                h, inside, rmse = got
                n = len(src)
                rows.append((pdf["pair_id"].iloc[0], m, int(inside.sum()), n, rmse, n * np.log(rmse**2 + 1e-6) + MODELS[m][1] * np.log(max(n, 1)), *h.ravel().tolist()))
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in FIT.split(", ")])

    return points.select("pair_id", "tp_id", "src_x", "src_y", "ref_x", "ref_y").groupBy("pair_id").applyInPandas(run, FIT)


def selected(fits: DataFrame) -> DataFrame:
    """The model of most inliers, then of least BIC, then of fewest parameters."""
    order = F.create_map(*(F.lit(x) for m, (_, k) in MODELS.items() for x in (m, k)))
    return fits.groupBy("pair_id").agg(F.max_by(F.struct(*[c for c in fits.columns if c != "pair_id"]), F.struct(F.col("inliers"), -F.col("bic"), -F.element_at(order, F.col("model")))).alias("best")).select("pair_id", "best.*")


def local_affine(points: DataFrame, fits: DataFrame, size: float, grid: int = 4, max_condition: float = 100.0, max_shift: float = 8.0) -> DataFrame:
    """Affine fit of each tile of a grid, or the pair's global fit where a tile's is not fit for use.

    Per tile: pair_id, tile, n, source (local or fallback), rmse, shift (largest move against the global fit).
    """
    tile = (F.least(F.lit(grid - 1), F.floor(F.col("src_y") / size * grid)) * grid + F.least(F.lit(grid - 1), F.floor(F.col("src_x") / size * grid))).cast("int")
    cells = fits.select("pair_id", F.explode(F.sequence(F.lit(0), F.lit(grid * grid - 1))).alias("tile"), *[f"h{i}{j}" for i in range(3) for j in range(3)])
    held = points.select("pair_id", tile.alias("tile"), "tp_id", "src_x", "src_y", "ref_x", "ref_y")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        h = pdf[[f"h{i}{j}" for i in range(3) for j in range(3)]].iloc[0].to_numpy().reshape(3, 3)
        pdf = pdf.dropna(subset=["tp_id"]).sort_values("tp_id")
        src, ref = pdf[["src_x", "src_y"]].to_numpy(), pdf[["ref_x", "ref_y"]].to_numpy()
        y, x = divmod(key[1], grid)
        side = size / grid
        corners = np.array([(x + i, y + j) for i in (0, 1) for j in (0, 1)], float) * side
        source, rmse, shift = "fallback", float(np.sqrt((residuals(h, src, ref) ** 2).mean())) if len(src) else np.nan, 0.0
        own = fit("AFFINE", src, ref) if len(src) >= 4 else None
        if own is not None and np.linalg.cond(own[:2, :2]) <= max_condition:
            p = np.column_stack([corners, np.ones(4)]) @ h.T
            move = residuals(own, corners, p[:, :2] / p[:, 2:]).max()
            if move <= max_shift:
                source, shift, rmse = "local", float(move), float(np.sqrt((residuals(own, src, ref) ** 2).mean()))
        return pd.DataFrame({"pair_id": [key[0]], "tile": [key[1]], "n": [len(src)], "source": [source], "rmse": [rmse], "shift": [shift]})

    return cells.join(held, ["pair_id", "tile"], "left").groupBy("pair_id", "tile").applyInPandas(run, "pair_id long, tile int, n long, source string, rmse double, shift double")


def local_summary(tiles: DataFrame) -> DataFrame:
    """For each pair of local_affine(): mean rmse of the tiles that have one above 0, largest shift, local and fallback tiles."""
    return tiles.groupBy("pair_id").agg(
        F.avg(F.when(~F.isnan("rmse") & (F.col("rmse") > 0), F.col("rmse"))).alias("mean_rmse"), F.max("shift").alias("max_shift"),
        F.count_if(F.col("source") == "local").alias("local_tiles"), F.count_if(F.col("source") == "fallback").alias("fallback_tiles"))
