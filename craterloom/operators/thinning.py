"""Thinning of tie points and measures of how they are spread, per image pair."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRID = 8


def cell(x: Column, y: Column, width: float, height: float, grid: int = GRID) -> Column:
    """Grid cell of a point, row-major; what lies outside counts to the border cell."""
    at = lambda v, size: F.greatest(F.lit(0), F.least(F.lit(grid - 1), F.floor(v / (size / grid))))
    return (at(y, height) * grid + at(x, width)).cast("int")


def cap_cells(points: DataFrame, width: float, height: float, cap: int = 4, grid: int = GRID) -> DataFrame:
    """The cap points of highest confidence in each cell; ties to the smaller tp_id."""
    best = Window.partitionBy("pair_id", "cell").orderBy(F.desc("confidence"), "tp_id")
    held = points.withColumn("cell", cell(F.col("src_x"), F.col("src_y"), width, height, grid))
    return held.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= cap)


def _entropy(counts: DataFrame, cells: int) -> DataFrame:
    """pair_id, cell, n to the normalised Shannon entropy of each pair."""
    totals = counts.groupBy("pair_id").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("weighted"))
    # -sum p log2 p = log2 total - sum n log2 n / total
    h = (F.log2("total") - F.col("weighted") / F.col("total")) / F.log2(F.lit(float(cells)))
    return totals.select("pair_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), h)).alias("entropy"))


def entropy_clamped(points: DataFrame, width: float, height: float, grid: int = GRID) -> DataFrame:
    held = points.groupBy("pair_id", cell(F.col("src_x"), F.col("src_y"), width, height, grid).alias("cell")).agg(F.count("*").alias("n"))
    return _entropy(held, grid * grid)


def entropy_inside(points: DataFrame, width: float, height: float, grid: int = GRID) -> DataFrame:
    """As entropy_clamped, but points outside do not count; the last edge belongs to the last cell."""
    inside = points.where((F.col("src_x") >= 0) & (F.col("src_x") <= width) & (F.col("src_y") >= 0) & (F.col("src_y") <= height))
    return entropy_clamped(inside, width, height, grid)


def nearest_distance(xy: np.ndarray, rank: np.ndarray | None = None, ignore_zero: bool = False) -> np.ndarray:
    """Distance of each point to its nearest other one (of smaller rank, if ranks are given), infinite without any.

    Points lie sorted in square cells; around each one, rings of cells are searched until the nearest is certain.
    """
    n = len(xy)
    out = np.full(n, np.inf)
    if n < 2:
        return out
    low = xy.min(0)
    side = max(float((xy.max(0) - low).max()) / max(1.0, np.sqrt(n / 2)), 1e-9)
    cell = np.floor((xy - low) / side).astype(np.int64)
    width = int(cell[:, 0].max()) + 1
    key = cell[:, 1] * width + cell[:, 0]
    order = np.argsort(key, kind="stable")
    held = key[order]
    open_, reach = np.arange(n), 1
    while len(open_):
        for dy in range(-reach, reach + 1):
            row = cell[open_, 1] + dy
            first = np.searchsorted(held, row * width + np.maximum(0, cell[open_, 0] - reach))
            last = np.searchsorted(held, row * width + np.minimum(width - 1, cell[open_, 0] + reach), "right")
            many = np.where((row >= 0) & (last > first), last - first, 0)
            for lo in _runs(many, 2_000_000):
                at = np.repeat(open_[lo], many[lo])
                ends = np.cumsum(many[lo])
                other = order[np.repeat(first[lo] - (ends - many[lo]), many[lo]) + np.arange(int(ends[-1]) if len(ends) else 0)]
                d = np.sqrt(((xy[at] - xy[other]) ** 2).sum(1))
                bad = (other == at) if rank is None else (rank[other] >= rank[at])
                if ignore_zero:
                    bad |= d == 0
                d[bad] = np.inf
                np.minimum.at(out, at, d)
        if reach >= width and reach * side >= float((xy.max(0) - low).max()):
            break
        open_ = open_[out[open_] > reach * side]
        reach *= 2
    return out


def _runs(many: np.ndarray, limit: int):
    """Slices of entries that stand for about limit candidates."""
    ends = np.cumsum(many)
    first = 0
    while first < len(many):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + limit, "right")))
        yield slice(first, last)
        first = last


def nearest(points: DataFrame, ignore_zero: bool) -> DataFrame:
    """pair_id, tp_id, distance to the nearest other source point of the pair.

    ignore_zero: coinciding points do not count as neighbours.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = nearest_distance(pdf[["src_x", "src_y"]].to_numpy(), ignore_zero=ignore_zero)
        return pd.DataFrame({"pair_id": pdf["pair_id"], "tp_id": pdf["tp_id"], "nn": np.where(np.isinf(out), np.nan, out)})

    found = points.select("pair_id", "tp_id", "src_x", "src_y").groupBy("pair_id").applyInPandas(run, "pair_id long, tp_id long, nn double")
    return found.withColumn("nn", F.when(~F.isnan("nn"), F.col("nn")))


def suppression_radius(points: DataFrame, target: int) -> DataFrame:
    """The target points of each pair with the largest distance to any stronger point (the strongest: infinite)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["confidence", "tp_id"], ascending=[False, True]).reset_index(drop=True)
        out = nearest_distance(pdf[["src_x", "src_y"]].to_numpy(), rank=np.arange(len(pdf)))
        pdf["radius"] = np.where(np.isinf(out), -1.0, out)
        pdf["order"] = np.arange(len(pdf))
        pdf["key"] = np.where(np.isinf(out), np.inf, out.round(9))
        return pdf.sort_values(["key", "order"], ascending=[False, True])[:target][["pair_id", "tp_id", "radius"]]

    return points.select("pair_id", "tp_id", "src_x", "src_y", "confidence").groupBy("pair_id").applyInPandas(run, "pair_id long, tp_id long, radius double").withColumn(
        "radius", F.when(F.col("radius") >= 0, F.col("radius")))


def _met(points: DataFrame, radius: float) -> DataFrame:
    """Sides a and b (a before b in order of confidence) of the points within radius in reference coordinates, with distance.

    An equi-join on cells twice the radius wide, b in each of the four or so that its radius touches, then the exact
    distance.  Both sides grow with the points, and Spark judges their size by the file: they are never broadcast.
    """
    side = lambda p: (F.col(c).alias(f"{p}_{c}") for c in ("tp_id", "ref_x", "ref_y", "confidence"))
    at = lambda c, by=0.0: F.floor(F.col(c) / (2 * radius) + by)
    touched = lambda c: F.explode(F.sequence(at(c, -0.500001), at(c, 0.500001)))  # noqa: E731 (a little more than the radius, for rounding)
    a = points.select("pair_id", at("ref_x").alias("cx"), at("ref_y").alias("cy"), *side("a"))
    b = points.select("pair_id", touched("ref_x").alias("cx"), *side("b")).select("*", touched("b_ref_y").alias("cy"))
    stronger = (F.col("a_confidence") > F.col("b_confidence")) | ((F.col("a_confidence") == F.col("b_confidence")) & (F.col("a_tp_id") < F.col("b_tp_id")))
    d = F.sqrt(F.pow(F.col("a_ref_x") - F.col("b_ref_x"), 2) + F.pow(F.col("a_ref_y") - F.col("b_ref_y"), 2))
    return a.join(b.hint("merge"), ["pair_id", "cx", "cy"]).where(stronger & (d <= radius)).withColumn("distance", d)


def close_pairs(points: DataFrame, radius: float) -> DataFrame:
    """Pairs of points (a before b in order of confidence) within radius in reference coordinates."""
    return _met(points, radius).select("pair_id", F.col("a_tp_id").alias("strong"), F.col("b_tp_id").alias("weak"), "distance")


#: Close pairs of points of one image pair that one task settles (32 bytes each).
SETTLED_AT_ONCE = 2_000_000


def seam_survivors(points: DataFrame, radius: float = 4.0, at_once: int = SETTLED_AT_ONCE) -> DataFrame:
    """Points with no surviving stronger point within radius, strongest first.

    The close pairs of an image pair are settled in one task.  Where an image pair has more than at_once of them, all are
    settled round by round over many tasks instead, with the same result: each round keeps the undecided points without an
    undecided stronger neighbour and drops their neighbours; rounds are checkpointed.
    """
    edges = _met(points, radius).select("pair_id", F.col("a_tp_id").alias("strong"), F.col("b_tp_id").alias("weak"), F.col("a_confidence").alias("confidence")).checkpoint()
    most = edges.groupBy("pair_id").count().agg(F.max("count")).first()[0]
    if most is None:
        return points
    if most <= at_once:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            gone: set[int] = set()
            for strong, weak in pdf.sort_values(["confidence", "strong"], ascending=[False, True])[["strong", "weak"]].itertuples(index=False):
                if strong not in gone:
                    gone.add(weak)
            return pd.DataFrame({"pair_id": np.full(len(gone), pdf["pair_id"].iloc[0]), "tp_id": np.array(sorted(gone), np.int64)})

        dropped = edges.groupBy("pair_id").applyInPandas(run, "pair_id long, tp_id long")
    else:
        dropped = _settled_in_rounds(edges.drop("confidence"))
    return points.join(dropped.hint("merge"), ["pair_id", "tp_id"], "left_anti")


def _settled_in_rounds(edges: DataFrame) -> DataFrame:
    left, dropped = edges, edges.select("pair_id", F.col("weak").alias("tp_id")).limit(0)
    while not left.isEmpty():
        weak = left.select("pair_id", F.col("weak").alias("tp_id")).distinct()
        keep = left.select("pair_id", F.col("strong").alias("tp_id")).distinct().join(weak.hint("merge"), ["pair_id", "tp_id"], "left_anti")
        gone = left.join(keep.withColumnRenamed("tp_id", "strong").hint("merge"), ["pair_id", "strong"], "left_semi").select("pair_id", F.col("weak").alias("tp_id")).distinct().checkpoint()
        dropped = dropped.unionByName(gone)
        left = left.join(gone.withColumnRenamed("tp_id", "weak").hint("merge"), ["pair_id", "weak"], "left_anti")
        left = left.join(gone.withColumnRenamed("tp_id", "strong").hint("merge"), ["pair_id", "strong"], "left_anti").select("pair_id", "strong", "weak").checkpoint()
    return dropped


def empty_region(counts: list[int], grid: int = GRID) -> int:
    """Cells of the largest four-connected region of empty cells."""
    empty = {i for i, n in enumerate(counts) if not n}
    best = 0
    while empty:
        todo, size = [empty.pop()], 0
        while todo:
            i = todo.pop()
            size += 1
            r, c = divmod(i, grid)
            for j in ([i - grid] if r else []) + ([i + grid] if r + 1 < grid else []) + ([i - 1] if c else []) + ([i + 1] if c + 1 < grid else []):
                if j in empty:
                    empty.remove(j)
                    todo.append(j)
        best = max(best, size)
    return best


def spatial_metrics(points: DataFrame, width: float, height: float, grid: int = GRID) -> DataFrame:
    """Coverage, density, entropy and clustering of each pair's points over a grid, empty cells included."""
    cells = grid * grid
    held = points.groupBy("pair_id", cell(F.col("src_x"), F.col("src_y"), width, height, grid).alias("cell")).agg(F.count("*").alias("n"))
    edge = (F.floor(F.col("cell") / grid).isin(0, grid - 1)) | ((F.col("cell") % grid).isin(0, grid - 1))
    n, sq = F.sum("n"), F.sum(F.col("n") * F.col("n"))
    # one entry for each occupied cell, grid * grid at most
    stats = held.groupBy("pair_id").agg(
        n.alias("points"), F.count("*").alias("occupied_cells"), F.max("n").alias("max_per_cell"), F.min("n").alias("low"), sq.alias("sq"),
        F.sum(F.when(edge, F.col("n")).otherwise(0)).alias("edge"), F.sum(F.col("n") * F.log2("n")).alias("weighted"), F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("by_cell"))
    mean = F.col("points") / cells
    h = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.log2("points") - F.col("weighted") / F.col("points")) / F.log2(F.lit(float(cells)))))
    stats = stats.withColumns({
        "coverage": F.col("occupied_cells") / cells, "mean_density": mean, "density_variance": F.col("sq") / cells - mean * mean,
        "min_per_cell": F.when(F.col("occupied_cells") < cells, F.lit(0)).otherwise(F.col("low")).cast("long"), "max_cluster_fraction": F.col("max_per_cell") / F.col("points"), "entropy": h,
        "edge_imbalance": F.abs(F.col("edge") / F.col("points") - 0.5)})
    near = nearest(points, ignore_zero=False).groupBy("pair_id").agg((F.avg("nn") / float(np.hypot(width, height))).alias("nn_concentration"))
    clustered = (F.col("coverage") < 0.20) | (F.col("max_cluster_fraction") > 0.50) | (F.col("entropy") < 0.35)
    status = F.when(clustered, "CLUSTERED_MATCHES").when(F.col("coverage") >= 0.5, "GOOD_DISTRIBUTION").otherwise("PARTIAL_COVERAGE")
    return stats.join(near, "pair_id").withColumn("status", status).drop("low", "sq", "edge", "weighted")


def largest_empty(metrics: DataFrame, grid: int = GRID) -> DataFrame:
    """pair_id and largest_empty_region, from the counts by cell of spatial_metrics()."""
    def run(frames):
        for pdf in frames:
            size = [empty_region([dict(m).get(i, 0) for i in range(grid * grid)], grid) for m in pdf["by_cell"]]
            yield pd.DataFrame({"pair_id": pdf["pair_id"], "largest_empty_region": np.array(size, np.int64)})

    return metrics.select("pair_id", "by_cell").mapInPandas(run, "pair_id long, largest_empty_region long")


def spatial_quality(points: DataFrame, width: float, height: float, grid: int = GRID) -> DataFrame:
    """Occupied, spanned and edge shares and the mean nearest neighbour; coinciding points are no neighbours."""
    at = lambda v, size: F.greatest(F.lit(0), F.least(F.lit(grid - 1), (v / max(size, 1) * grid).cast("int")))
    x, y = F.col("src_x"), F.col("src_y")
    mx, my = max(width * 0.1, 1.0), max(height * 0.1, 1.0)
    edge = (x <= mx) | (x >= width - mx) | (y <= my) | (y >= height - my)
    span = lambda c, size: (F.max(c) - F.min(c)) / max(size, 1)
    out = points.withColumn("cell", at(y, height) * grid + at(x, width)).groupBy("pair_id").agg(
        (F.count_distinct("cell") / (grid * grid)).alias("occupied_ratio"), F.least(F.lit(1.0), span("src_x", width) * span("src_y", height)).alias("coverage_ratio"), F.avg(edge.cast("int")).alias("edge_ratio"))
    near = nearest(points, ignore_zero=True).groupBy("pair_id").agg(F.avg("nn").alias("mean_nn"))
    good = lambda t: (F.col("occupied_ratio") >= t) & (F.col("coverage_ratio") >= t)
    return out.join(near, "pair_id").withColumn("status", F.when(good(0.5), "GOOD_DISTRIBUTION").when(good(0.2), "PARTIAL_COVERAGE").otherwise("CLUSTERED_MATCHES"))
