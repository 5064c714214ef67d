"""Queries on descriptor matching, robust fits and tile kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from craterloom.operators import estimation as E
from craterloom.operators import kernels as K
from craterloom.operators import matching as M
from craterloom.operators import thinning as N
from craterloom.plans.inputs import duck, relation
from craterloom.plans.registry import query, rounded

_V = "CAST(embedding AS DOUBLE[])"
_ROOT = f"list_transform({_V}, lambda x: sign(x) * sqrt(abs(x) / greatest(list_sum(list_transform({_V}, lambda y: abs(y))), 1e-7)))"


def _sides(spark, d, root: bool = False):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    v = F.col("embedding").cast("array<double>")
    e = e.select(F.floor(F.col("vec_id") / 100).cast("long").alias("pair_id"), F.col("vec_id").alias("id"), (M.root_normalised(v) if root else v).alias("v"))
    return e.where("id % 2 = 0"), e.where("id % 2 = 1")


def _two(v: str, a: int) -> str:
    return f"""SELECT a.pair_id, a.id, b.id AS near, round(list_distance(a.v, b.v), 9) AS d, row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance(a.v, b.v), 9), b.id) AS r FROM s a JOIN s b ON a.pair_id = b.pair_id AND a.id % 2 = {a} AND b.id % 2 = {1 - a}"""


def _match(v: str, ratio: float, mutual: bool) -> str:
    back = f"AND EXISTS (SELECT 1 FROM y WHERE y.r = 1 AND y.id = p.near AND y.near = p.id)" if mutual else ""
    return f"""WITH s AS (SELECT CAST(vec_id // 100 AS BIGINT) AS pair_id, vec_id AS id, {v} AS v FROM embeddings), x AS ({_two(v, 0)}), y AS ({_two(v, 1)}) SELECT p.pair_id, p.id AS source, p.near AS target, round(p.d, 6) AS distance, round(1 - p.d / (q.d + 1e-6), 6) AS confidence
 FROM x p JOIN x q ON p.id = q.id AND p.r = 1 AND q.r = 2 WHERE p.d < {ratio} * q.d {back}"""


@query("J7", _match(_V, 0.96, True))
def j7_mutual_ratio_match(spark, d):
    return rounded(M.ratio_matches(*_sides(spark, d), ratio=0.96))


@query("J8", _match(_ROOT, 0.98, False).replace("round(1 - p.d / (q.d + 1e-6), 6) AS confidence", "round(greatest(0.1, least(1, 1 - p.d / (q.d + 1e-6))), 6) AS confidence"))
def j8_root_ratio_match(spark, d):
    m = M.ratio_matches(*_sides(spark, d, root=True), ratio=0.98, mutual=False)
    return rounded(m.withColumn("confidence", F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.col("confidence")))))


@query("J9", """WITH s AS (SELECT CAST(vec_id // 100 AS BIGINT) AS pair_id, vec_id AS id, (vec_id * 2654435761) % 4294967296 AS v FROM embeddings), x AS (SELECT a.pair_id, a.id, b.id AS near, bit_count(CAST(xor(a.v, b.v) AS BIGINT)) AS d,
row_number() OVER (PARTITION BY a.id ORDER BY bit_count(CAST(xor(a.v, b.v) AS BIGINT)), b.id) AS r FROM s a JOIN s b ON a.pair_id = b.pair_id AND a.id % 2 = 0 AND b.id % 2 = 1)
SELECT p.pair_id, p.id AS source, p.near AS target, CAST(p.d AS BIGINT) AS distance FROM x p JOIN x q ON p.id = q.id AND p.r = 1 AND q.r = 2 WHERE p.d < 0.8 * q.d""")
def j9_hamming_match(spark, d):
    a, b = (s.select("pair_id", "id", ((F.col("id") * 2654435761) % 4294967296).alias("v")) for s in _sides(spark, d))
    return M.hamming_two_nearest(a, b).where("d1 < 0.8 * d2").select("pair_id", F.col("id").alias("source"), F.col("near1").alias("target"), F.col("d1").alias("distance"))


@query("P15", duck("tie_points") + "SELECT tp_id FROM tie_points WHERE confidence >= 0.3 AND src_x >= 0 AND src_x < 1024 AND src_y >= 0 AND src_y < 1024 AND ref_x >= 0 AND ref_x < 1024 AND ref_y >= 0 AND ref_y < 1024")
def p15_usable_matches(spark, d):
    return M.usable(relation(spark, d, "tie_points"), 0.3, 1024, 1024).select("tp_id")


@query("R12", None)
def r12_homography(spark, d):
    return rounded(E.fitted(relation(spark, d, "tie_points"), ("HOMOGRAPHY",), 0.5), 4)


@query("R13 M13 T7", None)
def r13_model_selection(spark, d):
    return rounded(E.selected(E.fitted(relation(spark, d, "tie_points"), tuple(E.MODELS), 0.5)), 4)


@query("R14 G22", None)
def r14_local_tiles(spark, d):
    p = relation(spark, d, "tie_points")
    return rounded(E.local_affine(p, E.fitted(p, ("AFFINE",), 0.5), 1024.0), 5)


@query("G22", None)
def g22_local_summary(spark, d):
    return rounded(E.local_summary(r14_local_tiles(spark, d)), 5)


#: Tile size of the kernels' queries, and the pixels around a tile that they see.
TILE, HALO = 128, 24


def _image(name: str, kernel, covers: str):
    """Registers a kernel that maps an image to an image, run on tiles with a halo."""
    def f(spark, d):
        def run(k, row, column, own, image):
            out = np.asarray(kernel(image), float)[own]
            y, x = np.indices(out.shape)
            return pd.DataFrame({"raster_id": k, "y": y.ravel() + row + own[0].start, "x": x.ravel() + column + own[1].start, "value": out.ravel()})

        return rounded(K.per_tile(relation(spark, d, "frames"), TILE, HALO, run, "raster_id long, y int, x int, value double"), 5)

    f.__name__ = name
    query(covers)(f)


_image("r3_retinex_clahe", K.enhanced, "R3 W7")
_image("r5_phase_congruency", lambda i: K.phase_congruency(i)[1], "R4 R5")
_image("t8_orientation_index", lambda i: K.phase_congruency(i)[3], "T8 R5")


def _own_corners(image, own):
    """Corners of an image with halo that lie in the tile itself."""
    return [(y, x) for y, x in K.corners(image) if own[0].start <= y < own[0].stop and own[1].start <= x < own[1].stop]


@query("R9", None)
def r9_descriptors(spark, d):
    def run(k, row, column, own, image):
        _, moment, _, mim = K.phase_congruency(image)
        held = [(y + row, x + column, v.round(6)) for y, x in _own_corners(moment, own) if (v := K.mim_descriptor(mim, y, x)) is not None]
        return pd.DataFrame([(k, *r) for r in held], columns=["raster_id", "y", "x", "v"])

    return K.per_tile(relation(spark, d, "frames"), TILE, HALO, run, "raster_id long, y int, x int, v array<double>")


@query("T10", None)
def t10_corners(spark, d):
    def run(k, row, column, own, image):
        at = _own_corners(image, own)
        return pd.DataFrame({"raster_id": k, "n": range(len(at)), "y": [p[0] + row for p in at], "x": [p[1] + column for p in at]})

    return K.per_tile(relation(spark, d, "frames"), TILE, HALO, run, "raster_id long, n int, y int, x int")


def _overviews(spark, d, kernel, schema: str):
    """kernel(pair id, source, reference) for the half-size overviews of each pair of frames."""
    side = lambda s: F.avg(F.when(F.col("side") == s, F.col("value")))
    half = lambda c: (F.col(c) / 2).cast("int").alias(c)
    px = relation(spark, d, "frames").groupBy(F.col("pair_id").alias("raster_id"), half("y"), half("x")).agg(side(0).alias("a"), side(1).alias("b"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return kernel(int(pdf["raster_id"].iloc[0]), *(K.image_of(pdf.assign(value=pdf[c])) for c in "ab"))

    return px.groupBy("raster_id").applyInPandas(run, schema)


@query("R7", None)
def r7_phase_shift(spark, d):
    def run(k, a, b):
        return pd.DataFrame([(k, *K.translation(a, b))], columns=["pair", "dx", "dy", "response"])

    return rounded(_overviews(spark, d, run, "pair long, dx double, dy double, response double"), 5)


@query("R6", None)
def r6_similarity(spark, d):
    def run(k, a, b):
        return pd.DataFrame([(k, *K.similarity(a, b))], columns=["pair", "rotation", "scale", "dx", "dy", "response"])

    return rounded(_overviews(spark, d, run, "pair long, rotation double, scale double, dx double, dy double, response double"), 5)


@query("R11 M14", None)
def r11_ncc_subpixel(spark, d):
    from craterloom.functions.photometry import paraboloid_peak

    names = [f"s{i}{j}" for i in range(3) for j in range(3)]

    def run(k, row, column, own, a, b):
        rows = []
        for y, x in _own_corners(a, own):
            # the reference sees the ground 6 to 11 pixels off
            surface = K.ncc_surface(a, b, y, x, max(0, y + 5 + k), max(0, x - 6 - k))
            if surface is None:
                continue
            py, px = np.unravel_index(surface.argmax(), surface.shape)
            if 0 < py < 4 and 0 < px < 4:
                rows.append((k, y + row, x + column, py - 2 + 5 + k, px - 2 - 6 - k, *surface[py - 1:py + 2, px - 1:px + 2].ravel()))
        return pd.DataFrame(rows, columns=["pair", "y", "x", "my", "mx", *names])

    side = lambda s: F.max(F.when(F.col("side") == s, F.col("value")))
    px = relation(spark, d, "frames").groupBy(F.col("pair_id").alias("raster_id"), "y", "x").agg(side(0).alias("a"), side(1).alias("b"))
    found = K.per_tile(px, TILE, HALO, run, "pair long, y int, x int, my int, mx int, " + ", ".join(f"{n} double" for n in names), ("a", "b"))
    fit = paraboloid_peak({(i - 1, j - 1): F.col(f"s{i}{j}") for i in range(3) for j in range(3)})
    refined = found.select("pair", "y", "x", (F.col("mx") + fit["dx"]).alias("dx"), (F.col("my") + fit["dy"]).alias("dy"), fit["peak"].alias("peak"))
    return rounded(refined.where("dx is not null"), 5)


@query("R20 P24", None)
def r20_tie_point_run(spark, d):
    """From ready tie points: thin, fit, evaluate; one report row for each pair."""
    from craterloom.functions import transforms as T
    from craterloom.operators import gates

    p = relation(spark, d, "tie_points")
    thin = N.cap_cells(M.usable(p, 0.1, 1024, 1024), 1024, 1024, cap=8)
    fits = E.fitted(thin, ("HOMOGRAPHY",), 0.5).withColumn("verdict", T.plausibility())
    res = thin.join(fits, "pair_id").withColumn("res", T.residual(F.col("src_x"), F.col("src_y"), F.col("ref_x"), F.col("ref_y")))
    inside = F.when(F.col("res") <= 0.5, F.col("res"))
    out = res.groupBy("pair_id", "verdict").agg(F.count("*").alias("matches"), F.count(inside).alias("inliers"), F.sqrt(F.avg(inside * inside)).alias("rmse"), F.percentile(inside, 0.95).alias("p95"))
    yes = F.lit(True)
    return rounded(out.withColumn("status", gates.registration_status(yes, F.lit(False), F.col("inliers"), F.col("verdict") == "PLAUSIBLE", yes, yes, yes)), 3)
