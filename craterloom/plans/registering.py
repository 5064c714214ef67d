"""Queries on warps, resampling, orthorectification, tile windows and registration from rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from craterloom.operators import raster as R
from craterloom.operators import registration as G
from craterloom.operators import warping as W
from craterloom.plans.inputs import SIZE, duck, relation
from craterloom.plans.registry import query, rounded

_FR = duck("frames")
#: A transform from a reference frame's source to its reference that has a little perspective.
_H = {"h00": "(1.01E0 + k * 0.004E0)", "h01": "(0.02E0 - k * 0.01E0)", "h02": "(4.5E0 - k)", "h10": "-0.015E0", "h11": "0.98E0", "h12": "(k + 3.25E0)", "h20": "0.00002E0", "h21": "(k * 0.00001E0)", "h22": "1.0E0"}


def _transforms(spark, d):
    keys = spark.read.parquet(f"{d}/region.parquet").select(F.col("r_regionkey").cast("long").alias("key"), F.col("r_regionkey").cast("long").alias("k"))
    return keys.selectExpr("key", *(f"CAST({e} AS DOUBLE) AS {n}" for n, e in _H.items()))


def _images(spark, d, side: int = 0):
    return relation(spark, d, "frames").where(F.col("side") == side).select(F.col("pair_id").alias("key"), "y", "x", "value")


def _minor(i: int, j: int) -> str:
    a, b = [x for x in range(3) if x != i], [x for x in range(3) if x != j]
    return f"({'-' if (i + j) % 2 else ''}(h{a[0]}{b[0]} * h{a[1]}{b[1]} - h{a[0]}{b[1]} * h{a[1]}{b[0]}))"


#: Bilinear values of frames (key, sy, sx, value) at places (key, y, x, u, v); outside and without data: 0.
_REMAP = """c AS (SELECT key, y, x, CAST(floor(v) AS INT) + j AS sy, CAST(floor(u) AS INT) + i AS sx, CASE WHEN j = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END * CASE WHEN i = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END AS w
 FROM places, range(2) t1(j), range(2) t2(i)), remapped AS (SELECT c.key, c.y, c.x, coalesce(sum(w * coalesce(s.value, 0)), 0) AS value FROM c LEFT JOIN images s ON s.key = c.key AND s.y = c.sy AND s.x = c.sx GROUP BY c.key, c.y, c.x)"""
_IMAGES = ", images AS (SELECT pair_id AS key, y, x, value FROM frames WHERE side = 0)"


@query("R15", _FR + _IMAGES + f""", t AS (SELECT k AS key, {', '.join(f'{e} AS {n}' for n, e in _H.items())} FROM (SELECT CAST(r_regionkey AS BIGINT) AS k FROM region)),
g AS (SELECT t.*, CAST(y AS INT) AS y, CAST(x AS INT) AS x, {_minor(0, 2)} * x + {_minor(1, 2)} * y + {_minor(2, 2)} AS w FROM t, range(96) t1(y), range(96) t2(x)),
places AS (SELECT key, y, x, round(({_minor(0, 0)} * x + {_minor(1, 0)} * y + {_minor(2, 0)}) / w, 9) AS u, round(({_minor(0, 1)} * x + {_minor(1, 1)} * y + {_minor(2, 1)}) / w, 9) AS v FROM g),
{_REMAP} SELECT key, y, x, round(value, 5) AS value FROM remapped""")
def r15_warp(spark, d):
    """Every source frame drawn in the reference's frame through a perspective transform."""
    return rounded(W.warped(_images(spark, d), _transforms(spark, d), 96, 96), 5)


_CAMERA = {"f": 700.0, "cx": 128.0, "cy": 120.0, "x": 130.0, "y": 125.0, "z": 900.0}


@query("R16 M23 M24 G25", _FR + _IMAGES + f""", dem AS (SELECT pair_id AS key, CAST(y / 2 AS INT) AS y, CAST(x / 2 AS INT) AS x, CASE WHEN value IS NOT NULL THEN 100 * value END AS z FROM frames WHERE side = 1 AND y % 2 = 0 AND x % 2 = 0),
d AS (SELECT key, median(z) AS datum FROM dem GROUP BY key), h AS (SELECT dem.key, y, x, datum, coalesce(z, datum) AS z FROM dem JOIN d ON d.key = dem.key),
pl AS (SELECT key, y, x, 128 + 700 * (x * 2.0 - 130) / (900 - z) AS u, 120 + 700 * (y * 2.0 - 125) / (900 - z) AS v, 128 + 700 * (x * 2.0 - 130) / (900 - datum) AS pu, 120 + 700 * (y * 2.0 - 125) / (900 - datum) AS pv FROM h),
places AS (SELECT key, y, x, round(u, 9) AS u, round(v, 9) AS v, sqrt(pow(u - pu, 2) + pow(v - pv, 2)) AS parallax FROM pl), {_REMAP}
SELECT r.key, r.y, r.x, round(r.value, 5) AS value, round(p.parallax, 5) AS parallax FROM remapped r JOIN places p ON p.key = r.key AND p.y = r.y AND p.x = r.x""")
def r16_orthorectify(spark, d):
    """Every source frame on the grid of an elevation model of half its size."""
    return rounded(W.orthorectified(_images(spark, d), _dem(spark, d), _CAMERA, 2.0), 5)


def _dem(spark, d):
    px = _images(spark, d, 1).where("y % 2 = 0 and x % 2 = 0")
    return px.select("key", (F.col("y") / 2).cast("int").alias("y"), (F.col("x") / 2).cast("int").alias("x"), (F.col("value") * 100).alias("z"))


@query("G25", _FR + _IMAGES + """, dem AS (SELECT pair_id AS key, CAST(y / 2 AS INT) AS y, CAST(x / 2 AS INT) AS x, 100 * value AS z FROM frames WHERE side = 1 AND y % 2 = 0 AND x % 2 = 0),
d AS (SELECT key, median(z) AS datum, max(z) - min(z) AS relief FROM dem GROUP BY key),
p AS (SELECT dem.key, sqrt(pow(700 * (x * 2.0 - 130) * (1 / (900 - coalesce(z, datum)) - 1 / (900 - datum)), 2) + pow(700 * (y * 2.0 - 125) * (1 / (900 - coalesce(z, datum)) - 1 / (900 - datum)), 2)) AS parallax FROM dem JOIN d ON d.key = dem.key)
SELECT d.key, round(datum, 5) AS datum, round(relief, 5) AS relief, round(max(parallax), 5) AS max_parallax, round(avg(parallax), 5) AS mean_parallax FROM d JOIN p ON p.key = d.key GROUP BY d.key, datum, relief""")
def g25_parallax(spark, d):
    return rounded(W.parallax_report(W.orthorectified(_images(spark, d), _dem(spark, d), _CAMERA, 2.0), _dem(spark, d)), 5)


def _blur_sql(table: str, axis: str) -> str:
    """One pass of the 3-weight blur of sigma 0.75 along an axis, mirrored."""
    import math

    from craterloom.operators.kernels import gaussian_kernel

    k = gaussian_kernel(0.75).tolist()
    r, n = len(k) // 2, SIZE
    other = "y" if axis == "x" else "x"
    at = f"(abs(a.{axis} + o - {r}) % {2 * n - 2})"
    weights = "CASE o " + " ".join(f"WHEN {i} THEN {w!r}" for i, w in enumerate(k)) + " END"
    assert math.isclose(sum(k), 1)
    return f"SELECT a.key, a.y, a.x, sum({weights} * b.value) AS value FROM {table} a, range({len(k)}) t(o), {table} b WHERE b.key = a.key AND b.{other} = a.{other} AND b.{axis} = CASE WHEN {at} >= {n} THEN {2 * n - 2} - {at} ELSE {at} END GROUP BY a.key, a.y, a.x"


@query("R8", _FR + f""", f AS (SELECT pair_id AS key, y, x, coalesce(value, 0.5) AS value FROM frames WHERE side = 0), bx AS ({_blur_sql('f', 'x')}), b AS ({_blur_sql('bx', 'y')}),
oy AS (SELECT CAST(p AS INT) AS p, CAST(o AS INT) AS o, least(p + 1, (o + 1) * 256 / 102.0) - greatest(p, o * 256 / 102.0) AS w FROM range(256) t1(p), range(102) t2(o) WHERE least(p + 1, (o + 1) * 256 / 102.0) - greatest(p, o * 256 / 102.0) > 1e-9)
SELECT b.key, ry.o AS y, rx.o AS x, round(sum(ry.w * rx.w * value) / sum(ry.w * rx.w), 5) AS value FROM b JOIN oy ry ON ry.p = b.y JOIN oy rx ON rx.p = b.x GROUP BY b.key, ry.o, rx.o""")
def r8_common_gsd(spark, d):
    """Every source frame resampled from 1 m to 2.5 m a pixel."""
    fine = _images(spark, d).withColumn("value", F.coalesce("value", F.lit(0.5)))
    return rounded(W.to_common_gsd(fine, SIZE, SIZE, 1.0, 2.5)[0], 5)


_OVER = """, o AS (SELECT k, CAST(512 + (k % 4) * 256 AS INT) AS ref_w, CAST(512 + (k % 3) * 128 AS INT) AS ref_h, CAST(256 + (k % 5) * 200 AS INT) AS src_w, CAST(300 + (k % 7) * 90 AS INT) AS src_h, lon - 340 AS dx, lat * 2.25 AS dy, 0.5 + k % 9 * 0.125 AS scale, k % 11 * 0.03 AS confidence FROM products)"""
_ROI = """, b AS (SELECT *, greatest(0, CAST(round_even(CASE WHEN confidence > 0.15 THEN dx ELSE least(0, dx) END, 0) AS BIGINT)) AS x0, greatest(0, CAST(round_even(CASE WHEN confidence > 0.15 THEN dy ELSE least(0, dy) END, 0) AS BIGINT)) AS y0,
 least(ref_w, CAST(round_even(CASE WHEN confidence > 0.15 THEN src_w * scale + dx ELSE ref_w + greatest(0, dx) END, 0) AS BIGINT)) AS x1, least(ref_h, CAST(round_even(CASE WHEN confidence > 0.15 THEN src_h * scale + dy ELSE ref_h + greatest(0, dy) END, 0) AS BIGINT)) AS y1 FROM o),
roi AS (SELECT *, x1 - x0 < 128 OR y1 - y0 < 128 AS small FROM b)"""


def _overlaps(spark, d):
    k = F.col("k")
    return relation(spark, d, "products").select(
        "k", (512 + (k % 4) * 256).cast("int").alias("ref_w"), (512 + (k % 3) * 128).cast("int").alias("ref_h"), (256 + (k % 5) * 200).cast("int").alias("src_w"), (300 + (k % 7) * 90).cast("int").alias("src_h"),
        (F.col("lon") - 340).alias("dx"), (F.col("lat") * 2.25).alias("dy"), (0.5 + k % 9 * 0.125).alias("scale"), (k % 11 * 0.03).alias("confidence"))


@query("R19", duck("products") + _OVER + _ROI + """ SELECT k, CAST(CASE WHEN small THEN 0 ELSE x0 END AS BIGINT) AS min_x, CAST(CASE WHEN small THEN 0 ELSE y0 END AS BIGINT) AS min_y, CAST(CASE WHEN small THEN ref_w ELSE x1 END AS BIGINT) AS max_x, CAST(CASE WHEN small THEN ref_h ELSE y1 END AS BIGINT) AS max_y FROM roi""")
def r19_coarse_roi(spark, d):
    return _overlaps(spark, d).select("k", *(c.alias(n) for n, c in W.coarse_roi(256).items()))


def _rois(spark, d):
    """Regions of interest, some beyond the raster, some empty or outside."""
    k = F.col("k")
    return relation(spark, d, "products").select("k", "height", "width", (k % 700 - 100).cast("int").alias("min_x"), (k % 500 - 60).cast("int").alias("min_y"), (k % 1900 - 50).cast("int").alias("max_x"), (k % 1300).cast("int").alias("max_y"))


_ROIS = duck("products") + """, r AS (SELECT k, height, width, CAST(k % 700 - 100 AS INT) AS min_x, CAST(k % 500 - 60 AS INT) AS min_y, CAST(k % 1900 - 50 AS INT) AS max_x, CAST(k % 1300 AS INT) AS max_y FROM products)"""


def _walk(lo: str, hi: str, size: str, off: str) -> str:
    """Offsets of 256-pixel tiles at steps of 192, walked one by one."""
    return f"""SELECT k, {lo} AS p, {hi} AS e, {size} AS n, 0 AS i FROM c UNION ALL SELECT k, p + 192, e, n, i + 1 FROM {off} WHERE NOT (p + least(256, n - p) >= e OR p + least(256, n - p) >= n)"""


@query("R18 T9", _ROIS.replace("WITH ", "WITH RECURSIVE ") + """, c AS (SELECT k, height, width, greatest(0, least(min_x, width)) AS x0, greatest(0, least(max_x, width)) AS x1, greatest(0, least(min_y, height)) AS y0, greatest(0, least(max_y, height)) AS y1 FROM r WHERE width > 0 AND height > 0 AND min_x < max_x AND min_y < max_y AND least(max_x, width) > greatest(min_x, 0) AND least(max_y, height) > greatest(min_y, 0)),
ys AS (""" + _walk("y0", "y1", "height", "ys") + "), xs AS (" + _walk("x0", "x1", "width", "xs") + """), w AS (SELECT ys.k, CAST(ys.p AS INT) AS row_off, CAST(xs.p AS INT) AS col_off, CAST(least(256, ys.n - ys.p) AS INT) AS h, CAST(least(256, xs.n - xs.p) AS INT) AS w, row_number() OVER (PARTITION BY ys.k ORDER BY ys.p, xs.p) - 1 AS number FROM ys JOIN xs ON xs.k = ys.k)
SELECT k, row_off, col_off, h, w, CAST(number AS INT) AS number FROM w WHERE number < 7""")
def r18_roi_windows(spark, d):
    """The first seven windows of each region of interest; regions without an area inside the raster have none."""
    return W.roi_windows(_rois(spark, d), 256, 192, max_tiles=7).select("k", "row_off", "col_off", "h", "w", "number")


@query("R18", _ROIS + """ SELECT k, CASE WHEN width IS NULL OR height IS NULL OR width <= 0 OR height <= 0 THEN 'EMPTY_IMAGE' WHEN min_x >= max_x OR min_y >= max_y THEN 'EMPTY_ROI' WHEN least(max_x, width) <= greatest(min_x, 0) OR least(max_y, height) <= greatest(min_y, 0) THEN 'ROI_OUTSIDE_IMAGE' END AS problem FROM r""")
def r18_roi_problems(spark, d):
    return _rois(spark, d).select("k", W.roi_problem().alias("problem"))


@query("J16", duck("products") + _OVER + """, s AS (SELECT k, CAST(row_off AS INT) AS row_off, CAST(col_off AS INT) AS col_off, greatest(0, least(src_w - 64, CAST(round_even(CASE WHEN confidence > 0.20 THEN col_off - dx ELSE col_off END, 0) AS INT))) AS src_col, greatest(0, least(src_h - 64, CAST(round_even(CASE WHEN confidence > 0.20 THEN row_off - dy ELSE row_off END, 0) AS INT))) AS src_row,
 least(256, ref_w - col_off) AS w, least(256, ref_h - row_off) AS h, src_w AS sw, src_h AS sh FROM o, (SELECT unnest([0, 192]) AS row_off), (SELECT unnest([0, 192, 384]) AS col_off) WHERE row_off < ref_h AND col_off < ref_w)
SELECT k, row_off, col_off, CAST(src_row AS INT) AS src_row, CAST(src_col AS INT) AS src_col, CAST(least(h, sh - src_row) AS INT) AS src_h, CAST(least(w, sw - src_col) AS INT) AS src_w FROM s WHERE least(h, sh - src_row) >= 64 AND least(w, sw - src_col) >= 64""")
def j16_source_windows(spark, d):
    """The source's window for each of up to six reference windows."""
    o = _overlaps(spark, d).withColumnsRenamed({"src_w": "src_w_all", "src_h": "src_h_all"})
    of = lambda *v: F.explode(F.array(*map(F.lit, v)))
    w = o.withColumn("row_off", of(0, 192)).withColumn("col_off", of(0, 192, 384)).where("row_off < ref_h and col_off < ref_w")
    w = w.withColumns({"h": F.least(F.lit(256), F.col("ref_h") - F.col("row_off")), "w": F.least(F.lit(256), F.col("ref_w") - F.col("col_off"))})
    return W.source_windows(w, 256).select("k", "row_off", "col_off", "src_row", "src_col", "src_h", "src_w")


@query("S22 S21", _FR + " SELECT pair_id, side, y, x, round(value, 6) AS value FROM frames")
def s22_benchmark_pairs(spark, d):
    """The benchmark's image pairs with known transforms."""
    return rounded(relation(spark, d, "frames").select("pair_id", "side", "y", "x", "value"))


@query("S22 J11", """SELECT pair_id, round(h00, 9) AS h00, round(h01, 9) AS h01, round(h02, 9) AS h02, round(-h01, 9) AS h10, round(h00, 9) AS h11, round(h12, 9) AS h12 FROM (SELECT k AS pair_id, a / (a * a + b * b) AS h00, b / (a * a + b * b) AS h01, -(a * c + b * e) / (a * a + b * b) AS h02, -(a * e - b * c) / (a * a + b * b) AS h12
FROM (SELECT CAST(r_regionkey AS BIGINT) AS k, 1.0 + r_regionkey * 0.002 AS a, 0.012 AS b, 6.25 + r_regionkey AS c, -4.5 - r_regionkey AS e FROM region))""")
def s22_benchmark_truth(spark, d):
    """The benchmark's manifest: the true transform from source to reference of each pair."""
    return rounded(G.ground_truth(spark.read.parquet(f"{d}/region.parquet").select(F.col("r_regionkey").cast("long").alias("k"))), 9)


def _pairs(spark, d):
    return relation(spark, d, "frames").select("pair_id", "side", "y", "x", "value")


@query("R20 R21 P24 J7 T3", None)
def r20_registration_run(spark, d):
    """From two rasters to a verdict: overviews, coarse overlap, tiles, matching, seams, fit, evaluation."""
    from craterloom.operators import gates

    points, fits = G.registered(_pairs(spark, d), 160, 32)
    out = G.report(points, fits)
    yes = F.lit(True)
    return rounded(out.withColumn("status", gates.registration_status(yes, F.lit(False), F.col("inliers"), F.col("verdict") == "PLAUSIBLE", yes, yes, yes)), 3)


@query("R21 R15", None)
def r21_registered_images(spark, d):
    """The source frames drawn in their references' frames through the transforms that were found; with the reference's value."""
    px = _pairs(spark, d)
    _, fits = G.registered(px, 160, 32)
    fits = fits.checkpoint().select(F.col("pair_id").alias("key"), *W.T.H)
    side = lambda s: px.where(F.col("side") == s).select(F.col("pair_id").alias("key"), "y", "x", "value")
    drawn = W.warped(side(0), fits, SIZE, SIZE)
    return rounded(drawn.join(side(1).withColumnRenamed("value", "reference"), ["key", "y", "x"]), 4)


@query("R22", None)
def r22_cascade(spark, d):
    """Fine to middle to coarse, each the block averages of the one before, and the product of both steps."""
    px = _pairs(spark, d)
    fine = px.where("side = 0").select("pair_id", "y", "x", "value")
    halves = lambda df, n: df.groupBy("pair_id", (F.col("y") / n).cast("int").alias("y"), (F.col("x") / n).cast("int").alias("x")).agg(F.avg("value").alias("value"))
    middle = halves(px.where("side = 1"), 2)
    return rounded(G.cascade(fine, middle, halves(fine, 4), {"fine": SIZE, "middle": SIZE // 2, "coarse": SIZE // 4}, {"fine": 1.0, "middle": 2.0, "coarse": 4.0}, 128, 16), 4)


@query("S24 R18", None)
def s24_coarse_similarity(spark, d):
    """Rotation, scale and shift of each pair from overviews of 128 pixels."""
    px = _pairs(spark, d)
    return rounded(G.coarse_similarity(px, G.shapes(px), 128), 4)


@query("G24", duck("tie_points") + """SELECT pair_id, upper(sha256('ref_x,ref_y,target_x,target_y,confidence,residual_error' || chr(10) || string_agg(printf('%.9f,%.9f,%.9f,%.9f,%.9f,', ref_x, ref_y, src_x, src_y, confidence) || coalesce(printf('%.9f', residual), '') || chr(10), '' ORDER BY tp_id))) AS digest FROM tie_points GROUP BY pair_id""")
def g24_tie_point_digest(spark, d):
    """The digest that a report names for its tie point file."""
    from craterloom.sources.sinks import csv_digest

    return csv_digest(relation(spark, d, "tie_points"))


_MASK = _FR + """, f AS (SELECT pair_id AS raster_id, y, x, value FROM frames WHERE side = 0), q AS (SELECT raster_id, quantile_cont(value, 0.05) AS dark, quantile_cont(value, 0.02) AS low, quantile_cont(value, 0.98) AS high FROM f GROUP BY raster_id)
SELECT f.raster_id, y, x, value > dark AS lit, round(greatest(0, least(1, (value - low) / (high - low))), 5) AS value FROM f JOIN q ON q.raster_id = f.raster_id WHERE value IS NOT NULL"""


@query("R2", _MASK)
def r2_shadow_stretch(spark, d):
    """Which pixels lie above the 5 % quantile, and their stretch from the 2nd to the 98th percentile."""
    px = _images(spark, d).select(F.col("key").alias("raster_id"), "y", "x", "value")
    return rounded(R.shadow_stretch(px).where("value is not null").select("raster_id", "y", "x", "lit", F.col("stretched").alias("value")), 5)
