"""Queries on rasters, tiles and spectral cubes."""

from __future__ import annotations

from pyspark.sql import functions as F

from craterloom.functions import photometry as P
from craterloom.operators import gates
from craterloom.operators import raster as R
from craterloom.operators import spectral as S
from craterloom.plans.inputs import duck, relation
from craterloom.plans.registry import query, rounded

_PX = duck("pixels")
_FILLED = ", med AS (SELECT raster_id, quantile_cont(value, 0.5) AS m FROM pixels GROUP BY raster_id), f AS (SELECT p.*, coalesce(value, m) AS filled FROM pixels p JOIN med ON p.raster_id = med.raster_id)"
_GRAD = _FILLED + """, g AS (SELECT *, CASE WHEN x = 0 THEN lead(filled) OVER r - filled WHEN x = 7 THEN filled - lag(filled) OVER r ELSE (lead(filled) OVER r - lag(filled) OVER r) / 2 END AS gx,
 CASE WHEN y = 0 THEN lead(filled) OVER c - filled WHEN y = 7 THEN filled - lag(filled) OVER c ELSE (lead(filled) OVER c - lag(filled) OVER c) / 2 END AS gy FROM f WINDOW r AS (PARTITION BY raster_id, y ORDER BY x), c AS (PARTITION BY raster_id, x ORDER BY y))"""


def _pixels(spark, d):
    return relation(spark, d, "pixels")


@query("W2", _PX + _GRAD + " SELECT raster_id, y, x, round(gx, 6) AS gx, round(gy, 6) AS gy FROM g")
def w2_gradient(spark, d):
    return rounded(R.gradients(R.filled(_pixels(spark, d))).select("raster_id", "y", "x", "gx", "gy"))


_QUAL = _GRAD + """, s AS (SELECT raster_id, min(value) AS lo, max(value) - min(value) AS span FROM pixels GROUP BY raster_id), q AS (SELECT g.raster_id, count(value) / count(*) AS valid_fraction,
 avg(CASE WHEN (value - lo) / span <= 0.02 OR (value - lo) / span >= 0.98 THEN 1 WHEN value IS NULL THEN NULL ELSE 0 END) AS extreme_fraction, var_pop((value - lo) / span) AS variance, avg(sqrt(gx * gx + gy * gy)) FILTER (WHERE value IS NOT NULL) / (any_value(span) + 1e-8) AS gradient_energy
 FROM g JOIN s ON g.raster_id = s.raster_id GROUP BY g.raster_id)"""


@query("G11", _PX + _QUAL + " SELECT raster_id, round(valid_fraction, 6) AS valid_fraction, round(extreme_fraction, 6) AS extreme_fraction, round(variance, 6) AS variance, round(gradient_energy, 6) AS gradient_energy FROM q")
def g11_image_quality(spark, d):
    return rounded(R.quality(_pixels(spark, d)))


@query("P18", _PX + _QUAL + """ SELECT a.raster_id, CASE WHEN a.raster_id % 11 = 0 THEN 'DATA_REQUIRED' WHEN a.raster_id % 7 = 0 THEN 'INVALID_GEOMETRY' WHEN (a.raster_id % 40) / 40.0 < 0.05 THEN 'NON_OVERLAPPING' WHEN least(a.valid_fraction, b.valid_fraction) < 0.15 THEN 'INSUFFICIENT_VALID_AREA'
 WHEN least(a.variance, b.variance) < 0.05 THEN 'LOW_TEXTURE' WHEN greatest(a.extreme_fraction, b.extreme_fraction) > 0.1 THEN 'EXCESSIVE_SHADOW_SATURATION' ELSE 'PASSED' END AS gate FROM q a JOIN q b ON b.raster_id = a.raster_id + 1""")
def p18_quality_gates(spark, d):
    q = R.quality(_pixels(spark, d))
    other = q.select((F.col("raster_id") - 1).alias("raster_id"), *(F.col(c).alias(f"b_{c}") for c in q.columns[1:]))
    k = F.col("raster_id")
    size = F.when(k % 11 == 0, F.lit(None)).when(k % 7 == 0, F.lit(8)).otherwise(F.lit(64))
    image = lambda p, w: {"width": w, "height": w, "valid": F.col(p + "valid_fraction"), "extreme": F.col(p + "extreme_fraction"), "variance": F.col(p + "variance")}
    gate = gates.pre_registration(image("", size), image("b_", F.lit(64)), (k % 40) / 40, max_extreme=0.1, min_variance=0.05)
    return q.join(other, "raster_id").select("raster_id", gate.alias("gate"))


def _mirror(c: str, axis: str) -> tuple[str, str]:
    w = "(PARTITION BY raster_id, y ORDER BY x)" if axis == "x" else "(PARTITION BY raster_id, x ORDER BY y)"
    return f"coalesce(lag({c}) OVER {w}, lead({c}) OVER {w})", f"coalesce(lead({c}) OVER {w}, lag({c}) OVER {w})"


_B, _A = _mirror("filled", "x")
_DB, _DA = _mirror("d", "y")
_SB, _SA = _mirror("s", "y")
#: From f (raster_id, y, x, filled) to its slopes n (zx, zy).
SOBEL_STEPS = f", e AS (SELECT *, {_A} - {_B} AS d, {_A} + 2 * filled + {_B} AS s FROM f), n AS (SELECT *, ({_DA} + 2 * d + {_DB}) / 8 AS zx, ({_SA} - {_SB}) / 8 AS zy FROM e)"
_SOBEL = _FILLED + SOBEL_STEPS


@query("W3", _PX + _SOBEL + " SELECT raster_id, y, x, round(-zx / sqrt(zx*zx+zy*zy+1), 6) AS nx, round(-zy / sqrt(zx*zx+zy*zy+1), 6) AS ny, round(1 / sqrt(zx*zx+zy*zy+1), 6) AS nz FROM n")
def w3_surface_normals(spark, d):
    return rounded(R.normals(R.sobel(R.filled(_pixels(spark, d)), "filled")).select("raster_id", "y", "x", "nx", "ny", "nz"))


def _photo(model: str) -> str:
    i = "greatest(ci, 0.005)"
    e = "greatest(nz, 0.005)"
    ls = lambda a, b: f"(greatest({a}, 0) / greatest({a} + {b}, 1e-6))"
    mi = lambda a, b: f"(pow(greatest({a}, 1e-6), 0.8) * pow(greatest({b}, 1e-6), -0.2))"
    f = ls if model == "ls" else mi
    ref = f("cos(radians(30.0e0))", "1.0e0")
    return _PX + _SOBEL + f""", c AS (SELECT raster_id, y, x, filled, 1 / sqrt(zx*zx+zy*zy+1) AS nz, (-zx * cos(radians(40.0e0)) * sin(radians(135.0e0)) - zy * cos(radians(40.0e0)) * cos(radians(135.0e0)) + sin(radians(40.0e0))) / sqrt(zx*zx+zy*zy+1) AS ci FROM n),
k AS (SELECT *, {f(i, e)} AS got FROM c) SELECT raster_id, y, x, round(ci, 6) AS cos_i, round(filled * least(greatest(CASE WHEN got > 1e-4 THEN {ref} / greatest(got, 1e-4) ELSE 1 END, 0.1), 5.0), 6) AS corrected FROM k"""


@query("R2 M15 M16", _photo("ls"))
def r2_photometric(spark, d):
    return rounded(R.photometric(_pixels(spark, d), 135.0, 40.0).select("raster_id", "y", "x", "cos_i", "corrected"))


@query("R2 M15", _photo("mi"))
def r2_minnaert(spark, d):
    return rounded(R.photometric(_pixels(spark, d), 135.0, 40.0, minnaert_k=0.8).select("raster_id", "y", "x", "cos_i", "corrected"))


@query("R1 M20 S25", _PX + """, c AS (SELECT raster_id, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM pixels GROUP BY raster_id) SELECT p.raster_id, y, x, round(coalesce(greatest(0, least(1, (value - lo) / greatest(hi - lo, 1e-5))), 0.5), 6) AS stretched FROM pixels p JOIN c ON p.raster_id = c.raster_id""")
def r1_percentile_stretch(spark, d):
    return rounded(R.stretch(_pixels(spark, d)).select("raster_id", "y", "x", "stretched"))


@query("S24", _PX + "SELECT raster_id, CAST(y * 3 // 8 AS INT) AS oy, CAST(x * 3 // 8 AS INT) AS ox, round(avg(value), 6) AS value FROM pixels GROUP BY ALL")
def s24_overview(spark, d):
    return rounded(R.overview(_pixels(spark, d), 8, 8, 3))


@query("P25 W5", _PX + """, m AS (SELECT raster_id, y, x, CASE WHEN y < raster_id % 3 OR x >= 8 - raster_id % 2 THEN 0 ELSE abs(value) END AS value FROM pixels), r AS (SELECT raster_id, y, avg(CASE WHEN coalesce(value, 0) <= 0 THEN 1 ELSE 0 END) AS b FROM m GROUP BY ALL),
c AS (SELECT raster_id, x, avg(CASE WHEN coalesce(value, 0) <= 0 THEN 1 ELSE 0 END) AS b FROM m GROUP BY ALL) SELECT d.raster_id, (SELECT min(y) FROM r WHERE r.raster_id = d.raster_id AND b < 0.98) AS first_y, (SELECT max(y) FROM r WHERE r.raster_id = d.raster_id AND b < 0.98) AS last_y,
(SELECT min(x) FROM c WHERE c.raster_id = d.raster_id AND b < 0.98) AS first_x, (SELECT max(x) FROM c WHERE c.raster_id = d.raster_id AND b < 0.98) AS last_x FROM (SELECT DISTINCT raster_id FROM m) d""")
def p25_border_crop(spark, d):
    k = F.col("raster_id")
    p = _pixels(spark, d).withColumn("value", F.when((F.col("y") < k % 3) | (F.col("x") >= 8 - k % 2), 0.0).otherwise(F.abs("value")))
    return R.border_strips(p)


@query("R18", duck("products") + """, s AS (SELECT k AS raster_id, width AS w, height AS h FROM products WHERE width > 0 AND height > 0), r AS (SELECT raster_id, w, h, unnest(range(0, CASE WHEN h <= 256 THEN 1 ELSE CAST(ceil((h - 256) / 192.0) AS BIGINT) + 1 END)) * 192 AS ro FROM s),
c AS (SELECT *, unnest(range(0, CASE WHEN w <= 256 THEN 1 ELSE CAST(ceil((w - 256) / 192.0) AS BIGINT) + 1 END)) * 192 AS co FROM r) SELECT raster_id, CAST(ro AS INT) AS row_off, CAST(co AS INT) AS col_off, CAST(least(256, h - ro) AS INT) AS h, CAST(least(256, w - co) AS INT) AS w FROM c""")
def r18_tile_windows(spark, d):
    p = relation(spark, d, "products").where("width > 0 and height > 0").select(F.col("k").alias("raster_id"), "height", "width")
    return R.tile_windows(p, 256, 192)


@query("M23", _PX + """, pt AS (SELECT DISTINCT raster_id, CAST(raster_id * 13 % 70 AS DOUBLE) / 10 AS px, CAST(raster_id * 29 % 70 AS DOUBLE) / 10 AS py FROM pixels), c AS (SELECT p.raster_id, v.value, (CASE WHEN dy = 1 THEN py - floor(py) ELSE 1 - py + floor(py) END) * (CASE WHEN dx = 1 THEN px - floor(px) ELSE 1 - px + floor(px) END) AS w
FROM pt p, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dy, dx) JOIN pixels v ON v.raster_id = p.raster_id AND v.y = floor(py) + dy AND v.x = floor(px) + dx WHERE v.value IS NOT NULL) SELECT raster_id, round(sum(w * value) / sum(w), 6) AS value FROM c WHERE w > 0 GROUP BY raster_id""")
def m23_bilinear(spark, d):
    px = _pixels(spark, d)
    k = F.col("raster_id")
    points = px.select("raster_id").distinct().select("raster_id", k.alias("point_id"), ((k * 13 % 70).cast("double") / 10).alias("px"), ((k * 29 % 70).cast("double") / 10).alias("py"))
    return rounded(R.bilinear(points, px).select("raster_id", "value"))


_S9 = {(dy, dx): f"max(value) FILTER (WHERE y = {3 + dy} AND x = {3 + dx})" for dy in (-1, 0, 1) for dx in (-1, 0, 1)}
_S9C = ", ".join(f"{e} AS s{dy + 1}{dx + 1}" for (dy, dx), e in _S9.items())


@query("M14 T8", _PX + f", s AS (SELECT raster_id, {_S9C} FROM pixels GROUP BY raster_id)" + """, t AS (SELECT *, (s12 - s10) / 2 AS gx, (s21 - s01) / 2 AS gy, s12 - 2 * s11 + s10 AS a, s21 - 2 * s11 + s01 AS b, (s22 - s20 - s02 + s00) / 4 AS c FROM s),
u AS (SELECT *, a * b - c * c AS det, -(b * gx - c * gy) / (a * b - c * c) AS dx, -(a * gy - c * gx) / (a * b - c * c) AS dy FROM t) SELECT raster_id, round(dx, 6) AS dx, round(dy, 6) AS dy, round(s11 + 0.5 * (gx * dx + gy * dy), 6) AS peak FROM u WHERE det > 1e-9 AND a < 0 AND b < 0 AND abs(dx) <= 1 AND abs(dy) <= 1""")
def m14_subpixel_peak(spark, d):
    s = {(dy, dx): F.max(F.when((F.col("y") == 3 + dy) & (F.col("x") == 3 + dx), F.col("value"))).alias(f"s{dy + 1}{dx + 1}") for dy in (-1, 0, 1) for dx in (-1, 0, 1)}
    wide = _pixels(spark, d).groupBy("raster_id").agg(*s.values())
    fit = P.paraboloid_peak({k: F.col(f"s{k[0] + 1}{k[1] + 1}") for k in s})
    return rounded(wide.select("raster_id", fit["dx"].alias("dx"), fit["dy"].alias("dy"), fit["peak"].alias("peak")).where("dx is not null"))


@query("G27", _PX + "SELECT a.raster_id, round(corr(a.value, b.value), 6) AS r FROM pixels a JOIN pixels b ON b.raster_id = a.raster_id + 1 AND a.y = b.y AND a.x = b.x GROUP BY a.raster_id")
def g27_pixel_correlation(spark, d):
    a = _pixels(spark, d)
    b = a.select((F.col("raster_id") - 1).alias("raster_id"), "y", "x", F.col("value").alias("other"))
    return rounded(a.join(b, ["raster_id", "y", "x"]).groupBy("raster_id").agg(F.corr("value", "other").alias("r")))


@query("G25 K17", _PX + "SELECT raster_id, round(quantile_cont(value, 0.5), 6) AS datum, round(max(value) - min(value), 6) AS relief, count(value) AS valid, CASE WHEN count(value) > 60 THEN 'VERIFIED' ELSE 'FAILED' END AS status FROM pixels GROUP BY raster_id")
def g25_relief(spark, d):
    n = F.count("value")
    return rounded(_pixels(spark, d).groupBy("raster_id").agg(F.percentile("value", 0.5).alias("datum"), (F.max("value") - F.min("value")).alias("relief"), n.alias("valid"), F.when(n > 60, "VERIFIED").otherwise("FAILED").alias("status")))


_CUBE = ", cube AS (SELECT raster_id // 10 AS cube_id, CAST(raster_id % 10 AS INT) AS band, y, x, CASE WHEN raster_id % 10 = 7 THEN 0.25e0 WHEN raster_id % 10 = 4 AND x < 4 THEN NULL ELSE value END AS value FROM pixels)"
_CLEAN = _CUBE + """, st AS (SELECT cube_id, band, 1 - count(value) / count(*) AS e, var_pop(value) AS v, quantile_cont(value, 0.5) AS m FROM cube GROUP BY ALL), clean AS (SELECT c.cube_id, c.band, y, x, coalesce(value, m) AS value FROM cube c JOIN st ON c.cube_id = st.cube_id AND c.band = st.band WHERE e <= 0.40 AND v >= 1e-7)"""


def _cube(spark, d):
    k = F.col("raster_id")
    value = F.when(k % 10 == 7, 0.25).when((k % 10 == 4) & (F.col("x") < 4), F.lit(None)).otherwise(F.col("value"))
    return _pixels(spark, d).select(F.floor(k / 10).cast("long").alias("cube_id"), (k % 10).cast("int").alias("band"), "y", "x", value.alias("value"))


@query("G19", _PX + _CLEAN + " SELECT cube_id, count(DISTINCT band) AS kept, round(sum(value), 5) AS total FROM clean GROUP BY cube_id")
def g19_clean_bands(spark, d):
    return S.clean_bands(_cube(spark, d)).groupBy("cube_id").agg(F.count_distinct("band").alias("kept"), F.round(F.sum("value"), 5).alias("total"))


@query("G20 M25", _PX + _CLEAN + """, w AS (SELECT DISTINCT cube_id, band, 900 + 45.0e0 * band AS nm FROM clean), i AS (SELECT clean.cube_id, y, x, avg(value) AS value FROM clean JOIN w ON clean.cube_id = w.cube_id AND clean.band = w.band WHERE nm BETWEEN 1000 AND 1250 GROUP BY ALL),
c AS (SELECT cube_id, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM i GROUP BY cube_id) SELECT i.cube_id, y, x, round(greatest(0, least(1, (value - lo) / greatest(hi - lo, 1e-5))), 6) AS value FROM i JOIN c ON i.cube_id = c.cube_id""")
def g20_continuum(spark, d):
    um = spark.range(10).select(F.col("id").cast("int").alias("band"), ((900 + 45.0 * F.col("id")) / 1000).alias("um"))
    bands = um.groupBy().agg(F.array_sort(F.collect_list(F.struct("band", "um"))).alias("b")).select("b", S.nanometres(F.col("b.um")).alias("nm"))
    nm = bands.select(F.explode(F.arrays_zip(F.col("b.band").alias("band"), "nm")).alias("z")).select("z.band", F.round("z.nm", 6).alias("nm"))
    return rounded(S.continuum(_cube(spark, d), nm))


@query("G20", _PX + _CUBE + " SELECT cube_id, y, x, round(coalesce(avg(value), 0), 6) AS value FROM cube GROUP BY ALL")
def g20_band_mean(spark, d):
    return rounded(S.band_mean(_cube(spark, d)))


@query("G21", _PX + _CLEAN + " SELECT a.cube_id, a.band AS a, b.band AS b, round(covar_samp(a.value, b.value), 6) AS cov FROM clean a JOIN clean b ON a.cube_id = b.cube_id AND a.y = b.y AND a.x = b.x AND a.band <= b.band GROUP BY ALL")
def g21_band_covariance(spark, d):
    return rounded(S.covariance(_cube(spark, d)))


@query("G21 N2", None)
def g21_structural_band(spark, d):
    return rounded(S.structural_band(_cube(spark, d)))


@query("M21", _PX + "SELECT raster_id, y, round(0.2989e0 * max(value) FILTER (WHERE x = 0) + 0.5870e0 * max(value) FILTER (WHERE x = 1) + 0.1140e0 * max(value) FILTER (WHERE x = 2), 6) AS grey FROM pixels GROUP BY ALL")
def m21_luminance(spark, d):
    at = lambda i: F.max(F.when(F.col("x") == i, F.col("value")))
    return rounded(_pixels(spark, d).groupBy("raster_id", "y").agg(P.luminance(at(0), at(1), at(2)).alias("grey")))
