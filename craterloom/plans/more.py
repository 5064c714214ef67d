"""Queries on raw rasters, terrain, clipping, inspection, reports and SQL functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F

from craterloom.functions.clip import intersection_area_km2
from craterloom.functions.registry import register
from craterloom.operators import catalog as C
from craterloom.operators import kernels as K
from craterloom.plans.catalogs import _IDENT
from craterloom.plans.inputs import duck, relation
from craterloom.plans.pairs import _triangle, _xyz
from craterloom.plans.rasters import SOBEL_STEPS as _SOBEL_STEPS
from craterloom.plans.registry import query, rounded
from craterloom.sources import archive, readers


def _encoded(spark, d, encode):
    """One binary row for each raster."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"path": [str(int(pdf["raster_id"].iloc[0]))], "content": [encode(K.image_of(pdf.assign(value=pdf["value"].fillna(-9999.0))))]})

    return relation(spark, d, "pixels").groupBy("raster_id").applyInPandas(run, "path string, content binary")


@query("S7 S8 S9 S10", duck("pixels") + "SELECT raster_id, y, x, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 6) AS value FROM pixels")
def s7_raw_raster(spark, d):
    files = _encoded(spark, d, lambda image: b"LABEL___" + image.astype(">f4").tobytes())
    layout = files.select("path").selectExpr("path", "8 as offset", "1 as bands", "8 as lines", "8 as samples", "'IEEE754MSBSingle' as kind", "-9999.0D as nodata")
    px = readers.read_raw_rasters(files, layout)
    return rounded(px.select(F.col("path").cast("long").alias("raster_id"), "y", "x", "value"))


@query("S6 K9 S20", duck("pixels") + "SELECT raster_id, y, x, round(CAST(CAST(coalesce(value, -9999) AS FLOAT) AS DOUBLE), 6) AS value FROM pixels")
def s6_tiff_round_trip(spark, d):
    from craterloom.sources.readers import read_tiff, write_tiff

    def run(frames):
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"]):
                image = read_tiff(content)
                yield pd.DataFrame([(int(path), y, x, float(image[y, x])) for y in range(image.shape[0]) for x in range(image.shape[1])], columns=["raster_id", "y", "x", "value"])

    return rounded(_encoded(spark, d, write_tiff).mapInPandas(run, "raster_id long, y int, x int, value double"))


_SUN = [repr(math.cos(math.radians(30.0)) * math.sin(math.radians(135.0))) + "e0", repr(math.cos(math.radians(30.0)) * math.cos(math.radians(135.0))) + "e0", repr(math.sin(math.radians(30.0))) + "e0"]
_CR = "WITH c AS (SELECT (n_nationkey * 37 % 64) AS cx, (n_nationkey * 53 % 48) AS cy, 2 + n_nationkey % 5 AS radius, 1.0e0 + n_nationkey % 3 AS depth FROM nation)"


@query("S21", _CR + """, p AS (SELECT CAST(i // 64 AS INT) AS y, CAST(i % 64 AS INT) AS x FROM (SELECT unnest(range(0, 3072)) AS i)), r AS (SELECT y, x, depth, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) / radius AS r FROM p, c)
SELECT y, x, round(sum(CASE WHEN r < 1 THEN depth * (r * r - 1) + 0.2 * depth WHEN r <= 3 THEN 0.2 * depth * exp(-2 * (r - 1)) ELSE 0 END), 6) AS z FROM r GROUP BY y, x""")
def s21_terrain(spark, d):
    n = F.col("n_nationkey")
    craters = spark.read.parquet(f"{d}/nation.parquet").select((n * 37 % 64).alias("cx"), (n * 53 % 48).alias("cy"), (2 + n % 5).alias("radius"), (1.0 + n % 3).alias("depth"))
    return rounded(archive.terrain(spark, craters, 48, 64))


_Z = _CR + """, p0 AS (SELECT CAST(i // 64 AS INT) AS y, CAST(i % 64 AS INT) AS x FROM (SELECT unnest(range(0, 3072)) AS i)), r0 AS (SELECT y, x, depth, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) / radius AS r FROM p0, c),
f AS (SELECT 0 AS raster_id, y, x, round(sum(CASE WHEN r < 1 THEN depth * (r * r - 1) + 0.2 * depth WHEN r <= 3 THEN 0.2 * depth * exp(-2 * (r - 1)) ELSE 0 END), 6) AS filled FROM r0 GROUP BY y, x)"""


@query("S21 W3", _Z + _SOBEL_STEPS + f" SELECT y, x, round(greatest(0, (-zx * {_SUN[0]} - zy * {_SUN[1]} + {_SUN[2]}) / sqrt(zx*zx+zy*zy+1)), 6) AS value FROM n")
def s21_shaded_terrain(spark, d):
    return rounded(archive.shaded(s21_terrain(spark, d), 135.0, 30.0))


_BOX = [("wa", "sa"), ("ea", "sa"), ("ea", "na"), ("wa", "na")]
_BV = ", ".join(f"{e} AS p{i}{n}" for i, (lon, lat) in enumerate(_BOX) for n, e in zip("xyz", _xyz(lon, lat)))


@query("M5 J6", duck("scenes") + f""", i AS (SELECT a.k AS a_k, b.k AS b_k, greatest(a.min_lon, b.min_lon) AS wa, least(a.max_lon, b.max_lon) AS ea, greatest(a.min_lat, b.min_lat) AS sa, least(a.max_lat, b.max_lat) AS na FROM scenes a JOIN scenes b ON a.k < b.k AND a.min_lon IS NOT NULL AND b.min_lon IS NOT NULL),
v AS (SELECT a_k, b_k, {_BV} FROM i WHERE ea > wa AND na > sa) SELECT a_k, b_k, round(({_triangle('p0', 'p1', 'p2')}+{_triangle('p0', 'p2', 'p3')})*1737.4*1737.4, 3) AS area_km2 FROM v""")
def m5_footprint_intersection(spark, d):
    from craterloom.operators.pairing import overlapping_pairs

    p = overlapping_pairs(relation(spark, d, "scenes"))
    lons = lambda s: F.array(f"{s}_min_lon", f"{s}_max_lon", f"{s}_max_lon", f"{s}_min_lon")
    lats = lambda s: F.array(f"{s}_min_lat", f"{s}_min_lat", f"{s}_max_lat", f"{s}_max_lat")
    return rounded(p.select("a_k", "b_k", intersection_area_km2(lons("a"), lats("a"), lons("b"), lats("b")).alias("area_km2")), 3)


@query("P1 S11", _IDENT + """, p AS (SELECT p.k, p.ext, p.width, p.height, p.band_count, CASE WHEN p.k % 18 = 4 THEN p.width + 1 ELSE p.width END AS lw, CASE WHEN p.k % 22 = 6 THEN p.band_count + 1 ELSE p.band_count END AS lb, p.k % 3 = 0 AS labelled, coalesce(v.m, v.im) AS mission FROM products p JOIN v ON v.k = p.k)
SELECT k, CASE WHEN NOT labelled AND ext IN ('.img', '.qub') THEN 'invalid' WHEN NOT labelled THEN 'discovered' WHEN ext IN ('.tif', '.TIFF') AND lw IS DISTINCT FROM width THEN 'invalid' WHEN lb IS DISTINCT FROM band_count THEN 'invalid' WHEN band_count > 1 THEN 'partial' ELSE 'validated' END AS status,
CASE WHEN NOT labelled AND ext IN ('.img', '.qub') THEN 'NO_LABEL' WHEN NOT labelled THEN NULL WHEN ext IN ('.tif', '.TIFF') AND lw IS DISTINCT FROM width THEN 'DIMENSIONS_DISAGREE' WHEN lb IS DISTINCT FROM band_count THEN 'BANDS_DISAGREE' END AS problem FROM p""")
def p1_inspect_product(spark, d):
    k = F.col("k")
    p = relation(spark, d, "products").withColumns({"label_width": F.when(k % 18 == 4, F.col("width") + 1).otherwise(F.col("width")), "label_bands": F.when(k % 22 == 6, F.col("band_count") + 1).otherwise(F.col("band_count")), "labelled": k % 3 == 0})
    return C.inspected(p).select("k", "status", "problem")


@query("K3 K11 K10", duck("tie_points") + """SELECT pair_id, printf('%.4f', sqrt(avg(residual * residual)) + 1e-9) AS rmse, count(*) AS points, count(*) FILTER (WHERE inlier) AS inliers FROM tie_points GROUP BY pair_id""")
def k3_report(spark, d):
    p = relation(spark, d, "tie_points").groupBy("pair_id").agg(F.format_string("%.4f", F.sqrt(F.avg(F.col("residual") * F.col("residual"))) + 1e-9).alias("rmse"), F.count("*").alias("points"), F.count_if("inlier").alias("inliers"))
    # as one JSON document for each pair, read back
    j = p.select(F.to_json(F.struct(*p.columns)).alias("value"))
    return j.select(F.from_json("value", "pair_id long, rmse string, points long, inliers long").alias("r")).select("r.*")


@query("K14", duck("scenes") + "SELECT k, product_id FROM scenes")
def k14_manifest_append(spark, d):
    import uuid

    from craterloom.sources.scratch import ensure_checkpoint_dir
    from craterloom.sources.sinks import append_pair

    path = f"{ensure_checkpoint_dir(spark)}/append-{uuid.uuid4().hex}"
    p = relation(spark, d, "scenes").select("k", "product_id")
    append_pair(p.where("k % 2 = 0"), path)
    append_pair(p.where("k % 2 = 1"), path)
    return spark.read.schema("k long, product_id string").parquet(path)


@query("2.13 M3 M7 M13", duck("products") + """SELECT k, round(2 * 1737.4 * asin(sqrt(least(1.0, pow(sin(radians(1 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(1)) * pow(sin(radians(2 - lon) / 2), 2)))), 5) AS km, round(abs(((sun_az - 10 + 180) % 360 + 360) % 360 - 180), 6) AS delta FROM products""")
def sql_functions(spark, d):
    register(spark)
    p = relation(spark, d, "products")
    return p.selectExpr("k", "round(crater_distance_km(lat, lon, 1.0D, 2.0D), 5) AS km", "round(crater_azimuth_delta(sun_az, 10.0D), 6) AS delta")


@query("S4", duck("scenes") + "SELECT k, product_id FROM scenes WHERE product_id = 'lro_5'")
def s4_find_product(spark, d):
    return archive.find_one(relation(spark, d, "scenes"), "LRO_5").select("k", "product_id")


@query("S26 R17", duck("products") + """SELECT k, 0 AS row_off, 0 AS col_off, height AS h, width AS w, CASE WHEN coalesce(band_count, 1) <= 1 THEN 'single_band' WHEN gsd_m IS NOT NULL THEN 'continuum' ELSE 'pca' END AS representation, 'OVERLAP_UNKNOWN' AS overlap_status FROM products WHERE width > 0 AND height > 0""")
def s26_registration_windows(spark, d):
    from craterloom.operators.spectral import registration_windows

    return registration_windows(relation(spark, d, "products"))


@query("R17", duck("products") + """SELECT k, CASE WHEN a = n THEN 0 WHEN c = n THEN 2 WHEN b = n THEN 1 WHEN a = b AND c <> a THEN 2 WHEN c < a AND c < b THEN 2 ELSE 0 END AS axis FROM (SELECT k, k % 5 AS a, k % 7 AS b, k % 3 AS c, k % 11 AS n FROM products)""")
def r17_band_axis(spark, d):
    from craterloom.operators.spectral import band_axis

    k = F.col("k")
    return relation(spark, d, "products").select("k", band_axis(k % 5, k % 7, k % 3, k % 11).alias("axis"))
