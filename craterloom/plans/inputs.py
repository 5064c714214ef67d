"""Input relations of the engine's queries, derived from the tables of a data folder.

Each relation is one SELECT that Spark and DuckDB read alike; :func:`relation` gives the DataFrame
and :data:`SQL` the text.  Columns follow the operators' data model: products (a catalog), tie_points,
transforms, checkpoints, pixels and cube (rasters and spectral cubes in long form), frames (pairs of larger rasters).
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from craterloom.sources.scratch import ensure_checkpoint_dir


def _products(table: str, k: str, nat: str, bal: str, spread: str) -> str:
    return f"""
SELECT k, product_id, concat('/data/', folder, '/', product_id, ext) AS image_path, ext, folder, mission, instrument, status, gsd_m, width, height, band_count,
       lat, lon, CASE WHEN k % 10 = 3 THEN NULL ELSE lon - half END AS min_lon, CASE WHEN k % 10 = 3 THEN NULL ELSE lon + half END AS max_lon,
       CASE WHEN k % 10 = 3 THEN NULL ELSE lat - half END AS min_lat, CASE WHEN k % 10 = 3 THEN NULL ELSE lat + half END AS max_lat,
       CASE WHEN k % 10 = 3 THEN 'UNAVAILABLE' WHEN k % 4 = 0 THEN 'APPROXIMATE' ELSE 'AUTHORITATIVE' END AS footprint_status,
       sun_az, sun_el, CASE WHEN k % 17 = 0 THEN NULL WHEN k % 19 = 0 THEN 'unknown' ELSE concat('2020-01-', lpad(CAST(1 + k % 28 AS STRING), 2, '0'), 'T', lpad(CAST(k % 24 AS STRING), 2, '0'), ':30:00Z') END AS acquisition_time,
       CASE WHEN k % 23 = 0 THEN 'Checksum FAIL' WHEN k % 29 = 0 THEN 'read Error' WHEN k % 5 = 0 THEN 'ok' ELSE NULL END AS validation_message
FROM (SELECT {k} AS k,
  CASE {k} % 8 WHEN 0 THEN concat('ch2_ohr_ncp_', {k}) WHEN 1 THEN concat('LROC_NAC_', {k}) WHEN 2 THEN concat('tc1_map_', {k}) WHEN 3 THEN concat('CH1_HYS_', {k})
       WHEN 4 THEN concat('CH2-IIR-', {k}) WHEN 5 THEN concat('lro_', {k}) WHEN 6 THEN concat('synthetic_', {k}) ELSE concat('frame', {k}) END AS product_id,
  CASE {nat} % 5 WHEN 0 THEN 'raw' WHEN 1 THEN 'Fixtures' WHEN 2 THEN 'lro/nac' WHEN 3 THEN 'selene' ELSE 'ch2' END AS folder,
  CASE {k} % 6 WHEN 0 THEN '.img' WHEN 1 THEN '.tif' WHEN 2 THEN '.TIFF' WHEN 3 THEN '.qub' WHEN 4 THEN '.dat' ELSE '.xml' END AS ext,
  CASE {nat} % 8 WHEN 0 THEN 'Chandrayaan-2' WHEN 1 THEN 'chandrayaan_2' WHEN 2 THEN 'LRO' WHEN 3 THEN 'Kaguya' WHEN 5 THEN 'Lunar  Reconnaissance Orbiter' WHEN 6 THEN ' CH2 ' WHEN 7 THEN 'SELENE' ELSE NULL END AS mission,
  CASE {k} % 7 WHEN 0 THEN 'OHRC' WHEN 1 THEN 'ohr' WHEN 2 THEN 'LROC_NAC' WHEN 3 THEN 'TC' WHEN 5 THEN 'iirs' WHEN 6 THEN 'Narrow Angle Camera' ELSE NULL END AS instrument,
  CASE {k} % 9 WHEN 0 THEN 'partial' WHEN 1 THEN 'invalid' WHEN 2 THEN 'discovered' WHEN 3 THEN 'unsupported' ELSE 'validated' END AS status,
  CASE WHEN {k} % 13 = 0 THEN NULL ELSE (1 + {k} % 37) * 0.25E0 END AS gsd_m,
  CASE WHEN {k} % 11 = 0 THEN NULL WHEN {k} % 31 = 0 THEN 0 ELSE CAST(512 + ({k} % 4) * 256 AS INT) END AS width, CASE WHEN {k} % 12 = 0 THEN NULL ELSE CAST(512 + ({k} % 3) * 128 AS INT) END AS height,
  CASE WHEN {k} % 14 = 0 THEN NULL ELSE CAST(1 + ({k} % 3) AS INT) END AS band_count,
  CAST(({k} * 7919) % {spread} AS DOUBLE) / 100 - CAST({spread} AS DOUBLE) / 200 AS lat, CAST(({k} * 104729) % (2 * {spread}) AS DOUBLE) / 100 AS lon,
  0.2E0 + CAST({k} % 9 AS DOUBLE) / 10 AS half,
  CASE WHEN {k} % 15 = 0 THEN NULL ELSE CAST(({k} * 37) % 3600 AS DOUBLE) / 10 END AS sun_az, CAST(({k} * 53) % 900 AS DOUBLE) / 10 AS sun_el
FROM {table}) p"""


SQL = {
    "products": _products("customer", "c_custkey", "c_nationkey", "c_acctbal", "17000"),
    "scenes": _products("supplier", "s_suppkey", "s_nationkey", "s_acctbal", "800"),
    "tie_points": """
SELECT tp_id, pair_id, src_x, src_y, src_x * 1.01E0 + 12.5E0 + nx AS ref_x, src_y * 0.99E0 - 3.25E0 + ny AS ref_y, confidence,
       CASE WHEN tp_id % 11 = 0 THEN NULL ELSE abs(nx) + abs(ny) END AS residual, CASE WHEN tp_id % 5 = 0 THEN NULL ELSE abs(nx) / 2 + 0.05E0 END AS sigma_x,
       CASE WHEN tp_id % 5 = 0 THEN NULL ELSE abs(ny) / 2 + 0.05E0 END AS sigma_y, CASE WHEN tp_id % 7 = 0 THEN NULL ELSE nx * ny END AS cov_xy,
       CASE WHEN tp_id % 6 = 0 THEN NULL ELSE 1 / (1 + abs(nx)) END AS weight, tp_id % 3 = 0 AS subpixel, tp_id % 4 <> 0 AS inlier
FROM (SELECT o_orderkey AS tp_id, CAST(floor(o_orderkey / 300.0) AS BIGINT) AS pair_id, CAST((o_orderkey * 7919) % 102400 AS DOUBLE) / 100 AS src_x, CAST((o_orderkey * 104729) % 102400 AS DOUBLE) / 100 AS src_y,
  (CAST((o_orderkey * 31) % 201 AS DOUBLE) - 100) / 397E0 AS nx, (CAST((o_orderkey * 57) % 201 AS DOUBLE) - 100) / 397E0 AS ny, CAST(1 + (o_custkey * 613) % 999 AS DOUBLE) / 1000 AS confidence
  FROM orders) t""",
    "clustered": "",
    "transforms": """
SELECT pair_id, 1.01E0 + pair_id % 5 * 0.001E0 AS h00, CASE WHEN pair_id % 13 = 5 THEN 4.5E0 ELSE pair_id % 3 * 0.002E0 END AS h01, 12.5E0 AS h02,
       pair_id % 4 * -0.001E0 AS h10, CASE WHEN pair_id % 17 = 3 THEN -0.99E0 WHEN pair_id % 19 = 4 THEN 0.01E0 ELSE 0.99E0 END AS h11, -3.25E0 AS h12,
       CASE WHEN pair_id % 23 = 7 THEN 0.06E0 ELSE pair_id % 2 * 0.0000001E0 END AS h20, 0E0 AS h21, 1E0 AS h22
FROM (SELECT DISTINCT CAST(floor(o_orderkey / 300.0) AS BIGINT) AS pair_id FROM orders) t""",
}

#: All tie points, drawn towards one corner so that parts of their images stay empty.
SQL["clustered"] = f"SELECT tp_id, pair_id, src_x * src_x * src_x / 1048576E0 AS src_x, src_y * src_y / 1024E0 AS src_y FROM ({SQL['tie_points']}) c"

#: Rasters of 8 x 8 pixels, one for each embedding; some pixels have no data.
PIXELS_DUCK = """
SELECT vec_id AS raster_id, CAST((i - 1) // 8 AS INT) AS y, CAST((i - 1) % 8 AS INT) AS x, CASE WHEN (vec_id * 64 + i - 1) % 23 = 0 THEN NULL ELSE CAST(v AS DOUBLE) END AS value
FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) e"""


#: Smooth texture: whole numbers mixed at the corners of cells, bilinear in between; cells of two sizes, with their weight.
CELLS = ((11, 0.5, 0), (5, 0.4, 3))


def _mixed(n: int, di: int, dj: int, shift: int) -> str:
    a, b = f"(i{n} + {di})", f"(j{n} + {dj})"
    return f"CAST(pmod({a} * {a} * 31 + {b} * {b} * 57 + {a} * {b} * 1013 + {a} * 37476 + {b} * 66826 + (k + {shift}) * 9753, 10007) AS DOUBLE) / 10007.0E0 AS n{n}{di}{dj}"


def _textured(places: str) -> str:
    """The texture (column value) at the places (u, v) of a SELECT; step by step, so that no step is a huge expression."""
    cells = ", ".join(f"CAST(floor(u / {c}.0E0) AS BIGINT) AS i{n}, CAST(floor(v / {c}.0E0) AS BIGINT) AS j{n}, u / {c}.0E0 - floor(u / {c}.0E0) AS f{n}, v / {c}.0E0 - floor(v / {c}.0E0) AS g{n}" for n, (c, _, _) in enumerate(CELLS))
    corners = ", ".join(_mixed(n, di, dj, shift) for n, (_, _, shift) in enumerate(CELLS) for di in (0, 1) for dj in (0, 1))
    value = " + ".join(f"{w}E0 * ((1 - f{n}) * (1 - g{n}) * n{n}00 + f{n} * (1 - g{n}) * n{n}10 + (1 - f{n}) * g{n} * n{n}01 + f{n} * g{n} * n{n}11)" for n, (_, w, _) in enumerate(CELLS))
    return f"SELECT *, 0.1E0 + {value} AS value FROM (SELECT *, {corners} FROM (SELECT *, {cells} FROM ({places}) p0) p1) p2"


#: Rasters of SIZE x SIZE pixels in pairs: side 0 is a region's texture, side 1 the same ground seen through a known
#: affine transform (pixel (x, y) of side 1 shows the place (u, v) of side 0); one pair for each region.
SIZE = 256
SEEN = {"u": "(x * (1.0E0 + k * 0.002E0) - y * 0.012E0 + 6.25E0 + k)", "v": "(x * 0.012E0 + y * (1.0E0 + k * 0.002E0) - 4.5E0 - k)"}
FRAMES = "SELECT k * 2 + side AS raster_id, k AS pair_id, side, y, x, CASE WHEN (x * 7 + y * 13 + k) % 1009 = 0 THEN NULL ELSE value END AS value FROM (" + _textured(
    f"SELECT k, side, y, x, CASE WHEN side = 0 THEN CAST(x AS DOUBLE) ELSE {SEEN['u']} END AS u, CASE WHEN side = 0 THEN CAST(y AS DOUBLE) ELSE {SEEN['v']} END AS v FROM grid") + ") f"
_GRID_DUCK = f"(SELECT CAST(r_regionkey AS BIGINT) AS k, CAST(s AS INT) AS side, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM region, range(2) t1(s), range({SIZE}) t2(y), range({SIZE}) t3(x)) grid"
FRAMES_DUCK = re.sub(r"pmod\((.+?), 10007\)", r"(((\1) % 10007 + 10007) % 10007)", FRAMES).replace("FROM grid", f"FROM {_GRID_DUCK}")


#: Where each application has written the frames of a data folder: they are a raster table that queries read several times.
_WRITTEN: dict[tuple[str, str], str] = {}


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN:
        of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        grid = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("long").alias("k"), of(2).alias("side"), of(SIZE).alias("y"))
        grid = grid.repartition(spark.sparkContext.defaultParallelism, "k", "side", "y").withColumn("x", of(SIZE))
        path = f"{ensure_checkpoint_dir(spark)}/frames-{uuid.uuid4().hex}"
        spark.sql(FRAMES.replace("FROM grid", "FROM {grid}"), grid=grid).write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.schema("raster_id bigint, pair_id bigint, side int, y int, x int, value double").parquet(_WRITTEN[key])


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "pixels":
        e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("i", "v"))
        value = F.when((F.col("vec_id") * 64 + F.col("i")) % 23 != 0, F.col("v").cast("double"))
        return e.select(F.col("vec_id").alias("raster_id"), (F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), value.alias("value"))
    if name == "frames":
        return _frames(spark, sf_dir)
    text, tables = SQL[name], {}
    for table in ("customer", "supplier", "orders"):
        if f"FROM {table}" in text:
            tables[table] = spark.read.parquet(f"{sf_dir}/{table}.parquet")
            text = text.replace(f"FROM {table}", f"FROM {{{table}}}")
    return spark.sql(text, **tables)


def duck(*names: str) -> str:
    """WITH clause that defines the named relations for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({ {'pixels': PIXELS_DUCK, 'frames': FRAMES_DUCK}.get(n) or SQL[n]})" for n in names)
