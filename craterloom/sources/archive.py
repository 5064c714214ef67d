"""Driver-side helpers: one product by name, dataset manifests, archive availability, synthetic terrain."""

from __future__ import annotations

import math
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST_FIELDS = ("id", "mission", "instrument", "status")

#: All fields that an entry of a dataset manifest needs, and the values of its validation_status.
REQUIRED_FIELDS = (
    "id", "mission", "spacecraft", "instrument", "product_id", "product_level", "acquisition_utc", "latitude", "longitude", "resolution_m_per_px", "image_dimensions", "geometry_available",
    "calibration_status", "source", "source_url", "local_path", "checksum_sha256", "license", "processing_status", "registration_suitability", "validation_status", "ground_truth_source", "notes",
)
VALIDATION_STATUS = ("pending", "available", "validated", "partial", "failed", "not_tested")


def find_one(products: DataFrame, product_id: str) -> DataFrame:
    """The one product of this id; an error that says how many there are otherwise (raised when the rows are read)."""
    hit = products.where(F.lower("product_id") == product_id.lower())
    n = hit.groupBy().count()
    checked = n.select(F.when(F.col("count") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{product_id}: "), F.col("count").cast("string"), F.lit(" products")))).alias("_one"))
    return hit.join(F.broadcast(checked), F.col("_one")).drop("_one")


def dataset_manifest(spark: SparkSession, path: str, fields: tuple[str, ...] = MANIFEST_FIELDS) -> DataFrame:
    """Entries of a YAML manifest's ``datasets`` list; missing fields are an error that names the entry.

    Only the fields asked for are checked and returned; full_manifest() asks for all.
    """
    import yaml

    with open(path, encoding="utf-8") as f:
        entries = (yaml.safe_load(f) or {}).get("datasets")
    if not isinstance(entries, list):
        raise ValueError("a manifest needs a list of datasets")
    for i, e in enumerate(entries):
        if not isinstance(e, dict):
            raise ValueError(f"dataset {i}: not a mapping of fields")
        if missing := [x for x in fields if x not in e]:
            raise ValueError(f"dataset {e.get('id', i)}: missing {', '.join(missing)}")
        if "validation_status" in fields and str(e["validation_status"]).lower() not in VALIDATION_STATUS:
            raise ValueError(f"dataset {e.get('id', i)}: validation_status {e['validation_status']} is none of {', '.join(VALIDATION_STATUS)}")
    return spark.createDataFrame([tuple(str(e[x]) if e[x] is not None else None for x in fields) for e in entries], ", ".join(f"{x} string" for x in fields))


def full_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a manifest with all REQUIRED_FIELDS; one without a field or with another validation_status is an error."""
    return dataset_manifest(spark, path, REQUIRED_FIELDS)


def archive_status(spark: SparkSession, mission: str, url: str, opener=urllib.request.urlopen) -> DataFrame:
    """One row: mission, url, available, http_status, message of a HEAD request; failures are rows too."""
    try:
        with opener(urllib.request.Request(url, method="HEAD"), timeout=10) as r:
            row = (mission, url, 200 <= r.status < 400, int(r.status), None)
    except Exception as e:  # noqa: BLE001
        row = (mission, url, False, getattr(e, "code", None), f"{type(e).__name__}: {e}")
    return spark.createDataFrame([row], "mission string, url string, available boolean, http_status int, message string")


def terrain(spark: SparkSession, craters: DataFrame, height: int, width: int) -> DataFrame:
    """Elevation (y, x, z) of a plain with craters (cx, cy, radius, depth): a bowl inside, a rim that fades outside.

    craters is a fixture table; the join is with its rows only where they reach (three radii).
    """
    reach = craters.select("*", F.explode(F.sequence(F.greatest(F.lit(0), F.floor(F.col("cy") - 3 * F.col("radius"))).cast("int"), F.least(F.lit(height - 1), F.ceil(F.col("cy") + 3 * F.col("radius"))).cast("int"))).alias("y"))
    reach = reach.withColumn("x", F.explode(F.sequence(F.greatest(F.lit(0), F.floor(F.col("cx") - 3 * F.col("radius"))).cast("int"), F.least(F.lit(width - 1), F.ceil(F.col("cx") + 3 * F.col("radius"))).cast("int"))))
    r = F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)) / F.col("radius")
    z = F.when(r < 1, F.col("depth") * (r * r - 1) + 0.2 * F.col("depth")).when(r <= 3, 0.2 * F.col("depth") * F.exp(-2 * (r - 1))).otherwise(0.0)
    height_at = reach.select("y", "x", z.alias("z")).groupBy("y", "x").agg(F.sum("z").alias("z"))
    plain = spark.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    return plain.join(height_at, ["y", "x"], "left").select("y", "x", F.coalesce("z", F.lit(0.0)).alias("z"))


def shaded(dem: DataFrame, azimuth: float, elevation: float) -> DataFrame:
    """Lambert shading of elevations in [0, 1]."""
    from craterloom.operators import raster as R

    sx, sy, sz = (math.cos(math.radians(elevation)) * math.sin(math.radians(azimuth)), math.cos(math.radians(elevation)) * math.cos(math.radians(azimuth)), math.sin(math.radians(elevation)))
    n = R.normals(R.sobel(dem.withColumn("raster_id", F.lit(0)), "z"))
    return n.select("y", "x", F.greatest(F.lit(0.0), F.col("nx") * sx + F.col("ny") * sy + F.col("nz") * sz).alias("value"))
