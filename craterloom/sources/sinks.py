"""Exports of tie points, control networks, catalogs and reports: rows as each format wants them, then a writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(points: DataFrame, start: int = 1) -> DataFrame:
    """n: place of each point in its pair, by tp_id."""
    return points.withColumn("n", F.row_number().over(Window.partitionBy("pair_id").orderBy("tp_id")) + (start - 1))


def _or(column: str, value: float, digits: int) -> Column:
    return F.coalesce(F.bround(column, digits), F.lit(value))


def control_network(points: DataFrame) -> DataFrame:
    """Control points in 1-based pixel coordinates; unknown deviations 0.2, weight 1."""
    at = lambda c: F.bround(F.col(c) + 1, 4)
    return numbered(points).select(
        "pair_id", F.format_string("GCP_%05d", "n").alias("point_id"), F.when(F.col("residual").isNotNull(), "TiePoint").otherwise("Free").alias("point_type"), at("ref_x").alias("ref_sample"), at("ref_y").alias("ref_line"),
        at("src_x").alias("tgt_sample"), at("src_y").alias("tgt_line"), _or("sigma_x", 0.2, 5).alias("sigma_x"), _or("sigma_y", 0.2, 5).alias("sigma_y"), _or("cov_xy", 0.0, 5).alias("cov_xy"), _or("weight", 1.0, 4).alias("weight"),
        _or("residual", 0.0, 4).alias("residual"), F.bround("confidence", 4).alias("confidence"))


def measures(points: DataFrame, reference: str, target: str) -> DataFrame:
    """Two rows for each point: its measure in the reference (Candidate) and in the target image (Registered)."""
    at = lambda c: F.bround(F.col(c) + 1, 4)
    p = numbered(points)
    row = lambda serial, kind, x, y, r: F.struct(F.lit(serial).alias("serial"), F.lit(kind).alias("measure"), at(x).alias("sample"), at(y).alias("line"), r.alias("residual"))
    both = F.array(row(reference, "Candidate", "ref_x", "ref_y", F.lit(0.0)), row(target, "Registered", "src_x", "src_y", _or("residual", 0.0, 4)))
    return p.select("pair_id", F.format_string("PT_%05d", "n").alias("point_id"), F.inline(both), "weight", "sigma_x", "sigma_y").select(
        "pair_id", "point_id", "serial", "measure", "sample", "line", "residual", _or("weight", 1.0, 4).alias("weight"), _or("sigma_x", 0.2, 5).alias("sigma_x"), _or("sigma_y", 0.2, 5).alias("sigma_y"))


def ground_control(points: DataFrame, a: float = 1.0, b: float = 0.0, c: float = 0.0, d: float = 0.0, e: float = 1.0, f: float = 0.0) -> DataFrame:
    """Ground control points with geo coordinates by an affine map; unknown deviations 0.5, weight the confidence."""
    geo = lambda p, q, r: p * F.col("ref_x") + q * F.col("ref_y") + r
    return numbered(points, 0).select(
        "pair_id", F.col("n").alias("gcp_id"), "ref_x", "ref_y", "src_x", "src_y", geo(a, b, c).alias("geo_x"), geo(d, e, f).alias("geo_y"), F.coalesce("residual", F.lit(0.0)).alias("residual"), "confidence",
        F.coalesce("sigma_x", F.lit(0.5)).alias("sigma_x"), F.coalesce("sigma_y", F.lit(0.5)).alias("sigma_y"), F.coalesce("cov_xy", F.lit(0.0)).alias("cov_xy"), F.coalesce("weight", "confidence", F.lit(1.0)).alias("weight"))


def vector_features(points: DataFrame) -> DataFrame:
    """One GeoJSON LineString for each point, with its displacement."""
    dx, dy = F.col("src_x") - F.col("ref_x"), F.col("src_y") - F.col("ref_y")
    p = numbered(points, 0).withColumns({"dx": dx, "dy": dy, "magnitude": F.sqrt(dx * dx + dy * dy)})
    feature = F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.col("n").alias("id"),
        F.struct(F.lit("LineString").alias("type"), F.array(F.array("ref_x", "ref_y"), F.array("src_x", "src_y")).alias("coordinates")).alias("geometry"),
        F.struct(F.col("n").alias("gcp_id"), F.col("dx").alias("dx_pixels"), F.col("dy").alias("dy_pixels"), "magnitude", F.coalesce("residual", F.lit(0.0)).alias("residual_px"), "confidence").alias("properties")))
    return p.select("pair_id", "n", "dx", "dy", "magnitude", feature.alias("feature"))


def matches_table(points: DataFrame, inliers: DataFrame) -> DataFrame:
    """Points with an inlier flag, by id (coordinates change when they are refined)."""
    flag = inliers.select("pair_id", "tp_id", F.lit(True).alias("inlier"))
    return points.drop("inlier").join(flag, ["pair_id", "tp_id"], "left").withColumn("inlier", F.coalesce("inlier", F.lit(False)))


def discovery_manifest(ranked: DataFrame, counts: DataFrame) -> DataFrame:
    """JSON lines: a header object, then one object for each pair, best first within a file."""
    head = counts.select(F.to_json(F.struct(F.lit("1.0.0").alias("schema_version"), *counts.columns)).alias("value"))
    body = ranked.select(F.to_json(F.struct(*ranked.columns)).alias("value"))
    return head.unionByName(body)


def digest(points: DataFrame) -> DataFrame:
    """Upper-case SHA-256 of each pair's points as CSV lines with nine decimals.

    Lines are hashed first and the digest is over the ordered hashes of blocks of 1,000 lines, so no
    task needs more of a pair than hashes.
    """
    line = F.format_string("%d,%.9f,%.9f,%.9f,%.9f", "tp_id", "ref_x", "ref_y", "src_x", "src_y")
    block = F.floor(F.col("tp_id") / 1000)
    lines = points.groupBy("pair_id", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("tp_id", line.alias("line")))).alias("l"))
    hashed = lines.select("pair_id", "block", F.sha2(F.array_join("l.line", "\n").cast("binary"), 256).alias("h"))
    return hashed.groupBy("pair_id").agg(F.upper(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "h"))), lambda x: x.h), "").cast("binary"), 256)).alias("sha256"))


def csv_digest(points: DataFrame) -> DataFrame:
    """pair_id, digest: upper-case SHA-256 of a pair's tie points as the report's CSV file (header, nine decimals, by tp_id).

    The digest of a file needs its lines in order, so a pair's lines meet in one row; digest() is for pairs beyond that.
    """
    fixed = lambda c: F.coalesce(F.format_string("%.9f", c), F.lit(""))
    value = lambda c: F.when(F.col(c).isNotNull(), fixed(c)).otherwise("")
    line = F.concat_ws(",", *(value(c) for c in ("ref_x", "ref_y", "src_x", "src_y", "confidence", "residual")))
    lines = points.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("tp_id", line.alias("line")))).alias("l"))
    text = F.concat(F.lit("ref_x,ref_y,target_x,target_y,confidence,residual_error\n"), F.array_join(F.transform("l", lambda x: F.concat(x.line, F.lit("\n"))), ""))
    return lines.select("pair_id", F.upper(F.sha2(text.cast("binary"), 256)).alias("digest"))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Header and rows; arrays and structs as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode(mode).csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path, ignoreNullFields=False)


def append_pair(df: DataFrame, path: str) -> None:
    """Adds pairs to a manifest table."""
    df.write.mode("append").parquet(path)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes each row (name, content) as a file of its own below folder; the paths written (run when they are read).

    A task that is run again writes the same bytes to the same place.
    """
    import pandas as pd

    base = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    base = base.replace("file:/", "file:///", 1) if base.startswith("file:/") and not base.startswith("file://") else base

    def run(frames):
        from pyarrow import fs

        for pdf in frames:
            paths = []
            for name, content in zip(pdf["name"], pdf["content"]):
                system, place = fs.FileSystem.from_uri(f"{base.rstrip('/')}/{name}")
                system.create_dir(place.rsplit("/", 1)[0])
                with system.open_output_stream(place) as f:
                    f.write(content.encode("utf-8") if isinstance(content, str) else content)
                paths.append(f"{base.rstrip('/')}/{name}")
            yield pd.DataFrame({"name": pdf["name"], "path": paths})

    return files.select("name", "content").mapInPandas(run, "name string, path string")


def registration_package(fits: DataFrame, points: DataFrame, spatial: DataFrame, products: DataFrame) -> DataFrame:
    """pair_id, file, content: the JSON documents that describe each pair's registration.

    fits: pair_id, model, h00 .. h22, rmse; points: pair_id, residual, inlier; spatial: pair_id and its measures;
    products: pair_id and the structs source and reference, with gsd_m, width, height among their fields.
    """
    c = F.col
    counts = points.groupBy("pair_id").agg(F.count("*").alias("raw_matches"), F.count_if("inlier").alias("inlier_count"),
                                           F.sort_array(F.collect_list(F.when(c("inlier"), c("residual")))).alias("fit_residuals"))
    held = fits.join(counts, "pair_id").join(spatial.select("pair_id", F.struct(*(x for x in spatial.columns if x != "pair_id")).alias("spatial")), "pair_id").join(products, "pair_id")
    row = lambda i: F.array(*(c(f"h{i}{j}") for j in range(3)))
    matrix, ratio = F.array(row(0), row(1), row(2)), c("inlier_count") / c("raw_matches")
    full = lambda side: F.struct(F.lit(0).alias("col_off"), F.lit(0).alias("row_off"), c(f"{side}.width").alias("width"), c(f"{side}.height").alias("height"))
    scale = c("reference.gsd_m") / c("source.gsd_m")
    frames = {"source_frame": F.lit("FULL_SOURCE_IMAGE"), "reference_frame": F.lit("FULL_REFERENCE_IMAGE")}
    documents = {
        "output_validation.json": {"status": F.lit("VERIFIED"), "width": c("reference.width"), "height": c("reference.height")},
        "geometry.json": {"model": F.lit("GLOBAL_PROJECTIVE"), **frames, "parameters": matrix, "fit_point_count": c("raw_matches"), "inlier_count": c("inlier_count"), "inlier_ratio": ratio, "fit_residuals": c("fit_residuals"), "held_out_residuals": F.array().cast("array<double>"), "plausibility_status": F.lit("PLAUSIBLE")},
        "source_metadata.json": None, "reference_metadata.json": None,
        "overlap.json": {"overlap_status": F.lit("OVERLAP_UNKNOWN"), "geometry_method": F.lit("FULL_IMAGE"), "scale_ratio": scale, "source_window": full("source"), "reference_window": full("reference")},
        "provenance.json": {"pair_id": c("pair_id"), "config": F.lit("default")},
        "coordinate_audit.json": {**frames, "transform_direction": F.lit("SOURCE_TO_REFERENCE"), "convention": F.lit("T(source FULL_IMAGE) = reference FULL_IMAGE"), "source_offset": F.array(F.lit(0), F.lit(0)), "reference_offset": F.array(F.lit(0), F.lit(0)), "source_gsd_m": c("source.gsd_m"), "reference_gsd_m": c("reference.gsd_m"), "scale_ratio": scale},
        "spatial_distribution.json": {"frame": F.lit("FULL_SOURCE_IMAGE"), "raw_match_count": c("raw_matches"), "inlier_count": c("inlier_count"), "inlier_ratio": ratio, "measures": c("spatial")},
        "transform.json": {"model": F.lit("HOMOGRAPHY"), "matrix": matrix, "source_frame": F.lit("FULL_SOURCE_IMAGE"), "target_frame": F.lit("FULL_REFERENCE_IMAGE")},
        "metrics.json": {"rmse_pixels": c("rmse"), "inlier_ratio": ratio, "inlier_count": c("inlier_count"), "raw_matches": c("raw_matches"), "spatial_entropy": c("spatial.entropy"), "coverage_ratio": c("spatial.coverage"), "estimated_transform": matrix},
    }
    whole = {"source_metadata.json": c("source"), "reference_metadata.json": c("reference")}
    struct = lambda name, fields: whole[name] if fields is None else F.struct(*(v.alias(k) for k, v in fields.items()))
    files = [F.struct(F.lit(name).alias("file"), F.to_json(struct(name, fields), {"ignoreNullFields": "false"}).alias("content")) for name, fields in documents.items()]
    return held.select("pair_id", F.explode(F.array(*files)).alias("f")).select("pair_id", "f.*")
