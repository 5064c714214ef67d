"""Queries behind the sinks, manifests, checkpoints and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from craterloom.operators import checkpoints as CP
from craterloom.plans.inputs import duck, relation
from craterloom.plans.registry import query, rounded
from craterloom.sources import sinks

_TP = duck("tie_points")
_N = "row_number() OVER (PARTITION BY pair_id ORDER BY tp_id)"


def _tp(spark, d):
    return relation(spark, d, "tie_points")


@query("K5 M19 W8", _TP + f"""SELECT pair_id, printf('GCP_%05d', {_N}) AS point_id, CASE WHEN residual IS NULL THEN 'Free' ELSE 'TiePoint' END AS point_type, round_even(ref_x + 1, 4) AS ref_sample, round_even(ref_y + 1, 4) AS ref_line, round_even(src_x + 1, 4) AS tgt_sample, round_even(src_y + 1, 4) AS tgt_line,
coalesce(round_even(sigma_x, 5), 0.2) AS sigma_x, coalesce(round_even(sigma_y, 5), 0.2) AS sigma_y, coalesce(round_even(cov_xy, 5), 0) AS cov_xy, coalesce(round_even(weight, 4), 1) AS weight, coalesce(round_even(residual, 4), 0) AS residual, round_even(confidence, 4) AS confidence FROM tie_points""")
def k5_control_network(spark, d):
    return sinks.control_network(_tp(spark, d))


@query("K6", _TP + f""", m AS (SELECT *, {_N} AS n FROM tie_points) SELECT pair_id, printf('PT_%05d', n) AS point_id, serial, measure, sample, line, residual, coalesce(round_even(weight, 4), 1) AS weight, coalesce(round_even(sigma_x, 5), 0.2) AS sigma_x, coalesce(round_even(sigma_y, 5), 0.2) AS sigma_y FROM
(SELECT pair_id, n, 'REF' AS serial, 'Candidate' AS measure, round_even(ref_x + 1, 4) AS sample, round_even(ref_y + 1, 4) AS line, 0.0e0 AS residual, weight, sigma_x, sigma_y FROM m UNION ALL
 SELECT pair_id, n, 'TGT', 'Registered', round_even(src_x + 1, 4), round_even(src_y + 1, 4), coalesce(round_even(residual, 4), 0), weight, sigma_x, sigma_y FROM m)""")
def k6_measures(spark, d):
    return sinks.measures(_tp(spark, d), "REF", "TGT")


@query("K7 M18", _TP + f"""SELECT pair_id, CAST({_N} - 1 AS INT) AS gcp_id, round(ref_x, 6) AS ref_x, round(ref_y, 6) AS ref_y, round(src_x, 6) AS src_x, round(src_y, 6) AS src_y, round(0.5e0 * ref_x + 10, 6) AS geo_x, round(-0.5e0 * ref_y + 20, 6) AS geo_y, round(coalesce(residual, 0), 6) AS residual, round(confidence, 6) AS confidence,
round(coalesce(sigma_x, 0.5), 6) AS sigma_x, round(coalesce(sigma_y, 0.5), 6) AS sigma_y, round(coalesce(cov_xy, 0), 6) AS cov_xy, round(coalesce(weight, confidence, 1), 6) AS weight FROM tie_points""")
def k7_ground_control(spark, d):
    return rounded(sinks.ground_control(_tp(spark, d), 0.5, 0.0, 10.0, 0.0, -0.5, 20.0), 6)


@query("K8", _TP + f"SELECT pair_id, CAST({_N} - 1 AS INT) AS n, round(src_x - ref_x, 6) AS dx, round(src_y - ref_y, 6) AS dy, round(sqrt(pow(src_x - ref_x, 2) + pow(src_y - ref_y, 2)), 6) AS magnitude FROM tie_points")
def k8_vector_field(spark, d):
    f = sinks.vector_features(_tp(spark, d))
    back = F.from_json("feature", "properties struct<gcp_id:int,dx_pixels:double,dy_pixels:double,magnitude:double>").properties
    return rounded(f.select("pair_id", back.gcp_id.alias("n"), back.dx_pixels.alias("dx"), back.dy_pixels.alias("dy"), back.magnitude.alias("magnitude")))


@query("K4 J12", _TP + "SELECT tp_id, inlier AND confidence > 0.2 AS inlier FROM tie_points")
def k4_inlier_flags(spark, d):
    p = _tp(spark, d)
    return sinks.matches_table(p, p.where("inlier and confidence > 0.2")).select("tp_id", "inlier")


@query("G24", _TP + """, l AS (SELECT pair_id, tp_id // 1000 AS block, sha256(string_agg(printf('%d,%.9f,%.9f,%.9f,%.9f', tp_id, ref_x, ref_y, src_x, src_y), chr(10) ORDER BY tp_id)) AS h FROM tie_points GROUP BY ALL) SELECT pair_id, upper(sha256(string_agg(h, '' ORDER BY block))) AS sha256 FROM l GROUP BY pair_id""")
def g24_content_digest(spark, d):
    return sinks.digest(_tp(spark, d))


@query("G26 K16", _TP + """, b AS (SELECT pair_id, least(greatest(5, count(residual) // 2), 20) AS bins, min(residual) AS lo, max(residual) AS hi FROM tie_points GROUP BY pair_id) SELECT t.pair_id, CAST(least(bins, CAST(floor((residual - lo) / ((hi - lo) / bins)) AS BIGINT) + 1) AS BIGINT) AS bin, count(*) AS n FROM tie_points t JOIN b ON t.pair_id = b.pair_id WHERE residual IS NOT NULL GROUP BY ALL""")
def g26_residual_histogram(spark, d):
    p = _tp(spark, d).where("residual is not null")
    b = p.groupBy("pair_id").agg(F.least(F.greatest(F.lit(5), F.floor(F.count("*") / 2)), F.lit(20)).alias("bins"), F.min("residual").alias("lo"), F.max("residual").alias("hi"))
    bin_ = F.least(F.col("bins"), F.floor((F.col("residual") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / F.col("bins"))) + 1)
    return p.join(b, "pair_id").groupBy("pair_id", bin_.cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("G15 G16", _TP + """SELECT pair_id, round(sqrt(avg(residual * residual)), 6) AS rmse, round(quantile_cont(residual, 0.5), 6) AS median, round(quantile_cont(residual, 0.95), 6) AS p95, round(least(1, (max(src_x) - min(src_x)) * (max(src_y) - min(src_y)) / (1024.0 * 1024.0)), 6) AS coverage FROM tie_points GROUP BY pair_id""")
def g15_baseline_metrics(spark, d):
    span = lambda c: F.max(c) - F.min(c)
    return rounded(_tp(spark, d).groupBy("pair_id").agg(F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rmse"), F.percentile("residual", 0.5).alias("median"), F.percentile("residual", 0.95).alias("p95"),
                   F.least(F.lit(1.0), span("src_x") * span("src_y") / (1024.0 * 1024.0)).alias("coverage")))


@query("K12 K13 U5 G23", _TP + """, s AS (SELECT 'raw' AS stage, 0 AS o, tp_id, residual, pair_id FROM tie_points UNION ALL SELECT 'thinned', 1, tp_id, residual, pair_id FROM tie_points WHERE confidence > 0.3 UNION ALL SELECT 'inliers', 2, tp_id, residual, pair_id FROM tie_points WHERE inlier)
SELECT stage, pair_id, count(*) AS n, round(avg(residual), 6) AS mean_residual FROM s GROUP BY ALL""")
def k13_ablation_stages(spark, d):
    p = _tp(spark, d)
    stage = lambda name, df: df.select(F.lit(name).alias("stage"), "pair_id", "residual")
    rows = stage("raw", p).unionByName(stage("thinned", p.where("confidence > 0.3"))).unionByName(stage("inliers", p.where("inlier")))
    return rounded(rows.groupBy("stage", "pair_id").agg(F.count("*").alias("n"), F.avg("residual").alias("mean_residual")))


@query("P14", _TP + "SELECT pair_id, bool_or(tp_id % 977 = 5) AS mixed_frames FROM tie_points GROUP BY pair_id")
def p14_frame_consistency(spark, d):
    p = _tp(spark, d).withColumn("frame", F.when(F.col("tp_id") % 977 == 5, "FULL_REFERENCE_IMAGE").otherwise("FULL_SOURCE_IMAGE"))
    return p.groupBy("pair_id").agg(F.max(F.col("frame") != "FULL_SOURCE_IMAGE").alias("mixed_frames"))


@query("M17 M18", _TP + """SELECT tp_id, round(src_x * 2 / 0.5 + 3 + 7, 6) AS full_x, round(src_y * 2 / 0.5 + 5 + 11, 6) AS full_y, true AS round_trip FROM tie_points""")
def m17_coordinate_audit(spark, d):
    from craterloom.functions.frames import full_to_local, local_to_full

    x, y = local_to_full(F.col("src_x"), F.col("src_y"), pyramid=0.5, resampling=2.0, tile=(3.0, 5.0), window=(7.0, 11.0))
    p = _tp(spark, d).select("tp_id", "src_x", "src_y", x.alias("full_x"), y.alias("full_y"))
    bx, by = full_to_local(F.col("full_x"), F.col("full_y"), pyramid=0.5, resampling=2.0, tile=(3.0, 5.0), window=(7.0, 11.0))
    error = F.greatest(F.abs(bx - F.col("src_x")), F.abs(by - F.col("src_y")))
    return rounded(p.select("tp_id", "full_x", "full_y", (error < 1e-9).alias("round_trip")))


@query("M24", _TP + """, c AS (SELECT tp_id, src_x - 512 AS px, src_y - 512 AS py, CASE WHEN tp_id % 10 = 0 THEN 0.5e0 ELSE 100 + confidence * 50 END AS z FROM tie_points) SELECT tp_id, CASE WHEN z > 1 THEN round(512 + 800 * px / z, 6) END AS u, CASE WHEN z > 1 THEN round(512 + 800 * py / z, 6) END AS v FROM c""")
def m24_pinhole(spark, d):
    from craterloom.functions.frames import pinhole

    z = F.when(F.col("tp_id") % 10 == 0, 0.5).otherwise(100 + F.col("confidence") * 50)
    u, v = pinhole(F.col("src_x") - 512, F.col("src_y") - 512, z, focal=800.0, cx=512.0, cy=512.0)
    return rounded(_tp(spark, d).select("tp_id", u.alias("u"), v.alias("v")))


@query("M12 W6", duck("transforms") + """, s AS (SELECT a.pair_id, 0.1e0 + a.pair_id % 5 * 0.05e0 AS r0, 0.2e0 + a.pair_id % 3 * 0.1e0 AS r1, b.h00 AS a, b.h01 AS b, b.h10 AS c, b.h11 AS d FROM transforms a JOIN transforms b ON b.pair_id = a.pair_id + 1),
t AS (SELECT *, a*a+b*b+c*c+d*d AS f, a*d-b*c AS dd FROM s) SELECT pair_id, round(r0*r0*(a*a+b*b)+r1*r1, 6) AS c00, round(r0*r0*(a*c+b*d), 6) AS c01, round(r0*r0*(c*c+d*d)+r1*r1, 6) AS c11, round(sqrt(pow(sqrt((f + sqrt(greatest(f*f-4*dd*dd, 0))) / 2) * r0, 2) + r1*r1), 6) AS uncertainty FROM t""")
def m12_cascade_uncertainty(spark, d):
    from craterloom.functions.frames import propagated

    t = relation(spark, d, "transforms").select("pair_id", "h00", "h01", "h10", "h11")
    nxt = t.select((F.col("pair_id") - 1).alias("pair_id"), *(F.col(c).alias("n" + c) for c in ("h00", "h01", "h10", "h11")))
    r0, r1 = 0.1 + F.col("pair_id") % 5 * 0.05, 0.2 + F.col("pair_id") % 3 * 0.1
    c00, c01, c11, u = propagated(r0, r1, *(F.col("n" + c) for c in ("h00", "h01", "h10", "h11")))
    return rounded(t.join(nxt, "pair_id").select("pair_id", c00.alias("c00"), c01.alias("c01"), c11.alias("c11"), u.alias("uncertainty")))


@query("J14", duck("transforms", "products") + """, s AS (SELECT k, instrument AS src, CASE WHEN k % 4 = 0 THEN 'nac' ELSE lead(instrument) OVER (PARTITION BY k // 6 ORDER BY k) END AS ref FROM products) SELECT k, upper(ref) IS DISTINCT FROM upper(nxt) AND nxt_k IS NOT NULL AS broken FROM (SELECT *, lead(src) OVER w AS nxt, lead(k) OVER w AS nxt_k FROM s WINDOW w AS (PARTITION BY k // 6 ORDER BY k))""")
def j14_cascade_links(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy(F.floor(F.col("k") / 6)).orderBy("k")
    s = relation(spark, d, "products").select("k", F.col("instrument").alias("src"), F.when(F.col("k") % 4 == 0, "nac").otherwise(F.lead("instrument").over(w)).alias("ref"))
    return s.select("k", (~F.upper("ref").eqNullSafe(F.upper(F.lead("src").over(w))) & F.lead("k").over(w).isNotNull()).alias("broken"))


_CPV = _TP + """, c AS (SELECT tp_id, CASE WHEN tp_id % 50 = 7 THEN tp_id - 1 ELSE tp_id END AS point_id, CASE WHEN tp_id % 40 = 3 THEN NULL ELSE src_x END AS source_x, CASE WHEN tp_id % 60 = 9 THEN src_y + 5000 ELSE src_y END AS source_y, CASE tp_id % 30 WHEN 4 THEN 'D' WHEN 5 THEN 'b' ELSE 'A' END AS quality, CASE WHEN tp_id % 45 = 8 THEN '' ELSE 'manual' END AS provenance FROM tie_points)"""


@query("S17 S18 S19", _CPV + """ SELECT tp_id, CASE WHEN source_x IS NULL THEN 'MISSING_FIELD' WHEN provenance = '' THEN 'MISSING_PROVENANCE' WHEN upper(quality) NOT IN ('A', 'B', 'C') THEN 'BAD_QUALITY' WHEN source_x < 0 OR source_y < 0 OR source_x >= 1024 OR source_y >= 1024 THEN 'OUT_OF_BOUNDS'
 WHEN count(*) OVER (PARTITION BY point_id) > 1 THEN 'DUPLICATE_ID' ELSE 'OK' END AS verdict FROM c""")
def s17_checkpoint_checks(spark, d):
    k = F.col("tp_id")
    c = _tp(spark, d).select(
        "tp_id", F.when(k % 50 == 7, k - 1).otherwise(k).alias("point_id"), F.when(k % 40 != 3, F.col("src_x")).alias("source_x"), F.when(k % 60 == 9, F.col("src_y") + 5000).otherwise(F.col("src_y")).alias("source_y"), "ref_x", "ref_y",
        F.when(k % 30 == 4, "D").when(k % 30 == 5, "b").otherwise("A").alias("quality"), F.when(k % 45 == 8, "").otherwise("manual").alias("provenance"))
    return CP.judged(c.withColumnsRenamed({"ref_x": "reference_x", "ref_y": "reference_y"}), (1024.0, 1024.0)).select("tp_id", "verdict")


@query("M27", duck("products") + "SELECT a.k, concat(a.product_id, '__', b.product_id) AS pair_id FROM products a JOIN products b ON b.k = a.k + 1")
def m27_pair_ids(spark, d):
    p = relation(spark, d, "products").select("k", "product_id")
    nxt = p.select((F.col("k") - 1).alias("k"), F.col("product_id").alias("other"))
    return p.join(nxt, "k").select("k", F.concat_ws("__", "product_id", "other").alias("pair_id"))


@query("P26 P27 P28", duck("products") + """SELECT k, CASE upper(trim(instrument)) WHEN 'OHRC' THEN 'OPTICAL' WHEN 'OHR' THEN 'OPTICAL' WHEN 'LROC_NAC' THEN 'OPTICAL' WHEN 'TC' THEN 'STEREO' WHEN 'IIRS' THEN 'HYPERSPECTRAL' ELSE 'UNKNOWN' END AS modality, 4 * (4 * CAST(width AS BIGINT) * height + 4 * CAST(width AS BIGINT) * height) <= 20000000 AS fits, greatest(width, height) >= 1024 AS tiled FROM products""")
def p27_routing(spark, d):
    from craterloom.functions.frames import fits_memory, sensor_modality

    p = relation(spark, d, "products")
    return p.select("k", sensor_modality(F.col("instrument")).alias("modality"), fits_memory(F.col("width"), F.col("height"), 20_000_000).alias("fits"),
                    F.when(F.col("width").isNull(), F.col("height")).when(F.col("height").isNull(), F.col("width")).otherwise(F.greatest("width", "height")).__ge__(1024).alias("tiled"))


@query("G17", duck("products") + ", t AS (SELECT k, unnest([min_lat, max_lat, lat]) AS la, unnest([min_lon, max_lon, lon]) AS lo FROM products) SELECT k, round(avg(la), 6) AS center_lat, round(avg(lo), 6) AS center_lon, round(min(lo), 6) AS west, round(max(la), 6) AS north FROM t GROUP BY k")
def g17_label_center(spark, d):
    t = relation(spark, d, "products").select("k", F.inline(F.array(*(F.struct(F.col(a).alias("la"), F.col(o).alias("lo")) for a, o in (("min_lat", "min_lon"), ("max_lat", "max_lon"), ("lat", "lon"))))))
    return rounded(t.groupBy("k").agg(F.avg("la").alias("center_lat"), F.avg("lo").alias("center_lon"), F.min("lo").alias("west"), F.max("la").alias("north")))


@query("K1 S14", duck("products") + "SELECT k, product_id, mission, gsd_m FROM products")
def k1_catalog_csv_round_trip(spark, d):
    """The catalog written as CSV to the shared folder and read back with its schema."""
    import uuid

    from craterloom.sources.readers import read_catalog
    from craterloom.sources.scratch import ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(spark)}/catalog-{uuid.uuid4().hex}"
    p = relation(spark, d, "products")
    sinks.write_csv(p.select("k", "product_id", "mission", "gsd_m"), path)
    return read_catalog(spark, path, "k long, product_id string, mission string, gsd_m double")


@query("K2 S15", duck("products") + "SELECT k AS pair, product_id AS source, status FROM products")
def k2_manifest_json_round_trip(spark, d):
    """A manifest of nested pairs written as JSON to the shared folder, read back and flattened."""
    import uuid

    from craterloom.sources.readers import read_manifest
    from craterloom.sources.scratch import ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(spark)}/manifest-{uuid.uuid4().hex}"
    p = relation(spark, d, "products")
    blocks = p.groupBy(F.floor(F.col("k") / 200).alias("block")).agg(F.collect_list(F.struct(F.col("k").alias("pair"), F.col("product_id").alias("source"), "status")).alias("pairs"))
    sinks.write_json(blocks, path)
    return read_manifest(spark, path, "pair long, source string, status string")
