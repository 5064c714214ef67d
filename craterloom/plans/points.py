"""Queries on tie points: thinning, spread, residuals, checkpoints, transforms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from craterloom.functions import transforms as T
from craterloom.operators import thinning as N
from craterloom.plans.inputs import duck, relation
from craterloom.plans.registry import query, rounded

SIDE = 1024.0
_CELL = "CAST(greatest(0, least(7, floor(src_y / 128.0e0))) * 8 + greatest(0, least(7, floor(src_x / 128.0e0))) AS INT)"
_TP = duck("tie_points")


def _points(spark, d):
    return relation(spark, d, "tie_points")


@query("T1 W1", _TP + f", c AS (SELECT pair_id, tp_id, confidence, {_CELL} AS cell FROM tie_points) SELECT pair_id, tp_id, cell, CAST(row_number() OVER w AS INT) AS rank FROM c WINDOW w AS (PARTITION BY pair_id, cell ORDER BY confidence DESC, tp_id) QUALIFY row_number() OVER w <= 4")
def t1_cap_grid_cells(spark, d):
    return N.cap_cells(_points(spark, d), SIDE, SIDE).select("pair_id", "tp_id", "cell", "rank")


@query("T2", _TP + """, r AS (SELECT a.pair_id, a.tp_id, any_value(a.confidence) AS c, sqrt(min(pow(a.src_x - b.src_x, 2) + pow(a.src_y - b.src_y, 2))) AS radius FROM tie_points a
LEFT JOIN tie_points b ON a.pair_id = b.pair_id AND (b.confidence > a.confidence OR b.confidence = a.confidence AND b.tp_id < a.tp_id) GROUP BY a.pair_id, a.tp_id)
SELECT pair_id, tp_id, round(radius, 6) AS radius FROM r QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY coalesce(round(radius, 9), 1e300) DESC, c DESC, tp_id) <= 100""")
def t2_suppression_radius(spark, d):
    return rounded(N.suppression_radius(_points(spark, d), 100))


@query("J10", _TP + """SELECT a.pair_id, a.tp_id AS strong, b.tp_id AS weak, round(sqrt(pow(a.ref_x - b.ref_x, 2) + pow(a.ref_y - b.ref_y, 2)), 6) AS distance FROM tie_points a JOIN tie_points b
ON a.pair_id = b.pair_id AND (a.confidence > b.confidence OR a.confidence = b.confidence AND a.tp_id < b.tp_id) WHERE sqrt(pow(a.ref_x - b.ref_x, 2) + pow(a.ref_y - b.ref_y, 2)) <= 24""")
def j10_radius_join(spark, d):
    return rounded(N.close_pairs(_points(spark, d), 24.0))


@query("T3 J10", None)
def t3_seam_suppression(spark, d):
    from craterloom.sources.scratch import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return N.seam_survivors(_points(spark, d), 24.0).select("pair_id", "tp_id")


def _entropy_sql(where: str) -> str:
    return _TP + f""", c AS (SELECT pair_id, {_CELL} AS cell, count(*) AS n FROM tie_points {where} GROUP BY ALL), p AS (SELECT pair_id, n / sum(n) OVER (PARTITION BY pair_id) AS p FROM c)
SELECT pair_id, round(greatest(0, least(1, -sum(p * log2(p)) / 6.0)), 6) AS entropy FROM p GROUP BY pair_id"""


@query("G7 U6", _entropy_sql("WHERE src_x BETWEEN 0 AND 1024 AND src_y BETWEEN 0 AND 1024"))
def g7_entropy_inside(spark, d):
    return rounded(N.entropy_inside(_points(spark, d), SIDE, SIDE))


@query("G8", _entropy_sql(""))
def g8_entropy_clamped(spark, d):
    return rounded(N.entropy_clamped(_points(spark, d), SIDE, SIDE))


_NN = """nn AS (SELECT a.pair_id, a.tp_id, sqrt(min(pow(a.src_x - b.src_x, 2) + pow(a.src_y - b.src_y, 2)){0}) AS nn FROM tie_points a JOIN tie_points b ON a.pair_id = b.pair_id AND a.tp_id <> b.tp_id GROUP BY ALL)"""


@query("G9", _TP + ", " + _NN.format("") + f""", grid AS (SELECT pair_id, cell FROM (SELECT DISTINCT pair_id FROM tie_points), (SELECT unnest(range(0, 64)) AS cell)),
h AS (SELECT pair_id, {_CELL} AS cell, count(*) AS n FROM tie_points GROUP BY ALL), c AS (SELECT g.pair_id, g.cell, coalesce(h.n, 0) AS n FROM grid g LEFT JOIN h ON g.pair_id = h.pair_id AND g.cell = h.cell),
s AS (SELECT pair_id, sum(n) AS points, count(*) FILTER (WHERE n > 0) AS occupied_cells, max(n) AS max_per_cell, min(n) AS min_per_cell, avg(n) AS mean_density, var_pop(n) AS density_variance,
 sum(n) FILTER (WHERE cell // 8 IN (0, 7) OR cell % 8 IN (0, 7)) AS edge FROM c GROUP BY pair_id),
e AS (SELECT c.pair_id, -sum(n / points * log2(n / points)) / 6.0 AS entropy FROM c JOIN s ON c.pair_id = s.pair_id WHERE n > 0 GROUP BY c.pair_id),
m AS (SELECT pair_id, avg(nn) / sqrt(1024.0e0 * 1024 * 2) AS nn_concentration FROM nn GROUP BY pair_id)
SELECT s.pair_id, CAST(points AS BIGINT) AS points, occupied_cells, CAST(max_per_cell AS BIGINT) AS max_per_cell, CAST(min_per_cell AS BIGINT) AS min_per_cell, round(occupied_cells / 64.0e0, 6) AS coverage, round(mean_density, 6) AS mean_density,
round(density_variance, 6) AS density_variance, round(max_per_cell / points, 6) AS max_cluster_fraction, round(entropy, 6) AS entropy, round(abs(edge / points - 0.5), 6) AS edge_imbalance, round(nn_concentration, 6) AS nn_concentration,
CASE WHEN occupied_cells < 12.8 OR max_per_cell / points > 0.5 OR entropy < 0.35 THEN 'CLUSTERED_MATCHES' WHEN occupied_cells >= 32 THEN 'GOOD_DISTRIBUTION' ELSE 'PARTIAL_COVERAGE' END AS status
FROM s JOIN e ON s.pair_id = e.pair_id JOIN m ON s.pair_id = m.pair_id""")
def g9_spatial_metrics(spark, d):
    return rounded(N.spatial_metrics(_points(spark, d), SIDE, SIDE).drop("by_cell"))


@query("G10", duck("clustered") + f""", h AS (SELECT DISTINCT pair_id, {_CELL} AS cell FROM clustered),
empty AS (SELECT p.pair_id, CAST(g.cell AS INT) AS cell FROM (SELECT DISTINCT pair_id FROM clustered) p, (SELECT unnest(range(0, 64)) AS cell) g WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.pair_id = p.pair_id AND h.cell = g.cell)),
reach AS (WITH RECURSIVE w(pair_id, cell, root) AS (SELECT pair_id, cell, cell FROM empty UNION SELECT e.pair_id, e.cell, w.root FROM w JOIN empty e ON e.pair_id = w.pair_id
 AND (abs(e.cell - w.cell) = 8 OR abs(e.cell - w.cell) = 1 AND e.cell // 8 = w.cell // 8)) SELECT pair_id, root, count(*) AS n FROM w GROUP BY pair_id, root)
SELECT p.pair_id, CAST(coalesce(max(n), 0) AS BIGINT) AS largest_empty_region FROM (SELECT DISTINCT pair_id FROM clustered) p LEFT JOIN reach r ON r.pair_id = p.pair_id GROUP BY p.pair_id""")
def g10_largest_empty(spark, d):
    return N.largest_empty(N.spatial_metrics(relation(spark, d, "clustered"), SIDE, SIDE))


@query("G12", _TP + ", " + _NN.format(" FILTER (WHERE a.src_x <> b.src_x OR a.src_y <> b.src_y)") + """, q AS (SELECT pair_id, count(DISTINCT least(7, CAST(trunc(src_y / 1024 * 8) AS INT)) * 8 + least(7, CAST(trunc(src_x / 1024 * 8) AS INT))) / 64.0e0 AS occ,
least(1, (max(src_x) - min(src_x)) / 1024 * ((max(src_y) - min(src_y)) / 1024)) AS cov, avg(CASE WHEN src_x <= 102.4 OR src_x >= 921.6 OR src_y <= 102.4 OR src_y >= 921.6 THEN 1 ELSE 0 END) AS edge FROM tie_points GROUP BY pair_id)
SELECT q.pair_id, round(occ, 6) AS occupied_ratio, round(cov, 6) AS coverage_ratio, round(edge, 6) AS edge_ratio, round(avg(nn), 6) AS mean_nn,
CASE WHEN occ >= 0.5 AND cov >= 0.5 THEN 'GOOD_DISTRIBUTION' WHEN occ >= 0.2 AND cov >= 0.2 THEN 'PARTIAL_COVERAGE' ELSE 'CLUSTERED_MATCHES' END AS status FROM q JOIN nn ON q.pair_id = nn.pair_id GROUP BY q.pair_id, occ, cov, edge""")
def g12_spatial_quality(spark, d):
    return rounded(N.spatial_quality(_points(spark, d), SIDE, SIDE))


_PROJ = """(h00*src_x+h01*src_y+h02)/(h20*src_x+h21*src_y+h22) AS px, (h10*src_x+h11*src_y+h12)/(h20*src_x+h21*src_y+h22) AS py"""
_RES = duck("tie_points", "transforms") + f""", proj AS (SELECT p.*, {_PROJ} FROM tie_points p JOIN transforms t ON p.pair_id = t.pair_id), res AS (SELECT *, sqrt(pow(px - ref_x, 2) + pow(py - ref_y, 2)) AS res FROM proj) """


def _residuals(spark, d):
    p = _points(spark, d).join(relation(spark, d, "transforms"), "pair_id")
    px, py = T.applied(F.col("src_x"), F.col("src_y"))
    return p.withColumns({"px": px, "py": py}).withColumn("res", F.sqrt(F.pow(F.col("px") - F.col("ref_x"), 2) + F.pow(F.col("py") - F.col("ref_y"), 2)))


@query("M1", _RES + "SELECT tp_id, round(px, 6) AS px, round(py, 6) AS py, round(res, 6) AS res FROM res")
def m1_project(spark, d):
    return rounded(_residuals(spark, d).select("tp_id", "px", "py", "res"))


@query("G4 G5 G6 M28 G22", _RES + """SELECT pair_id, count(*) FILTER (WHERE inlier) AS inliers, round(100.0 * count(*) FILTER (WHERE inlier) / count(*), 6) AS inlier_ratio_percent, round(sqrt(avg(res * res) FILTER (WHERE inlier)), 6) AS rmse,
round(avg(res) FILTER (WHERE inlier), 6) AS mean_res, round(quantile_cont(res, 0.5) FILTER (WHERE inlier), 6) AS median_res, round(max(res) FILTER (WHERE inlier), 6) AS max_res, round(stddev_pop(res) FILTER (WHERE inlier), 6) AS std_res,
round(quantile_cont(res, 0.9) FILTER (WHERE inlier), 6) AS ce90, round(quantile_cont(res, 0.95) FILTER (WHERE inlier), 6) AS p95, sqrt(avg(res * res) FILTER (WHERE inlier)) < 0.40 AND count(*) FILTER (WHERE inlier) >= 4 AS meets_mandate FROM res GROUP BY pair_id""")
def g6_residual_statistics(spark, d):
    r = F.when(F.col("inlier"), F.col("res"))
    n, rmse = F.count(r), F.sqrt(F.avg(r * r))
    low = lambda c, v=999.0: F.when(F.count(r) >= 4, c).otherwise(v)
    return rounded(_residuals(spark, d).groupBy("pair_id").agg(
        n.alias("inliers"), (100.0 * n / F.count("*")).alias("inlier_ratio_percent"), low(rmse).alias("rmse"), low(F.avg(r)).alias("mean_res"), low(F.percentile(r, 0.5)).alias("median_res"), low(F.max(r)).alias("max_res"),
        low(F.stddev_pop(r), 0.0).alias("std_res"), low(F.percentile(r, 0.9)).alias("ce90"), low(F.percentile(r, 0.95)).alias("p95"), (low(rmse) < 0.40).alias("meets_mandate")))


@query("G13", _RES + """, c AS (SELECT *, sqrt(pow(round_even(px, 0) - ref_x, 2) + pow(round_even(py, 0) - ref_y, 2)) AS ires FROM res), a AS (SELECT pair_id, count(*) AS n, sqrt(avg(res * res)) AS s, sqrt(avg(ires * ires)) AS i,
quantile_cont(res, 0.5) AS sm, quantile_cont(ires, 0.5) AS im, quantile_cont(res, 0.95) AS sp, quantile_cont(ires, 0.95) AS ip FROM c GROUP BY pair_id) SELECT pair_id, n AS checkpoint_count, round(s, 6) AS subpixel_rmse, round(i, 6) AS integer_rmse,
round(sm, 6) AS subpixel_median, round(im, 6) AS integer_median, round(sp, 6) AS subpixel_p95, round(ip, 6) AS integer_p95, round(CASE WHEN i > 0 THEN (i - s) / greatest(i, 1e-6) * 100 ELSE 0 END, 5) AS improvement_percent FROM a WHERE n >= 4""")
def g13_checkpoint_accuracy(spark, d):
    """Every tie point as a checkpoint of its pair's transform."""
    c = _residuals(spark, d).withColumn("ires", F.sqrt(F.pow(F.rint("px") - F.col("ref_x"), 2) + F.pow(F.rint("py") - F.col("ref_y"), 2)))
    rms = lambda x: F.sqrt(F.avg(F.col(x) * F.col(x)))
    a = c.groupBy("pair_id").agg(F.count("*").alias("checkpoint_count"), rms("res").alias("subpixel_rmse"), rms("ires").alias("integer_rmse"), F.percentile("res", 0.5).alias("subpixel_median"), F.percentile("ires", 0.5).alias("integer_median"),
                                 F.percentile("res", 0.95).alias("subpixel_p95"), F.percentile("ires", 0.95).alias("integer_p95")).where("checkpoint_count >= 4")
    better = (F.col("integer_rmse") - F.col("subpixel_rmse")) / F.greatest("integer_rmse", F.lit(1e-6)) * 100
    out = a.withColumn("better", F.round(F.when(F.col("integer_rmse") > 0, better).otherwise(0.0), 5))
    return rounded(out.drop("better")).join(out.select("pair_id", F.col("better").alias("improvement_percent")), "pair_id")


_SPLIT = """, ranked AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY md5(concat(tp_id, ':42')), tp_id) AS r, count(*) OVER (PARTITION BY pair_id) AS n FROM {0}),
split AS (SELECT *, CASE WHEN n < 6 OR r <= least(greatest(4, round_even(0.7e0 * n, 0)), n - 2) THEN 'control' ELSE 'checkpoint' END AS part FROM ranked)"""


def _split(points, seed: int = 42, fraction: float = 0.7):
    """Each pair's points as control and checkpoint, by a hash of id and seed; small pairs have no checkpoints."""
    w = Window.partitionBy("pair_id")
    key = F.md5(F.concat(F.col("tp_id").cast("string"), F.lit(f":{seed}")))
    ranked = points.withColumn("r", F.row_number().over(w.orderBy(key, "tp_id"))).withColumn("n", F.count("*").over(w))
    control = F.least(F.greatest(F.lit(4.0), F.rint(F.col("n") * fraction)), F.col("n") - 2)
    return ranked.withColumn("part", F.when((F.col("n") < 6) | (F.col("r") <= control), "control").otherwise("checkpoint")).drop("r", "n")


@query("N1 U3", _TP + _SPLIT.format("tie_points") + " SELECT tp_id, pair_id, part FROM split")
def n1_control_split(spark, d):
    return _split(_points(spark, d)).select("tp_id", "pair_id", "part")


@query("G14", _RES + _SPLIT.format("res") + """ SELECT pair_id, count(*) FILTER (WHERE part = 'control') AS control_points, count(*) FILTER (WHERE part = 'checkpoint') AS checkpoints, round(sqrt(avg(res * res) FILTER (WHERE part = 'control')), 6) AS consensus_rmse,
round(sqrt(avg(res * res) FILTER (WHERE part = 'checkpoint')), 6) AS checkpoint_rmse, round(avg(res) FILTER (WHERE part = 'checkpoint'), 6) AS checkpoint_mae, round(quantile_cont(res, 0.5) FILTER (WHERE part = 'checkpoint'), 6) AS checkpoint_median,
round(quantile_cont(res, 0.95) FILTER (WHERE part = 'checkpoint'), 6) AS checkpoint_p95, round(max(res) FILTER (WHERE part = 'checkpoint'), 6) AS checkpoint_max FROM split GROUP BY pair_id""")
def g14_independent_checkpoints(spark, d):
    p = _split(_residuals(spark, d))
    on = lambda part: F.when(F.col("part") == part, F.col("res"))
    c, k = on("control"), on("checkpoint")
    or999 = lambda x: F.coalesce(x, F.lit(999.0))
    return rounded(p.groupBy("pair_id").agg(
        F.count(c).alias("control_points"), F.count(k).alias("checkpoints"), or999(F.sqrt(F.avg(c * c))).alias("consensus_rmse"), or999(F.sqrt(F.avg(k * k))).alias("checkpoint_rmse"), or999(F.avg(k)).alias("checkpoint_mae"),
        or999(F.percentile(k, 0.5)).alias("checkpoint_median"), or999(F.percentile(k, 0.95)).alias("checkpoint_p95"), or999(F.max(k)).alias("checkpoint_max")))


@query("P20", _RES + """, s AS (SELECT pair_id, count(*) AS n, stddev_pop(res) AS sd, abs(corr(ref_x, res)) AS cx, abs(corr(ref_y, res)) AS cy FROM res GROUP BY pair_id) SELECT pair_id, CASE WHEN n < 8 THEN 'INSUFFICIENT_POINTS_FOR_SPATIAL_AUDIT' WHEN sd < 1e-6 THEN 'UNIFORM_RESIDUALS'
WHEN cx > 0.65 OR cy > 0.65 THEN 'MODEL_MISMATCH' ELSE 'GLOBAL_MODEL_ACCEPTED' END AS verdict FROM s""")
def p20_spatial_mismatch(spark, d):
    s = _residuals(spark, d).groupBy("pair_id").agg(F.count("*").alias("n"), F.stddev_pop("res").alias("sd"), F.abs(F.corr("ref_x", "res")).alias("cx"), F.abs(F.corr("ref_y", "res")).alias("cy"))
    return s.select("pair_id", F.when(F.col("n") < 8, "INSUFFICIENT_POINTS_FOR_SPATIAL_AUDIT").when(F.col("sd") < 1e-6, "UNIFORM_RESIDUALS").when((F.col("cx") > 0.65) | (F.col("cy") > 0.65), "MODEL_MISMATCH").otherwise("GLOBAL_MODEL_ACCEPTED").alias("verdict"))


_SV = "sqrt((f + sqrt(greatest(f*f - 4*dd*dd, 0))) / 2)"


@query("P19 M10 M11", duck("transforms") + f""", q AS (SELECT *, h00*(h11*h22-h12*h21)-h01*(h10*h22-h12*h20)+h02*(h10*h21-h11*h20) AS det, (h00*h00+h01*h01+h10*h10+h11*h11) / pow(h22+1e-12, 2) AS f, (h00*h11-h01*h10) / pow(h22+1e-12, 2) AS dd FROM transforms),
s AS (SELECT *, {_SV} AS big, abs(dd) / {_SV} AS small FROM q) SELECT pair_id, round(big, 6) AS large, round(small, 6) AS small, round(CASE WHEN h00*h11-h01*h10 > 0 THEN sqrt(h00*h11-h01*h10) ELSE sqrt(h00*h00+h01*h01+h10*h10+h11*h11) / sqrt(2) END, 6) AS scale,
CASE WHEN det <= 1e-7 THEN 'NON_POSITIVE_DETERMINANT' WHEN small < 0.05 OR big > 20 THEN 'SCALE_OUT_OF_BOUNDS' WHEN big / (small + 1e-12) > 3 THEN 'EXCESSIVE_SHEAR' WHEN abs(h20) > 0.05 OR abs(h21) > 0.05 THEN 'EXCESSIVE_TILT' ELSE 'PLAUSIBLE' END AS verdict FROM s""")
def p19_plausibility(spark, d):
    t = relation(spark, d, "transforms")
    large, small = T.singular_values(*(F.col(c) / (F.col("h22") + 1e-12) for c in ("h00", "h01", "h10", "h11")))
    return rounded(t.select("pair_id", large.alias("large"), small.alias("small"), T.effective_scale(*(F.col(c) for c in ("h00", "h01", "h10", "h11"))).alias("scale"), T.plausibility().alias("verdict")))


def _mul(a: str, b: str) -> dict[tuple, str]:
    return {(i, j): "(" + "+".join(f"{a}h{i}{k}*{b}h{k}{j}" for k in range(3)) + ")" for i in range(3) for j in range(3)}


_AB = ", ".join(f"{p}.h{i}{j} AS {p}h{i}{j}" for p in "ab" for i in range(3) for j in range(3))
_M = _mul("b", "a")


@query("M2 J14 W6", duck("transforms") + f", ab AS (SELECT a.pair_id, {_AB} FROM transforms a JOIN transforms b ON b.pair_id = a.pair_id + 1) SELECT pair_id, " + ", ".join(f"round({_M[i, j]} / {_M[2, 2]}, 6) AS h{i}{j}" for i in range(3) for j in range(3)) + " FROM ab")
def m2_compose(spark, d):
    t = relation(spark, d, "transforms")
    a = t.select("pair_id", *(F.col(c).alias("a" + c) for c in T.H))
    b = t.select((F.col("pair_id") - 1).alias("pair_id"), *(F.col(c).alias("b" + c) for c in T.H))
    return rounded(a.join(b, "pair_id").select("pair_id", *(c.alias(n) for n, c in T.composed("a", "b").items())))


def _minor(i: int, j: int) -> str:
    a, b, c, e = (i + 1) % 3, (j + 1) % 3, (i + 2) % 3, (j + 2) % 3
    return f"(h{a}{b}*h{c}{e}-h{a}{e}*h{c}{b})"


@query("M2", duck("transforms") + ", t AS (SELECT *, h00*(h11*h22-h12*h21)-h01*(h10*h22-h12*h20)+h02*(h10*h21-h11*h20) AS det FROM transforms) SELECT pair_id, " + ", ".join(f"round({_minor(j, i)}/det, 5) AS h{i}{j}" for i in range(3) for j in range(3)) + " FROM t")
def m2_inverse(spark, d):
    return rounded(relation(spark, d, "transforms").select("pair_id", *(c.alias(n) for n, c in T.inverse().items())), 5)


@query("M13 T7", _RES + """, m AS (SELECT pair_id, k, model, count(*) FILTER (WHERE res <= 0.2 * k) AS inliers, sqrt(avg(res * res)) + 0.01 * k AS rmse, count(*) AS n FROM res, (VALUES (2, 'TRANSLATION', 0), (4, 'SIMILARITY', 1), (6, 'AFFINE', 2), (8, 'HOMOGRAPHY', 3)) v(k, model, o) GROUP BY pair_id, k, model)
SELECT pair_id, model, inliers, round(n * ln(rmse * rmse + 1e-6) + k * ln(greatest(n, 1)), 6) AS bic FROM m QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY inliers DESC, n * ln(rmse * rmse + 1e-6) + k * ln(greatest(n, 1)), k) = 1""")
def t7_model_choice(spark, d):
    models = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(m).alias("model")) for k, m in ((2, "TRANSLATION"), (4, "SIMILARITY"), (6, "AFFINE"), (8, "HOMOGRAPHY"))))
    r = _residuals(spark, d).select("pair_id", "res", F.explode(models).alias("v")).select("pair_id", "res", "v.*")
    m = r.groupBy("pair_id", "k", "model").agg(F.count_if(F.col("res") <= 0.2 * F.col("k")).alias("inliers"), F.sqrt(F.avg(F.col("res") * F.col("res"))).alias("rmse"), F.count("*").alias("n"))
    m = m.withColumn("bic", T.bic(F.col("n"), F.col("rmse") + 0.01 * F.col("k"), F.col("k")))
    best = m.groupBy("pair_id").agg(F.max_by(F.struct("model", "inliers", "bic"), F.struct(F.col("inliers"), -F.col("bic"), -F.col("k"))).alias("b"))
    return rounded(best.select("pair_id", "b.*"))
