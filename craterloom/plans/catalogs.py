"""Queries on the catalog: scans, identity, classification, labels, inventory, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from craterloom.functions import geometry as G
from craterloom.operators import catalog as C
from craterloom.operators import gates
from craterloom.plans.inputs import duck, relation
from craterloom.plans.registry import query, rounded

_P = duck("products")
_NAME = "split_part(image_path, '/', -1)"
_SUFFIX = f"lower(regexp_extract({_NAME}, '[^.]\\.([^.]+)$', 1))"
_STEM = f"CASE WHEN regexp_matches({_NAME}, '[^.]\\.[^.]+$') THEN regexp_replace({_NAME}, '\\.[^.]+$', '') ELSE {_NAME} END"


def _products(spark, d):
    return relation(spark, d, "products").withColumn("path", F.col("image_path"))


@query("S1 S2", _P + f"SELECT k, image_path FROM products WHERE {_SUFFIX} IN ('tif', 'tiff', 'img', 'qub')")
def s1_scan(spark, d):
    return C.scan(_products(spark, d)).select("k", "image_path")


@query("S2", _P + f"SELECT k, image_path FROM products WHERE {_SUFFIX} IN ('img', 'tif', 'tiff', 'dat')")
def s2_candidate_images(spark, d):
    return C.scan(_products(spark, d), ("img", "tif", "tiff", "dat")).select("k", "image_path")


@query("S3", _P + f""", f AS (SELECT image_path AS path FROM products UNION ALL SELECT replace(image_path, ext, '.xml') FROM products WHERE k % 3 = 0 AND ext <> '.xml' UNION ALL SELECT replace(image_path, ext, '.tif') FROM products WHERE k % 4 = 0 AND ext <> '.tif')
SELECT path FROM (SELECT path, {_SUFFIX.replace('image_path', 'path')} AS s, row_number() OVER (PARTITION BY lower({_STEM.replace('image_path', 'path')}) ORDER BY path) AS n FROM f
 WHERE {_SUFFIX.replace('image_path', 'path')} IN ('xml', 'lbl', 'img', 'tif', 'tiff', 'qub')) WHERE n = 1 OR s IN ('xml', 'lbl')""")
def s3_scan_unique_stems(spark, d):
    p = relation(spark, d, "products")
    more = lambda n, e: p.where((F.col("k") % n == 0) & (F.col("ext") != e)).select(F.expr(f"replace(image_path, ext, '{e}')").alias("path"))
    files = p.select(F.col("image_path").alias("path")).unionByName(more(3, ".xml")).unionByName(more(4, ".tif"))
    return C.scan_unique_stems(files).select("path")


def _case(column: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}') THEN {v!r}" if v else f"WHEN regexp_matches({column}, '{p}') THEN NULL" for p, v in rules) + " END"


def _inside(k: str) -> str:
    return f"regexp_matches({{0}}, '(^|[^A-Z0-9]){k}([^A-Z0-9]|$)')" if len(k) <= 3 else f"contains({{0}}, '{k}')"


def _mission_sql(v: str) -> str:
    return "CASE " + " ".join(f"WHEN {v} = '{k}' THEN '{m}'" for k, m in C.MISSIONS) + " " + " ".join(f"WHEN {_inside(k).format(v)} THEN '{m}'" for k, m in C.MISSIONS) + " END"


def _instrument_sql(v: str, mission: str) -> str:
    own = _case(v, [(p, i) for p, _, i in C.IDENTIFIERS])
    return (f"CASE WHEN {v} = 'TC' THEN CASE WHEN {mission} = 'SELENE' THEN 'TC' END " + " ".join(f"WHEN {v} = '{k}' THEN '{i}'" for k, i in C.INSTRUMENTS) + " "
            + " ".join(f"WHEN contains({v}, '{k}') THEN '{i}'" for k, i in C.INSTRUMENTS if len(k) > 4) + f" WHEN {v} IS NOT NULL THEN {own} END")


_FOLD = "trim(regexp_replace(upper({0}), '\\s+', ' ', 'g'))"
_IDENT = _P + f""", t AS (SELECT k, {_FOLD.format('mission')} AS mv, {_FOLD.format('instrument')} AS iv, upper(product_id) AS pv, {_FOLD.format('product_id')} AS pf, upper({_STEM}) AS fv FROM products),
u AS (SELECT *, {_mission_sql('mv')} AS m, {_case('pv', [(p, m) for p, m, _ in C.IDENTIFIERS])} AS im, {_case('pv', [(p, i) for p, _, i in C.IDENTIFIERS])} AS ii, {_mission_sql('pf')} AS pm,
 {_case('fv', [(p, m) for p, m, _ in C.IDENTIFIERS])} AS fm, {_case('fv', [(p, i) for p, _, i in C.IDENTIFIERS])} AS fi FROM t),
v AS (SELECT *, {_instrument_sql('iv', 'm')} AS i, coalesce(ii, {_instrument_sql('iv', 'im')}) AS ii2, coalesce(fi, {_instrument_sql('iv', 'fm')}) AS fi2 FROM u)
"""


@query("P7 P8 P9 M26", _IDENT + """SELECT k, CASE WHEN m IS NOT NULL OR i IS NOT NULL THEN coalesce(m, im) WHEN im IS NOT NULL THEN im WHEN pm IS NOT NULL THEN pm ELSE fm END AS found_mission,
CASE WHEN m IS NOT NULL OR i IS NOT NULL THEN coalesce(i, ii, CASE WHEN coalesce(m, im) = 'LRO' THEN 'NAC' END) WHEN im IS NOT NULL THEN ii2 WHEN pm IS NOT NULL THEN NULL WHEN fm IS NOT NULL THEN fi2 END AS found_instrument,
CASE WHEN m IS NOT NULL OR i IS NOT NULL THEN 'pds4_metadata' WHEN im IS NOT NULL THEN CASE WHEN ii2 IS NOT NULL THEN 'mission_specific_identifier' ELSE 'product_identifier' END WHEN pm IS NOT NULL THEN 'product_identifier'
 WHEN fm IS NOT NULL THEN 'filename_heuristic' ELSE 'unknown' END AS method FROM v""")
def p7_identify(spark, d):
    return C.identified(relation(spark, d, "products"), "mission", "instrument", "product_id", "image_path").select("k", "found_mission", "found_instrument", "method")


_CANON = "coalesce(CASE regexp_replace(lower(trim({0})), '[-_]', '', 'g') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.CANONICAL.items()) + " END, trim({0}))"


@query("P5 P6", _P + f""", t AS (SELECT k, status, mission, instrument, {_case('upper(product_id)', [(p, m) for p, m, _ in C.IDENTIFIERS])} AS im, {_case('upper(product_id)', [(p, i) for p, _, i in C.IDENTIFIERS])} AS ii FROM products),
u AS (SELECT *, status = 'validated' AND (mission IS NOT NULL OR im IS NULL OR {_CANON.format('im')} = 'LRO') AS may FROM t), w AS (SELECT k, CASE WHEN may THEN coalesce(mission, im) ELSE mission END AS mission, CASE WHEN may THEN coalesce(instrument, ii) ELSE instrument END AS instrument FROM u)
SELECT * FROM w WHERE {_CANON.format('mission')} = 'LRO' AND coalesce(CASE upper(trim(instrument)) WHEN 'OHR' THEN 'OHRC' WHEN 'TMC' THEN 'TMC-2' WHEN 'TMC2' THEN 'TMC-2' WHEN 'LROC_NAC' THEN 'NAC' WHEN 'LROCNAC' THEN 'NAC' END, upper(trim(instrument))) IN ('NAC', 'LROC')""")
def p5_mission_adapter(spark, d):
    return C.of_mission(relation(spark, d, "products"), "LRO").select("k", "mission", "instrument")


_SYN = "(" + " OR ".join([f"contains(lower(product_id), '{w}')" for w in C.SYNTHETIC] + [f"list_contains(string_split(lower(image_path), '/'), '{w}')" for w in C.SYNTHETIC] + [f"starts_with(lower({_STEM}), 'synth')"]) + ")"
_KNOWN = "(" + " OR ".join(f"contains(upper(coalesce(mission, '')), '{m}')" for m in C.REAL) + ")"
_CLASS = f"""CASE WHEN status IN ('invalid', 'unsupported') OR contains(lower(coalesce(validation_message, '')), 'fail') OR contains(lower(coalesce(validation_message, '')), 'error') OR coalesce(width <= 0 OR height <= 0, false) AND width IS NOT NULL AND height IS NOT NULL THEN 'INVALID'
WHEN {_SYN} THEN 'SYNTHETIC_FIXTURE' WHEN k % 16 = 7 OR NOT {_KNOWN} THEN 'UNVERIFIED' WHEN coalesce(status = 'validated' AND gsd_m > 0 AND width > 0 AND height > 0, false) THEN 'AUTHORIZED_REAL' ELSE 'UNVERIFIED' END"""
FIELDS = ("mission", "instrument", "product_id", "width", "height", "band_count", "gsd_m", "acquisition_time")


def _classified(spark, d):
    return relation(spark, d, "products").withColumn("classification", C.classification(F.col("k") % 16 != 7))


@query("P2 P3 U4", _P + f"SELECT k, {_CLASS} AS classification, concat(" + " + ".join(f"CAST(coalesce(CAST({f} AS VARCHAR) <> '', false) AS INT)" for f in FIELDS) + ", '/8') AS metadata_completeness FROM products")
def p2_classify(spark, d):
    return _classified(spark, d).select("k", "classification", C.completeness(FIELDS).alias("metadata_completeness"))


@query("G1 K15", _P + f"SELECT {_CLASS} AS classification, count(*) AS n FROM products GROUP BY 1")
def g1_inventory(spark, d):
    return _classified(spark, d).groupBy("classification").agg(F.count("*").alias("n"))


@query("G2", _P + """SELECT mission, status, count(*) AS n, string_agg(CASE WHEN status = 'discovered' THEN product_id END, ',' ORDER BY product_id) AS pending FROM products GROUP BY GROUPING SETS ((mission), (status))""")
def g2_status_summary(spark, d):
    p = relation(spark, d, "products").select("mission", "status", F.when(F.col("status") == "discovered", F.col("product_id")).alias("pid"))
    # the report lists the pending ids of each group
    pending = F.array_join(F.array_sort(F.collect_list("pid")), ",")
    df = p.groupingSets([["mission"], ["status"]], "mission", "status").agg(F.count("*").alias("n"), pending.alias("pending"))
    return df.withColumn("pending", F.nullif("pending", F.lit("")))


@query("P10 P11", _P + "SELECT k, product_id, gsd_m FROM products WHERE instrument = 'OHRC' AND status IN ('validated', 'partial') ORDER BY gsd_m IS NOT NULL, coalesce(gsd_m, 0), product_id LIMIT 1")
def p11_primary_product(spark, d):
    p = relation(spark, d, "products").where("instrument = 'OHRC' and status in ('validated', 'partial')")
    return p.orderBy(F.col("gsd_m").isNotNull(), F.coalesce("gsd_m", F.lit(0.0)), "product_id").limit(1).select("k", "product_id", "gsd_m")


@query("P12", _P + """SELECT k, array_to_string(list_filter([CASE WHEN mission IS NULL THEN 'mission' END, CASE WHEN gsd_m IS NULL THEN 'gsd_m' END, CASE WHEN width IS NULL THEN 'width' END, CASE WHEN acquisition_time IS NULL THEN 'acquisition_time' END], lambda x: x IS NOT NULL), ',') AS missing,
status IN ('validated', 'partial', 'discovered') AS status_known FROM products""")
def p12_validate_entry(spark, d):
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), c) for c in ("mission", "gsd_m", "width", "acquisition_time"))))
    return relation(spark, d, "products").select("k", F.array_join(missing, ",").alias("missing"), F.col("status").isin("validated", "partial", "discovered").alias("status_known"))


@query("T5 J13", _P + """, u AS (SELECT * FROM products WHERE status IN ('validated', 'partial', 'parsed')) SELECT instrument, product_id, acquisition_time FROM u
QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY coalesce(epoch_us(TRY_CAST(acquisition_time AS TIMESTAMPTZ)), -4611686018427387904) DESC, product_id DESC) = 1""")
def t5_latest_product(spark, d):
    return C.latest_product(relation(spark, d, "products"), "instrument").select("instrument", "product_id", "acquisition_time")


_LABELS = """, im AS (SELECT k, image_path AS path FROM products), lb AS (
 SELECT replace(image_path, ext, '.xml') AS path, CASE WHEN k % 20 = 5 THEN NULL WHEN k % 20 = 10 THEN ['other.img'] WHEN k % 20 = 15 THEN [concat('X/', product_id, upper(ext))] ELSE CAST([] AS VARCHAR[]) END AS refs FROM products WHERE k % 5 = 0
 UNION ALL SELECT replace(image_path, ext, '.LBL'), CAST([] AS VARCHAR[]) FROM products WHERE k % 25 = 0
 UNION ALL SELECT concat(replace(image_path, ext, ''), '_about.xml'), [concat(product_id, ext)] FROM products WHERE k % 6 = 1
 UNION ALL SELECT concat(replace(image_path, ext, ''), '_more.xml'), [concat(product_id, '.raw')] FROM products WHERE k % 12 = 1
 UNION ALL SELECT concat(replace(image_path, ext, ''), '_label.xml'), CAST([] AS VARCHAR[]) FROM products WHERE k % 7 = 2),
i2 AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS dir, lower(split_part(path, '/', -1)) AS name, lower(regexp_replace(split_part(path, '/', -1), '\\.[^.]+$', '')) AS stem FROM im),
l2 AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS dir, lower(split_part(path, '/', -1)) AS name, lower(regexp_replace(split_part(path, '/', -1), '\\.[^.]+$', '')) AS stem, list_transform(refs, lambda r: lower(split_part(r, '/', -1))) AS refs FROM lb),
j AS (SELECT i.path, l.path AS label, l.refs IS NULL AS bad, l.stem = i.stem AS same, coalesce(list_contains(l.refs, i.name) OR len(list_filter(l.refs, lambda r: regexp_replace(r, '\\.[^.]+$', '') = i.stem)) > 0, false) AS refers, coalesce(len(l.refs) > 0, false) AS told,
 l.name IN (i.stem || '_label.xml', i.stem || '.lbl.xml', i.stem || '.lbl') AS usual FROM i2 i JOIN l2 l ON i.dir = l.dir),
g AS (SELECT i.path, count(*) FILTER (WHERE same) AS s, min(label) FILTER (WHERE same) AS sp, bool_or(bad) FILTER (WHERE same) AS sb, bool_or(told AND NOT refers) FILTER (WHERE same) AS so, count(*) FILTER (WHERE refers) AS e, min(label) FILTER (WHERE refers) AS ep, count(*) FILTER (WHERE usual) AS c,
 min(label) FILTER (WHERE usual) AS cp FROM i2 i LEFT JOIN j ON i.path = j.path GROUP BY i.path),
r AS (SELECT *, CASE WHEN s > 1 THEN 'ambiguous' WHEN s = 1 THEN CASE WHEN sb THEN 'missing' WHEN so THEN 'ambiguous' ELSE 'resolved' END WHEN e > 1 THEN 'ambiguous' WHEN e = 1 THEN 'resolved' WHEN c > 1 THEN 'ambiguous' WHEN c = 1 THEN 'resolved' ELSE 'missing' END AS status FROM g)
SELECT path, status, CASE WHEN status = 'resolved' THEN CASE WHEN s = 1 THEN 'same_stem' WHEN e = 1 THEN 'explicit_file_reference' ELSE 'mission_convention' END END AS method, CASE WHEN status = 'resolved' THEN CASE WHEN s = 1 THEN sp WHEN e = 1 THEN ep ELSE cp END END AS label_path FROM r"""


@query("J1 J15", duck("products") + _LABELS.replace("FROM products)", "FROM products WHERE ext <> '.xml')", 1).replace("FROM products WHERE k", "FROM products WHERE ext <> '.xml' AND k"))
def j1_resolve_labels(spark, d):
    p = relation(spark, d, "products").where("ext <> '.xml'")
    none = F.array().cast("array<string>")
    base = F.expr("replace(image_path, ext, '')")
    k, pid = F.col("k"), F.col("product_id")
    own = F.when(k % 20 == 5, F.lit(None).cast("array<string>")).when(k % 20 == 10, F.array(F.lit("other.img"))).when(k % 20 == 15, F.array(F.concat(F.lit("X/"), pid, F.upper("ext")))).otherwise(none)
    at = lambda cond, tail, refs: p.where(cond).select(F.concat(base, F.lit(tail)).alias("path"), refs.alias("refs"))
    labels = at(k % 5 == 0, ".xml", own).unionByName(at(k % 25 == 0, ".LBL", none)).unionByName(at(k % 6 == 1, "_about.xml", F.array(F.concat(pid, "ext"))))
    labels = labels.unionByName(at(k % 12 == 1, "_more.xml", F.array(F.concat(pid, F.lit(".raw"))))).unionByName(at(k % 7 == 2, "_label.xml", none))
    return C.resolve_labels(p.select(F.col("image_path").alias("path")), labels)


@query("P16 P17", _P + """, t AS (SELECT k, instrument, CASE WHEN k % 3 = 0 THEN 'NAC' ELSE 'OHRC' END AS ref, gsd_m / 0.5 AS ratio, sun_el AS delta, k % 2 = 0 AS w FROM products) SELECT k,
CASE WHEN upper(instrument) IN ('IIRS', 'HYSI') THEN 'classical_rift' WHEN delta > 45 THEN CASE WHEN w THEN 'dense_loftr' ELSE 'classical_rift' END WHEN ratio > 4 THEN 'hybrid_cascade' WHEN w THEN 'dense_loftr' ELSE 'classical_rift' END AS strategy,
CASE WHEN upper(instrument) IN ('IIRS', 'HYSI') THEN 'spectral' WHEN delta > 45 THEN printf('illumination %.1f', delta) WHEN ratio > 4 THEN printf('ratio %.1fx', ratio) WHEN w THEN 'default' ELSE 'no weights' END AS reason,
CASE WHEN instrument = 'IIRS' OR ref = 'IIRS' THEN 'SPECTRAL_TO_2D' WHEN instrument = ref THEN 'SAME_MODALITY' WHEN ratio > 3 THEN 'MULTIRESOLUTION' ELSE 'CROSS_MODALITY' END AS modality FROM t""")
def p16_strategy(spark, d):
    c = F.col
    t = relation(spark, d, "products").select("k", "instrument", F.when(c("k") % 3 == 0, "NAC").otherwise("OHRC").alias("ref"), (c("gsd_m") / 0.5).alias("ratio"), c("sun_el").alias("delta"), (c("k") % 2 == 0).alias("w"))
    spectral = F.coalesce(F.upper("instrument").isin(*gates.SPECTRAL), F.lit(False))
    return t.select("k", gates.strategy(c("instrument"), c("ref"), c("ratio"), c("delta"), c("w")).alias("strategy"), gates.strategy_reason(c("delta"), c("ratio"), c("w"), spectral).alias("reason"), gates.modality(c("instrument"), c("ref"), c("ratio")).alias("modality"))


_CLAIM = """SELECT k, CASE k % 7 WHEN 0 THEN 'PARTIAL' WHEN 1 THEN 'NO_CORRESPONDENCE' WHEN 2 THEN 'WARP_FAILURE' WHEN 3 THEN NULL ELSE 'SUCCESS' END AS status, CASE k % 5 WHEN 0 THEN 'CHECKPOINT_VALIDATION_FAILED' WHEN 1 THEN NULL ELSE 'READY' END AS held,
CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(k % 30 AS DOUBLE) / 20 END AS rmse, CASE WHEN k % 6 = 0 THEN NULL WHEN k % 6 = 1 THEN 0E0 ELSE CAST(k % 25 AS DOUBLE) / 20 END AS sub, CASE WHEN k % 9 = 0 THEN NULL ELSE CAST(k % 10 AS DOUBLE) / 10 END AS coverage, k % 4 <> 0 AS reopened,
CASE WHEN k % 8 = 0 THEN NULL ELSE 1 + CAST(k % 4 AS DOUBLE) END AS ratio, k % 3 <> 0 AS lit, CASE k % 4 WHEN 0 THEN 'SAME_MODALITY' WHEN 1 THEN 'CROSS_MODALITY' WHEN 2 THEN 'MULTIRESOLUTION' ELSE 'SPECTRAL_TO_2D' END AS kind FROM products"""
_OK, _READY, _BROKEN = "coalesce(status = 'SUCCESS', false)", "coalesce(held = 'READY' AND rmse IS NOT NULL, false)", "status IN ('IMPLAUSIBLE_TRANSFORM', 'NO_CORRESPONDENCE')"


@query("P21", _P + f", t AS ({_CLAIM}), u AS (SELECT *, coalesce(nullif(sub, 0), rmse) AS best FROM t)" + f""" SELECT k, CASE WHEN {_OK} AND reopened THEN 'PROVEN' WHEN status IN ('IMPLAUSIBLE_TRANSFORM', 'NO_CORRESPONDENCE', 'DEGENERATE_TRANSFORM', 'WARP_FAILURE', 'OUTPUT_VERIFICATION_FAILED') THEN 'FAILED'
 WHEN status = 'PARTIAL' THEN 'PARTIAL' ELSE 'DATA_REQUIRED' END AS real_registration, CASE WHEN {_READY} THEN 'PROVEN' WHEN held = 'CHECKPOINT_VALIDATION_FAILED' THEN 'FAILED' ELSE 'DATA_REQUIRED' END AS independent_validation,
 CASE WHEN {_READY} AND best < 0.5 THEN 'PROVEN' WHEN {_READY} AND best < 1 THEN 'SUPPORTED' WHEN {_READY} THEN 'FAILED' ELSE 'DATA_REQUIRED' END AS subpixel_accuracy,
 CASE WHEN coverage >= 0.5 AND {_OK} AND {_READY} THEN 'PROVEN' WHEN coverage >= 0.5 AND {_OK} THEN 'SUPPORTED' WHEN coverage >= 0.2 AND {_OK} THEN 'PARTIAL' WHEN {_OK} THEN 'FAILED' ELSE 'DATA_REQUIRED' END AS uniform_distribution,
 CASE WHEN {_OK} AND ratio >= 2 AND {_READY} THEN 'PROVEN' WHEN {_OK} AND ratio IS NOT NULL THEN 'SUPPORTED' WHEN {_BROKEN} THEN 'FAILED' ELSE 'DATA_REQUIRED' END AS scale_robustness,
 CASE WHEN {_OK} AND lit AND {_READY} THEN 'PROVEN' WHEN {_OK} AND lit THEN 'SUPPORTED' WHEN {_BROKEN} THEN 'FAILED' ELSE 'DATA_REQUIRED' END AS illumination_robustness,
 CASE WHEN {_OK} AND kind <> 'SAME_MODALITY' AND {_READY} THEN 'PROVEN' WHEN {_OK} AND kind <> 'SAME_MODALITY' THEN 'SUPPORTED' WHEN {_BROKEN} THEN 'FAILED' ELSE 'DATA_REQUIRED' END AS cross_modal FROM u""")
def p21_claims(spark, d):
    t = spark.sql(_CLAIM.replace("FROM products", "FROM {products}"), products=relation(spark, d, "products"))
    c = F.col
    out = gates.claims(c("status"), c("held"), c("rmse"), c("sub"), c("coverage"), c("reopened"), c("ratio"), c("lit"), c("kind"))
    return t.select("k", *(v.alias(n) for n, v in out.items()))


_PROVEN = "CASE WHEN coalesce({}, false) THEN 'PROVEN' ELSE 'DATA_REQUIRED' END AS {}_supported"


@query("P21", _P + f", t AS ({_CLAIM}) SELECT k, " + ", ".join(_PROVEN.format(c, n) for c, n in (
    (f"{_OK} AND reopened", "real_registration"), (_READY, "independent_accuracy"), (f"{_READY} AND k % 12 > 0", "subpixel_accuracy"), ("coverage >= 0.5", "uniform_distribution"),
    (f"ratio IS NOT NULL AND {_OK}", "scale_robustness"), (f"lit AND {_OK}", "illumination_robustness"))) + """, coalesce(nullif(held, ''), 'DATA_REQUIRED') AS validation_scope, CASE WHEN rmse IS NOT NULL THEN 'AVAILABLE' ELSE 'NOT_AVAILABLE' END AS inlier_ratio_available FROM t""")
def p21_compatibility_claims(spark, d):
    t = spark.sql(_CLAIM.replace("FROM products", "FROM {products}"), products=relation(spark, d, "products"))
    c = F.col
    out = gates.compatibility_claims(c("status"), c("reopened"), c("held"), c("rmse"), c("k") % 12, c("coverage"), c("ratio"), c("lit"), c("held"), c("rmse"))
    return t.select("k", *(v.alias(n) for n, v in out.items()))


@query("P22", """WITH m AS (SELECT * FROM (VALUES (1, 'SAME_SENSOR', 'SUPPORTED'), (2, 'CROSS_SENSOR', 'DATA_REQUIRED'), (3, 'SPECTRAL', 'PARTIAL'), (4, 'MULTISCALE', 'DATA_REQUIRED'), (5, 'CROSS_MISSION', 'DATA_REQUIRED')) v(i, pair, status)), c AS (SELECT count(*) FILTER (WHERE toxic = 1) > 0 AS cross_ready FROM labels)
SELECT i, pair, CASE WHEN cross_ready AND i IN (2, 5) THEN 'AVAILABLE' ELSE status END AS status FROM m, c""")
def p22_validation_matrix(spark, d):
    rows = spark.createDataFrame([(1, "SAME_SENSOR", "SUPPORTED"), (2, "CROSS_SENSOR", "DATA_REQUIRED"), (3, "SPECTRAL", "PARTIAL"), (4, "MULTISCALE", "DATA_REQUIRED"), (5, "CROSS_MISSION", "DATA_REQUIRED")], "i int, pair string, status string")
    flag = spark.read.parquet(f"{d}/labels.parquet").agg((F.count_if(F.col("toxic") == 1) > 0).alias("cross_ready"))
    return rows.join(F.broadcast(flag)).select("i", "pair", F.when(F.col("cross_ready") & F.col("i").isin(2, 5), "AVAILABLE").otherwise(F.col("status")).alias("status"))


@query("P23 P24 J11", duck("products", "transforms") + """, s AS (SELECT p.k, p.status = 'validated' AS has_pair, p.gsd_m IS NOT NULL AS has_cp, p.k % 9 AS n, t.pair_id IS NOT NULL AS has_t, CAST(p.k % 80 AS DOUBLE) / 100 AS rmse, t.h11 FROM products p LEFT JOIN transforms t ON p.k = t.pair_id)
SELECT k, CASE WHEN NOT has_pair THEN 'NOT_VALIDATED' WHEN NOT has_cp THEN 'PENDING_CHECKPOINTS' WHEN NOT has_t THEN 'PENDING_REGISTRATION' WHEN n < 4 THEN 'INSUFFICIENT_CHECKPOINTS' WHEN rmse < 0.4 THEN 'PASS' ELSE 'FAIL' END AS validation,
CASE WHEN NOT has_pair THEN 'DATA_REQUIRED' WHEN k % 14 = 3 THEN 'IIRS_REPRESENTATION_UNCERTAIN' WHEN n < 4 THEN 'NO_CORRESPONDENCE' WHEN NOT coalesce(h11 > 0.5, true) THEN 'IMPLAUSIBLE_TRANSFORM' WHEN rmse >= 0.7 THEN 'MODEL_MISMATCH' WHEN k % 10 = 6 THEN 'WARP_FAILURE' WHEN k % 10 = 7 THEN 'OUTPUT_VERIFICATION_FAILED' ELSE 'SUCCESS' END AS registration FROM s""")
def p23_status_ladders(spark, d):
    c, t = F.col, relation(spark, d, "transforms").select("pair_id", "h11")
    s = relation(spark, d, "products").join(t, F.col("k") == F.col("pair_id"), "left")
    n, rmse, good = c("k") % 9, (c("k") % 80).cast("double") / 100, c("status") == "validated"
    return s.select("k", gates.validation_status(good, c("gsd_m").isNotNull(), n, c("pair_id").isNotNull(), rmse).alias("validation"),
                    gates.registration_status(good, c("k") % 14 == 3, n, F.coalesce(c("h11") > 0.5, F.lit(True)), rmse < 0.7, c("k") % 10 != 6, c("k") % 10 != 7).alias("registration"))


@query("M22 S13", _P + """, t AS (SELECT k, gsd_m, CASE k % 6 WHEN 0 THEN 'km' WHEN 1 THEN 'cm/pixel' WHEN 2 THEN 'meters/pixel' WHEN 3 THEN 'mm' WHEN 4 THEN 'deg' ELSE NULL END AS unit, instrument FROM products)
SELECT k, round(coalesce(gsd_m * CASE unit WHEN 'km' THEN 1000 WHEN 'cm/pixel' THEN 0.01 WHEN 'meters/pixel' THEN 1 WHEN 'mm' THEN 0.001 WHEN 'deg' THEN NULL ELSE 1 END, CASE upper(instrument) WHEN 'OHRC' THEN 0.25 WHEN 'NAC' THEN 0.5 WHEN 'IIRS' THEN 80 WHEN 'TC' THEN 10 END), 9) AS metres FROM t""")
def m22_resolution_metres(spark, d):
    from craterloom.functions.labels import metres

    unit = F.when(F.col("k") % 6 == 0, "km").when(F.col("k") % 6 == 1, "cm/pixel").when(F.col("k") % 6 == 2, "meters/pixel").when(F.col("k") % 6 == 3, "mm").when(F.col("k") % 6 == 4, "deg")
    return rounded(relation(spark, d, "products").select("k", metres(F.col("gsd_m"), unit, F.col("instrument")).alias("metres")), 9)


@query("S5", _P + """SELECT k, NOT (contains(p, chr(0)) OR list_contains(string_split(p, '/'), '..') OR NOT starts_with(p, '/data/')) AS allowed FROM (SELECT k, replace(CASE WHEN starts_with(raw, 'file://') THEN substr(raw, 8) ELSE raw END, '%2E', '.') AS p FROM
(SELECT k, CASE k % 4 WHEN 0 THEN concat('file://', image_path) WHEN 1 THEN replace(image_path, '/data/', '/data/%2E%2E/') WHEN 2 THEN replace(image_path, '/data/', '/tmp/') ELSE image_path END AS raw FROM products))""")
def s5_sanitize_path(spark, d):
    from craterloom.functions.labels import allowed_path

    k, path = F.col("k"), F.col("image_path")
    raw = F.when(k % 4 == 0, F.concat(F.lit("file://"), path)).when(k % 4 == 1, F.replace(path, F.lit("/data/"), F.lit("/data/%2E%2E/"))).when(k % 4 == 2, F.replace(path, F.lit("/data/"), F.lit("/tmp/"))).otherwise(path)
    return relation(spark, d, "products").select("k", allowed_path(raw, "/data/").alias("allowed"))


@query("S12 S11 S13 M26", _P + "SELECT k, product_id, mission, gsd_m, width AS samples, lower(ext) AS suffix FROM products")
def s12_pds4_labels(spark, d):
    from craterloom.functions import labels as L

    p = relation(spark, d, "products")
    tag = lambda n, c: F.concat(F.lit(f"<pds:{n}>"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(f"</pds:{n}>"))
    xml = F.concat(F.lit('<pds:Product xmlns:pds="http://example.org/pds"><pds:File>'), tag("product_id", "product_id"), F.lit("</pds:File><pds:Mission_Area>"), tag("mission_name", "mission"), F.lit("</pds:Mission_Area>"), tag("pixel_resolution", "gsd_m"), tag("elements", "width"), F.lit("</pds:Product>"))
    read = p.select("k", "ext", xml.alias("xml"))
    return read.select("k", L.first_value("xml", "product_id").alias("product_id"), L.raw_value("xml", "mission_name").alias("mission"), L.number("xml", "pixel_resolution").alias("gsd_m"), L.number("xml", "elements").cast("int").alias("samples"), F.lower("ext").alias("suffix"))


@query("S12", _P + "SELECT k, product_id, CASE WHEN mission IS NULL THEN NULL ELSE trim(mission) END AS mission, gsd_m FROM products")
def s12_pds3_labels(spark, d):
    from craterloom.functions import labels as L

    p = relation(spark, d, "products")
    line = lambda key, c, tail="": F.concat(F.lit(f"{key} = "), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(tail + "\n"))
    text = F.concat(F.lit("PDS_VERSION_ID = PDS3 /* comment */\n"), line("PRODUCT_ID", "product_id"), line("INSTRUMENT_HOST_NAME", "mission"), line("MAP_SCALE", "gsd_m", " <m/pixel>"), F.lit("END\n"))
    kv = p.select("k", L.pds3_map(text).alias("kv"))
    value = lambda key: F.nullif(F.trim(F.col("kv")[key]), F.lit(""))
    return kv.select("k", value("PRODUCT_ID").alias("product_id"), value("INSTRUMENT_HOST_NAME").alias("mission"), value("MAP_SCALE").cast("double").alias("gsd_m"))
