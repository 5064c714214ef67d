"""Catalog rules: identity, classification, filters and inventory of products (columns and joins only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Mission and instrument names as the catalog's users write them.
MISSIONS = (
    ("CHANDRAYAAN-1", "Chandrayaan-1"), ("CHANDRAYAAN 1", "Chandrayaan-1"), ("CHANDRAYAAN1", "Chandrayaan-1"), ("CH1", "Chandrayaan-1"),
    ("CHANDRAYAAN-2", "Chandrayaan-2"), ("CHANDRAYAAN 2", "Chandrayaan-2"), ("CHANDRAYAAN2", "Chandrayaan-2"), ("CH2", "Chandrayaan-2"),
    ("LRO", "LRO"), ("LROC", "LRO"), ("LUNAR RECONNAISSANCE ORBITER", "LRO"), ("SELENE", "SELENE"), ("KAGUYA", "SELENE"),
)
INSTRUMENTS = (
    ("OHRC", "OHRC"), ("OHR", "OHRC"), ("TMC-2", "TMC-2"), ("TMC2", "TMC-2"), ("TMC_2", "TMC-2"), ("TMC", "TMC-2"), ("IIRS", "IIRS"), ("HYSI", "HYSI"), ("NAC", "NAC"), ("LROC", "LROC"),
    ("LROC-NAC", "NAC"), ("LROC_NAC", "NAC"), ("TERRAIN CAMERA", "TC"), ("TERRAIN MAPPING CAMERA", "TMC-2"), ("TERRAIN MAPPING CAMERA-2", "TMC-2"), ("HIGH RESOLUTION CAMERA", "OHRC"),
    ("ORBITE HIGH RESOLUTION CAMERA", "OHRC"), ("ORBITER HIGH RESOLUTION CAMERA", "OHRC"), ("NARROW ANGLE CAMERA", "NAC"), ("IMAGING INFRARED SPECTROMETER", "IIRS"), ("HYPER SPECTRAL IMAGER", "HYSI"),
)
# Product identifiers, in the order in which they are tried.
IDENTIFIERS = (
    (r"(^|[^A-Z0-9])CH1[_-]?HYS", "Chandrayaan-1", "HYSI"),
    (r"(^|[^A-Z0-9])CH1([^A-Z0-9]|$)", "Chandrayaan-1", None),
    (r"(^|[^A-Z0-9])CH2[_-]?OHR", "Chandrayaan-2", "OHRC"),
    (r"(^|[^A-Z0-9])CH2[_-]?(TMC2|TMC)", "Chandrayaan-2", "TMC-2"),
    (r"(^|[^A-Z0-9])CH2[_-]?IIR", "Chandrayaan-2", "IIRS"),
    (r"(^|[^A-Z0-9])CH2([^A-Z0-9]|$)", "Chandrayaan-2", None),
    (r"(^|[^A-Z0-9])(LROC[_-]?NAC|LRO[_-]?NAC|NAC)([^A-Z0-9]|$)", "LRO", "NAC"),
    (r"(^|[^A-Z0-9])LROC([^A-Z0-9]|$)", "LRO", "LROC"),
    (r"(^|[^A-Z0-9])LRO([^A-Z0-9]|$)", "LRO", None),
    (r"(^|[^A-Z0-9])(TCO|TC1|TC2)([^A-Z0-9]|$)", "SELENE", "TC"),
    (r"(^|[^A-Z0-9])(SELENE|KAGUYA)([^A-Z0-9]|$)", "SELENE", None),
)
# Words that mark a product as made up.
SYNTHETIC = ("synthetic", "fixture", "fixtures", "sample_data", "mock", "dummy")
# Mission names that a real product may have.
REAL = ("CHANDRAYAAN-2", "CHANDRAYAAN-1", "CH2", "CH1", "LRO", "LROC", "SELENE", "KAGUYA")
# Short names of the mission adapters.
CANONICAL = {"chandrayaan2": "Chandrayaan-2", "ch2": "Chandrayaan-2", "chandrayaan": "Chandrayaan-2", "lro": "LRO", "selene": "SELENE", "kaguya": "SELENE"}
ADAPTER_ALIASES = {"OHR": "OHRC", "TMC": "TMC-2", "TMC2": "TMC-2", "LROC_NAC": "NAC", "LROCNAC": "NAC"}
ADAPTERS = {"Chandrayaan-2": ("OHRC", "TMC-2", "IIRS"), "LRO": ("NAC", "LROC"), "SELENE": ("TC",)}

SCAN_SUFFIXES = ("tif", "tiff", "img", "qub")
LABEL_SUFFIXES = ("xml", "lbl")


def mapped(value: Column, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), value)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"[^.]\.([^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=[^.])\.[^.]+$", "")


def folded(value: Column) -> Column:
    """Upper case, white space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.upper(value), r"\s+", " "))


def _table(rows, *names: str) -> Column:
    """A rule table as an array of structs, small enough to stand in the plan."""
    return F.array(*(F.struct(*(F.lit(x).cast("string").alias(n) for n, x in zip(names, r))) for r in rows))


def _hit(table: Column, test) -> Column:
    """The first rule that holds; null where none does."""
    return F.get(F.filter(table, test), F.lit(0))


def _word(key: str) -> str:
    """Short names match as whole words only."""
    return rf"(^|[^A-Z0-9]){key}([^A-Z0-9]|$)" if len(key) <= 3 else key


def mission_from_value(value: Column) -> Column:
    """A structured mission field: exact name, else a name inside it (short ones as whole words)."""
    v = folded(value)
    return F.coalesce(mapped(v, dict(MISSIONS)), _hit(_table([(_word(k), m) for k, m in MISSIONS], "p", "m"), lambda r: F.rlike(v, r.p)).m)


def identity_from_identifier(identifier: Column) -> tuple[Column, Column]:
    """Mission and instrument of the first matching identifier pattern."""
    v = F.upper(identifier)
    hit = _hit(_table(IDENTIFIERS, "p", "m", "i"), lambda r: F.rlike(v, r.p))
    return hit.m, hit.i


def instrument_from_value(value: Column, mission: Column) -> Column:
    """A structured instrument field: TC for one mission only, exact name, a long name inside it, then identifier patterns."""
    v = folded(value)
    inside = _hit(_table([(k, i) for k, i in INSTRUMENTS if len(k) > 4], "k", "i"), lambda r: v.contains(r.k)).i
    return F.when(v == "TC", F.when(mission == "SELENE", "TC")).otherwise(F.coalesce(mapped(v, dict(INSTRUMENTS)), inside, identity_from_identifier(v)[1]))


def identified(df: DataFrame, mission: str, instrument: str, product_id: str, path: str) -> DataFrame:
    """found_mission, found_instrument, method: structured fields first, then the id, then the file name."""
    m = mission_from_value(F.col(mission))
    i = instrument_from_value(F.col(instrument), m)
    id_m, id_i = identity_from_identifier(F.col(product_id))
    fn_m, fn_i = identity_from_identifier(stem(F.col(path)))
    df = df.withColumns({"_m": m, "_i": i, "_im": id_m, "_ii": id_i, "_fm": fn_m, "_fi": fn_i, "_pm": mission_from_value(F.col(product_id))})
    c = F.col
    structured, by_id, by_name, by_file = c("_m").isNotNull() | c("_i").isNotNull(), c("_im").isNotNull(), c("_pm").isNotNull(), c("_fm").isNotNull()
    sm = F.coalesce("_m", "_im")
    si = F.coalesce(F.coalesce("_i", "_ii"), F.when(sm == "LRO", "NAC"))
    late = lambda own, m: F.coalesce(own, instrument_from_value(F.col(instrument), m))
    out = df.withColumns({
        "found_mission": F.when(structured, sm).when(by_id, c("_im")).when(by_name, c("_pm")).when(by_file, c("_fm")),
        "found_instrument": F.when(structured, si).when(by_id, late(c("_ii"), c("_im"))).when(by_name, F.lit(None).cast("string")).when(by_file, late(c("_fi"), c("_fm"))),
        "method": F.when(structured, "pds4_metadata").when(by_id, F.when(late(c("_ii"), c("_im")).isNotNull(), "mission_specific_identifier").otherwise("product_identifier")).when(by_name, "product_identifier")
        .when(by_file, "filename_heuristic").otherwise("unknown")})
    return out.drop("_m", "_i", "_im", "_ii", "_fm", "_fi", "_pm")


def canonical_mission(value: Column) -> Column:
    return F.coalesce(mapped(F.regexp_replace(F.lower(F.trim(value)), "[-_]", ""), CANONICAL), F.trim(value))


def adapter_instrument(value: Column) -> Column:
    v = F.upper(F.trim(value))
    return F.coalesce(mapped(v, ADAPTER_ALIASES), v)


def of_mission(df: DataFrame, mission: str) -> DataFrame:
    """Products of one mission's adapter; validated rows get missing identity from their id, if it names that mission."""
    id_m, id_i = identity_from_identifier(F.col("product_id"))
    may = (F.col("status") == "validated") & (F.col("mission").isNotNull() | id_m.isNull() | (canonical_mission(id_m) == mission))
    df = df.withColumns({"mission": F.when(may, F.coalesce("mission", id_m)).otherwise(F.col("mission")), "instrument": F.when(may, F.coalesce("instrument", id_i)).otherwise(F.col("instrument"))})
    return df.where((canonical_mission(F.col("mission")) == mission) & adapter_instrument(F.col("instrument")).isin(*ADAPTERS[mission]))


def classification(exists: Column) -> Column:
    """INVALID, SYNTHETIC_FIXTURE, UNVERIFIED or AUTHORIZED_REAL; exists: whether the image file is there."""
    c = F.col
    said = F.lower(F.coalesce("validation_message", F.lit("")))
    invalid = c("status").isin("invalid", "unsupported") | said.contains("fail") | said.contains("error") | F.coalesce((c("width") <= 0) | (c("height") <= 0), F.lit(False)) & c("width").isNotNull() & c("height").isNotNull()
    pid = F.lower(F.coalesce("product_id", F.lit("")))
    made_up = F.arrays_overlap(F.split(F.lower("image_path"), "/"), F.array(*map(F.lit, SYNTHETIC))) | F.lower(stem(c("image_path"))).startswith("synth")
    for word in SYNTHETIC:
        made_up = made_up | pid.contains(word)
    mission = F.upper(F.coalesce("mission", F.lit("")))
    known = F.lit(False)
    for m in REAL:
        known = known | mission.contains(m)
    sound = (c("status") == "validated") & (c("gsd_m") > 0) & (c("width") > 0) & (c("height") > 0)
    return F.when(invalid, "INVALID").when(made_up, "SYNTHETIC_FIXTURE").when(~exists | ~known, "UNVERIFIED").when(F.coalesce(sound, F.lit(False)), "AUTHORIZED_REAL").otherwise("UNVERIFIED")


def completeness(fields: tuple[str, ...]) -> Column:
    """n/m: how many of the fields are known and not empty."""
    n = sum((F.coalesce(F.col(f).cast("string") != "", F.lit(False)).cast("int") for f in fields), F.lit(0))
    return F.concat(n.cast("string"), F.lit(f"/{len(fields)}"))


def scan(files: DataFrame, suffixes: tuple[str, ...] = SCAN_SUFFIXES) -> DataFrame:
    """Files with an image suffix, by path; nothing that fails later is dropped here."""
    return files.where(suffix(F.col("path")).isin(*suffixes))


def scan_unique_stems(files: DataFrame) -> DataFrame:
    """Images and labels; of files with one stem the first by path, and every label."""
    held = scan(files, SCAN_SUFFIXES + LABEL_SUFFIXES).withColumn("_label", suffix(F.col("path")).isin(*LABEL_SUFFIXES))
    first = Window.partitionBy(F.lower(stem(F.col("path")))).orderBy("path")
    return held.withColumn("_n", F.row_number().over(first)).where("_n = 1 or _label").drop("_n", "_label")


def resolve_labels(images: DataFrame, labels: DataFrame) -> DataFrame:
    """The label of each image in its folder: path, status, method, label_path.

    labels: path and refs (file names that the label declares; null where it can't be read).  Rules in
    order: same stem (not contradicted by refs), declared file name, naming convention.  More than one
    at a level is ambiguous; a label that no rule selects is never taken.
    """
    parts = lambda df: df.withColumns({"dir": F.regexp_replace("path", "/[^/]*$", ""), "name": F.lower(file_name(F.col("path")))})
    im = parts(images.select("path")).withColumn("stem", F.lower(stem(F.col("path"))))
    lb = parts(labels.select("path", "refs"))
    lb = lb.withColumns({"stem": F.lower(stem(F.col("path"))), "declared": F.transform("refs", lambda r: F.lower(file_name(r)))})
    count = lambda df, p: df.groupBy("path").agg(F.count("*").alias(f"{p}_n"), F.min("label_path").alias(f"{p}_path"), F.min("bad").alias(f"{p}_bad"), F.min("other").alias(f"{p}_other"))
    on = lambda left, right, keys: left.alias("i").join(right.alias("l"), keys)
    names = F.col("l.declared")
    refers = F.coalesce(F.array_contains(names, F.col("i.name")) | F.exists(names, lambda n: F.regexp_replace(n, r"(?<=[^.])\.[^.]+$", "") == F.col("i.stem")), F.lit(False))
    cols = [F.col("i.path").alias("path"), F.col("l.path").alias("label_path"), names.isNull().alias("bad")]
    same = on(im, lb, ["dir", "stem"]).select(*cols, (F.coalesce(F.size(names) > 0, F.lit(False)) & ~refers).alias("other"))
    told = lb.withColumn("word", F.explode(F.array_distinct(F.concat("declared", F.transform("declared", lambda n: F.concat(F.lit("stem:"), F.regexp_replace(n, r"(?<=[^.])\.[^.]+$", "")))))))
    asked = im.withColumn("word", F.explode(F.array("name", F.concat(F.lit("stem:"), "stem"))))
    explicit = on(asked, told, ["dir", "word"]).select(*cols, F.lit(False).alias("other")).distinct()
    usual = im.withColumn("want", F.explode(F.array(*(F.concat("stem", F.lit(x)) for x in ("_label.xml", ".lbl.xml", ".lbl")))))
    convention = usual.alias("i").join(lb.alias("l"), (F.col("i.dir") == F.col("l.dir")) & (F.col("i.want") == F.col("l.name"))).select(*cols, F.lit(False).alias("other")).distinct()
    out = im.select("path").join(count(same, "s"), "path", "left").join(count(explicit, "e"), "path", "left").join(count(convention, "c"), "path", "left")
    c = F.col
    status = (
        F.when(c("s_n") > 1, "ambiguous").when(c("s_n") == 1, F.when(c("s_bad"), "missing").when(c("s_other"), "ambiguous").otherwise("resolved"))
        .when(c("e_n") > 1, "ambiguous").when(c("e_n") == 1, "resolved").when(c("c_n") > 1, "ambiguous").when(c("c_n") == 1, "resolved").otherwise("missing")
    )
    out = out.withColumn("status", status)
    method = F.when(c("status") == "resolved", F.when(c("s_n") == 1, "same_stem").when(c("e_n") == 1, "explicit_file_reference").otherwise("mission_convention"))
    chosen = F.when(c("status") == "resolved", F.coalesce(F.when(c("s_n") == 1, c("s_path")), F.when(c("e_n") == 1, c("e_path")), c("c_path")))
    return out.select("path", "status", method.alias("method"), chosen.alias("label_path"))


def latest_product(df: DataFrame, by: str | None = None) -> DataFrame:
    """The product with the latest acquisition among usable ones, for each value of by; unreadable times come last."""
    usable = df.where(F.col("status").isin("validated", "partial", "parsed"))
    at = F.coalesce(F.unix_micros(F.try_to_timestamp("acquisition_time")), F.lit(-(1 << 62)))
    pick = F.max_by(F.struct("product_id", "acquisition_time"), F.struct(at, F.col("product_id")))
    return (usable.groupBy(by) if by else usable).agg(pick.alias("latest")).select(*([by] if by else []), "latest.*")


def inspected(df: DataFrame) -> DataFrame:
    """status and problem of each product from its header (width, band_count) and label (label_width, label_bands, labelled).

    A detached raster without a label is invalid; header and label must agree; spectral cubes are partial.
    """
    c, kind = F.col, suffix(F.col("image_path"))
    differ = lambda a, b: ~c(a).eqNullSafe(c(b))
    problem = (
        F.when(~c("labelled") & kind.isin("img", "qub"), "NO_LABEL").when(~c("labelled"), F.lit(None)).when(kind.isin("tif", "tiff") & differ("label_width", "width"), "DIMENSIONS_DISAGREE")
        .when(differ("label_bands", "band_count"), "BANDS_DISAGREE")
    )
    df = df.withColumn("problem", problem)
    return df.withColumn("status", F.when(c("problem").isNotNull(), "invalid").when(~c("labelled"), "discovered").when(c("band_count") > 1, "partial").otherwise("validated"))
