"""Control points from JSON documents: the rules for importing them, and ground truth under several names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The methods that a document may name.
METHODS = ("independent_reference", "manual", "photogrammetric")

_POINT = "array<struct<source_x:string,source_y:string,reference_x:string,reference_y:string,uncertainty_px:string>>"
_DOCUMENT = f"method string, pair_id string, source string, points {_POINT}"


def judged(documents: DataFrame, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """documents (pair_id, text) with doc and verdict: the first rule that a document breaks, or OK."""
    c = F.col
    raw = F.from_json("text", _DOCUMENT)
    held = documents.withColumn("doc", raw).withColumn("is_object", F.trim("text").startswith("{") & c("doc").isNotNull())
    points = c("doc.points")
    missing = F.exists(points, lambda p: p.isNull() | p["source_x"].isNull() | p["source_y"].isNull() | p["reference_x"].isNull() | p["reference_y"].isNull())
    bad = F.exists(points, lambda p: F.array_contains(F.transform(F.array(*(p[k] for k in ("source_x", "source_y", "reference_x", "reference_y"))), lambda v: v.try_cast("double").isNull()), True))
    verdict = (
        F.when(~F.coalesce(c("is_object"), F.lit(False)), "NOT_AN_OBJECT").when(~F.coalesce(F.lower("doc.method").isin(*methods), F.lit(False)), "UNSUPPORTED_METHOD")
        .when(c("doc.pair_id").isNotNull() & (c("doc.pair_id") != c("pair_id").cast("string")), "OTHER_PAIR").when(F.coalesce(F.size(points), F.lit(0)) < 1, "NO_POINTS")
        .when(missing, "MISSING_FIELD").when(bad, "NOT_A_NUMBER").otherwise("OK")
    )
    return held.withColumn("verdict", verdict).drop("is_object")


def imported(documents: DataFrame, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """Points of the documents that keep the rules: pair_id, method, source, index, coordinates, uncertainty_px (0 where none is given)."""
    ok = judged(documents, methods).where("verdict = 'OK'")
    rows = ok.select("pair_id", F.lower("doc.method").alias("method"), F.coalesce("doc.source", F.lit("unknown")).alias("source"), F.posexplode("doc.points").alias("index", "p"))
    value = lambda k: F.col(f"p.{k}").cast("double").alias(k)
    return rows.select("pair_id", "method", "source", "index", *map(value, ("source_x", "source_y", "reference_x", "reference_y")), F.coalesce(F.col("p.uncertainty_px").cast("double"), F.lit(0.0)).alias("uncertainty_px"))


def ground_truth(documents: DataFrame) -> DataFrame:
    """documents (pair_id, text) with verdict, src and ref (arrays of x, y), under whichever of their names they are given.

    The first name whose value is not empty counts, else the last name's value.  What is given but is no list of lists
    has the wrong shape, and its src or ref is null.
    """
    names = [("source_points", "target_points"), ("src_points", "ref_points"), ("source", "target")]
    doc = F.from_json("text", ", ".join(f"{n} string" for pair in names for n in pair))
    held = documents.withColumn("doc", doc)

    def given(side: int) -> Column:
        some = [F.when(~F.col(f"doc.{pair[side]}").isin("[]", "{}", "", "0", "0.0", "false"), F.col(f"doc.{pair[side]}")) for pair in names]
        return F.coalesce(*some, F.col(f"doc.{names[-1][side]}"))

    def listed(c: str) -> Column:
        points = F.from_json(c, "array<array<double>>")
        return F.when(~F.exists(points, lambda p: p.isNull()), points)

    held = held.withColumns({"given_src": given(0), "given_ref": given(1)}).withColumns({"src": listed("given_src"), "ref": listed("given_ref")})
    flat = lambda c: F.coalesce(F.exists(c, lambda p: F.size(p) != 2), F.lit(True))
    verdict = (F.when(F.col("given_src").isNull() | F.col("given_ref").isNull(), "NO_POINTS").when(flat("src") | flat("ref") | (F.size("src") != F.size("ref")) | (F.size("src") == 0), "BAD_SHAPE")
               .when(F.size("src") < 4, "TOO_FEW_POINTS").otherwise("OK"))
    return held.withColumn("verdict", verdict).drop("doc", "given_src", "given_ref")
