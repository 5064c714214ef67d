"""Checks of independent checkpoints: what is wrong with each row, and a reader's fail-fast rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COORDINATES = ("source_x", "source_y", "reference_x", "reference_y")


def judged(points: DataFrame, source_shape: tuple[float, float] | None = None, reference_shape: tuple[float, float] | None = None) -> DataFrame:
    """verdict of each row: the first rule that it breaks, or OK.  Shapes are (height, width)."""
    c = F.col
    missing = c("point_id").isNull()
    for x in COORDINATES:
        missing = missing | c(x).isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    out = F.lit(False)
    for shape, x, y in ((source_shape, "source_x", "source_y"), (reference_shape, "reference_x", "reference_y")):
        if shape:
            out = out | (c(x) < 0) | (c(y) < 0) | (c(x) >= shape[1]) | (c(y) >= shape[0])
    repeated = points.groupBy("point_id").agg(F.count("*").alias("_n"))
    verdict = (
        F.when(missing, "MISSING_FIELD").when(F.coalesce(F.trim("provenance"), F.lit("")) == "", "MISSING_PROVENANCE").when(~F.coalesce(F.upper("quality").isin("A", "B", "C"), F.lit(False)), "BAD_QUALITY")
        .when(out, "OUT_OF_BOUNDS").when(c("_n") > 1, "DUPLICATE_ID").otherwise("OK")
    )
    return points.join(repeated, "point_id", "left").withColumn("verdict", verdict).drop("_n")


def require_sound(points: DataFrame, order: str, **shapes) -> DataFrame:
    """points, or an error that names the first bad row in the given order."""
    bad = judged(points, **shapes).where("verdict <> 'OK'").orderBy(order).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['verdict']}: checkpoint {bad[0]['point_id']}")
    return points
