"""Raw images and spectral cubes by byte ranges, with layouts from their XML labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from craterloom.sources.readers import SAMPLES


def _texts(xml: str, path: str) -> Column:
    """Trimmed texts at a path of local names."""
    steps = "".join(f"//*[local-name()='{p}']" if i == 0 else f"/*[local-name()='{p}']" for i, p in enumerate(path.split("/")))
    return F.transform(F.expr(f"xpath({xml}, \"{steps}/text()\")"), lambda t: F.trim(t))


def _kind(data_type: Column, bits: Column) -> Column:
    """A sample type of readers.SAMPLES from a label's data type and width."""
    t = F.upper(data_type)
    end = F.when(t.contains("MSB"), "MSB").otherwise("LSB")
    whole = F.concat(F.when(t.contains("UNSIGNED"), "Unsigned").otherwise("Signed"), F.when(bits == 8, "Byte").otherwise(F.concat(end, (bits / 8).cast("int").cast("string"))))
    return F.when(t.contains("REAL") | t.contains("IEEE754"), F.concat(F.lit("IEEE754"), end, F.lit("Single"))).otherwise(whole)


def layouts(labels: DataFrame) -> DataFrame:
    """path, offset, bands, lines, samples, kind, problem for each label (path, text), the path being that of its image.

    A three-dimensional spectrum must have its axes in the order BAND, LINE, SAMPLE by sequence number; otherwise, the last
    two numbers of elements are lines and samples.  An offset keeps its digits only.
    """
    axes = F.arrays_zip(_texts("text", "Axis_Array/axis_name").alias("name"), _texts("text", "Axis_Array/elements").alias("n"), _texts("text", "Axis_Array/sequence_number").alias("at"))
    held = labels.withColumns({"cube": F.size(F.expr("xpath(text, \"//*[local-name()='Array_3D_Spectrum']/*\")")) > 0, "axes": axes, "sizes": _texts("text", "elements"), "offsets": _texts("text", "offset"), "types": _texts("text", "data_type"), "bits": _texts("text", "bits")})
    first = lambda c, default: F.coalesce(F.try_element_at(F.col(c), F.lit(1)), F.lit(default))
    ordered = F.array_sort(F.transform("axes", lambda a: F.struct(a["at"].cast("int").alias("at"), F.upper(a["name"]).alias("name"), a["n"].cast("int").alias("n"))))
    held = held.withColumn("axes", ordered).withColumn("names", F.concat_ws(",", F.transform("axes", lambda a: a["name"])))
    size = lambda i: F.when(F.col("cube"), F.try_element_at(F.transform("axes", lambda a: a["n"]), F.lit(i))).otherwise(F.try_element_at("sizes", F.lit(i - 4)).cast("int") if i > 1 else F.lit(1))
    real = F.upper(first("types", "MSB_INTEGER")).rlike("REAL|IEEE754")
    bits = F.coalesce(F.try_element_at("bits", F.lit(1)).cast("int"), F.when(F.upper(first("types", "")).contains("BYTE"), 8).when(real, 32).otherwise(16))
    out = held.select(
        "path", F.coalesce(F.regexp_replace(first("offsets", "0"), r"[^0-9.]", "").cast("double").cast("long"), F.lit(0)).alias("offset"),
        size(1).alias("bands"), size(2).alias("lines"), size(3).alias("samples"), _kind(first("types", "MSB_INTEGER"), bits).alias("kind"), "cube", "names", F.size("axes").alias("n_axes"), bits.alias("b"), real.alias("real"))
    problem = (F.when(F.col("cube") & (F.col("n_axes") != 3), "NOT_THREE_AXES").when(F.col("cube") & (F.col("names") != "BAND,LINE,SAMPLE"), "UNSUPPORTED_AXIS_ORDER")
               .when(F.coalesce(F.least("bands", "lines", "samples") <= 0, F.lit(True)) | F.col("lines").isNull() | F.col("samples").isNull(), "NO_DIMENSIONS")
               .when(F.col("cube") & ~F.col("real"), "UNSUPPORTED_SAMPLE_TYPE").when(~F.col("b").isin(8, 16, 32), "UNSUPPORTED_WIDTH"))
    return out.withColumn("problem", problem).drop("cube", "names", "n_axes", "b", "real")


def read_ranges(layout: DataFrame, lines_at_once: int = 256) -> DataFrame:
    """Pixels (path, band, y, x, value) of raw files; every task reads only the byte ranges of its lines.

    layout: path (a file that Arrow's file systems reach), offset, bands, lines, samples, kind, nodata; rows with a problem
    are left out.  A file that is too short fails with its path.
    """
    ok = layout.where("problem is null") if "problem" in layout.columns else layout
    rows = ok.withColumn("first", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.col("bands") * F.col("lines") - 1).cast("int")), F.lit(lines_at_once))))
    # dealt by range, so that one very large file is read by many tasks
    rows = rows.repartition(F.xxhash64("path", "first"))

    def run(frames):
        from pyarrow import fs

        for pdf in frames:
            for r in pdf.itertuples():
                kind = np.dtype(SAMPLES[r.kind])
                n = int(min(lines_at_once, r.bands * r.lines - r.first))
                system, place = fs.FileSystem.from_uri(r.path)
                with system.open_input_file(place) as f:
                    f.seek(int(r.offset + r.first * r.samples * kind.itemsize))
                    raw = f.read(n * int(r.samples) * kind.itemsize)
                if len(raw) < n * r.samples * kind.itemsize:
                    raise ValueError(f"TRUNCATED: {r.path}")
                value = np.frombuffer(raw, kind).astype(np.float32).astype(np.float64)
                line = np.repeat(np.arange(r.first, r.first + n), r.samples)
                yield pd.DataFrame({"path": r.path, "band": line // r.lines, "y": line % r.lines, "x": np.tile(np.arange(r.samples), n), "value": np.where(value == r.nodata, np.nan, value)})

    px = rows.select("path", "offset", "bands", "lines", "samples", "kind", "nodata", "first").mapInPandas(run, "path string, band int, y int, x int, value double")
    return px.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
