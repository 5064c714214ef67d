"""Readers with fixed schemas: catalogs, manifests, checkpoints, label files and raw rasters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path and length of all files below root; contents are not read unless asked for."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)


def read_catalog(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def read_manifest(spark: SparkSession, path: str, pair_schema: str) -> DataFrame:
    """Rows of the ``pairs`` array of JSON documents; documents that can't be read give none."""
    return spark.read.schema(f"pairs array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in pair_schema.split(','))}>>").json(path).select(F.inline("pairs"))


def read_labels(spark: SparkSession, root: str) -> DataFrame:
    """path and text of label files."""
    return read_files(spark, root, "*.{xml,XML,lbl,LBL}").select("path", F.decode("content", "UTF-8").alias("text"))


# Numpy types of the raw sample types.
SAMPLES = {
    "UnsignedByte": "u1", "SignedByte": "i1", "UnsignedMSB2": ">u2", "SignedMSB2": ">i2", "UnsignedLSB2": "<u2", "SignedLSB2": "<i2", "UnsignedMSB4": ">u4", "SignedMSB4": ">i4",
    "UnsignedLSB4": "<u4", "SignedLSB4": "<i4", "IEEE754MSBSingle": ">f4", "IEEE754LSBSingle": "<f4",
}


def read_raw_rasters(files: DataFrame, layout: DataFrame) -> DataFrame:
    """Pixels (path, band, y, x, value) of raw rasters; layout: path, offset, bands, lines, samples, kind, nodata.

    Bands stand one after the other, lines within them.  A file that is too short fails with its path.
    """
    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                kind = np.dtype(SAMPLES[r.kind])
                n = r.bands * r.lines * r.samples
                if len(r.content) < r.offset + n * kind.itemsize:
                    raise ValueError(f"TRUNCATED: {r.path}")
                line = np.frombuffer(r.content, kind, n, r.offset).astype(np.float32).astype(np.float64).reshape(r.bands * r.lines, r.samples)
                for i in range(0, len(line), 256):
                    part = line[i:i + 256]
                    at = np.arange(i, i + len(part))
                    v = part.ravel()
                    yield pd.DataFrame({"path": r.path, "band": np.repeat(at // r.lines, r.samples), "y": np.repeat(at % r.lines, r.samples), "x": np.tile(np.arange(r.samples), len(part)), "value": np.where(v == r.nodata, np.nan, v)})

    joined = files.select("path", "content").join(layout, "path")
    px = joined.mapInPandas(run, "path string, band int, y int, x int, value double")
    return px.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def read_tiff(content: bytes) -> np.ndarray:
    """First image of an uncompressed, strip-organised, single-band TIFF."""
    import struct

    order = {b"II": "<", b"MM": ">"}[content[:2]]
    magic, at = struct.unpack_from(order + "HI", content, 2)
    if magic != 42:
        raise ValueError("not a TIFF file")
    tags = {}
    for i in range(struct.unpack_from(order + "H", content, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", content, at + 2 + 12 * i)
        code, size = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}.get(kind, (None, 0))
        if code:
            where = at + 10 + 12 * i if n * size <= 4 else struct.unpack_from(order + "I", content, at + 10 + 12 * i)[0]
            tags[tag] = struct.unpack_from(f"{order}{n}{code}", content, where)
    if tags.get(259, (1,))[0] != 1:
        raise ValueError("compressed TIFF files are not read")
    width, height, bits, form = tags[256][0], tags[257][0], tags.get(258, (8,))[0], tags.get(339, (1,))[0]
    kind = np.dtype(order + {1: "u", 2: "i", 3: "f"}[form] + str(bits // 8))
    raw = b"".join(content[o:o + n] for o, n in zip(tags[273], tags[279]))
    return np.frombuffer(raw, kind, width * height).reshape(height, width)


def write_tiff(image: np.ndarray) -> bytes:
    """A little-endian float32 TIFF of one strip, the counterpart of read_tiff()."""
    import struct

    h, w = image.shape
    data = image.astype("<f4").tobytes()
    entries = [(256, 4, w), (257, 4, h), (258, 3, 32), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, h), (279, 4, len(data)), (339, 3, 3)]
    directory = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHI", t, k, 1) + (struct.pack("<I", v) if k == 4 else struct.pack("<HH", v, 0)) for t, k, v in entries) + struct.pack("<I", 0)
    return b"II" + struct.pack("<HI", 42, 8 + len(data)) + data + directory
