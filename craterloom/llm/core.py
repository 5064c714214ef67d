"""Shared helpers of the text operators: scratch tables and byte-level views of text columns."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a Python worker turns into arrays at once; more where that saves repeated lookups.
SLICE_BYTES, TOKEN_SLICE_BYTES = 1 << 20, 4 << 20

#: What empties each cache of this worker, by the cache's name.
CACHES: dict[str, Callable[[], None]] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``.

    Where a session in one process has no such folder (tests, a notebook) a temporary one is made and
    set; on a cluster its lack is an error, as executors share no temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="craterloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: With this, Spark drops an execution's shuffle files when it ends (4.1 on; unknown to older ones, which drop them later).
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes of a batch of rows that go to a Python worker at once; Spark's own default is 64 MB.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def written(df: DataFrame, name: str, release: bool = True, batch_bytes: int | None = None, **options) -> DataFrame:
    """The rows of df, written once to the shared folder and read back: cuts lineage and survives lost executors.

    The files go when the session's file system closes.  Shuffle files of the write go when it ends, as nothing
    else reads them.  With release, memory of what is no longer referred to is given back at once.
    batch_bytes: the most that goes to a Python worker at once (a longer row goes alone), unless the session has less.
    options: of Spark's Parquet writer.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    with contextlib.ExitStack() as after:
        if tuple(map(int, spark.version.split(".")[:2])) >= (4, 1):
            after.callback(spark.conf.set, CLEAN_UP, spark.conf.get(CLEAN_UP))
            spark.conf.set(CLEAN_UP, "true")
            limit = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(ARROW_BYTES))
            if batch_bytes and not 0 < limit <= batch_bytes:
                after.callback(spark.conf.set, ARROW_BYTES, str(limit))
                spark.conf.set(ARROW_BYTES, str(batch_bytes))
        df.write.options(**options).parquet(path)
    forget_on_exit(spark, path)
    if release:
        gc.collect()
        spark._jvm.System.gc()  # the cleaner acts on collected references
    return spark.read.schema(df.schema).parquet(path)


def forget_on_exit(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)


def tidy(run, uses: str | None = None):
    """run for mapInArrow in a worker that lives on: caches it does not use go first, freed memory is given back after."""
    def wrapped(batches):
        for name, empty in CACHES.items():
            if name != uses:
                empty()
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def pieces_of(batches, nbytes: int = 2 << 20):
    """The batches again, each in slices of about nbytes."""
    for b in batches:
        step = max(1, int(len(b) * nbytes / max(1, b.nbytes)))
        for i in range(0, len(b), step):
            yield b.slice(i, step)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    if not len(offsets):
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges (first, last) of rows that hold about ``limit`` bytes each; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (in place)."""
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Rolling:
    """Polynomial hashes modulo 2**64 of any byte ranges of one buffer, from prefix sums."""

    BASE = 0x5851F42D4C957F2D | 1

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    #: Powers of the base and of its inverse, shared by all instances.
    up = down = np.ones(1, np.uint64)

    @classmethod
    def _powers(cls, n: int) -> None:
        if len(cls.up) < n:
            n = max(n, SLICE_BYTES + 1)
            with np.errstate(over="ignore"):
                cls.up, cls.down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, b, np.uint64))]) for b in (cls.BASE, pow(cls.BASE, -1, 2**64)))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        out = np.empty(len(data) + 1, np.uint64)
        out[0] = 0
        terms = self.table[data]
        terms *= self.up[: len(data)]
        np.cumsum(terms, out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = prefix[end] - prefix[start]
        h *= self.down[start]
        return mix(h)

    def fixed(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """Hash of each range [i, i + width)."""
        h = prefix[width:] - prefix[:-width]
        h *= self.down[: len(h)]
        return mix(h)
