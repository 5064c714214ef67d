"""Exact deduplication by Grace hashing.

Every map task folds equal texts of its own rows first, so that a text with a third of all rows
leaves each task once.  The folded rows are then dealt by content hash, and each reduce task runs
the recursive Grace hash: records go to spill files by further hash bits until a file fits an
open-addressing table, which compares complete contents (a hash alone never decides).

Defined results
---------------
* A null text counts as empty; the empty text is a text like any other.
* Of equal texts the row with the largest id stays.  A null id is smaller than any other; if the
  largest id occurs on several equal rows, exactly one of them (the first as read) stays.
* Repeated rows are copies.  An empty table gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from craterloom.llm.core import pieces_of, tidy, written

#: Bytes of distinct text that one table may hold before its records go to spill files.
TABLE_BYTES = 24 << 20
FANOUT = 16


class OpenTable:
    """Open addressing with linear probing; keys are (64-bit hash, content)."""

    def __init__(self):
        self.slots: list[int] = [-1] * 64
        self.hashes: list[int] = []
        self.texts: list[bytes] = []
        self.values: list[list] = []
        self.bytes = 0

    def find(self, h: int, text: bytes) -> tuple[int, int]:
        """The entry with this content, or -1, and the slot where the probe ended."""
        mask = len(self.slots) - 1
        at = h & mask
        while (e := self.slots[at]) >= 0:
            if self.hashes[e] == h and self.texts[e] == text:
                return e, at
            at = (at + 1) & mask
        return -1, at

    def add(self, h: int, text: bytes, value: list, at: int) -> int:
        e = len(self.texts)
        self.slots[at] = e
        self.hashes.append(h)
        self.texts.append(text)
        self.values.append(value)
        self.bytes += len(text) + 200
        if 2 * len(self.texts) > len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            mask = len(self.slots) - 1
            for i, x in enumerate(self.hashes):
                at = x & mask
                while self.slots[at] >= 0:
                    at = (at + 1) & mask
                self.slots[at] = i
        return e


def grace(records: Iterator[tuple[int, bytes, list]], merge, folder: str, limit: int = TABLE_BYTES, level: int = 0):
    """Groups (text, value) of equal texts among records (hash, text, value); merge(old, new) folds values in place.

    While the table has room every record goes in.  Once full, a record whose content is there is
    still folded in, and the others go to one of FANOUT spill files by four further hash bits; each
    file is then treated alike.  Past the last bits (a hash with many contents) the table grows.
    """
    table, files, shift = OpenTable(), {}, 60 - 4 * level
    try:
        for h, text, value in records:
            e, at = table.find(h, text)
            if e >= 0:
                merge(table.values[e], value)
            elif table.bytes < limit or shift < 0:
                table.add(h, text, value, at)
            else:
                part = (h >> shift) & (FANOUT - 1)
                if part not in files:
                    files[part] = open(os.path.join(folder, f"{level}-{len(os.listdir(folder))}-{part}"), "wb+")
                pickle.dump((h, text, value), files[part], protocol=5)
        for text, value in zip(table.texts, table.values):
            yield text, value
        del table
        for f in files.values():
            f.seek(0)
            yield from grace(_spilled(f), merge, folder, limit, level + 1)
            f.close()
            os.unlink(f.name)
    finally:
        for f in files.values():
            f.close()


def _spilled(f):
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def _fold(limit: int):
    """Map side: (h, id, text) batches to one ``rep`` row per distinct text and one ``row`` row per input row."""
    names = ["part", "grp", "pos", "id", "h", "text", "n"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names)

    def run(batches):
        part, pos, seen, table = TaskContext.get().partitionId(), 0, 0, OpenTable()
        best: list[tuple] = []

        def flush():
            nonlocal seen
            step = 500
            for i in range(0, len(table.texts), step):
                yield batch([(part, seen + j, best[j][1], best[j][0][1], h, t.decode("utf-8", "surrogatepass"), v[0])
                             for j, (h, t, v) in enumerate(zip(table.hashes[i:i + step], table.texts[i:i + step], table.values[i:i + step]), i)])
            seen += len(table.texts)

        for b in pieces_of(batches):
            rows = []
            for h, doc, text in zip(b["h"].to_pylist(), b["id"].to_pylist(), b["text"].to_pylist()):
                text = text.encode("utf-8", "surrogatepass")
                order = (doc is not None, doc)
                e, at = table.find(h, text)
                if e < 0:
                    if table.bytes >= limit:  # a new table: a text may then leave this task once more
                        yield from flush()
                        table, best[:] = OpenTable(), []
                        e, at = table.find(h, text)
                    e = table.add(h, text, [0], at)
                    best.append((order, pos))
                table.values[e][0] += 1
                if order[0] and (not best[e][0][0] or doc > best[e][0][1]):
                    best[e] = (order, pos)
                rows.append((part, seen + e, pos, doc, None, None, None))
                pos += 1
            yield batch(rows)
        yield from flush()

    return run


def _group(limit: int):
    """Reduce side: the rows of equal texts of all map tasks, folded; one row for each of them."""
    def merge(old, new):
        old[0] += new[0]
        old[1] = max(old[1], new[1], key=lambda x: (x[0] is not None, x[0] or 0, -x[1], -x[2]))
        old[2] += new[2]

    def records(batches):
        for b in pieces_of(batches):
            cols = [b[c].to_pylist() for c in ("h", "text", "n", "id", "part", "pos", "grp")]
            for h, text, n, doc, part, pos, grp in zip(*cols):
                yield h & (2**64 - 1), text.encode("utf-8", "surrogatepass"), [n, (doc, part, pos), [(part, grp)]]

    names = ["part", "grp", "keep_id", "keep_part", "keep_pos", "group_size", "text_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        folder = tempfile.mkdtemp()
        try:
            rows: list[tuple] = []
            for text, (n, (doc, part, pos), reps) in grace(records(batches), merge, folder, limit):
                sha = hashlib.sha256(text).hexdigest()
                rows += [(p, g, doc, part, pos, n, sha) for p, g in reps]
                if len(rows) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = TABLE_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", "text", F.xxhash64("text").alias("h"))
    folded = written(rows.mapInArrow(tidy(_fold(limit)), "part long, grp long, pos long, id long, h long, text string, n long"), "grace")
    reps = folded.where("n is not null").repartition("h").select("part", "grp", "pos", "id", "h", "text", "n")
    groups = reps.mapInArrow(tidy(_group(limit)), "part long, grp long, keep_id long, keep_part long, keep_pos long, group_size long, text_sha256 string")
    members = folded.where("n is null").select("part", "grp", "pos", F.col("id").alias("doc_id"))
    return members.join(groups, ["part", "grp"]).select(
        "doc_id", "keep_id", "group_size", ((F.col("part") == F.col("keep_part")) & (F.col("pos") == F.col("keep_pos"))).alias("kept"), "text_sha256"
    )


def _fold_rows(limit: int):
    """Map side of drop_exact(): of equal texts of a task one row, that with the largest id, first as read."""
    def run(batches):
        part, pos, table, rest = TaskContext.get().partitionId(), 0, OpenTable(), None

        def flush():
            names = ["h", "text", "id", "part", "pos", "rest"]
            for i in range(0, len(table.texts), 500):
                held = list(zip(table.hashes[i:i + 500], table.texts[i:i + 500], table.values[i:i + 500]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h for h, _, _ in held], pa.int64()), pa.array([t.decode("utf-8", "surrogatepass") for _, t, _ in held], pa.string()), *(pa.array([v[k] for _, _, v in held], pa.int64()) for k in range(3)),
                     pa.array([v[3] for _, _, v in held], rest)], names)

        for b in pieces_of(batches):
            rest = b.schema.field("rest").type
            for h, doc, text, more in zip(*(b[c].to_pylist() for c in ("h", "id", "text", "rest"))):
                text = text.encode("utf-8", "surrogatepass")
                e, at = table.find(h, text)
                if e < 0:
                    if table.bytes >= limit:
                        yield from flush()
                        table = OpenTable()
                        e, at = table.find(h, text)
                    table.add(h, text, [doc, part, pos, more], at)
                else:
                    _keep_larger(table.values[e], [doc, part, pos, more])
                pos += 1
        yield from flush()

    return run


def _keep_larger(old: list, new: list) -> None:
    """Values (id, part, pos, rest): the larger id, then the earlier place."""
    rank = lambda v: (v[0] is not None, v[0] or 0, -v[1], -v[2])
    if rank(new) > rank(old):
        old[:] = new


def _kept_rows(limit: int):
    """Reduce side of drop_exact(): the row that stays of each text."""
    def run(batches):
        folder, kinds = tempfile.mkdtemp(), []

        def records():
            for b in pieces_of(batches):
                kinds[:] = [b.schema.field("rest").type]
                for h, text, *value in zip(*(b[c].to_pylist() for c in ("h", "text", "id", "part", "pos", "rest"))):
                    yield h & (2**64 - 1), text.encode("utf-8", "surrogatepass"), value

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([t.decode("utf-8", "surrogatepass") for t, _ in rows], pa.string()), pa.array([v[3] for _, v in rows], kinds[0])], ["text", "rest"])

        try:
            rows = []
            for text, value in grace(records(), _keep_larger, folder, limit):
                rows.append((text, value))
                if len(rows) >= 500:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return run


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = TABLE_BYTES) -> DataFrame:
    """One row of docs, with all its columns, for each distinct text: that with the largest id.

    Texts are dealt once; the row that stays comes whole out of the task that compared its text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col]
    rest = F.struct(F.col(text_col).isNull().alias("null_text"), *others)
    rows = docs.select(F.xxhash64(text).alias("h"), text.alias("text"), F.col(id_col).cast("long").alias("id"), rest.alias("rest"))
    kind = rows.schema["rest"].dataType.simpleString()
    folded = rows.mapInArrow(tidy(_fold_rows(limit)), f"h long, text string, id long, part long, pos long, rest {kind}")
    kept = folded.repartition("h").mapInArrow(tidy(_kept_rows(limit)), f"text string, rest {kind}")
    return kept.select(*(F.when(~F.col("rest.null_text"), F.col("text")).alias(c) if c == text_col else F.col(f"rest.c{i}").alias(c) for i, c in enumerate(docs.columns)))


def op8_grace_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
