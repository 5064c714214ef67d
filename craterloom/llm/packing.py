"""Best-two-fit packing of tokenized documents into sequences of a fixed length.

Documents are tokenized where they lie and cut into pieces of the sequence length only where longer.
Pieces' lengths, never their ids, are then dealt into packing tasks of up to PACK_PIECES
pieces each; ids that were asked for are joined to their places afterwards.  A task fills one bin at a time, largest fitting piece first; when nothing fits any
more, the bin's smallest piece makes way for the two unpacked pieces that together fit its expanded
gap most tightly, if they fit it more tightly than it did.  Each task leaves at most a few loose bins.

Defined results
---------------
* A null text counts as empty: its only id is the end id.  Repeated rows are packed each.
* A null doc_id stays null.  Ties in length are settled by (doc_id, piece, crc).
* An empty table gives no rows.  Columns besides the two named ones are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from craterloom.llm.chunks import library_cache, tokenizer_path
from craterloom.llm.core import TOKEN_SLICE_BYTES, slices, text_bytes, tidy, written

LENGTH = 4096
PACK_PIECES = 500_000
#: Cached chunks of a worker: fewer than where nothing else runs in it.
PACK_CHUNKS = 400_000


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; pieces of one length are taken in the order given."""
    order = np.argsort(lengths, kind="stable")[::-1]  # popped from the end of each stack: the given order
    stacks: dict[int, list[int]] = {}
    for i in order.tolist():
        stacks.setdefault(int(lengths[i]), []).append(i)
    there = 0  # bit n: some unpacked piece has length n
    for n in stacks:
        there |= 1 << n
    below = [(1 << (n + 1)) - 1 for n in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)

    def largest(limit: int) -> int:
        """The largest length of an unpacked piece up to limit, or 0."""
        return max(0, (there & below[limit]).bit_length() - 1) if limit > 0 else 0

    def take(n: int) -> int:
        nonlocal there
        i = stacks[n].pop()
        if not stacks[n]:
            there ^= 1 << n
        return i

    number = 0
    while there:
        inside: list[tuple[int, int]] = []
        gap = capacity
        while n := largest(gap):
            inside.append((n, take(n)))
            gap -= n
        if gap and there and len(inside) > 1:
            small, i = inside[-1]
            room, best = gap + small, (small, 0, 0)
            a = largest(room - 1)
            while a and 2 * a > best[0]:
                b = largest(min(a, room - a))
                if b == a and len(stacks[a]) < 2:
                    b = largest(a - 1)
                if b and a + b > best[0]:
                    best = (a + b, a, b)
                    if a + b == room:
                        break
                a = largest(a - 1)
            if best[1]:
                inside[-1:] = [(best[1], take(best[1])), (best[2], take(best[2]))]
                stacks.setdefault(small, []).append(i)
                there |= 1 << small
        at = 0
        for n, i in inside:
            bins[i], offsets[i] = number, at
            at += n
        number += 1
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian unsigned 32 bit)."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def run(batches):
        cache = library_cache(tokenizer, PACK_CHUNKS)
        for b in batches:
            doc_ids = b["id"]
            data, offsets = text_bytes(b["text"])
            for i, j in slices(offsets, TOKEN_SLICE_BYTES):
                ids, at = cache.rows(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                ids, sizes = np.insert(ids, at[1:], end_id).astype("<u4"), np.diff(at) + 1
                first = np.cumsum(sizes) - sizes
                count = -(-sizes // length)
                row = np.repeat(np.arange(j - i), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * length
                long = np.minimum(length, sizes[row] - start)
                a = first[row] + start
                view = memoryview(ids).cast("B")
                spans = list(zip((4 * a).tolist(), (4 * (a + long)).tolist()))
                crc = [zlib.crc32(view[x:y]) for x, y in spans]
                columns = [doc_ids.slice(i, j - i).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(long), pa.array(crc, pa.int64())]
                if keep_ids:
                    columns.append(pa.array([bytes(view[x:y]) for x, y in spans], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(tidy(run, tokenizer), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def pack(table: DataFrame, length: int = LENGTH, pack_pieces: int = PACK_PIECES) -> DataFrame:
    """A written table of pieces, each with its own piece_key: every other column of it, sequence_id and offset."""
    light = ["piece_key", "length", "doc_id", "piece", "ids_crc32"]

    def run(batches):
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pa.Table.from_batches(held).sort_by([("length", "ascending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = best_two_fit(rows["length"].to_numpy(), length)
        rows = pa.table({"key": rows["piece_key"], "sequence_id": pa.array(bins + (TaskContext.get().partitionId() << 40)), "offset": pa.array(offsets)} | {c: rows[c] for c in carried})
        yield from rows.to_batches(20_000)

    # what is small goes along; ids stay where they are until their places are known
    heavy = [c for c in table.columns if c not in light and c not in ("start",)]
    carried = [] if heavy else [c for c in table.columns if c != "piece_key"]
    # dealt by a number, not by a column that may be the same in a third of all rows
    tasks = max(1, -(-table.count() // pack_pieces))
    kinds = "".join(f", {c} {table.schema[c].dataType.simpleString()}" for c in carried)
    placed = table.select(*light, *([] if heavy else ["start"])).repartition(tasks, "piece_key").mapInArrow(tidy(run), f"key long, sequence_id long, offset long{kinds}")
    if heavy:
        placed = table.join(placed, F.col("piece_key") == F.col("key"))
    return placed.select(*(c for c in table.columns if c != "piece_key"), "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    table = pieces(docs, tokenizer, end_id, id_col, text_col, length, keep_ids).withColumn("piece_key", F.monotonically_increasing_id())
    return pack(written(table, "pieces"), length)


def op7_best_two_fit(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=1)
