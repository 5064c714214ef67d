"""Token ids as wavelet matrices: one compressed, searchable file per shard.

A shard holds consecutive documents' ids as succinct bit planes, highest bit first: at each plane the
ids with a 0 bit go stably before those with a 1 bit.  Every plane has a rank directory (ones before
each block of 512 bits) and is compressed in pieces of PIECE bytes, of which a look-up unpacks only those
that it touches.  So from the one file tokens can be read (``access``), counted in a range
(``count``) and located (``select``), and all can be read back in order (``tokens``).

The writer encodes documents where they lie, orders their ids (two bytes each, where the vocabulary
allows it) by document id over the whole table by range partitioning, and cuts each partition
into shards of about SHARD_TOKENS ids.  Each shard is one file in the shared folder, in a Parquet
wrapper, as Spark's writers are what executors can reach that folder by: a row with the shard's bytes, its
partition, its place there and the ids before it in the partition; partition totals give the global starts.

Defined results
---------------
* A null text counts as empty: its only id is the end id.  A null doc_id sorts before all others.
* Repeated rows are written each; rows of one doc_id lie in the order of a hash of their ids, so that
  an id that stands on very many rows doesn't come to one task.
* A document longer than a shard gets a shard of its own.  An empty table gives no files, no rows.
* Columns besides the two named ones are not looked at.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from craterloom.llm.chunks import library_cache, tokenizer_path
from craterloom.llm.core import TOKEN_SLICE_BYTES, slices, text_bytes, tidy, written

MAGIC = b"CRWM0002"
BLOCK, PIECE = 512, 1 << 15
SHARD_TOKENS = 1 << 20
#: Values that are dealt at once, so that they and their places stay in a core's own cache.
DEALT = 1 << 14


class Plane:
    """Bits in compressed pieces, unpacked when they are first needed; the last block is followed by an empty one."""

    def __init__(self, size: int, parts: list[bytes]):
        self.size, self.parts = size, parts
        self.data = np.zeros((-(-size // (BLOCK // 8)) + 1) * (BLOCK // 8), np.uint8)
        self.missing = np.ones(len(parts), bool)

    @classmethod
    def packed(cls, raw: np.ndarray) -> Plane:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        return cls(len(raw), [squeeze(raw[i:i + PIECE].tobytes()) for i in range(0, len(raw), PIECE)])

    def need(self, at: np.ndarray | None = None) -> np.ndarray:
        """The bytes, of which at least the pieces with these places (all, if none are named) are there."""
        if self.missing.any():
            pieces = np.arange(len(self.parts)) if at is None else np.unique(np.minimum(at // PIECE, len(self.parts) - 1))
            unpack = zstandard.ZstdDecompressor().decompress
            for k in pieces[self.missing[pieces]].tolist():
                raw = unpack(self.parts[k], max_output_size=PIECE)
                self.data[k * PIECE:k * PIECE + len(raw)] = np.frombuffer(raw, np.uint8)
                self.missing[k] = False
        return self.data


class WaveletMatrix:
    """Bit planes of a sequence of unsigned numbers."""

    def __init__(self, n: int, planes: list[Plane], zeros: list[int], ranks: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks

    @classmethod
    def build(cls, values: np.ndarray) -> WaveletMatrix:
        width = max(1, int(values.max()).bit_length()) if len(values) else 1
        a = np.ascontiguousarray(values, np.uint16 if width <= 16 else np.uint32)
        a, down = a.copy(), np.empty_like(a)
        planes, zeros, ranks = [], [], []
        for bit in range(width - 1, -1, -1):
            one = (a & a.dtype.type(1 << bit)) != 0
            plane = np.packbits(one, bitorder="little")
            planes.append(Plane.packed(plane))
            ranks.append(cls._directory(plane))
            zeros.append(int(len(one) - ranks[-1][-1]))
            if not bit:
                break  # the order below the last plane is not looked at
            zero, i, j = ~one, 0, zeros[-1]
            for lo in range(0, len(a), DEALT):
                part = a[lo:lo + DEALT]
                low, high = part.compress(zero[lo:lo + DEALT]), part.compress(one[lo:lo + DEALT])  # many times faster than by places
                down[i:i + len(low)], down[j:j + len(high)] = low, high
                i, j = i + len(low), j + len(high)
            a, down = down, a
        return cls(len(values), planes, zeros, ranks)

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        """Ones before each block; the last entry counts all."""
        step = BLOCK // 8
        padded = np.zeros(-(-max(1, len(plane)) // step) * step, np.uint8)
        padded[:len(plane)] = plane
        ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, step // 8).sum(1, dtype=np.uint32)
        return np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)

    def _rank1(self, level: int, i: np.ndarray) -> np.ndarray:
        """Ones of the plane before each place."""
        block, rest = i // BLOCK, i % BLOCK
        words = self.planes[level].need(block * (BLOCK // 8)).view(np.uint64).reshape(-1, BLOCK // 64)
        out = self.ranks[level][np.minimum(block, len(self.ranks[level]) - 1)].astype(np.int64)
        return out + np.bitwise_count(words[block] & self._BELOW[rest]).sum(1, dtype=np.int64)

    #: Row r: the first r bits of a block.
    _BELOW = np.packbits(np.tri(BLOCK, BLOCK, -1, np.uint8), axis=1, bitorder="little").view(np.uint64)

    def access(self, i) -> np.ndarray:
        """The values at the given places."""
        i = np.atleast_1d(np.asarray(i, np.int64)).copy()
        out = np.zeros(len(i), np.int64)
        for level, plane in enumerate(self.planes):
            one = (plane.need(i >> 3)[i >> 3] >> (i & 7) & 1).astype(bool)
            r = self._rank1(level, i)
            out = out << 1 | one
            i = np.where(one, self.zeros[level] + r, i - r)
        return out

    def _descend(self, value: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where, below all planes, the occurrences of each value among its places a .. b - 1 lie."""
        a, b = (np.where(value >> len(self.planes) > 0, 0, x) for x in (a, b))
        for level in range(len(self.planes)):
            ra, rb = self._rank1(level, a), self._rank1(level, b)
            one = value >> (len(self.planes) - 1 - level) & 1 > 0
            a, b = (np.where(one, self.zeros[level] + r, x - r) for x, r in ((a, ra), (b, rb)))
        return a, b

    def counts(self, values, first, last) -> np.ndarray:
        """Occurrences of each value among its places first .. last - 1."""
        a, b = self._descend(*np.broadcast_arrays(*(np.atleast_1d(np.asarray(x, np.int64)) for x in (values, first, last))))
        return b - a

    def selects(self, values, ks) -> np.ndarray:
        """Place of the kth occurrence of each value (k from 0); -1 where there are fewer."""
        values, ks = np.broadcast_arrays(*(np.atleast_1d(np.asarray(x, np.int64)) for x in (values, ks)))
        a, b = self._descend(values, np.zeros_like(values), np.full_like(values, self.n))
        there = (ks >= 0) & (ks < b - a)
        at = (a + ks)[there]
        for level in range(len(self.planes) - 1, -1, -1):
            one = at >= self.zeros[level]
            at = self._select(level, np.where(one, at - self.zeros[level], at), one)
        out = np.full(len(values), -1)
        out[there] = at
        return out

    def _select(self, level: int, k: np.ndarray, one: np.ndarray) -> np.ndarray:
        """Place of the kth 1 bit, where one, else 0 bit."""
        ranks, step = self.ranks[level].astype(np.int64), BLOCK // 8
        none = np.minimum(np.arange(len(ranks)) * BLOCK, self.n) - ranks
        block = np.where(one, np.searchsorted(ranks, k, "right"), np.searchsorted(none, k, "right")) - 1
        left = k - np.where(one, ranks[block], none[block])
        words = self.planes[level].need(block * step).view(np.uint64).reshape(-1, BLOCK // 64)
        out = np.empty(len(k), np.int64)
        for lo in range(0, len(k), 4096):
            at, rest = block[lo:lo + 4096], left[lo:lo + 4096]
            own = words[at] ^ np.where(one[lo:lo + 4096], np.uint64(0), ~np.uint64(0))[:, None]  # sought bits are ones
            upto, row = np.cumsum(np.bitwise_count(own), axis=1, dtype=np.int64), np.arange(len(at))
            word = (upto > rest[:, None]).argmax(1)
            rest = rest - np.where(word > 0, upto[row, word - 1], 0)
            bits = np.unpackbits(own[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            out[lo:lo + 4096] = at * BLOCK + 64 * word + (np.cumsum(bits, axis=1, dtype=np.uint8) > rest[:, None]).argmax(1)
        return out

    def count(self, value: int, first: int = 0, last: int | None = None) -> int:
        """Occurrences of value among places first .. last - 1."""
        return int(self.counts(value, first, self.n if last is None else last)[0])

    def select(self, value: int, k: int) -> int:
        """Place of the kth occurrence of value (k from 0); IndexError where there are fewer."""
        at = int(self.selects(value, k)[0])
        if at < 0:
            raise IndexError(k)
        return at

    def tokens(self) -> np.ndarray:
        """All values in order: the planes undone from the last to the first."""
        a = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        up = np.empty_like(a)
        for level in range(len(self.planes) - 1, -1, -1):
            one = np.unpackbits(self.planes[level].need(), count=self.n, bitorder="little").view(bool)
            zero, i, j = ~one, 0, self.zeros[level]
            a[j:] |= a.dtype.type(1 << (len(self.planes) - 1 - level))
            for lo in range(0, self.n, DEALT):
                part = up[lo:lo + DEALT]
                places = zero[lo:lo + DEALT].nonzero()[0]
                part[places] = a[i:i + len(places)]
                i += len(places)
                places = one[lo:lo + DEALT].nonzero()[0]
                part[places] = a[j:j + len(places)]
                j += len(places)
            a, up = up, a
        return a

    def to_bytes(self) -> bytes:
        parts = [struct.pack("<QI", self.n, len(self.planes))]
        for plane, zero, rank in zip(self.planes, self.zeros, self.ranks):
            ranks = zstandard.ZstdCompressor(level=1).compress(np.diff(rank, prepend=np.uint32(0)).astype("<u2").tobytes())
            parts += [struct.pack("<QQQQ", zero, plane.size, len(rank), len(ranks)), ranks, np.array([len(p) for p in plane.parts], "<u4").tobytes(), *plane.parts]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, raw: bytes, at: int = 0) -> WaveletMatrix:
        n, width = struct.unpack_from("<QI", raw, at)
        at += 12
        planes, zeros, ranks = [], [], []
        for _ in range(width):
            zero, size, entries, packed = struct.unpack_from("<QQQQ", raw, at)
            at += 32
            steps = zstandard.ZstdDecompressor().decompress(raw[at:at + packed], max_output_size=2 * entries)
            ranks.append(np.cumsum(np.frombuffer(steps, "<u2"), dtype=np.uint32))
            zeros.append(zero)
            at += packed
            sizes = np.frombuffer(raw, "<u4", -(-size // PIECE), at).tolist()
            at += 4 * len(sizes)
            parts = []
            for k in sizes:
                parts.append(raw[at:at + k])
                at += k
            planes.append(Plane(size, parts))
        return cls(n, planes, zeros, ranks)


def shard_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard: documents' ids and lengths, then the wavelet matrix of their token ids."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    head = zlib.compress(known.tobytes() + numbers.tobytes() + np.asarray(lengths, "<u4").tobytes(), 1)
    return MAGIC + struct.pack("<QQ", len(doc_ids), len(head)) + head + WaveletMatrix.build(ids).to_bytes()


def read_shard(raw: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    if raw[:8] != MAGIC:
        raise ValueError("not a shard file")
    n, size = struct.unpack_from("<QQ", raw, 8)
    head = zlib.decompress(raw[24:24 + size])
    known = np.frombuffer(head, np.uint8, n)
    numbers = np.frombuffer(head, "<i8", n, n)
    lengths = np.frombuffer(head, "<u4", n, 9 * n).astype(np.int64)
    return [int(d) if k else None for d, k in zip(numbers, known)], lengths, WaveletMatrix.from_bytes(raw, 24 + size)


SHARD_SCHEMA = "part int, shard long, before long, n_docs long, n_tokens long, file binary"


def encoded(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n and the n ids of each text with the end id behind them: two bytes each, or four with a larger vocabulary."""
    def run(batches):
        cache = library_cache(tokenizer)
        kind = np.dtype("<u2" if max(cache.top, end_id) < 1 << 16 else "<u4")
        for b in batches:
            data, offsets = text_bytes(b["text"])
            for i, j in slices(offsets, TOKEN_SLICE_BYTES):
                ids, at = cache.rows(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                # the end id goes in after each row
                ids, n = np.insert(ids, at[1:], end_id).astype(kind), np.diff(at) + 1
                bounds = np.concatenate([[0], np.cumsum(n * kind.itemsize)]).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(bounds), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([b["id"].slice(i, j - i), pa.array(n), raw], ["id", "n", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(tidy(run, tokenizer), "id long, n long, ids binary")


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The table of shard files, written: part, shard, before (ids before it in its part), n_docs, n_tokens, file."""
    def run(batches):
        part = TaskContext.get().partitionId()
        held: list = [[], [], [], 0]
        shard = before = 0

        def flush():
            nonlocal held, shard, before
            doc_ids, lengths, ids, n = held
            raw = shard_file(doc_ids, np.array(lengths), np.concatenate(ids))
            row = [[part], [shard], [before], [len(doc_ids)], [n], [raw]]
            held, shard, before = [[], [], [], 0], shard + 1, before + n
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, (pa.int32(), *[pa.int64()] * 4, pa.binary()))], ["part", "shard", "before", "n_docs", "n_tokens", "file"])

        for b in batches:
            if not len(b):
                continue
            doc_ids, lengths = b["id"].to_pylist(), b["n"].to_numpy()
            data, _ = text_bytes(b["ids"])
            ids = data.view(np.dtype(f"<u{len(data) // int(lengths.sum())}"))
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            first = 0
            while first < len(b):
                room = shard_tokens - held[3]
                last = int(np.searchsorted(bounds, bounds[first] + room, "right")) - 1
                if last <= first and held[3]:
                    yield flush()
                    continue
                last = min(len(b), max(first + 1, last))
                held[0] += doc_ids[first:last]
                held[1] += lengths[first:last].tolist()
                held[2].append(ids[bounds[first]:bounds[last]].copy())
                held[3] += int(bounds[last] - bounds[first])
                first = last
                if held[3] >= shard_tokens:
                    yield flush()
        if held[3]:
            yield flush()

    # written first, as Spark looks at what it deals by ranges twice
    rows = written(encoded(docs, tokenizer, end_id, id_col, text_col).withColumn("h", F.xxhash64("ids")), "ids")
    order = [F.col("id").asc_nulls_first(), F.col("h").asc()]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "ids").select("id", "n", "ids")
    return written(dealt.mapInArrow(tidy(run), SHARD_SCHEMA), "wavelet", maxRecordsPerFile=1, compression="uncompressed")


def read_documents(shards: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32, first_id, n_first, last_first.

    first_id is read by ``access``; n_first is how often it stands in the document, by ``count``; last_first is the place
    in the document where it stands last, by ``select``.
    """
    names = ["part", "doc_id", "start", "n_tokens", "ids_crc32", "first_id", "n_first", "last_first"]

    def run(batches):
        for b in batches:
            for part, before, raw in zip(b["part"].to_pylist(), b["before"].to_pylist(), b["file"]):
                doc_ids, lengths, matrix = read_shard(raw.as_py())
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                a, e = bounds[:-1], bounds[1:]
                first = matrix.access(a)
                upto, earlier = matrix.counts(np.tile(first, 2), 0, np.concatenate([e, a])).reshape(2, -1)
                n_first = upto - earlier
                last = matrix.selects(first, upto - 1) - a
                view = memoryview(matrix.tokens().astype("<u4")).cast("B")
                crc = [zlib.crc32(view[4 * x:4 * y]) for x, y in zip(a.tolist(), e.tolist())]
                columns = [pa.array([part] * len(crc), pa.int32()), pa.array(doc_ids, pa.int64()), *(pa.array(x, pa.int64()) for x in (a + before, lengths, crc, first, n_first, last))]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = shards.mapInArrow(tidy(run), "part int, " + ", ".join(f"{c} long" for c in names[1:]))
    # one row per partition of the writer, as many as it had tasks
    sizes = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = sizes.select(F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return rows.join(F.broadcast(base), F.col("part") == F.col("p")).select("doc_id", (F.col("start") + F.col("base")).alias("start"), *names[3:])


def find_token(shards: DataFrame, token: int) -> DataFrame:
    """Where a token id stands: doc_id, place (in the document) of each occurrence, found in the files by count and select."""
    def run(batches):
        for b in batches:
            for raw in b["file"]:
                doc_ids, lengths, matrix = read_shard(raw.as_py())
                bounds, n = np.concatenate([[0], np.cumsum(lengths)]), matrix.count(token)
                for lo in range(0, n, 100_000):
                    at = matrix.selects(token, np.arange(lo, min(n, lo + 100_000)))
                    row = np.searchsorted(bounds, at, "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array([doc_ids[r] for r in row.tolist()], pa.int64()), pa.array(at - bounds[row])], ["doc_id", "place"])

    return shards.select("file").mapInArrow(tidy(run), "doc_id long, place long")


def op5_wavelet_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_documents(write_shards(docs, tokenizer_path("word_bpe_49k.json"), end_id=2))
