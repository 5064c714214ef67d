"""Repeated substrings by two-stage suffix sorting.

Suffixes of type B (smaller than their successor) are sorted directly; those of type A (larger) are
induced from them by one scan over the buckets of first bytes: whatever is read off the array at j,
if the suffix at j - 1 is of type A, that one is next in the A part of its own bucket.  Adjacent
common prefixes of the result show which windows of WIDTH bytes stand more than once.

One array over a whole corpus fits no task, so windows are first dealt by content.  Each window's
*anchor* is its K-byte substring of least hash (the leftmost, if equal): equal windows have equal
anchors at equal places.  Neighbouring windows with one anchor place form a context.  Hashes only
deal: what is equal, bytes decide, in every step.

1. One pass over the texts cuts all contexts and writes down their places and anchors, a row for each
   text.  Contexts of one slice of text with the same bytes are folded to one; all are repeated.
2. Anchors are counted.  Only contexts whose anchor stands more than once go on, with their bytes.
   Those with the same bytes are folded again, before they are dealt and where they meet.
3. The different contexts of an anchor meet in one task, which sorts their suffixes and reads off the
   repeated windows.  The contexts of an anchor with over MANY of them are dealt window by window, by
   a hash of the whole window, so that no task holds more than MANY contexts of one anchor.
4. A text's repeated windows are merged to spans, and what they cover is removed.

Defined results
---------------
* A null text counts as empty.  Texts of fewer bytes than WIDTH have no window and lose nothing.
* Repeated rows and copies lose all their windows, in every copy, the first included.
* Rows are told apart by id and content; rows that share both get equal results.
* An empty table gives no rows.  Other columns may have any names; those named as a result column
  are replaced by it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from craterloom.llm.core import Rolling, mix, text_bytes, tidy, written

WIDTH, K = 200, 48
#: Bytes of text whose contexts are cut at once; positions inside have 24 bits.
SLICE = 1 << 20
#: Contexts of one anchor beyond which windows are dealt singly.
MANY = 5_000
#: Bytes of contexts that are sorted in one array, if their anchors' contexts are not more by themselves.
ARRAY_BYTES = 1 << 20

_ANCHOR, _CONTENT = Rolling(21), Rolling(22)


# --- the sort ---------------------------------------------------------------------------------


def _words(text: np.ndarray, nbytes: int) -> np.ndarray:
    """Big-endian number of the nbytes bytes at each place; beyond the end: 0."""
    out = np.zeros(len(text), np.uint64)
    for i in range(nbytes):
        out <<= np.uint64(8)
        out[:max(0, len(text) - i)] |= text[i:].astype(np.uint64)
    return out


def _sorted_directly(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their first depth bytes: five bytes a round, only ties go on."""
    if not len(places):
        return places
    top = len(words) - 1
    group = np.zeros(len(places), np.uint64)
    slot = np.arange(len(places))  # where the open places go in the result
    out, open_ = places.copy(), places
    for d in range(0, depth, 5):
        key = group << np.uint64(40) | words[np.minimum(open_ + d, top)]
        order = np.argsort(key)
        key, open_ = key[order], open_[order]
        out[slot] = open_
        new = np.empty(len(key), bool)
        new[0] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        last = np.append(new[1:], True)
        tied = ~(new & last)
        if not tied.any():
            break
        group = (np.cumsum(new) - 1).astype(np.uint64)[tied]
        open_, slot = open_[tied], slot[tied]
        group = (np.cumsum(np.append(True, group[1:] != group[:-1])) - 1).astype(np.uint64)
    return out


def two_stage_sort(text: np.ndarray, wanted: np.ndarray, depth: int = WIDTH) -> np.ndarray:
    """The wanted places of text (a mask) in the order of their first depth bytes at least.

    text: uint8, with 0 only as an end mark (the caller shifts what it has).  Places that are needed
    to induce the wanted ones are sorted along and left out of the result.
    """
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    # type B: the first differing byte to the right is larger; the very end and end marks count as B
    change = np.flatnonzero(text[1:] != text[:-1])
    nxt = np.full(n, n - 1)
    if len(change):
        runs = np.searchsorted(change, np.arange(n - 1))
        inside = runs < len(change)
        nxt[:-1][inside] = change[runs[inside]] + 1
    is_b = text < text[nxt]
    is_b[text == 0] = True
    is_b[nxt == n - 1] |= text[nxt[nxt == n - 1]] == text[nxt == n - 1]
    # each wanted type A place needs the places up to the next type B one
    next_b = np.flatnonzero(is_b)
    at = np.flatnonzero(wanted)
    at = at[~is_b[at]]
    used = wanted.copy()
    if len(at):
        stop = next_b[np.minimum(np.searchsorted(next_b, at), len(next_b) - 1)]
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, at, 1)
        np.add.at(edge, stop + 1, -1)
        used |= np.cumsum(edge[:-1]) > 0
    words = _words(text, 5)
    direct = _sorted_directly(np.flatnonzero(used & is_b), words, depth)
    first = text[direct]
    cuts = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        part = np.concatenate(waiting[c]) if waiting[c] else direct[:0]
        waiting[c] = []
        full, wave = [part], part
        while len(wave):  # A suffixes that begin with c and whose successor does so too
            wave = wave[wave > 0] - 1
            wave = wave[used[wave] & (text[wave] == c)]
            full.append(wave)
        here = np.concatenate([*full, direct[cuts[c]:cuts[c + 1]]])
        if not len(here):
            continue
        out.append(here)
        before = here[here > 0] - 1
        before = before[used[before] & (text[before] > c)]
        if len(before):
            chars = text[before]
            order = np.argsort(chars, kind="stable")
            before, chars = before[order], chars[order]
            borders = np.flatnonzero(np.append(True, chars[1:] != chars[:-1]))
            for a, b in zip(borders.tolist(), [*borders[1:].tolist(), len(before)]):
                waiting[chars[a]].append(before[a:b])
    result = np.concatenate(out) if out else direct
    return result[wanted[result]]


def adjacent_prefixes(text: np.ndarray, order: np.ndarray, depth: int = WIDTH) -> np.ndarray:
    """Common prefix, up to depth, of each place in the order and the one before; the first has 0."""
    out = np.zeros(len(order), np.int64)
    a, b = order[1:], order[:-1]
    alive, words, top = np.arange(1, len(order)), _words(text, 8), len(text) - 1
    for d in range(0, depth, 8):
        x, y = words[np.minimum(a + d, top)], words[np.minimum(b + d, top)]
        diff = x ^ y
        same = diff == 0
        out[alive[same]] += 8
        odd = ~same
        if odd.any():  # whole bytes before the first differing one
            lead = np.zeros(int(odd.sum()), np.int64)
            rest = diff[odd]
            for k in range(7):
                lead += (rest >> np.uint64(8 * (7 - k) if k < 7 else 0) == 0)
            out[alive[odd]] += lead
        alive, a, b = alive[same], a[same], b[same]
        if not len(alive):
            break
    return np.minimum(out, depth)


def repeated_windows(contexts: list[bytes], starts: list[int], width: int = WIDTH) -> list[np.ndarray]:
    """For each context, which of its first ``starts`` windows stand elsewhere in the contexts too."""
    size = np.array([len(c) for c in contexts])
    at = np.concatenate([[0], np.cumsum(size + 1)])
    raw = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    text = raw
    if b"\xff" in (joined := raw.tobytes()) or joined.count(b"\0") > len(contexts):
        # bytes 0 and 255: code each byte so that 0 stays free; 255 never stands in UTF-8
        text = (raw + 1).astype(np.uint8)
        text[at[1:] - 1] = 0
    wanted = np.zeros(len(text), bool)
    for a, n in zip(at.tolist(), starts):
        wanted[a:a + n] = True
    order = two_stage_sort(text, wanted, width)
    long = adjacent_prefixes(text, order, width) >= width
    hit = np.zeros(len(text), bool)
    hit[order[long]] = True
    hit[order[:-1][long[1:]]] = True
    return [hit[a:a + n] for a, n in zip(at.tolist(), starts)]


# --- contexts ---------------------------------------------------------------------------------


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width neighbouring keys."""
    m, have = key, 1
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[:len(m) - rest], m[rest:]) if rest else m


def contexts(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, k: int = K, anchor: Rolling = _ANCHOR):
    """Contexts of all rows of a slice: row, first window (its place in the data), windows, anchor hash."""
    none = np.empty(0, np.int64)
    if len(data) < width:
        return none, none, none, none
    gram = anchor.fixed(anchor.prefix(data), k)
    key = gram >> np.uint64(24) << np.uint64(24) | np.arange(len(gram), dtype=np.uint64)
    place = (_least(key, width - k + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    valid = np.zeros(len(data) + 1, np.int32)
    size = np.diff(offsets)
    held = np.flatnonzero(size >= width)
    valid[offsets[held]] += 1
    valid[offsets[held] + size[held] - width + 1] -= 1
    at = np.flatnonzero(np.cumsum(valid[:-1]))
    if not len(at):
        return none, none, none, none
    p = place[at]
    row = np.searchsorted(offsets, at, "right") - 1
    new = np.append(True, (p[1:] != p[:-1]) | (row[1:] != row[:-1]))
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    return row[first], at[first], n, gram[p[first]].view(np.int64)


def same_bytes(data: np.ndarray, x: np.ndarray, y: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the bytes from x on and those from y on are equal, length of them, for each entry."""
    words, top, out = _words(data, 8), len(data) - 1, np.ones(len(x), bool)
    alive = np.arange(len(x))
    for d in range(0, int(length.max(initial=0)), 8):
        alive = alive[length[alive] > d]
        rest = np.minimum(8, length[alive] - d).astype(np.uint64)
        diff = words[np.minimum(x[alive] + d, top)] ^ words[np.minimum(y[alive] + d, top)]
        bad = diff >> (np.uint64(64) - np.uint64(8) * rest) != 0
        out[alive[bad]] = False
        alive = alive[~bad]
    return out


def folded(data: np.ndarray, start: np.ndarray, n: np.ndarray, a: np.ndarray, width: int, content: Rolling):
    """Contexts of a slice with the same bytes: which one stands for the others, and which have an equal one.

    The hash puts equal ones side by side; if it does not, they are folded later.
    """
    c = content.ranges(content.prefix(data), start, start + n + (width - 1))
    order = np.lexsort((start, n, c, a))
    x, y = order[:-1], order[1:]
    near = np.flatnonzero((a[x] == a[y]) & (c[x] == c[y]) & (n[x] == n[y]))
    equal = np.zeros(len(order), bool)  # to the one before in the order
    equal[near + 1] = same_bytes(data, start[x[near]], start[y[near]], n[x[near]] + (width - 1))
    twice, head = np.zeros(len(order), bool), np.zeros(len(order), bool)
    twice[order] = equal | np.append(equal[1:], False)
    head[order] = ~equal
    return head, twice


def _parts(data: np.ndarray, offsets: np.ndarray, width: int, size: int = SLICE):
    """Slices of the rows: (first row, last, the slice's place in the data, its start in the row)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1))
        if offsets[j] - offsets[i] <= 4 * size:
            yield i, j, int(offsets[i]), int(offsets[j]), 0
        else:  # one very long row, in parts that overlap so that no window is lost
            for a in range(int(offsets[i]), int(offsets[j]) - width + 1, size):
                yield i, j, a, min(int(offsets[j]), a + size + width - 1), a - int(offsets[i])
        i = j


def merged(ranges: np.ndarray) -> np.ndarray:
    """Sorted disjoint ranges, not touching, that cover what the given (m, 2) ranges cover."""
    if len(ranges) < 2:
        return ranges.reshape(-1, 2)
    r = ranges[np.lexsort((ranges[:, 1], ranges[:, 0]))]
    end = np.maximum.accumulate(r[:, 1])
    new = np.append(True, r[1:, 0] > end[:-1])
    first = np.flatnonzero(new)
    return np.stack([r[first, 0], end[np.append(first[1:], len(r)) - 1]], 1)


RUN = pa.struct([("a", pa.int64()), ("s", pa.int32()), ("n", pa.int32()), ("twice", pa.bool_())])


def _cut(rows: DataFrame, width: int, anchor: Rolling, content: Rolling, slice_bytes: int) -> DataFrame:
    """uid, id, k1, k2, runs (contexts to be dealt) and spans that are repeated for sure, of every row."""
    def run(batches):
        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            data, offsets = text_bytes(b["text"])
            m = len(offsets) - 1
            runs: list[list[np.ndarray]] = []
            spans: dict[int, list[tuple]] = {}
            for i, j, lo, hi, shift in _parts(data, offsets, width, slice_bytes):
                part_of_row = shift or hi - lo < offsets[j] - offsets[i]
                own = np.array([0, hi - lo]) if part_of_row else offsets[i:j + 1] - lo
                row, at, n, a = contexts(data[lo:hi], own, width, anchor=anchor)
                if not len(row):
                    continue
                head, twice = folded(data[lo:hi], at, n, a, width, content)
                row, s = row + i, at - own[row] + shift
                for r, x, y in zip(row[twice].tolist(), s[twice].tolist(), (s + n)[twice].tolist()):
                    spans.setdefault(r, []).append((x, y + width - 1))
                runs.append([x[head] for x in (row, s, n, a, twice)])
            if runs:
                row, s, n, a, twice = map(np.concatenate, zip(*runs))
            else:
                row = s = n = a = np.empty(0, np.int64)
                twice = np.empty(0, bool)
            order = np.argsort(row, kind="stable")
            bounds = np.searchsorted(row[order], np.arange(m + 1)).astype(np.int32)
            values = pa.StructArray.from_arrays([pa.array(x[order], t.type) for x, t in zip((a, s, n, twice), RUN)], fields=list(RUN))
            sure = [merged(np.array(spans[r])).tolist() if r in spans else [] for r in range(m)]
            sure = pa.array([[{"s": x, "e": y} for x, y in one] for one in sure], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))
            uid = np.arange(seen, seen + m) + (part << 40)
            seen += m
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid), b["id"], b["k1"], b["k2"], pa.ListArray.from_arrays(pa.array(bounds), values), sure], ["uid", "id", "k1", "k2", "runs", "sure"])

    return rows.mapInArrow(tidy(run), "uid long, id long, k1 long, k2 long, runs array<struct<a:long,s:int,n:int,twice:boolean>>, sure array<struct<s:long,e:long>>")


def _asked(cut: DataFrame, many: int) -> DataFrame:
    """uid and the contexts of that text whose anchor stands elsewhere too."""
    runs = cut.select("uid", F.inline("runs"))
    counts = runs.groupBy("a").agg(F.count("*").alias("m")).where("m > 1").select("a", (F.col("m") > many).alias("many"))
    return runs.join(counts, "a").groupBy("uid").agg(F.collect_list(F.struct("a", "s", "n", "twice", "many")).alias("asked"))


def _bytes(texts: DataFrame, width: int, content: Rolling) -> DataFrame:
    """The bytes of the contexts asked for, by the key under which they are sorted.

    Equal ones of a task are folded: all but one become spans, rows without bytes.  known: the row's
    own windows need no answer any more.
    """
    names = ["key", "uid", "s", "n", "known", "bytes"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]

    def run(batches):
        held: dict[tuple[int, bytes], list] = {}
        sure: list[tuple] = []
        size = 0

        def add(key: int, uid: int, s: int, n: int, known: bool, raw: bytes):
            nonlocal size
            if (old := held.get((key, raw))) is None:
                held[key, raw] = [uid, s, n, known]
                size += len(raw) + 200
                return
            if not known:
                sure.append((uid, uid, s, n, True, None))
            if not old[3]:
                old[3] = True
                sure.append((old[0], *old[:3], True, None))

        def flush():
            nonlocal size
            rows = [(key, *value, raw) for (key, raw), value in held.items()] + sure
            held.clear(), sure.clear()
            size = 0
            for i in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i:i + 10_000]), kinds)], names)

        for b in batches:
            data, offsets = text_bytes(b["text"])
            for r, (uid, asked) in enumerate(zip(b["uid"].to_pylist(), b["asked"].to_pylist())):
                own = data[offsets[r]:offsets[r + 1]]
                for x in asked:
                    s, n, a = x["s"], x["n"], x["a"]
                    raw = own[s:s + n + width - 1]
                    if not x["many"]:
                        add(a, uid, s, n, x["twice"], raw.tobytes())
                    else:
                        whole = mix(content.fixed(content.prefix(raw), width)[:n] ^ np.uint64(a & (2**64 - 1)))
                        for i, h in enumerate(whole.view(np.int64).tolist()):
                            add(h, uid, s + i, 1, x["twice"], raw[i:i + width].tobytes())
                    if size + 60 * len(sure) > 8 << 20:
                        yield from flush()
        yield from flush()

    return texts.mapInArrow(tidy(run), "key long, uid long, s int, n int, known boolean, bytes binary")


def sorted_spans(rows, width: int = WIDTH, array_bytes: int = ARRAY_BYTES):
    """Spans (uid, s, e) of repeated windows, in lists, from rows (key, uid, s, n, known, bytes) that come key by key.

    A row without bytes is a span already.
    """
    array: list[list] = []  # different contexts, of the keys that have several
    size, key, own = 0, None, {}
    out: list[tuple] = []

    def solve():
        hits = repeated_windows([x[4] for x in array], [x[2] for x in array], width)
        for (uid, s, _, known, _), hit in zip(array, hits):
            if not known and hit.any():
                at = np.flatnonzero(hit)
                out.extend((uid, s + x, s + y) for x, y in merged(np.stack([at, at + width], 1)).tolist())
        array.clear()

    for k, uid, s, n, known, raw in rows:
        if raw is None:
            out.append((uid, s, s + n + width - 1))
        else:
            if k != key:
                if len(own) > 1:
                    array += own.values()
                    size += sum(map(len, own))
                key, own = k, {}
                if size >= array_bytes:
                    solve()
                    size = 0
            if (old := own.get(raw)) is None:
                own[raw] = [uid, s, n, known, raw]
            else:  # the same bytes: both are repeated whole
                if not known:
                    out.append((uid, s, s + n + width - 1))
                if not old[3]:
                    old[3] = True
                    out.append((old[0], old[1], old[1] + old[2] + width - 1))
        if len(out) > 20_000:
            yield out
            out = []
    if len(own) > 1:
        array += own.values()
    if array:
        solve()
    if out:
        yield out


def _sort(dealt: DataFrame, width: int) -> DataFrame:
    def run(batches):
        rows = (r for b in batches for r in zip(*(b[x].to_pylist() for x in ("key", "uid", "s", "n", "known", "bytes"))))
        for spans in sorted_spans(rows, width):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*spans)], ["uid", "s", "e"])

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(run), "uid long, s long, e long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                   many: int = MANY, anchor: Rolling = _ANCHOR, content: Rolling = _CONTENT, slice_bytes: int = SLICE) -> DataFrame:
    """docs, all columns, with n_bytes, n_removed, n_spans, kept_sha256 and kept_text.

    kept_text is the remaining bytes as text; halves of characters that a span's border cut are left out.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2"), text.alias("text"))
    cut = written(_cut(rows, width, anchor, content, slice_bytes), "contexts")
    asked = written(_asked(cut, many), "asked").join(cut.select("uid", "id", "k1", "k2"), "uid")
    same = lambda x, y: x["id"].eqNullSafe(y["id"]) & (x["k1"] == y["k1"]) & (x["k2"] == y["k2"])
    # written, so that what was shuffled for the sort is gone before texts are dealt for the result
    spans = written(_sort(_bytes(rows.join(asked, same(rows, asked)).select(asked["uid"], "asked", rows["text"]), width, content), width), "sorted")
    spans = spans.groupBy("uid").agg(F.collect_list(F.struct("s", "e")).alias("more"))
    # rows that share id and content have equal sets of spans
    found = cut.select("uid", "id", "k1", "k2", "sure").join(spans, "uid", "left").where("size(sure) > 0 or more is not null")
    found = found.groupBy("id", "k1", "k2").agg(F.flatten(F.collect_set(F.concat("sure", F.coalesce("more", F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)"))))).alias("spans"))
    extra = {"n_bytes": LongType(), "n_removed": LongType(), "n_spans": LongType(), "kept_sha256": StringType(), "kept_text": StringType()}
    others = [c for c in docs.columns if c != text_col and c not in extra]
    whole = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2"),
        F.col(f"`{text_col}`").alias("text"), F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others))).alias("others"))
    joined = whole.join(found, same(whole, found), "left").select(whole["text"], whole["others"], found["spans"])
    schema = StructType([joined.schema["text"], joined.schema["others"], *(StructField(c, t) for c, t in extra.items())])

    def run(batches):
        for b in batches:
            data, offsets = text_bytes(b["text"])
            out: list[list] = [[], [], [], [], []]
            for r, spans in enumerate(b["spans"].to_pylist()):
                raw = data[offsets[r]:offsets[r + 1]]
                gone = merged(np.array([(x["s"], x["e"]) for x in spans or ()], np.int64).reshape(-1, 2))
                keep = raw.tobytes()
                if len(gone):
                    border = [0, *gone.ravel().tolist(), len(raw)]
                    keep = b"".join(keep[x:y] for x, y in zip(border[::2], border[1::2]))
                for column, value in zip(out, (len(raw), len(raw) - len(keep), len(gone), hashlib.sha256(keep).hexdigest(), keep.decode("utf-8", "ignore"))):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b["text"], b["others"], *(pa.array(x, k) for x, k in zip(out, kinds))], ["text", "others", *extra])

    place = {c: f"others.c{i}" for i, c in enumerate(others)} | {text_col: "text"}
    return joined.mapInArrow(tidy(run), schema).select(*(F.col(place[c]).alias(c) for c in docs.columns if c not in extra), *extra)


def op3_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
