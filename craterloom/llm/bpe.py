"""Byte-level BPE as a bounded-lookahead streaming transducer, and an incremental decoder.

Encoding.  Text comes in blocks.  :class:`Encoder` cuts it into pre-tokens, holding back only the few
characters that later text can still regroup, and hands a pre-token's bytes to a :class:`Transducer`
as they come, also of a pre-token that has not ended.  The merge list fixes a *sufficient lookahead*:
a number of bytes L such that tokens which end L bytes or more before the end of what
has been read can't change with what follows (see :func:`sufficient_lookahead`).  Such tokens are
emitted, and the rest of the buffer is tokenized anew with the next block, as the BPE tokens of a
text from a token border on are the BPE tokens of that rest.  The buffer never holds more than
BLOCK + L bytes plus one token, so a text of any length, and a pre-token of any length, needs constant
memory.  No other code of this module makes ids.

Decoding.  Token bytes run through a UTF-8 state machine that holds back an incomplete last
character (three bytes at most) until the next token; bytes that can't be a character become U+FFFD.

Short texts are cut into chunks first (see chunks.py), at places where the encoder holds nothing back, and a
chunk's ids are cached per worker; texts over TOKEN_SLICE_BYTES are streamed in blocks of STEP
bytes.  Either way ids and decoded text go into running digests.

Defined results
---------------
* A null text counts as empty: no ids, an empty decoded text.  Special tokens written out in a text
  become their ids, as the library does it.  Repeated rows get equal results; an empty table gives
  no rows; columns besides the two named ones are not looked at.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from craterloom.llm.chunks import ChunkCache, in_order, ragged, tokenizer_path
from craterloom.llm.core import CACHES, TOKEN_SLICE_BYTES, slices, text_bytes, tidy

BLOCK, STEP = 1024, 1 << 16
#: Characters of one unfinished pre-token that are held before they are handed on.
HOLD = 2048
#: Fixed value: the published pre-tokenizer pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[int, int]], made: list[int], length: dict[int, int]) -> int:
    """Bytes after a token's end that can still decide about it, from the merge list alone.

    Rule r = (u, v) joins u to what stands at its right.  To know whether it applies one must see v
    (its bytes), and know that v comes to be and is not taken by an earlier rule (v, x) first; v comes
    to be by the one rule that makes it, whose own right part may in turn be taken by earlier rules.
    Earlier rules have smaller ranks, so going through the list in order settles every reach.
    """
    taken: dict[int, int] = {}  # token -> most bytes beyond its end that an earlier rule (token, x) has to see
    open_end: dict[int, int] = {}  # token -> most bytes beyond its end that decide whether it comes to be
    longest = 0
    for (u, v), t in zip(merges, made):
        beyond = max(taken.get(v, 0), open_end.get(v, 0))
        reach = length[v] + beyond
        taken[u] = max(taken.get(u, 0), reach)
        open_end[t] = max(open_end.get(t, 0), beyond)
        longest = max(longest, reach)
    return longest


class Bpe:
    """A tokenizers file's byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, of_symbol = spec["model"], {s: b for b, s in enumerate(byte_symbols())}
        vocab = model["vocab"]
        as_bytes = lambda s: bytes(of_symbol[c] for c in s)
        self.bytes_of: dict[int, bytes] = {i: as_bytes(s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.first = [vocab[s] for s in byte_symbols()]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        merges = [(vocab[a], vocab[b]) for a, b in pairs]
        made = [vocab[a + b] for a, b in pairs]
        self.rule = {m: (rank, t) for rank, (m, t) in enumerate(zip(merges, made))}
        self.whole = {b: i for i, b in self.bytes_of.items()}
        self.lookahead = sufficient_lookahead(merges, made, {i: len(b) for i, b in self.bytes_of.items()})
        self.pattern = regex.compile(PATTERN)
        self.marks = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.seen: dict[str, list[int]] = {}

    def merged(self, raw: bytes) -> list[int]:
        """BPE of a byte string held in memory."""
        ids = [self.first[b] for b in raw]
        if len(ids) > 48:
            return self._merged_long(ids)
        rule, none = self.rule.get, (1 << 30, 0)
        ranks = [rule(p, none) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best is none or best[0] == none[0]:
                break
            i = ranks.index(best)
            ids[i:i + 2] = [best[1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rule((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = rule((ids[i], ids[i + 1]), none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        n, rule = len(ids), self.rule.get
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := rule((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        alive = [True] * n
        while queue:
            _, i, a, b, t = heapq.heappop(queue)
            j = right[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = t, False
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
                if r := rule((t, ids[right[i]])):
                    heapq.heappush(queue, (r[0], i, t, ids[right[i]], r[1]))
            if (k := left[i]) >= 0 and (r := rule((ids[k], t))):
                heapq.heappush(queue, (r[0], k, ids[k], t, r[1]))
        return [x for x, ok in zip(ids, alive) if ok]

    def stream(self, blocks: Iterable[bytes]) -> Iterator[int]:
        """Ids of one pre-token that comes in blocks: each is emitted once it is stable."""
        machine = Transducer(self)
        for block in blocks:
            yield from machine.push(block)
        yield from machine.end()

    def pretoken(self, text: str) -> list[int]:
        ids = self.seen.get(text)
        if ids is None:
            raw = text.encode("utf-8")
            ids = list(self.stream([raw]))
            if len(raw) <= 32:
                if len(self.seen) >= 200_000:
                    self.seen.clear()
                self.seen[text] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        encoder = Encoder(self)
        return encoder.feed(text) + encoder.close()

    def encode_many(self, texts: list[str]):
        return in_order(list(map(self.encode, texts)))

    def decode(self, ids: Iterable[int]) -> str:
        machine = Utf8Machine()
        return "".join(machine.feed(self.bytes_of[int(i)]) for i in ids) + machine.close()


class Transducer:
    """Bytes of one pre-token in, stable ids out; state: the bytes whose tokens later bytes may change."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.buffer = bpe, b""

    def push(self, raw: bytes) -> list[int]:
        bpe, out = self.bpe, []
        for i in range(0, len(raw), BLOCK):
            self.buffer += raw[i:i + BLOCK]
            if len(self.buffer) <= bpe.lookahead:
                continue
            at = 0
            for t in bpe.merged(self.buffer):
                end = at + len(bpe.bytes_of[t])
                if end + bpe.lookahead > len(self.buffer):
                    break
                out.append(t)
                at = end
            self.buffer = self.buffer[at:]
        return out

    def end(self) -> list[int]:
        rest, self.buffer = self.buffer, b""
        return self.bpe.merged(rest)


class Encoder:
    """Text in, ids out, block by block; state: the beginning of a special token, of a pre-token, and a transducer.

    A pre-token is certain once two characters stand behind it (an apostrophe's group needs to see two
    more).  One that grows beyond HOLD characters is a run of one kind, and all but its last characters go on to
    the transducer; the kind then tells how far it goes on.
    """

    #: How a run of each kind goes on.
    GOES_ON = {kind: regex.compile(rf"{kind}*") for kind in (r"\p{L}", r"\p{N}", r"\s", r"[^\s\p{L}\p{N}]")}
    AHEAD, BACK = 2, 4

    def __init__(self, bpe: Bpe):
        self.bpe, self.mark, self.rest, self.open, self.machine = bpe, "", "", None, Transducer(bpe)

    def feed(self, text: str) -> list[int]:
        out: list[int] = []
        if self.bpe.marks:
            text = self.mark + text
            while m := self.bpe.marks.search(text):
                out += self._cut(text[:m.start()], True)
                out.append(self.bpe.special[m[0]])
                text = text[m.end():]
            begun = max((k for s in self.bpe.special for k in range(1, min(len(s), len(text) + 1)) if text.endswith(s[:k])), default=0)
            text, self.mark = text[:len(text) - begun], text[len(text) - begun:]
        return out + self._cut(text, False)

    def close(self) -> list[int]:
        last, self.mark = self.mark, ""
        return self._cut(last, True)

    def _cut(self, text: str, last: bool) -> list[int]:
        """Ids that text makes certain; last: nothing of this stretch follows."""
        text, self.rest = self.rest + text, ""
        out: list[int] = []
        at, sure = 0, len(text) if last else len(text) - self.AHEAD
        if self.open:
            at = self.open.match(text).end()
            if at > sure:
                return self._hand_on(text)
            if self.open is self.GOES_ON[r"\s"] and at < len(text):
                at -= 1  # a run's last blank goes with what follows
            out += self.machine.push(text[:at].encode("utf-8")) + self.machine.end()
            self.open = None
        for m in self.bpe.pattern.finditer(text, at):
            if m.end() > sure:
                break
            out += self.bpe.pretoken(m[0])
            at = m.end()
        text = text[at:]
        if len(text) > HOLD:
            begin = text[1] if text[0] == " " and not self.GOES_ON[r"\s"].match(text[1]).end() else text[0]
            self.open = next(k for k in self.GOES_ON.values() if k.match(begin).end())
            return out + self._hand_on(text)
        self.rest = text
        return out

    def _hand_on(self, text: str) -> list[int]:
        """All but the last characters of an open run to the transducer."""
        cut = max(0, len(text) - self.BACK)
        self.rest = text[cut:]
        return self.machine.push(text[:cut].encode("utf-8"))


class Utf8Machine:
    """Bytes in, text out; state: the bytes of a character that has begun and not ended."""

    def __init__(self):
        self.held = b""

    #: first byte -> (bytes of the character, lowest and highest second byte)
    LEADS = {b: (2, 0x80, 0xBF) for b in range(0xC2, 0xE0)} | {b: (3, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF) for b in range(0xE0, 0xF0)} | {
        b: (4, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF) for b in range(0xF0, 0xF5)}

    def feed(self, raw: bytes) -> str:
        raw = self.held + raw
        keep = self._begun(raw)
        cut = len(raw) - keep
        self.held = raw[cut:]
        return raw[:cut].decode("utf-8", "replace")

    def _begun(self, raw: bytes) -> int:
        """Bytes at the end that are the beginning of a character."""
        for back in range(1, min(3, len(raw)) + 1):
            b = raw[-back]
            if b < 0x80:
                return 0
            if b >= 0xC0:
                need, low, high = self.LEADS.get(b, (0, 0, 0))
                return back if back < need and (back < 2 or low <= raw[-back + 1] <= high) else 0
        return 0

    def close(self) -> str:
        rest, self.held = self.held.decode("utf-8", "replace"), b""
        return rest


class _Worker:
    """A worker's encoder with its chunk cache, decimal ids of chunks and table of token bytes."""

    def __init__(self, path: str):
        self.bpe = Bpe(path)
        self.cache = ChunkCache(self.bpe.encode_many)
        top = max(self.bpe.bytes_of) + 1
        parts = [self.bpe.bytes_of.get(i, b"") for i in range(top)]
        self.length = np.array([len(p) for p in parts])
        self.start = np.cumsum(self.length) - self.length
        self.pool = np.frombuffer(b"".join(parts), np.uint8)
        digits = [b"%d," % i for i in range(top)]
        self.digit_length = np.array([len(p) for p in digits])
        self.digit_start = np.cumsum(self.digit_length) - self.digit_length
        self.digits = np.frombuffer(b"".join(digits), np.uint8)


_WORKERS: dict[str, _Worker] = {}


def _worker(path: str) -> _Worker:
    if path not in _WORKERS:
        worker = _WORKERS[path] = _Worker(path)
        CACHES[path] = lambda: (worker.cache.reset(), worker.bpe.seen.clear())
    return _WORKERS[path]


class _Digests:
    """Running digests of a text's ids and of what they decode to; with keep, both themselves too."""

    def __init__(self, worker: _Worker, keep: bool):
        self.worker, self.keep = worker, keep
        self.n, self.ids_sha, self.text_sha, self.machine = 0, hashlib.sha256(), hashlib.sha256(), Utf8Machine()
        self.ids: list[int] = []
        self.texts: list[str] = []

    def add(self, n: int, decimal: bytes, raw: bytes) -> None:
        """n ids, given in decimal with a comma behind each, and their bytes."""
        if n:
            self.ids_sha.update((b"," if self.n else b"") + bytes(decimal[:-1]))
            self.n += n
            self._text(self.machine.feed(bytes(raw)))

    def ids_of(self, ids: list[int]) -> None:
        w = self.worker
        self.add(len(ids), b"".join([b"%d," % i for i in ids]), b"".join([w.bpe.bytes_of[i] for i in ids]))
        if self.keep:
            self.ids += ids

    def _text(self, text: str) -> None:
        self.text_sha.update(text.encode("utf-8"))
        if self.keep:
            self.texts.append(text)

    def done(self) -> list:
        self._text(self.machine.close())
        return [self.n, self.ids_sha.hexdigest(), self.text_sha.hexdigest()] + [self.ids, "".join(self.texts)] * self.keep


def _streamed(worker: _Worker, raw: np.ndarray, keep: bool) -> list:
    """A long text's results: blocks of STEP bytes through the encoder and the decoder."""
    out, encoder, chars = _Digests(worker, keep), Encoder(worker.bpe), codecs.getincrementaldecoder("utf-8")()
    for i in range(0, len(raw), STEP):
        out.ids_of(encoder.feed(chars.decode(raw[i:i + STEP].tobytes())))
    out.ids_of(encoder.close())
    return out.done()


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, slice_bytes: int = TOKEN_SLICE_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with keep, ids and decoded themselves."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32()), pa.string()] * keep

    def run(batches):
        w = _worker(tokenizer)
        for b in batches:
            doc_ids = b["id"].to_pylist()
            data, offsets = text_bytes(b["text"])
            for i, j in slices(offsets, slice_bytes):
                part = data[offsets[i]:offsets[j]]
                if len(part) > slice_bytes:
                    rows = [_streamed(w, part, keep)]
                else:
                    ids, at = w.cache.rows(part, offsets[i:j + 1] - offsets[i])
                    size, shown = w.length[ids], w.digit_length[ids]
                    raw = w.pool[ragged(w.start[ids], size)] if len(ids) else w.pool[:0]
                    decimal = w.digits[ragged(w.digit_start[ids], shown)] if len(ids) else w.digits[:0]
                    raw_at, decimal_at = (np.concatenate([[0], np.cumsum(x)])[at].tolist() for x in (size, shown))
                    raw, decimal, rows = memoryview(raw), memoryview(decimal), []
                    for k in range(j - i):
                        out = _Digests(w, keep)
                        out.add(int(at[k + 1] - at[k]), decimal[decimal_at[k]:decimal_at[k + 1]], raw[raw_at[k]:raw_at[k + 1]])
                        out.ids = ids[at[k]:at[k + 1]]
                        rows.append(out.done())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([doc_ids[i:j], *zip(*rows)], kinds)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep
    return rows.mapInArrow(tidy(run, tokenizer), schema)


def op4_bpe_stream(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs, tokenizer_path("byte_bpe_50k.json"))
