"""Cuts texts where a tokenizer's pre-tokenizer surely cuts, and keeps the ids of each distinct chunk.

A cut stands before an ASCII white-space character that follows anything but white space, and before
a comma or full stop that follows an ASCII letter.  Neither of the two public BPE tokenizers lets a
token, a special token or a normalisation reach over such a place, so a text's ids are its chunks'
ids in a row; property tests hold this against the library.  Chunks repeat a lot, so each worker
keeps a bounded cache.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa

from craterloom.llm.core import CACHES

#: Entries and pooled ids after which a cache starts anew.
CACHE_CHUNKS, CACHE_IDS = 900_000, 9_000_000


def _space(data: np.ndarray) -> np.ndarray:
    """Whether each byte is ASCII white space; comparisons, as they are several times faster than a table."""
    return (data - np.uint8(9) < 5) | (data == 32)


def _letter(data: np.ndarray) -> np.ndarray:
    return (data | np.uint8(32)) - np.uint8(97) < 26


def _after_wide_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place is white space outside the six ASCII ones."""
    out = np.zeros(len(at), bool)
    last = data[at - 1]
    maybe = np.flatnonzero((last >= 0x80) | (last - np.uint8(0x1C) < 4))  # few
    at, p1 = at[maybe], last[maybe]
    p2, p3 = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    wide = (p1 >= 0x1C) & (p1 <= 0x1F)
    wide |= (p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0))
    wide |= (p3 == 0xE1) & (p2 == 0x9A) & (p1 == 0x80)
    wide |= (p3 == 0xE2) & (p2 == 0x80) & ((p1 <= 0x8B) | (p1 == 0xA8) | (p1 == 0xA9) | (p1 == 0xAF))
    wide |= (p3 == 0xE2) & (p2 == 0x81) & (p1 == 0x9F)
    wide |= (p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x80)
    out[maybe] = wide
    return out


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places in data where chunks start; each non-empty row starts one."""
    if not len(data):
        return np.empty(0, np.int64)
    space = _space(data)
    cut = np.zeros(len(data), bool)
    np.greater(space[1:], space[:-1], out=cut[1:])
    at = np.flatnonzero(cut)
    cut[at[_after_wide_space(data, at)]] = False
    cut[1:] |= ((data[1:] == ord(",")) | (data[1:] == ord("."))) & _letter(data[:-1])
    first = offsets[:-1]
    cut[first[first < offsets[1:]]] = True
    return np.flatnonzero(cut)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + length), one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class ChunkCache:
    """Ids of chunks; encode(chunk texts) gives them in some order: their indices, all ids in a row, ids of each."""

    def __init__(self, encode: Callable[[list[str]], tuple[list[int], np.ndarray, np.ndarray]], uncased: bool = False):
        """uncased: the tokenizer drops white space and lower-cases, so chunks may be folded before they are looked up."""
        self.encode, self.uncased = encode, uncased
        self.limit, self.top = CACHE_CHUNKS, 0  # top: the largest id
        self.reset()

    def reset(self) -> None:
        self.at: dict[bytes, int] = {}
        self.pool, self.used = np.empty(1 << 16, np.uint32), 0
        self.start, self.length = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.uses = np.empty(1 << 14, np.uint32)

    def shrink(self) -> None:
        """Keeps what was looked up in more than one call since the last time, at most half of what the cache may hold."""
        n = len(self.at)
        kept = np.flatnonzero(self.uses[:n] > 1)
        kept = kept[np.cumsum(self.length[kept]) <= CACHE_IDS // 2][:self.limit // 2]
        chunks, lengths = list(self.at), self.length[kept]
        pool = self.pool[ragged(self.start[kept], lengths)]
        self.reset()
        self._put([chunks[i] for i in kept.tolist()], pool, lengths)
        self.uses[:len(kept)] = 0

    def _add(self, chunks: list[bytes]) -> None:
        of_bytes = getattr(self.encode, "of_bytes", None)
        which, flat, lengths = of_bytes(chunks) if of_bytes else self.encode([c.decode("utf-8") for c in chunks])
        self._put(list(map(chunks.__getitem__, which)), flat, lengths)

    def _put(self, chunks: list[bytes], flat: np.ndarray, lengths: np.ndarray) -> None:
        n, m = len(self.at), len(chunks)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while n + m > len(self.start):
            self.start, self.length, self.uses = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.length, self.uses))
        self.pool[self.used:self.used + len(flat)] = flat
        self.start[n:n + m] = self.used + np.cumsum(lengths) - lengths
        self.length[n:n + m], self.uses[n:n + m] = lengths, 0
        self.used += len(flat)
        self.at.update(zip(chunks, range(n, n + m)))

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and the offset of each row's ids (n + 1 of them)."""
        codes, entries, of_row = self.codes(data, offsets)
        starts, lengths = self.start[entries], self.length[entries]
        each = lengths[codes]
        ids = self.pool[ragged(starts[codes], each)] if len(codes) else np.empty(0, np.uint32)
        return ids, np.concatenate([[0], np.cumsum(each)])[of_row]

    def codes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the distinct chunk at each place; the cache entry of each; chunk offsets of the rows."""
        starts = chunk_starts(data, offsets)
        if self.uncased and not _has_special(data):
            data = np.frombuffer(data.tobytes().translate(_FOLDED), np.uint8)
        of_row = np.searchsorted(starts, offsets)
        if not len(starts):
            return np.empty(0, np.int64), np.empty(0, np.int64), of_row
        bounds = np.append(starts, len(data)).astype(np.int64)
        array = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        coded = array.dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # bytes, many times faster than to_pylist()
        if len(self.at) + len(chunks) > self.limit or self.used > CACHE_IDS:
            self.shrink()
        entries = list(map(self.at.get, chunks))
        if new := [i for i, e in enumerate(entries) if e is None]:
            self._add([chunks[i] for i in new])
            for i in new:
                entries[i] = self.at[chunks[i]]
        entries = np.array(entries, np.int64)
        self.uses[entries] += 1  # each stands there once
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), entries, of_row


_FOLDED = bytes(32 if 9 <= b <= 13 else b for b in bytes(range(256)).lower())


def _has_special(data: np.ndarray) -> bool:
    """Whether the beginning of a special token stands there; those are matched before letters are lowered."""
    at = np.flatnonzero(data[:-1] == ord("<"))
    return bool((data[at + 1] == ord("|")).any())


#: What a byte is in a chunk: white space, a letter, a mark; a mark but full stop and comma; anything else.
_IN_SPACE, _IN_LETTERS, _IN_MARKS, _IN_OTHER_MARKS, _ELSE = 1, 2, 4, 16, 8
_KIND = bytes(
    _IN_SPACE if chr(b) in " \t\n\v\f\r" else _IN_LETTERS if b < 128 and chr(b).isalpha() else _IN_MARKS if chr(b) in ".,"
    else _ELSE if b < 33 or b > 126 or chr(b).isalnum() or chr(b) in "'<|" else _IN_MARKS | _IN_OTHER_MARKS for b in range(256))
_ORDER = bytes({_IN_SPACE: 0, _IN_LETTERS: 1, _ELSE: 3}.get(k, 2) for k in _KIND)
#: Simple chunks that are encoded as one text.
_TOGETHER = 200


class _WordEnds:
    """Encodes simple chunks many at a time, where each pre-token's last token is marked as a word's end.

    Simple are letters of ASCII and Latin-1 (each stays one letter in lower case) with or without a run of marks behind them, and
    runs of full stops and commas; white space may stand before.  Their pre-tokens are known, so the library's model gets them
    split by spaces, in lower case and with bytes as the letters that stand for them, and neither normalises nor splits them again.
    """

    def __init__(self, tokenizer, suffix: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = tokenizer
        self.words = Tokenizer(tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # U+00C0 to U+00FF are 0xC3 and a byte from 0x80 to 0xBF, for most of which the letter of that number stands
        letters = {chr(b): as_bytes.pre_tokenize_str(chr(b + 0x40))[0][0][1] for b in range(0x80, 0xC0)}
        self.letters = [(c, letter) for c, letter in letters.items() if c != letter]
        vocab = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True

    def __call__(self, chunks: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        return self.of_bytes([c.encode("utf-8") for c in chunks])

    def of_bytes(self, chunks: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        joined = b" ".join([*chunks, b""]).lower()  # each with a space behind it
        data, order, kind = (np.frombuffer(bytearray(x), np.uint8) for x in (joined, joined.translate(_ORDER), joined.translate(_KIND)))
        at = np.flatnonzero(data == 0xC3) + 1  # never the last, which is a space
        second = data[at]
        at = at[(second >= 0x80) & (second < 0xC0) & (second != 0x97) & (second != 0xB7)]
        for x, value in ((order, 1), (kind, _IN_LETTERS)):
            x[at - 1] = x[at] = value
        data[at[data[at] < 0x9F]] |= 0x20  # capitals
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1
        first = np.cumsum(sizes) - sizes
        kind[1:][order[1:] < order[:-1]] |= _ELSE
        kind[first + sizes - 1] = _IN_SPACE
        seen = np.bitwise_or.reduceat(kind, first) if len(first) else kind[:0]
        letters, marks, fine = seen & _IN_LETTERS > 0, seen & _IN_MARKS > 0, seen & _ELSE == 0
        which, flat, lengths = [], [], []
        for simple, ends in ((fine & (letters ^ marks) & (letters | (seen & _IN_OTHER_MARKS == 0)), 1), (fine & letters & marks, 2)):
            if not (simple := np.flatnonzero(simple)).size:
                continue
            src = ragged(first[simple], sizes[simple])
            text = data[src]
            if ends == 2:  # a space goes in before the marks
                text = np.insert(text, np.flatnonzero((order[src][1:] == 2) & (order[src][:-1] == 1)) + 1, 32)
            text = text.tobytes().decode("latin-1")
            if not text.isascii():
                for c, letter in self.letters:
                    text = text.replace(c, letter)
            bounds = np.append(0, np.cumsum(sizes[simple] + (ends - 1)))[[*range(0, len(simple), _TOGETHER), len(simple)]].tolist()
            groups = [text[x:y] for x, y in zip(bounds, bounds[1:])]
            for k in range(0, len(groups), 50):
                for j, e in enumerate(self.words.encode_batch_fast(groups[k:k + 50], add_special_tokens=False), k):
                    g, ids = simple[j * _TOGETHER:(j + 1) * _TOGETHER], np.array(e.ids)
                    stop = np.flatnonzero(self.ends[ids]) + 1
                    if len(stop) == ends * len(g) and stop[-1] == len(ids):
                        which.append(g)
                        flat.append(ids)
                        lengths.append(np.diff(stop[ends - 1::ends], prepend=0))
        rest = np.ones(len(chunks), bool)
        for g in which:
            rest[g] = False
        which = list(chain.from_iterable(g.tolist() for g in which))
        if (rest := np.flatnonzero(rest).tolist()):
            more = plain(self.tokenizer, [chunks[i].decode("utf-8") for i in rest])
            which, flat, lengths = which + rest, [*flat, more[1]], [*lengths, more[2]]
        return which, np.concatenate(flat), np.concatenate(lengths)


def in_order(ids: list[list[int]]) -> tuple[range, np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return range(len(ids)), np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths


def plain(tokenizer, chunks: list[str]) -> tuple[range, np.ndarray, np.ndarray]:
    return in_order([e.ids for e in tokenizer.encode_batch_fast(chunks, add_special_tokens=False)])


_LIBRARY: dict[str, ChunkCache] = {}


def library_cache(path: str, limit: int = CACHE_CHUNKS) -> ChunkCache:
    """This worker's cache for a tokenizers file, without truncation, padding or special tokens added; limit: its chunks."""
    if path not in _LIBRARY:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        spec = json.loads(tokenizer.to_str())
        steps = spec["normalizer"] or {}
        uncased = any(n["type"] == "Lowercase" for n in steps.get("normalizers", [steps]) if n) and '"behavior":"Removed"' in json.dumps(spec["pre_tokenizer"], separators=(",", ":"))
        suffix = spec["model"].get("end_of_word_suffix")
        _LIBRARY[path] = ChunkCache(_WordEnds(tokenizer, suffix) if uncased and suffix else lambda chunks: plain(tokenizer, chunks), uncased)
        _LIBRARY[path].top = max(tokenizer.get_vocab(with_added_tokens=True).values())
        CACHES[path] = _LIBRARY[path].reset
    _LIBRARY[path].limit = limit
    return _LIBRARY[path]


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; the folder is a parameter of the machine, never of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)
