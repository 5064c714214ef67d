"""Word shingles of texts: hashed sets for candidates, exact ones for verification, MinHash signatures."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa

from craterloom.llm.core import mix

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Number of each word (white space between words, A-Z in lower case), the distinct words, word offsets of the rows.

    Words have equal numbers if and only if their bytes are equal.
    """
    data = _LOWER[data]
    inside = ~_SPACE[data]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[first] = inside[first]
    ends[:-1] &= ~inside[1:]
    ends[first[1:] - 1] = inside[first[1:] - 1]
    starts = np.flatnonzero(begins)
    rows = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.empty(0, np.int64), [], rows
    bounds = np.concatenate([[0], np.cumsum(np.flatnonzero(ends) + 1 - starts)])
    packed = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    coded = packed.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist(), rows


def _hashes(words: list[bytes]) -> np.ndarray:
    """Two independent 64-bit numbers of each word."""
    return np.frombuffer(b"".join([blake2b(w, digest_size=16).digest() for w in words]), np.uint64).reshape(-1, 2)


def _chain(words: list[np.ndarray]) -> np.ndarray:
    acc = np.full(len(words[0]), len(words), np.uint64)
    for w in words:
        acc = mix(acc * np.uint64(0xA24BAED4963EE407) + w)
    return acc


def _padded(codes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """codes + 1 with short rows filled up to width by zeros, and the rows' new offsets; empty rows stay empty."""
    size = np.diff(rows)
    more = np.where((size > 0) & (size < width), width - size, 0)
    if more.any():
        codes = np.insert(codes, np.repeat(rows[1:], more), -1)
        rows = np.concatenate([[0], np.cumsum(size + more)])
    return codes + 1, rows


def hashed_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sorted distinct shingles of each row as 64-bit hashes, and a second, independent hash of each.

    A row of fewer words has its whole sequence as the only shingle.
    """
    codes, words, rows = word_codes(data, offsets)
    none = np.empty(0, np.uint64)
    if not words:
        return [none] * (len(offsets) - 1), [none] * (len(offsets) - 1)
    codes, rows = _padded(codes, rows, width)
    table = np.concatenate([np.zeros((1, 2), np.uint64), _hashes(words)])
    one, two = (_chain([h[codes[i:len(codes) - width + 1 + i]] for i in range(width)]) for h in table.T)
    sets, others = [], []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        own, at = np.unique(one[a:max(a, b - width + 1)], return_index=True)
        sets.append(own)
        others.append(two[a + at])
    return sets, others


def exact_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each row as numbers that stand for the very words; comparable within one call."""
    codes, words, rows = word_codes(data, offsets)
    codes, rows = _padded(codes, rows, width)
    key, base = codes, len(words) + 1
    for i in range(1, width):
        if (int(key.max(initial=0)) + 1) * base >= 2**63:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key[:max(0, len(codes) - i)] * base + codes[i:]
    return [np.unique(key[a:max(a, b - width + 1)]) for a, b in zip(rows[:-1].tolist(), rows[1:].tolist())]


class MinHash:
    """Signatures of n 32-bit minima over the linear maps a * x + b modulo 2**64."""

    def __init__(self, n: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 2**63, (n, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, (n, 1), dtype=np.uint64)

    def of(self, shingles: np.ndarray) -> np.ndarray:
        low = None
        for i in range(0, len(shingles), 1024):
            part = (shingles[None, i:i + 1024] * self.a + self.b).min(1)
            low = part if low is None else np.minimum(low, part)
        return (low >> np.uint64(32)).astype(np.uint32)
