"""Vectorised word and line hashing over Arrow string columns.

A word is a maximal run of bytes outside {0x20, 0x09-0x0D}; no such byte occurs
inside a multi-byte UTF-8 character, so bytes and code points agree on words.
All arrays are per slice of a batch (about a megabyte of text, or one document
if it is longer), so memory follows the longest document and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

_U = np.uint64
SLICE_BYTES = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULT = np.random.default_rng(20240601).integers(1, 2**63, size=64, dtype=np.uint64) * _U(2) + _U(1)
_LEFT = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], _U)  # keeps the first k bytes of a little-endian word
SEED, OTHER_SEED = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
LONG = 512  # bytes of a span from which a library's hash is taken


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Texts:
    """A run of documents as one byte buffer; ``offs`` has the bounds of each."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, first: int):
        self.buf, self.offs, self.first, self.n = buf, offs, first, len(offs) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words, and for each document the index of its first word (one more at the end)."""
        inside = ~_SPACE[self.buf]
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.n + 1, np.int64)
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edges = self.offs[1:-1]
        edges = edges[(edges > 0) & (edges < len(inside))]
        begin[edges] = inside[edges]
        end[edges - 1] = inside[edges - 1]
        starts = np.flatnonzero(begin)
        return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, self.offs)

    def spans(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: np.uint64 = SEED) -> np.ndarray:
        """A 64-bit hash of the bytes of each span; equal bytes give equal hashes.

        Eight bytes at a time go through a full mix each, so no pattern of bytes
        cancels another, as it can in a polynomial modulo 2**64.
        """
        starts, ends = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
        out = mix((ends - starts).astype(_U) * _MULT[63] + seed)
        if not len(self.buf) or not len(starts):
            return out
        raw = np.zeros(len(self.buf) + 8, np.uint8)
        raw[:-8] = _LOWER[self.buf] if lower else self.buf
        words = np.ndarray(len(self.buf) + 1, "<u8", raw, strides=(1,))
        size = ends - starts
        long = np.flatnonzero(size >= LONG)
        for i in long.tolist():
            out[i] = int.from_bytes(blake2b(raw[starts[i] : ends[i]].data, digest_size=8, key=seed.tobytes()).digest(), "little")
        todo = np.flatnonzero((size > 0) & (size < LONG))
        at, left, h = starts[todo], size[todo], out[todo]
        while len(todo):
            h = mix((h ^ (words[at] & _LEFT[np.minimum(left, 8)])) + seed)
            more = left > 8
            if not more.all():
                out[todo[~more]] = h[~more]
                todo, at, left, h = todo[more], at[more], left[more], h[more]
            at, left = at + 8, left - 8
        return out


def texts(column: pa.Array | pa.ChunkedArray, slice_bytes: int = SLICE_BYTES) -> Iterator[Texts]:
    """Slices of a string column. A null counts as an empty text."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if chunk.null_count:
            chunk = chunk.fill_null("")
        if not len(chunk):
            continue
        _, offs, data = chunk.buffers()
        wide = pa.types.is_large_string(chunk.type)
        offs = np.frombuffer(offs, np.int64 if wide else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(chunk):
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + slice_bytes, "right")) - 1)
            yield Texts(raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at], at)
            at = to


def grams(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k items inside each group, and each group's first run (one more at the end)."""
    n = len(hashes)
    counts = np.maximum(np.diff(bounds) - (k - 1), 0)
    first = np.concatenate([[0], np.cumsum(counts)])
    if n < k:
        return np.zeros(0, _U), first
    m = n - k + 1
    total = hashes[:m] * _MULT[0]
    for j in range(1, k):
        total += hashes[j : j + m] * _MULT[j]
    keep = np.ones(m, bool)
    for at in range(1, k):  # runs that would cross the end of a group
        edge = bounds[1:] - at
        keep[edge[(edge >= 0) & (edge < m)]] = False
        # a group shorter than k - 1 leaves marks in the one before it, which are crossings too
    return mix(total[keep]), first


def shingle_sets(t: Texts, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every document and the bounds of each.

    Words are lower-cased (A-Z only). A document of fewer than k words has its
    whole sequence as its one shingle; one without words has the empty set.
    """
    starts, ends, bounds = t.words()
    words = t.spans(starts, ends, lower=True)
    runs, first = grams(words, bounds, k)
    sizes = np.diff(bounds)
    out, sized = [], np.zeros(t.n, np.int64)
    for i in range(t.n):
        if sizes[i] >= k:
            a = runs[first[i] : first[i + 1]]
            a.sort()
            if len(a) > 1:
                fresh = np.empty(len(a), bool)
                fresh[0] = True
                np.not_equal(a[1:], a[:-1], out=fresh[1:])
                if not fresh.all():
                    a = a[fresh]
        elif sizes[i]:
            w = words[bounds[i] : bounds[i + 1]]
            a = mix((w * _MULT[: len(w)]).sum(keepdims=True) + np.array([len(w)], _U) * _MULT[40])
        else:
            a = runs[:0]
        sized[i] = len(a)
        out.append(a)
    return (np.concatenate(out) if out else np.zeros(0, _U)), np.concatenate([[0], np.cumsum(sized)])


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
