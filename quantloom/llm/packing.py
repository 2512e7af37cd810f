"""Packing along a space-filling curve.

A document's token counts, hashed to a fixed number of buckets, are projected to
few dimensions; the Hilbert index of the projection is its place on a curve that
keeps near points near. Whole sequences are cut from a document at once; what is
left of it goes, in curve order, into sequences that neighbours share. Rows are
range-partitioned by curve position, into as many parts as their tokens need, and
each part fills its own sequences. Its last one is cut at powers of two, the lengths
that need no padding, so padding does not depend on the number of parts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, small_batches
from .subwords import Encoder, default_files
from .textkit import table

LENGTH = 1024
BUCKETS, DIMENSIONS, BITS = 256, 3, 10
END = 0
PART_TOKENS, PARTS = 1 << 20, 20_000  # tokens of a range partition, and the most partitions

_NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve")
_PIECE = pa.schema([*[(c, pa.int64()) for c in _NAMES], ("ids", pa.binary())])
_PIECE_SQL = ", ".join(f"{c} long" for c in _NAMES) + ", ids binary"
_OUT = pa.schema([*[(c, pa.int64()) for c in _NAMES], ("ids", pa.list_(pa.int32()))])
_OUT_SQL = ", ".join(f"{c} long" for c in _NAMES) + ", ids array<int>"


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert indices of integer points, one a row (Skilling, 2004), for all rows at once."""
    x = x.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) > 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _projection(seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(BUCKETS, DIMENSIONS)) / np.sqrt(DIMENSIONS)


def curve_keys(docs: list[np.ndarray]) -> np.ndarray:
    """Curve positions of id arrays: square roots of hashed counts, unit length, projected, binned by the normal law."""
    from math import erf

    v = np.stack([np.sqrt(np.bincount((d.astype(np.int64) * 2654435761 >> 7) % BUCKETS, minlength=BUCKETS)) for d in docs])
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    p = np.vectorize(erf)(v @ _projection())
    return hilbert(np.clip((p + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _tokenise(batches: Iterator[pa.RecordBatch], files: tuple[str, str | None], length: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Whole sequences, complete, and for each document its remainder (no offset yet) with curve position and ids."""
    encoder = Encoder(*files)
    for b in batches:
        for at in range(0, len(b), 256):
            part = b.slice(at, 256)
            docs = [np.append(x, np.array(END, x.dtype)) for x in encoder.encode(part.column(1))]
            rows: list[tuple] = []
            held = 0
            for i, d, key in zip(part.column(0).to_pylist(), docs, curve_keys(docs).tolist()):
                edge = len(d) // length * length
                for j in range(0, edge, length):
                    piece = d[j : j + length]
                    rows.append((i, j, length, _crc(piece), len(d), None, 0, key, piece.tobytes() if with_ids else None))
                if edge < len(d):
                    rows.append((i, edge, len(d) - edge, None, len(d), None, None, key, d[edge:].tobytes()))
                held += len(d)
                if held > 1 << 20:
                    yield _rows(_PIECE, rows)
                    rows, held = [], 0
            yield _rows(_PIECE, rows)


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(schema)
    return table(schema, **{f.name: c for f, c in zip(schema, cols)})


def _fill(batches: Iterator[pa.RecordBatch], dtype: str, length: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """One range partition in curve order: pieces with their sequences. Ids of sequences: partition, then a count."""
    from pyspark import TaskContext

    sequence = TaskContext.get().partitionId() << 36
    rows: list[tuple] = []
    waiting: list[tuple] = []  # pieces of the sequence that is not full yet: (doc, start, ids, doc_tokens, curve)
    used = 0

    def close(size: int) -> None:
        """Moves the first ``size`` waiting ids into a sequence."""
        nonlocal sequence, waiting, used
        at, rest = 0, []
        for doc, start, ids, total, key in waiting:
            n = min(size - at, len(ids))
            if n:
                rows.append((doc, start, n, _crc(ids[:n]), total, sequence, at, key, ids[:n].astype(np.int32) if with_ids else None))
            if n < len(ids):
                rest.append((doc, start + n, ids[n:], total, key))
            at += n
        waiting, used, sequence = rest, used - size, sequence + 1

    for b in batches:
        for doc, start, total, key, raw in zip(*[b.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "curve", "ids")]):
            ids = np.frombuffer(raw, dtype)
            waiting.append((doc, start, ids, total, key))
            used += len(ids)
            while used >= length:
                close(length)
            if len(rows) > 2048:
                yield _rows(_OUT, rows)
                rows = []
    while used:
        close(1 << (used.bit_length() - 1))
    yield _rows(_OUT, rows)


def _decoded(batches: Iterator[pa.RecordBatch], dtype: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, len(b), 2048):
            part = b.slice(at, 2048)
            ids = [None if x is None else np.frombuffer(x, dtype).astype(np.int32) for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in _NAMES], pa.array(ids, pa.list_(pa.int32()))], schema=_OUT)


def pack(docs: DataFrame, files: tuple[str, str | None] | None = None, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, curve, ids.

    A null or empty text is the end id alone. Rows with equal or null ids are
    packed one by one. Equal documents lie beside each other on the curve and may
    span range partitions, for partitions are cut by position, then id, then row. An
    empty table gives no rows; other columns are ignored. Without ``with_ids`` the ids
    are checked and counted but not carried.
    """
    small_batches(docs.sparkSession)
    files = files or default_files()
    dtype = np.dtype(Encoder(files[0], None).dtype).str

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _tokenise(batches, files, length, with_ids)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _fill(batches, dtype, length, with_ids)

    # range bounds come from a sample of the rows, so they are kept before and not computed twice
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tokenise, _PIECE_SQL).withColumn("row", F.monotonically_increasing_id()))
    whole, rest = rows.where("offset is not null"), rows.where("offset is null")
    parts = min(PARTS, max(1, -(-(rest.agg(F.sum("length")).first()[0] or 0) // PART_TOKENS)))
    order = ["curve", "doc_id", "start", "row"]
    rest = rest.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("row").mapInArrow(fill, _OUT_SQL)
    whole = whole.withColumn("sequence_id", F.monotonically_increasing_id() + F.lit(1 << 62)).drop("row")
    if not with_ids:
        return rest.drop("ids").unionByName(whole.drop("ids"))
    return rest.unionByName(whole.mapInArrow(lambda batches: _decoded(batches, dtype), _OUT_SQL))
