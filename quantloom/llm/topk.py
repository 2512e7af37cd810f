"""Exact top-k by integer inner product, with norm buckets.

Vectors are range-partitioned by length (norm), so a chunk holds vectors of like
length. A query meets every chunk, chunk by chunk and query block by query block,
as a join on the cell of both. With a query's k-th best score so far, a bucket has
a local cosine threshold: score / (query norm * largest norm in it). Above one, the
bucket is skipped; where the threshold is high, coordinate pruning keeps vectors
whose largest coordinates can lie within the angle; else the length prefix of the
bucket is taken whole. What is left is verified by exact integer products.

An integer component floor(1024 x) is kept as floor(1024 x) / 1024, which a double
holds exactly for every finite x. Vectors whose products could pass 2**53 are rare;
they are compared one by one in wider integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut
from .textkit import table

SCALE = 1024
CHUNK, QUERY_CHUNK = 1 << 15, 1 << 12  # most vectors in a chunk, and queries in a block
BUCKET = 1024  # vectors of like length that are pruned together
SEEDS = 2048  # longest vectors: a proven bound on what goes to all tasks
STEEP = 0.75  # local cosine threshold from which coordinates are looked at


def stepped(v: np.ndarray) -> np.ndarray:
    """floor(1024 v) / 1024, exactly; no negative zeros."""
    small = np.abs(v) < 2.0**50
    return np.where(small, np.floor(SCALE * np.where(small, v, 0.0)) / SCALE, v) + 0.0


def _prepared(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, dim, norm, v): integer components as bytes; unusable vectors are gone."""
    schema = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("norm", pa.float64()), ("v", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            for i, x in zip(ids, b.column(1)):
                values = x.values
                if i is None or values is None or values.null_count:
                    continue
                v = values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(v).all():
                    u = stepped(v)
                    with np.errstate(over="ignore"):
                        out.append((i, len(u), float(np.sqrt((u**2).sum())), u.tobytes()))
            yield table(schema, **{f.name: [r[k] for r in out] for k, f in enumerate(schema)})

    return vectors.select(F.col(id_col).cast("long"), F.col(vec_col)).mapInArrow(run, "vec_id long, dim int, norm double, v binary")


_CHUNK = pa.schema([("chunk", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("m", pa.binary())])
_CHUNK_SQL = "chunk int, dim int, ids binary, m binary"


def _packed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows of one partition as matrices of one dimension each, in the order they come."""
    from pyspark import TaskContext

    pid, ids, rows, dim = TaskContext.get().partitionId(), [], [], None

    def flush() -> pa.RecordBatch:
        return table(_CHUNK, chunk=[pid], dim=[dim], ids=[np.array(ids, np.int64).tobytes()], m=[b"".join(rows)])

    for b in batches:
        for i, d, _, v in zip(*[c.to_pylist() for c in b.columns]):
            if ids and (d != dim or len(ids) >= most):
                yield flush()
                ids, rows = [], []
            dim = d
            ids.append(i)
            rows.append(v)
    if ids:
        yield flush()


class Best:
    """The k best (score, smaller id first) of each query in a block."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        self.floor = np.full(n, -np.inf)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        best = self.found[q]
        if len(scores) > self.k:
            low = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            keep = scores >= low
            scores, ids = scores[keep], ids[keep]
            if len(scores) > self.k:  # ties at the edge: the smaller ids
                order = np.lexsort((ids, -scores))[: self.k]
                scores, ids = scores[order], ids[order]
        best += [(-int(s), int(i)) for s, i in zip(scores, ids)]
        best.sort()
        del best[self.k :]
        if len(best) == self.k:
            low = float(-best[-1][0])
            self.floor[q] = max(self.floor[q], low if abs(low) < 2**53 else np.nextafter(low, -np.inf))


def _coordinates(q: np.ndarray, c: np.ndarray, cosine: float, few: int = 3) -> np.ndarray:
    """Rows of c (unit length) that may be within arccos(cosine) of q, by the coordinates where q is largest."""
    keep = np.ones(len(c), bool)
    spread = np.arccos(cosine) + 1e-6
    for j in np.argsort(-np.abs(q))[:few]:
        a = np.arccos(np.clip(q[j], -1, 1))
        low, high = np.cos(min(np.pi, a + spread)), np.cos(max(0.0, a - spread))
        keep &= (c[:, j] >= low - 1e-9) & (c[:, j] <= high + 1e-9)
    return np.flatnonzero(keep)


def search(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, best: Best) -> None:
    """Improves ``best`` by all of c; rows of c need not be in order. Matrices as :func:`stepped` gives them."""
    widest = np.sqrt(2.0**53 / max(1, q.shape[1])) / SCALE  # products of vectors below stay whole in doubles
    wide_q, wide_c = np.abs(q).max(1, initial=0) >= widest, np.abs(c).max(1, initial=0) >= widest
    _pruned(np.flatnonzero(~wide_q), qids, q, ids[~wide_c], c[~wide_c], best)
    _plain(np.arange(len(q)), qids, q, ids[wide_c], c[wide_c], best)
    _plain(np.flatnonzero(wide_q), qids, q, ids[~wide_c], c[~wide_c], best)


def _integers(u: np.ndarray) -> np.ndarray:
    """Exact components, as objects where 64 bits do not hold them."""
    if np.abs(u).max(initial=0) < 2.0**52:
        return (u * SCALE).astype(np.int64)
    return np.array([[int(x) * SCALE if abs(x) >= 2.0**43 else int(x * SCALE) for x in row] for row in u.tolist()], object).reshape(u.shape)


def _plain(js: np.ndarray, qids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, best: Best) -> None:
    """Every product of these queries with c in integers that hold it; what is beyond a long is held at its end."""
    for at in range(0, len(ids) if len(js) else 0, BUCKET):
        bi, bc = ids[at : at + BUCKET], c[at : at + BUCKET]
        whole = _integers(bc)
        for j in js.tolist():
            one = _integers(q[j : j + 1])[0]
            fits = np.abs(q[j]).max(initial=0) * SCALE * float(np.abs(bc).max(initial=0)) * SCALE * max(1, len(one)) < 2.0**62
            s = whole @ one if fits else whole.astype(object) @ one.astype(object)
            s = s if fits else np.array([max(-(2**63) + 1, min(2**63 - 1, x)) for x in s], np.int64)
            ok = (bi != qids[j]) & (s >= best.floor[j])
            if ok.any():
                best.add(j, s[ok], bi[ok])


def _pruned(js: np.ndarray, qids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, best: Best) -> None:
    """Norm buckets of c, longest first, for the queries at ``js``."""
    if not len(js) or not len(ids):
        return
    qids, q, c = qids[js], q[js] * SCALE, c * SCALE
    qn, norm = np.sqrt((q**2).sum(1)), np.sqrt((c**2).sum(1))
    order = np.lexsort((ids, -norm))
    ids, c, norm = ids[order], c[order], norm[order]
    for at in range(0, len(ids), BUCKET):
        bi, bc, bn = ids[at : at + BUCKET], c[at : at + BUCKET], norm[at : at + BUCKET]
        unit = bc / np.maximum(bn, 1e-12)[:, None]
        floor = best.floor[js]
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(qn * bn[0] > 0, floor / (qn * bn[0]), np.where(floor > 0, np.inf, -np.inf))
        whole = np.flatnonzero(cosine <= STEEP)
        scores = (q[whole] @ bc.T).astype(np.int64)
        for row, j in enumerate(whole):
            s = scores[row]
            ok = (bi != qids[j]) & (s >= floor[j])
            if ok.any():
                best.add(js[j], s[ok], bi[ok])
        for j in np.flatnonzero((cosine > STEEP) & (cosine <= 1 + 1e-9)):
            n = int(np.searchsorted(-bn, -(floor[j] / max(qn[j], 1e-12)) * (1 - 1e-12), "right")) if qn[j] > 0 else len(bn)
            near = _coordinates(q[j] / max(qn[j], 1e-12), unit[:n], min(1.0, max(-1.0, cosine[j])))
            if len(near):
                s = (bc[near] @ q[j]).astype(np.int64)
                ok = (bi[near] != qids[j]) & (s >= floor[j])
                if ok.any():
                    best.add(js[j], s[ok], bi[near][ok])


def _matrix(ids: bytes, m: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(m, np.float64).reshape(len(i), dim)


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Each query's k best among all other ids: query_id, rank, vec_id, score.

    Queries are the rows whose id divides by ``every``. Vectors that are null, or
    hold nulls or non-finite components, and null ids take no part; vectors of
    different lengths never meet. A row with the query's own id is not its
    candidate. Rows that repeat an id and a vector count once. Ties go to the
    smaller id. Products are exact whatever the components; a score beyond a long is
    given, and ranked, as the nearest long. An empty table, or no query, gives no rows.
    """
    spark = vectors.sparkSession
    rows = cut(_prepared(vectors, id_col, vec_col).dropDuplicates(["vec_id", "v"]))
    queries = rows.where(F.col("vec_id") % every == 0)
    n, nq = rows.count(), queries.count()
    cores = spark.sparkContext.defaultParallelism
    parts = max(1, -(-n // CHUNK), min(2 * cores, n // (4 * BUCKET)))
    qparts = max(1, -(-nq // QUERY_CHUNK))
    seeds: dict[int, list] = {}
    for r in rows.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).collect():
        seeds.setdefault(r.dim, []).append((r.vec_id, r.v))
    packed_seeds = {d: (np.array([i for i, _ in s]), np.stack([np.frombuffer(v, np.float64) for _, v in s]).reshape(len(s), d)) for d, s in seeds.items()}
    shared = spark.sparkContext.broadcast(packed_seeds)

    def pack(most: int):
        return lambda batches: _packed(batches, most)

    chunks = rows.repartitionByRange(parts, "dim", F.desc("norm"), "vec_id").sortWithinPartitions("dim", F.desc("norm"), "vec_id").mapInArrow(pack(CHUNK), _CHUNK_SQL)
    blocks = queries.repartitionByRange(qparts, "dim", "vec_id").sortWithinPartitions("dim", "vec_id").mapInArrow(pack(QUERY_CHUNK), _CHUNK_SQL)
    left = chunks.select("dim", F.col("chunk").alias("c"), F.col("ids"), F.col("m"), F.explode(F.sequence(F.lit(0), F.lit(qparts - 1))).alias("q"))
    right = blocks.select(
        "dim", F.col("chunk").alias("q"), F.col("ids").alias("qids"), F.col("m").alias("qm"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("c")
    )
    cells = left.join(right, ["dim", "c", "q"]).select("dim", "ids", "m", "qids", "qm")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, c = _matrix(row["ids"], row["m"], row["dim"])
                qids, q = _matrix(row["qids"], row["qm"], row["dim"])
                first = Best(len(qids), k)
                if row["dim"] in shared.value:
                    search(qids, q, *shared.value[row["dim"]], first)
                best = Best(len(qids), k)
                best.floor = first.floor
                search(qids, q, ids, c, best)
                out = [(qids[j], i, -s) for j, f in enumerate(best.found) for s, i in f]
                yield table(schema, **{f.name: [o[x] for o in out] for x, f in enumerate(schema)})

    found = cells.mapInArrow(run, "query_id long, vec_id long, score long").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
