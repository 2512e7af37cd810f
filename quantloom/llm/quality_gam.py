"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits one feature at a time and adds a shallow tree to its
lookup table (Lou et al., 2013); afterwards the pairs of features that explain
most of what is left get small two-way tables. A score is the sum of looked-up
values, so tasks only bin and add.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_rules import labelled_sample, sampled_features
from .shared import small_batches
from .textkit import table, texts
from .textstats import features, stats

SAMPLE = 20_000  # labelled rows the model sees
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 200, 80, 0.1
CUT = 0.3


def held_out() -> F.Column:
    """True for rows that no fit may see: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if len(x) else np.zeros(0)


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, ridge: float = 1.0) -> np.ndarray:
    """A piecewise constant step over ordered bins: the best cuts by gain, one after another."""
    parts = [(0, len(grad))]
    g, h = np.concatenate([[0.0], np.cumsum(grad)]), np.concatenate([[0.0], np.cumsum(hess)])
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    for _ in range(leaves - 1):
        best = max(
            ((worth(a, c) + worth(c, b) - worth(a, b), i, c) for i, (a, b) in enumerate(parts) for c in range(a + 1, b)),
            default=(0.0, 0, 0),
        )
        if best[0] <= 1e-9:
            break
        _, i, c = best
        a, b = parts.pop(i)
        parts += [(a, c), (c, b)]
    out = np.zeros(len(grad))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


@dataclass
class Additive:
    edges: list[np.ndarray]
    pair_edges: list[np.ndarray]
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        one = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]
        return one, [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.pair_edges)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        one, two = self.bins(x)
        out = np.full(len(x), self.base)
        for b, t in zip(one, self.tables):
            out += t[b]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            out += t[two[i], two[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> "Additive":
        m = cls([_edges(x[:, j], BINS) for j in range(x.shape[1])], [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])])
        p = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
        m.base = float(np.log(p / (1 - p)))
        m.tables = [np.zeros(len(e) + 1) for e in m.edges]
        if not len(y) or y.min() == y.max():
            return m
        one, two = m.bins(x)
        f = np.full(len(y), m.base)
        for _ in range(ROUNDS):
            for j, b in enumerate(one):
                q = 1 / (1 + np.exp(-f))
                n = len(m.tables[j])
                step = RATE * _tree(np.bincount(b, y - q, n), np.bincount(b, q * (1 - q), n), 3)
                m.tables[j] += step
                f += step[b]

        def cells(i: int, j: int) -> tuple[np.ndarray, int, int]:
            a, b = len(m.pair_edges[i]) + 1, len(m.pair_edges[j]) + 1
            return two[i] * b + two[j], a, b

        q = 1 / (1 + np.exp(-f))
        worth = []
        for i, j in combinations(range(x.shape[1]), 2):
            c, a, b = cells(i, j)
            worth.append(((np.bincount(c, y - q, a * b) ** 2 / (np.bincount(c, q * (1 - q), a * b) + 1)).sum(), i, j))
        m.pairs = [(i, j) for _, i, j in sorted(worth, reverse=True)[:PAIRS]]
        m.pair_tables = [np.zeros((len(m.pair_edges[i]) + 1, len(m.pair_edges[j]) + 1)) for i, j in m.pairs]
        for _ in range(PAIR_ROUNDS):
            for k, (i, j) in enumerate(m.pairs):
                c, a, b = cells(i, j)
                q = 1 / (1 + np.exp(-f))
                g, h = np.bincount(c, y - q, a * b).reshape(a, b), np.bincount(c, q * (1 - q), a * b).reshape(a, b)
                # a tree of depth two: cut one side, then the other within each part
                step = np.zeros((a, b))
                first = _tree(g.sum(1), h.sum(1), 2)
                for v in np.unique(first):
                    rows = first == v
                    step[rows] = _tree(g[rows].sum(0), h[rows].sum(0), 2, ridge=5.0)
                m.pair_tables[k] += RATE * step
                f += RATE * step.ravel()[c]
        return m


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Additive:
    """A model of ``quality`` from at most ``bound`` labelled rows, held-out ids never among them."""
    x, y = sampled_features(labelled_sample(docs, labels.where(~held_out()), bound))
    return Additive.fit(x, (y == 1).astype(np.float64))


def score(docs: DataFrame, model: Additive) -> DataFrame:
    """doc_id, held_out, score and predicted for every row by its whole text.

    Null texts score as empty ones. A null id has a null held_out. Rows with equal
    ids are scored one by one; columns other than doc_id and text are ignored.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for t in texts(b.column(2)):
                s = m.score(features(stats(t)))
                yield table(schema, doc_id=b.column(0).slice(t.first, t.n), held_out=b.column(1).slice(t.first, t.n), score=s, predicted=(s >= CUT).astype(np.int32))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
