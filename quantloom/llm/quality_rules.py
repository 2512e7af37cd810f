"""Quality rules: an isolation forest over rule statistics.

Random splits isolate a document in few steps where its statistics are unusual
(Liu et al., 2008). Each tree draws its own few rows, as the method has it, from all
rows labelled good; all labelled rows set the box that cuts are drawn from and the
score above which a document is rejected. A document that
fails a base rule is rejected whatever its score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, small_batches
from .textkit import table, texts
from .textstats import COUNTS, FEATURES, features, stats

BUCKETS = 4_096  # of labelled rows, by the hash of their id: a row's number is the rows of the buckets before and its place in its own
TREES, LEAVES, LEVELS = 200, 256, 16
KEEP = 0.998  # share of rows labelled good that the threshold must keep


def _expected_path(n: np.ndarray | int) -> np.ndarray:
    """Mean path length of an unsuccessful search among n items."""
    n = np.asarray(n, np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as flat arrays: split column (-1: leaf), cut, first child, path length at leaves."""

    column: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    depth: np.ndarray
    roots: np.ndarray
    size: int
    threshold: float = np.inf

    @classmethod
    def fit(cls, drawn: list[np.ndarray], low: np.ndarray, high: np.ndarray, seed: int = 17) -> "Forest":
        """One tree for the rows of each draw, with cuts taken uniformly from the box that is left of [low, high].

        The box comes from all rows, draws from the usual ones only: what lies where
        no usual row does ends in an empty leaf after few cuts.
        """
        rng = np.random.default_rng(seed)
        column, cut, child, depth, roots = [], [], [], [], []

        def grow() -> int:
            column.append(-1), cut.append(0.0), child.append(0), depth.append(0.0)
            return len(column) - 1

        for x in drawn:
            roots.append(grow())
            todo = [(x, 0, low, high, roots[-1])]
            while todo:
                rows, level, lo, hi, at = todo.pop()
                c = int(rng.integers(len(lo)))
                if level >= LEVELS or len(rows) <= 1 or hi[c] <= lo[c]:
                    depth[at] = level + float(_expected_path(len(rows)))
                    continue
                v = float(rng.uniform(lo[c], hi[c]))
                column[at], cut[at], child[at] = c, v, len(column)
                less = rows[:, c] < v
                lo2, hi2 = lo.copy(), hi.copy()
                lo2[c] = hi2[c] = v
                todo += [(rows[less], level + 1, lo, hi2, grow()), (rows[~less], level + 1, lo2, hi, grow())]
        return cls(*(np.array(a) for a in (column, cut, child, depth, roots)), len(drawn[0]))

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for anomalies."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                c = self.column[at]
                inner = c >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(c, 0)] >= self.cut[at]
                at = np.where(inner, self.child[at] + right, at)
            total += self.depth[at]
        return 2.0 ** (-total / max(len(self.roots), 1) / max(float(_expected_path(self.size)), 1e-9))


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int, where: str = "true") -> DataFrame:
    """At most ``bound`` labelled documents, those of the least hash of the id: (doc_id, text, quality)."""
    known = labels.where("doc_id is not null and quality in (0, 1)").where(where)
    few = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few), "doc_id")


def sampled_features(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and quality of a bounded sample, in the order of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("x", pa.list_(pa.float64()))])
        for b in batches:
            for t in texts(b.column(1)):
                x = features(stats(t))
                part = slice(t.first, t.first + t.n)
                yield table(schema, doc_id=b.column(0).to_numpy()[part], quality=b.column(2).to_numpy()[part], x=list(x))

    rows = sample.select("doc_id", "text", F.col("quality").cast("int").alias("quality")).mapInArrow(run, "doc_id long, quality int, x array<double>").toPandas()
    rows = rows.sort_values("doc_id")
    x = np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, len(FEATURES)))
    return x, rows["quality"].to_numpy()


def labelled_features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, good, x): every labelled document that the base rules leave to the forest, with its features.

    Features are made before labels are joined, so no text is shuffled; labels are not sent
    to all tasks, as Spark takes them for as small as their file. Rows that share an id are each taken.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])
        for b in batches:
            for t in texts(b.column(1)):
                x = features(stats(t))
                left = (x[:, 0] >= np.log1p(20)) & (x[:, 4] <= 0.3)  # the base rules decide the others
                yield table(schema, doc_id=b.column(0).to_numpy()[t.first : t.first + t.n][left], x=list(x[left]))

    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") == 1).alias("good"))
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<double>")
    return rows.join(known.hint("merge"), "doc_id").select("doc_id", "good", "x")


def drawn_rows(good: DataFrame, trees: int = TREES, leaves: int = LEAVES, seed: int = 17) -> list[np.ndarray]:
    """For each tree, that many different rows out of all: numbers are drawn, and only the rows that have them are fetched."""
    rows = good.select("doc_id", "x", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    counts = np.zeros(BUCKETS, np.int64)
    for r in rows.groupBy("bucket").count().collect():  # BUCKETS at most
        counts[r[0]] = r[1]
    before, n = np.cumsum(counts) - counts, int(counts.sum())
    rng = np.random.default_rng(seed)
    picks = [rng.choice(n, min(leaves, n), replace=False) for _ in range(trees)]
    wanted = np.unique(np.concatenate(picks))
    bucket = np.searchsorted(before + counts, wanted, "right")
    asked = good.sparkSession.createDataFrame(pa.table({"bucket": pa.array(bucket, pa.int32()), "place": pa.array(wanted - before[bucket] + 1, pa.int32()), "number": wanted}))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy("doc_id", "x")))
    got = rows.join(F.broadcast(asked), ["bucket", "place"]).select("number", "x").toPandas().sort_values("number")
    x = np.stack(got["x"].to_numpy())
    return [x[np.searchsorted(wanted, p)] for p in picks]


def threshold(scored: DataFrame, n_good: int, n_bad: int, keep: float = KEEP) -> float:
    """The score that separates all labels best (true rate of bad less false rate) and keeps that share of the good.

    Only a score of a good row can do so: above any other, fewer bad ones are rejected than at the good one below it, and no
    fewer good ones. So the highest scores of good rows, a share of 1 - keep, are fetched, and bad ones are counted between them.
    Where all rows are good, or none is, nothing tells a score apart: it is infinite and only the base rules reject.
    """
    if not n_good or not n_bad:
        return np.inf
    most = n_good - int(np.ceil((n_good - 1) * keep))
    top = scored.where("good").select("score").orderBy(F.desc("score")).limit(most).toPandas()["score"].to_numpy()
    cuts = np.unique(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n = np.unique(np.searchsorted(cuts, b.column(0).to_numpy(), "left"), return_counts=True)
            yield pa.record_batch({"at": pa.array(at, pa.int64()), "n": pa.array(n, pa.int64())})

    above = np.zeros(len(cuts) + 1)  # bad rows above so many cuts
    for r in scored.where("not good").select("score").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n")).collect():
        above[r[0]] = r[1]
    bad = np.cumsum(above[::-1])[::-1][1:] / n_bad
    good = (len(top) - np.searchsorted(np.sort(top), cuts, "right")) / n_good
    return float(cuts[int(np.argmax(bad - good))])


def fit(docs: DataFrame, labels: DataFrame) -> Forest | None:
    """A forest calibrated on all labelled rows, or None where no row is labelled good: then only base rules reject."""
    rows = cut(labelled_features(docs, labels))
    ends = rows.agg(F.count_if(F.col("good")), F.count_if(~F.col("good")), *[f(F.col("x")[k]) for f in (F.min, F.max) for k in range(len(FEATURES))]).first()
    n_good, n_bad, low, high = ends[0], ends[1], ends[2 : 2 + len(FEATURES)], ends[2 + len(FEATURES) :]
    if not n_good:
        return None
    forest = Forest.fit(drawn_rows(rows.where("good")), np.array(low), np.array(high))
    model = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.record_batch({"good": b.column(0), "score": pa.array(model.value.score(x))})

    forest.threshold = threshold(cut(rows.select("good", "x").mapInArrow(run, "good boolean, score double")), n_good, n_bad)
    return forest


def judge(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """doc_id, the five counts, base_failed, score and kept, for every row and its whole text.

    Null and empty texts count 0 words and fail the base rules. Rows with equal or
    null ids are judged one by one. Columns other than doc_id and text are ignored.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(forest)
    schema = pa.schema(
        [("doc_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("base_failed", pa.bool_()), ("score", pa.float64()), ("kept", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = model.value
        for b in batches:
            for t in texts(b.column(1)):
                s = stats(t, more=f is not None)
                failed = (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])
                score = f.score(features(s)) if f else np.zeros(t.n)
                kept = ~failed & ~(score > (f.threshold if f else np.inf))
                yield table(schema, doc_id=b.column(0).slice(t.first, t.n), base_failed=failed, score=score, kept=kept, **{c: s[c] for c in COUNTS})

    sql = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, sql)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    The verdict is made beside the row itself, so no join by id is needed and
    rows that share an id, or have none, are each judged by their own text.
    """
    small_batches(docs.sparkSession)
    forest = fit(docs, labels)
    model = docs.sparkSession.sparkContext.broadcast(forest)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = model.value
        for b in batches:
            for t in texts(b.column(at)):
                s = stats(t, more=f is not None)
                failed = (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])
                keep = ~failed & ~(f.score(features(s)) > f.threshold) if f else ~failed
                yield b.slice(t.first, t.n).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
