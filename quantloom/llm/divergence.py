"""How far the words of each source lie from those of the other sources of its language.

A text's bytes go through one 256-entry table that lowers A-Z and turns every ASCII
byte that is no letter into a blank; splitting at blanks gives the terms, and a counter
a document gives how often each occurs. Counters are added up in the task, by group
and term, before anything is shuffled: a row says how often a term occurs in a group
and in how many of its documents.

Shares and distances are integers. Most terms are missing from most sources, and all
terms that a source lacks have one share there. So a pair's distance over all terms is
that of a term which both lack, times all terms; plus corrections for the terms of
each source, gathered first by count; plus corrections for the terms that both have.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

LEAST_DOCS, TOP = 10, 10
SCALE = 1_000_000_000
HELD, KEPT = 1 << 18, 1 << 20  # (document, term) pairs that are added up at once, and (group, term) sums that a task keeps
SENT = 1 << 23  # bytes of groups that are sent to all tasks; more are shuffled
_LETTERS = {*range(65, 91), *range(97, 123), *range(128, 256)}
#: A-Z to a-z, other letters and all bytes of longer characters as they are, the rest to blanks.
TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if c in _LETTERS else 32 for c in range(256))


def terms(text: bytes) -> Counter:
    return Counter(text.translate(TABLE).split())


_SUMS = pa.schema([("g", pa.int32()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])
_OUT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _summed(rows: pa.Table) -> pa.Table:
    out = rows.group_by(["g", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return out.select(["g", "term", "n_sum", "docs_sum"]).rename_columns(_SUMS.names)


class Sums:
    """Counters added up by group and term; what is held is bounded, and handed on when it is full."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.tables: list[pa.Table] = []
        self._fresh()

    def _fresh(self) -> None:
        self.at, self.sizes, self.words, self.counts = [], [], [], []

    def add(self, group: tuple[str, str], seen: Counter) -> None:
        self.at.append(self.groups.setdefault(group, len(self.groups)))
        self.sizes.append(len(seen))
        self.words.extend(seen)
        self.counts.extend(seen.values())

    def _fold(self) -> None:
        g = np.repeat(np.array(self.at, np.int32), self.sizes)
        cols = [pa.array(g), pa.array(self.words, pa.binary()), pa.array(self.counts, pa.int64()), pa.array(np.ones(len(g), np.int64))]
        self._fresh()
        self.tables.append(_summed(pa.table(cols, schema=_SUMS)))

    def full(self, held: int, kept: int, end: bool = False) -> Iterator[pa.RecordBatch]:
        if self.words and (end or len(self.words) > held):
            self._fold()
        if sum(map(len, self.tables)) > (0 if end else kept):
            whole = _summed(pa.concat_tables(self.tables))
            self.tables = [whole]
            if end or len(whole) > kept // 2:  # too few of them meet again
                self.tables = []
                names = [pa.array([x[j] for x in self.groups], pa.string()) for j in range(2)]
                for b in whole.to_batches(max_chunksize=1 << 16):
                    yield pa.RecordBatch.from_arrays([*[x.take(b["g"]) for x in names], b["term"].cast(pa.string()), b["n"], b["docs"]], schema=_OUT)


def _counted(batches: Iterator[pa.RecordBatch], held: int, kept: int) -> Iterator[pa.RecordBatch]:
    """Columns: lang, source, text."""
    sums = Sums()
    for b in batches:
        for first in range(0, len(b), 256):
            part = b.slice(first, 256)
            for lang, source, text in zip(*[part.column(j).to_pylist() for j in range(2)], part.column(2).cast(pa.binary()).to_pylist()):
                if seen := terms(text):
                    sums.add((lang, source), seen)
                    yield from sums.full(held, kept)
    yield from sums.full(held, kept, end=True)


def frequencies(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of all terms that occur. A term's groups lie in one partition."""
    held, kept = HELD, KEPT

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _counted(batches, held, kept)

    sums = named(docs).mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    return sums.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def named(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _sent(groups: DataFrame) -> DataFrame:
    """groups, to be sent to all tasks if their names and numbers are few bytes."""
    size = groups.agg(F.sum(F.octet_length("lang") + F.octet_length("source") + 96)).first()[0] or 0
    return F.broadcast(groups) if size <= SENT else groups


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exact; null where nothing is kept."""
    wide = lambda c: c.cast("decimal(20,0)")
    parts = F.struct((F.lit(SCALE).cast("decimal(10,0)") * wide(count + 2)).alias("top"), wide(total + 2 * kept).alias("below"))
    return F.when(kept > 0, 1 + F.call_function("div", parts["top"], parts["below"]))


def distance(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / (p + q)); shares are at most SCALE + 1, so a long holds the square."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """Rows lang, source, part, item, value, rank.

    Part ``pair``: every other source of the language, with the sum of distances over
    all kept terms. Part ``term``: the ``top`` terms that the source uses more than its
    language does, by distance. A term is kept in a language if ``least_docs`` of its
    documents have it. Ties go to the smaller item in UTF-8 order. Null text, lang and
    source are empty strings; rows that repeat count each. A group without terms has
    its pairs; a language without kept terms has distances of 0. An empty table gives
    no rows; other columns, the id among them, are ignored.

    Pairs of sources meet within a term they both have, half of each pair, and are
    summed where they are made. That is the work of an exact sum, and no more than
    terms times the pairs that the result holds.
    """
    by_term = Window.partitionBy("lang", "term")
    found = frequencies(docs).withColumns({"all_n": F.sum("n").over(by_term), "all_docs": F.sum("docs").over(by_term)})
    kept = cut(found.where(F.col("all_docs") >= least_docs).drop("docs", "all_docs"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("source_n"))
    langs = kept.groupBy("lang", "term").agg(F.max("all_n").alias("all_n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("lang_n"))
    # one row a group: totals, and the share of a term it lacks
    groups = named(docs).select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["source_n", "v", "lang_n"])
    groups = cut(groups.withColumn("p0", share(F.lit(0).cast("long"), F.col("source_n"), F.col("v"))))

    rows = kept.join(_sent(groups), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("source_n"), F.col("v")))
    rows = rows.select("lang", "source", "term", "p", "p0", share(F.col("all_n"), F.col("lang_n"), F.col("v")).alias("q"))

    a = groups.select("lang", F.col("source").alias("a"), F.col("p0").alias("a0"), "v")
    b = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0"))
    pairs = a.join(b, "lang").where("a <> b").withColumn("base", F.coalesce(distance(F.col("a0"), F.col("b0")), F.lit(0)))
    # terms of one source against all others as if they lacked them: terms of one share are one row
    shares = rows.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count("*").alias("k"))
    single = shares.join(pairs, ["lang", "a"]).groupBy("lang", "a", "b").agg(F.sum(F.col("k") * (distance(F.col("p"), F.col("b0")) - F.col("base"))).alias("own"))
    x = rows.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("x"), F.col("p0").alias("x0"))
    y = rows.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("y"), F.col("p0").alias("y0"))
    both = x.join(y, ["lang", "term"]).where("a < b")
    d = distance(F.col("x"), F.col("y")) - distance(F.col("x"), F.col("y0")) - distance(F.col("x0"), F.col("y")) + distance(F.col("x0"), F.col("y0"))
    both = both.groupBy("lang", "a", "b").agg(F.sum(d).alias("shared"))
    # distances are the same both ways
    flip = lambda df, c: df.unionByName(df.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), c))
    single = flip(single.select("lang", "a", "b", "own"), "own").groupBy("lang", "a", "b").agg(F.sum("own").alias("own"))
    value = F.col("v") * F.col("base") + F.coalesce("own", F.lit(0)) + F.coalesce("shared", F.lit(0))
    pairs = pairs.join(single, ["lang", "a", "b"], "left").join(flip(both, "shared"), ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), value.alias("value"))
    own = rows.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(own).where(F.col("rank") <= top))
