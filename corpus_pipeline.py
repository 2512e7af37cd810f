"""A training corpus in five stages, each written as Parquet and read again by the next.

Every stage works on all that its predecessor kept, and what it decides holds.
Stages but the last return the columns of ``documents``; the last returns pieces of
sequences with their token ids.

Nulls in any column pass: a null text has no words, so the quality rules drop it; a
null id, source or language stays null. Rows that repeat an id and a text are copies,
of which one stays. An empty table gives no rows. Columns besides those of
``documents`` are dropped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import line_dedup, mixing, ngram_join, packing, quality_rules
from quantloom.llm.shared import cut, few, shared_dir
from quantloom.llm.textkit import texts

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _sized(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars counted anew."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs of lines. One whose every word went is gone."""
    out = line_dedup.drop_repeats(docs.select(*COLUMNS))
    return _sized(out.where((F.col("n_deleted") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest id.

    A row is a node of its own: its id, or where that is null or stands for several
    texts, a place behind all ids below 2**62 that id and text decide. So texts that
    share an id stay or go each by itself. Of rows with one id and one text the first stays.
    """
    own = docs.select(*COLUMNS, F.col("doc_id").cast("long").alias("id"))
    hashed = own.where("id is not null").groupBy("id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
    several = cut(hashed.where("a <> b").select("id", F.lit(True).alias("several")))
    own = own.withColumn("several", F.lit(None).cast("boolean")) if several.isEmpty() else own.join(few(several), "id", "left")
    behind = F.xxhash64("text", "id").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
    own = own.select(*COLUMNS, F.when(F.col("id").isNull() | F.col("several").isNotNull(), behind).otherwise(F.col("id")).alias("node"))
    groups = ngram_join.near_duplicates(own, id_col="node")
    gone = cut(groups.where("component_id < node").select("node").distinct())
    # sent to all tasks where they are few, so that texts are not shuffled
    kept = own.join(few(gone), "node", "leftanti")
    again = cut(own.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"))
    if not again.isEmpty():
        once = kept.join(few(again), "node", "leftsemi").dropDuplicates(["node", "text"])
        kept = kept.join(few(again), "node", "leftanti").unionByName(once)
    return kept.select(*COLUMNS)


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents with rounds, first and rest to copies: whole ones, and one of the words taken besides.

    The words are cut out of the text with all that stands between them. A slice of a
    batch at a time, so memory follows the longest document.
    """
    at = COLUMNS.index("text")
    for b in batches:
        for t in texts(b.column(at)):
            part = b.slice(t.first, t.n)
            rounds, first, rest = (part.column(c).to_numpy() for c in ("rounds", "first", "rest"))
            whole = part.select(list(COLUMNS)).take(pa.array(np.repeat(np.arange(t.n), rounds)))
            some = np.flatnonzero(rest)
            cuts = part.select(list(COLUMNS)).take(pa.array(some))
            starts, ends, bounds = t.words()
            made = []
            for i in some.tolist():
                a, n = bounds[i], bounds[i + 1] - bounds[i]
                stop = first[i] + rest[i]  # a run may go on at the beginning
                pieces = [(starts[a + first[i]], ends[a + min(stop, n) - 1])] + ([(starts[a], ends[a + stop - n - 1])] if stop > n else [])
                made.append("\n".join(t.buf[x:y].tobytes().decode() for x, y in pieces))
            for rows, text in ((whole, whole.column(at)), (cuts, pa.array(made, pa.string()))):
                if len(rows):
                    new = {"text": text, "n_chars": pc.cast(pc.utf8_length(text), pa.int64())}
                    yield pa.RecordBatch.from_arrays([new.get(c, rows.column(c)) for c in COLUMNS], list(COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole rounds, then one row of the words it takes besides.

    Rows of which nothing is taken, null and empty texts among them, are gone.
    """
    rows = mixing.mix(docs.select(*COLUMNS), whole=True).where("taken > 0")
    rows = rows.select(*[F.col("row")[c].alias(c) for c in COLUMNS], "rounds", "first", "rest")
    return rows.mapInArrow(_taken, docs.select(*COLUMNS).withColumn("n_chars", F.col("n_chars").cast("long")).schema)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their ids; doc_id names the document of each. A null or empty text is the end id alone."""
    return packing.pack(docs.select(*COLUMNS))


STAGES = [("quality rules", rules), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("mixing", mixture), ("packing", packed)]

#: Hashes, models and tokenizers are not SQL; the tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
