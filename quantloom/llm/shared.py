"""What several operators need: shared storage, connected components, bounded filters."""

from __future__ import annotations

import os
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set, a local master gets one in its own temp folder; a cluster must set it."""
    ctx = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or ctx.getCheckpointDir()
    if not path:
        if not (ctx.master == "local" or ctx.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "quantloom-checkpoints")
    if not ctx.getCheckpointDir():
        ctx.setCheckpointDir(path)
    return path


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds what tasks hand to Python at once to 4 MB, unless the session has set a bound of its own.

    Rows are whole texts here, and Spark's own bound (64 MB) is held several times over
    by a task, its Python worker and what goes back.
    """
    if spark.conf.get(BATCH) == "67108864b":
        spark.conf.set(BATCH, "4m")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


SMALL = 1 << 19  # rows of two longs that are sent to all tasks, 8 MB; more are shuffled


def few(df: DataFrame) -> DataFrame:
    """df, to be sent to all tasks if it has few rows. Rows hold two longs at most."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


FEW = 1 << 18


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links between longs to (node, component): the smallest id each node can reach.

    Alternates large-star and small-star (Kiveris et al., 2014): every node
    hands its neighbours to the smallest of them until stars are left. Both steps
    are a combinable minimum and an equi-join, so a node with very many links
    neither gathers in one task nor makes pairs of its neighbours.
    """
    links = cut(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before, n = None, links.count()
    while n:
        # few links: minima go to all tasks (two longs a node, 2 * FEW nodes at most) and files stay few
        sent = F.broadcast if n <= FEW else (lambda df: df)
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(sent(low), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(sent(low), "u")
        out = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        out = out.where(F.col("u") != F.col("v")).distinct()
        links = cut(out.coalesce(1 + (n >> 15)) if n <= FEW else out)
        row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        n = row[0]
        if row == before:
            break
        before = row
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


BLOOM_BITS = 16  # for each id: one in some 200 others passes
BLOOM_IDS = 1 << 22  # ids that a filter is made of: 8 MB; more are joined


def bloom(ids: DataFrame, n: int) -> bytes:
    """A Bloom filter of the n ids in the one long column, of ``BLOOM_BITS`` or more bits each."""
    bits = 1 << max(12, (BLOOM_BITS * n - 1).bit_length())
    spots_ = F.explode(F.array(*[F.pmod(s, F.lit(bits)) for s in spots(F.col(ids.columns[0]))])).alias("p")
    words = ids.select(spots_).select((F.col("p") / 64).cast("long").alias("w"), F.expr("shiftleft(1L, int(p % 64))").alias("b"))
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # at most bits / 64 rows
    out = np.zeros(bits // 64, np.int64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return out.tobytes()


def spots(c) -> list:
    """The hashes of an id that :func:`bloom` and :func:`passes` use."""
    return [F.xxhash64(c, F.lit(i)) for i in range(3)]


def passes(filt: bytes, hashes: list[np.ndarray]) -> np.ndarray:
    """True for all ids in the filter and few others."""
    words = np.frombuffer(filt, np.int64).view(np.uint64)
    keep = np.ones(len(hashes[0]), bool)
    for h in hashes:
        p = h & (len(words) * 64 - 1)
        keep &= (words[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
    return keep
