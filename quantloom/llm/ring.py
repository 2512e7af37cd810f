"""Consistent hashing with bounded loads, with DataFrame functions only.

Shards own virtual nodes on a ring of 2**32 points, and a row belongs to the first
node at or after its own point. Rows of an arc (the points of one node) are taken
in the order of their points; a shard takes rows until it is full, and what
overflows goes on clockwise to the next nodes whose shards have room. Whole arcs
and ranks within them decide, so the walk needs the number of rows of each arc
only: shards times virtual nodes counts, whatever the size of the table. Ranks are
counted by ranges of an arc, so no arc, and no key or row that is repeated very
often, gathers in one task.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

POINTS = 1 << 32
SHARDS, VIRTUAL = 40, 64


def _point(c: F.Column) -> F.Column:
    """The first 32 bits of the md5 of a text."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")


def nodes(shards: int, virtual: int) -> list[tuple[int, int]]:
    """(point, shard) of every virtual node in ring order; equal points go to the smaller shard."""
    from hashlib import md5

    out: dict[int, int] = {}
    for s in range(shards):
        for v in range(virtual):
            p = int(md5(f"shard-{s}-{v}".encode()).hexdigest()[:8], 16)
            out[p] = min(s, out.get(p, s))
    return sorted(out.items())


def plan(counts: dict[int, int], ring: list[tuple[int, int]], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Where the rows of each arc go: (arc, first rank, end rank, shard, first slot).

    In rounds: every arc offers what is left of it to the node that its rows have
    reached, nodes in ring order, and shards take what fits.
    """
    room, taken = list(capacity), [0] * len(capacity)
    waiting = [[arc, 0, n] for arc, n in sorted(counts.items()) if n]
    out, step = [], 0
    while waiting:
        left = []
        for arc, done, n in waiting:
            shard = ring[(arc + step) % len(ring)][1]
            fits = min(n - done, room[shard])
            if fits:
                out.append((arc, done, done + fits, shard, taken[shard]))
                room[shard] -= fits
                taken[shard] += fits
                done += fits
            if done < n:
                left.append([arc, done, n])
        waiting, step = left, step + 1
    return out


ORDER = ("point", "doc_id", "text_crc32", "size", "split")


def spread(rows: DataFrame) -> DataFrame:
    """rows in ranges of (arc, point, ...), numbered in ``part``: an arc of very many rows has several.

    ``split`` is the number of the input's part a row was read from. It tells equal rows
    apart, so that however often a document is repeated, its rows need not share a range.
    """
    rows = rows.withColumn("split", F.spark_partition_id())
    return rows.repartitionByRange("arc", *ORDER).withColumn("part", F.spark_partition_id())


def assign(docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: shard counts differ by one at most, and slots of a shard
    run from 0 without gaps. A null text has no bytes (crc32 0). A null id lies at
    the point of its text. Rows that share a point are split into ranges by their texts
    and by the part of the input they come from; rows equal in every column used are
    interchangeable. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ring = nodes(shards, virtual)
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        _point(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text-"), F.md5(text)))).alias("point"),
    )
    # the arc of a point: nodes are looked up by their place in a sorted literal, one lookup a cell of the ring
    cells = 1 << 12
    points = [p for p, _ in ring]
    width = POINTS // cells
    known = spark.createDataFrame([(c, [p for p in points if c * width <= p < (c + 1) * width], bisect_left(points, c * width)) for c in range(cells)], "cell int, inside array<long>, before int")
    rows = rows.withColumn("cell", (F.col("point") / width).cast("int"))
    rows = rows.join(F.broadcast(known), "cell").withColumn(
        "arc", (F.col("before") + F.size(F.filter("inside", lambda p: p < F.col("point")))) % F.lit(len(ring))
    )
    rows = rows.select("doc_id", "size", "text_crc32", "point", F.col("arc").cast("int").alias("arc"))
    placed = cut(spread(rows))
    parts = placed.groupBy("arc", "part").agg(F.count("*").alias("n"))
    counts = {r.arc: r.n for r in parts.groupBy("arc").agg(F.sum("n").alias("n")).collect()}  # one row a virtual node at most
    total = sum(counts.values())
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    moves = spark.createDataFrame(plan(counts, ring, capacity), "arc int, first long, end long, shard int, slot0 long")
    moves = moves.groupBy("arc").agg(F.array_sort(F.collect_list(F.struct("first", "end", "shard", "slot0"))).alias("moves"))
    # ranks in two levels: within a range of an arc, after the rows of the arc's earlier ranges; a range
    # partition meets an arc once, so there are no more ranges than partitions and arcs together
    earlier = Window.partitionBy("arc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("arc", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("arc", "part").orderBy(*ORDER)
    ranked = placed.withColumn("within", F.row_number().over(within) - 1).join(F.broadcast(parts), ["arc", "part"])
    ranked = ranked.withColumn("rank", F.col("earlier") + F.col("within"))
    ranked = ranked.join(F.broadcast(moves), "arc")
    move = F.filter("moves", lambda m: (m["first"] <= F.col("rank")) & (F.col("rank") < m["end"]))[0]
    return ranked.withColumn("move", move).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("move.shard").alias("shard"),
        (F.col("move.slot0") + F.col("rank") - F.col("move.first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
