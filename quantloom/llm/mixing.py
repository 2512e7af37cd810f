"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets: sources in code-point order share a multiple of all words by repeating
weights; a target stops at a multiple of its source's size and the excess is
shared again by weight. Words are dealt in equal blocks. Sources get whole numbers
of blocks by highest quotients, and so do the shards of a source: hash shards of
bounded expected size, so the largest source is many small groups. Within a shard
documents lie in seeded order; whole rounds take all of it, the rest is a run of
words that starts at a seeded place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, small_batches

WEIGHTS = (3, 1, 2)
SHARE, LIMIT = 1.5, 2
BLOCK = 16  # words
SHARD_ROWS = 256  # expected rows of a shard
SEED = "mix-1"
BINS = 4096  # of quotients that are looked at; only those of one bin are ranked
FEW = 1 << 18  # sources (a digest and four numbers each) that are sent to all tasks; more are shuffled


def words(c: F.Column) -> F.Column:
    """The number of runs outside blanks, tabs and line ends; 0 for null."""
    ends = F.regexp_replace(c, "[^\\x20\\x09-\\x0D]+", "w")
    return F.coalesce(F.length(ends) - F.length(F.translate(ends, "w", "")), F.lit(0)).cast("long")


def _hash(*cols: F.Column) -> F.Column:
    return F.xxhash64(F.lit(SEED), *cols)


def _placed(sources: DataFrame) -> DataFrame:
    """Adds ``place``, from 0, by code point with null last: ranks inside ranges, then the ranges' offsets."""
    spark = sources.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    by = F.col("source").asc_nulls_last()
    rows = cut(sources.repartitionByRange(parts, by).sortWithinPartitions(by).withColumn("at", F.monotonically_increasing_id()))
    sizes = {r.part: r.n for r in rows.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).collect()}  # one a partition
    before, offsets = 0, []
    for part in sorted(sizes):
        offsets.append((part, before))
        before += sizes[part]
    offsets = spark.createDataFrame(offsets, "part long, before long")
    rows = rows.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(offsets), "part")
    return rows.withColumn("place", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("part", "before", "at")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, ...) to the same with place, weight and target.

    A source is at its limit where the common rate of words per weight would pass
    it. The rate rises as sources stop, so a few passes over the source table (one
    row a source, aggregated to a row each pass) settle it.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = cut(_placed(sources).withColumn("weight", weight))
    rate = 0.0
    total = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        stopped = F.col("weight") * F.lit(rate) > F.lit(limit) * F.col("source_size")
        row = table.agg(
            F.sum(F.when(stopped, limit * F.col("source_size"))).alias("at_limit"), F.sum(F.when(~stopped, F.col("weight"))).alias("open")
        ).first()
        if not row["open"]:
            break
        new = (total - (row["at_limit"] or 0)) / row["open"]
        if new <= rate * (1 + 1e-12):
            break
        rate = new
    return table.withColumn("target", F.least(F.col("weight") * F.lit(rate), (limit * F.col("source_size")).cast("double")))


def apportion(groups: DataFrame, key: str, value: str, seats: str, tie: str, bins: int = BINS) -> DataFrame:
    """Adds ``quota``: how many of its key's ``seats`` a row gets, by the highest quotients value / (2 j + 1).

    A row has floor(x value + 1/2) quotients of 1 / (2 x) or more. With V the sum of
    values and n their number, x = (seats - n/2) / V gives no more quotients than seats
    and x = (seats + n/2) / V no fewer, and about n quotients lie between. Those are
    counted by bin of x, which are spread over tasks; the bin that holds the last seat
    is ranked (equal quotients in the order of ``tie``). Keys and ties are not null.
    """
    positive = groups.where(F.col(value) > 0)
    facts = positive.groupBy(key).agg(F.sum(value).cast("double").alias("_v"), F.count("*").alias("_n"), F.max(seats).alias("_s"))
    rows = positive.select(key, tie, F.col(value).alias("_own")).join(facts, key)
    low = F.greatest(F.lit(0.0), (F.col("_s") - F.col("_n") / 2) / F.col("_v"))
    high = (F.col("_s") + F.col("_n") / 2) / F.col("_v")
    # one quotient more at either end, for rounding
    rows = rows.withColumn("_base", F.greatest(F.lit(0), F.floor(F.col("_own") * low + 0.5) - 1).cast("long"))
    last = F.floor(F.col("_own") * high + 0.5).cast("long")
    # j = -1 stands for the quotients below base, which are taken without a look
    at = rows.withColumn("_j", F.explode(F.concat(F.array(F.lit(-1).cast("long")), F.sequence(F.col("_base"), last))))
    x = (2 * F.col("_j") + 1) / (2 * F.col("_own"))
    spot = F.least(F.lit(bins), F.greatest(F.lit(0), F.floor((x - low) / (high - low) * bins))).cast("int")
    at = at.select(
        key, tie, "_s", (F.col("_own") / (2 * F.col("_j") + 1)).alias("_q"),
        F.when(F.col("_j") < 0, -1).otherwise(spot).alias("_bin"), F.when(F.col("_j") < 0, F.col("_base")).otherwise(1).alias("_w"),
    )
    upto = Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = at.groupBy(key, "_bin").agg(F.sum("_w").alias("_w"), F.max("_s").alias("_s"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_w").over(upto), F.lit(0)))
    edge = sums.where((F.col("_before") < F.col("_s")) & (F.col("_before") + F.col("_w") >= F.col("_s"))).select(key, F.col("_bin").alias("_edge"), (F.col("_s") - F.col("_before")).alias("_open"))
    at = at.join(edge, key)
    ranked = at.where("_bin = _edge").withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_q"), tie)))
    got = at.where("_bin < _edge").select(key, tie, "_w").unionByName(ranked.where("_rank <= _open").select(key, tie, "_w"))
    got = got.groupBy(key, tie).agg(F.sum("_w").alias("quota"))
    return groups.join(got, [key, tie], "left").withColumn("quota", F.coalesce("quota", F.lit(0)).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT, block: int = BLOCK, whole: bool = False) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, rounds, first, rest.

    ``taken`` = rounds * size + ``rest``; the rest are the words from ``first`` on,
    around the end. With ``whole`` the columns of docs come along in a struct
    ``row``, so that the decision stands beside the text it is about. Null and empty
    texts have size 0 and take 0. The null source is a source, last in order. Null or
    equal ids are told apart by their texts; rows equal in id, source and text are
    interchangeable. Reruns agree. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce(F.md5(F.col("source").cast("binary")), F.lit("")).alias("s"), words(F.col("text")).alias("size"),
        _hash(F.col("doc_id").cast("string"), F.when(F.col("doc_id").isNull(), F.col("text"))).alias("h"), _hash("text").alias("h2"),
        *([F.struct(*docs.columns).alias("row")] if whole else []),
    )
    sized = cut(own.select("source", "s", "size", "h") if whole else own)
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"), F.first("s").alias("s"))
    sources = cut(targets(sources, weights, share, limit).withColumn("all", F.lit(0)))
    blocks = int((sources.agg(F.sum("target")).first()[0] or 0) / block + 0.5)
    sources = apportion(sources.withColumn("blocks", F.lit(blocks).cast("long")), "all", "target", "blocks", "place")
    facts = cut(sources.select("s", "place", "source_size", "target", F.col("quota").alias("source_blocks"), F.ceil(F.col("rows") / SHARD_ROWS).cast("long").alias("shards")))
    few = F.broadcast(facts) if facts.count() <= FEW else facts
    placed = lambda rows: rows.join(few, "s").withColumn("shard", F.pmod("h", "shards"))
    quotas = placed(sized).groupBy("place", "shard").agg(F.sum("size").alias("shard_size"), F.max("source_blocks").alias("source_blocks"))
    quotas = apportion(cut(quotas), "place", "shard_size", "source_blocks", "shard")
    budget = F.least(F.col("quota") * block, limit * F.col("shard_size"))
    some = lambda c: F.when(F.col("shard_size") > 0, c).otherwise(0).cast("long")
    quotas = quotas.select(
        "place", "shard", "shard_size", some(F.floor(budget / F.col("shard_size"))).alias("rounds"), some(budget % F.col("shard_size")).alias("extra"),
        some(F.floor(F.pmod(F.xxhash64(F.lit(SEED), "place", "shard"), F.col("shard_size")) / block) * block).alias("from"),
    )
    line = Window.partitionBy("place", "shard").orderBy("h", "h2", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = placed(own if whole else sized).withColumn("end", F.sum("size").over(line)).withColumn("begin", F.col("end") - F.col("size"))
    rows = rows.join(quotas, ["place", "shard"])
    # the run [from, from + extra), and what of it comes around at the start of the shard
    last = F.col("from") + F.col("extra")
    straight = F.greatest(F.lit(0), F.least("end", last) - F.greatest("begin", "from"))
    around = F.greatest(F.lit(0), F.least(F.col("end"), last - F.col("shard_size")) - F.col("begin"))
    rows = rows.withColumn("straight", straight).withColumn("rest", F.col("straight") + around)
    first = F.when(F.col("straight") > 0, F.greatest(F.lit(0), F.col("from") - F.col("begin"))).otherwise(0)
    taken = F.col("rounds") * F.col("size") + F.col("rest")
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "rounds", first.alias("first"), "rest", *(["row"] if whole else []))
