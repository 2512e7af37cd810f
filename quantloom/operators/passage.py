"""Which of two price levels a span of bars touches first, from extrema of blocks of bars.

Bars of a symbol lie on a grid of equal steps. Blocks of ``RADIX`` bars, and blocks of
blocks, have their least low, highest high and number of bars. A span is cut into the
largest blocks that fill it, which are few however long it is; the first of them that
reaches a level is found by an equi-join, and its first touching part is sought level
by level. Neither bars nor blocks are paired freely with spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

RADIX = 16
SENT = 1 << 17  # rows of a tree of blocks that is sent to all tasks; a larger one is dealt by cells


def grid(ts: Column, step: int) -> Column:
    """Number of the last grid point at or before a time; step in seconds."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(step * 1_000_000)).cast("long")


def on_grid(ts: Column, step: int) -> Column:
    return F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(step * 1_000_000)) == 0


def blocks(bars: DataFrame, by: list[str], step: int, levels: int, ts: str = "ts") -> DataFrame:
    """(by, _level, _id, _n, _off, _lo, _hi): extrema and counts of each block; ``_off`` counts bars beside the grid and second bars of a point."""
    at = bars.dropna(subset=[*by, ts]).groupBy(*by, grid(F.col(ts), step).alias("_id")).agg(
        F.count("*").alias("_n"), (F.count_if(~on_grid(F.col(ts), step)) + F.count("*") - 1).alias("_off"), F.min("low").alias("_lo"), F.max("high").alias("_hi")
    )
    out = at.withColumn("_level", F.lit(0))
    for level in range(1, levels):
        at = at.groupBy(*by, F.floor(F.col("_id") / RADIX).alias("_id")).agg(F.sum("_n").alias("_n"), F.sum("_off").alias("_off"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
        out = out.unionByName(at.withColumn("_level", F.lit(level)))
    return out


def _cover(first: Column, last: Column, levels: int) -> Column:
    """The largest blocks that fill the points first to last, as an array of (level, id)."""
    parts = []
    run = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<long>"))
    for level in range(levels):
        here = lambda ids, k=level: F.transform(ids, lambda i: F.struct(F.lit(k).alias("level"), i.alias("id")))
        up, down = F.ceil(first / RADIX), F.floor((last + 1) / RADIX) - 1  # the blocks of the next level inside
        whole = up > down
        if level == levels - 1:
            parts.append(here(run(first, last)))
        else:
            parts += [here(run(first, F.when(whole, last).otherwise(up * RADIX - 1))), here(F.when(~whole, run((down + 1) * RADIX, last)).otherwise(F.array().cast("array<long>")))]
            # where nothing is left, an empty run on all further levels
            first, last = F.when(whole, F.lit(1)).otherwise(up).cast("long"), F.when(whole, F.lit(0)).otherwise(down).cast("long")
    return F.concat(*parts)


def first_touch(spans: DataFrame, bars: DataFrame, by: list[str], id_col: str, start: str, end: str, down: str, up: str, step: int, most: int | None = None) -> DataFrame:
    """One row a span: id_col, n_bars, complete, touched, touched_at.

    Bars (by, ts, low, high) with start < ts <= end count; step is the seconds between
    bars. ``complete``: start and end lie on the grid and each point in the span has
    exactly one bar there. Only of complete spans is it told what was touched first:
    ``down`` (a low at or below), ``up`` (a high at or above) or ``both`` in one bar,
    null for neither; touched_at is that bar's time. A span that ends before it starts,
    lacks a bound, a key or a level, or holds no point is not complete. ``id_col`` must be
    unique. ``most``, the points of the longest span, is looked up if not given.
    """
    whole = spans.select(F.col(id_col).alias("_span"), *by, F.col(down).cast("double").alias("_down"), F.col(up).cast("double").alias("_up"), (grid(F.col(start), step) + 1).alias("_a"), grid(F.col(end), step).alias("_b"),
                         (on_grid(F.col(start), step) & on_grid(F.col(end), step)).alias("_even"))
    if most is None:
        most = whole.agg(F.max(F.col("_b") - F.col("_a") + 1)).first()[0] or 1
    levels = 1
    while RADIX**levels < most:
        levels += 1
    size = RADIX**levels  # points of a cell: no block crosses one, and a span lies in two at most
    tree = cut(blocks(bars, by, step, levels))
    small = tree.count() <= SENT
    cell = lambda level, i: F.floor(i * F.pow(F.lit(RADIX).cast("double"), level).cast("long") / size)
    tree = tree.withColumn("_cell", cell(F.col("_level"), F.col("_id")))
    tree = F.broadcast(tree) if small else tree.repartition(*by, "_cell").hint("shuffle_hash")

    def met(rows: DataFrame, parts: Column) -> DataFrame:
        """Each row beside its parts (level, id) of its cell in the tree. A left join: the tree is what is sent or hashed, never spans, whose size Spark guesses from their files."""
        rows = rows if small else rows.repartition(*by, "_cell")
        rows = rows.withColumn("_part", F.explode_outer(parts)).withColumns({"_level": F.col("_part.level"), "_id": F.col("_part.id")}).drop("_part")
        return rows.join(tree, [*by, "_cell", "_level", "_id"], "left")

    touches = (F.col("_lo") <= F.col("_down")) | (F.col("_hi") >= F.col("_up"))
    keys = ["_span", *by, "_down", "_up", "_a", "_b", "_even"]
    cells = whole.withColumn("_cell", F.explode_outer(F.when(F.col("_a") <= F.col("_b"), F.sequence(F.floor(F.col("_a") / size), F.floor(F.col("_b") / size)))))
    cells = cells.withColumns({"_from": F.greatest("_a", F.col("_cell") * size), "_to": F.least("_b", F.col("_cell") * size + size - 1)})
    # blocks of a cover do not overlap, so the one that begins first is the first; its level goes with it
    begin = F.col("_id") * F.pow(F.lit(RADIX).cast("double"), F.col("_level")).cast("long")
    state = met(cells, F.when(F.col("_cell").isNotNull(), _cover(F.col("_from"), F.col("_to"), levels))).groupBy(*keys).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_bars"), F.sum("_off").alias("_off"), F.min(F.when(touches, begin * 64 + F.col("_level"))).alias("_code")
    )
    ok = F.col("_even") & (F.col("_off") == 0) & (F.col("n_bars") == F.col("_b") - F.col("_a") + 1) & F.col("_down").isNotNull() & F.col("_up").isNotNull()
    state = state.withColumn("complete", F.coalesce(ok, F.lit(False))).withColumn("_code", F.when(F.col("complete"), F.col("_code")))
    keys += ["n_bars", "complete"]
    found = state.select(*keys, F.floor(F.col("_code") / 64).alias("_begin"), (F.col("_code") % 64).cast("int").alias("_at"))
    for level in range(levels - 1, 0, -1):
        # a block of this level is replaced by its parts; the others meet themselves, which touch as well
        first = F.floor(F.col("_begin") / RADIX ** (level - 1))
        own = F.struct(F.col("_at").alias("level"), F.floor(F.col("_begin") / F.pow(F.lit(RADIX).cast("double"), F.col("_at"))).alias("id"))
        inside = F.arrays_zip(F.array_repeat(F.lit(level - 1), RADIX).alias("level"), F.sequence(first, first + RADIX - 1).alias("id"))
        parts = F.when(F.col("_at") == level, inside).when(F.col("_at").isNotNull(), F.array(own))
        found = met(found.withColumn("_cell", F.floor(F.col("_begin") / size)), parts).groupBy(*keys, F.when(F.col("_at") == level, level - 1).otherwise(F.col("_at")).alias("_at")).agg(F.min(F.when(touches, begin)).alias("_begin"))
    bar = met(found.withColumn("_cell", F.floor(F.col("_begin") / size)), F.when(F.col("_begin").isNotNull(), F.array(F.struct(F.lit(0).alias("level"), F.col("_begin").alias("id")))))
    low, high = F.col("_lo") <= F.col("_down"), F.col("_hi") >= F.col("_up")
    kind = F.when(low & high, "both").when(low, "down").when(high, "up")
    at = F.timestamp_micros(F.col("_begin") * F.lit(step * 1_000_000)).cast("timestamp_ntz")
    return bar.select(F.col("_span").alias(id_col), "n_bars", "complete", kind.alias("touched"), at.alias("touched_at"))
