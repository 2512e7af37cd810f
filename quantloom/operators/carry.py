"""Values carried along a series in two levels.

Rows of a series are dealt to tasks by chunk of its order (a day, a month, a range of
numbers), also where the input already lies by series. What a chunk hands to the next
ones is one row; only those rows are ordered by series alone. So no task holds a
series, however its rows are spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"


def chunk_of(df: DataFrame, name: str) -> Column:
    """The default chunk of an ordering column: months of dates, days of times, ranges of numbers."""
    kind = df.schema[name].dataType.typeName()
    if kind == "date":
        return F.trunc(name, "month")
    if kind.startswith("timestamp"):
        return F.date_trunc("day", name)
    return F.floor(F.col(name) / (1 << 16))


def dealt(rows: DataFrame, keys: list[str], chunk: Column) -> DataFrame:
    """rows with a column of chunks, in one partition for each key and chunk."""
    return rows.withColumn(CHUNK, chunk).repartition(*keys, CHUNK)


def carried(rows: DataFrame, known: DataFrame, keys: list[str], order: list[str], values: list[str], onward: bool = True) -> DataFrame:
    """Fills ``values`` of dealt rows with the last known ones up to each row in order, or the next ones from it on.

    ``known`` has the rows that bring values, with keys, chunk and order. Null values
    are passed over.
    """
    # what comes next is what came last in the reverse order: a frame that begins at its row would be gone through anew for each row
    way = F.asc if onward else F.desc
    near = Window.partitionBy(*keys, CHUNK).orderBy(*[way(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    far = Window.partitionBy(*keys).orderBy(way(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    end = F.max_by if onward else F.min_by
    at = lambda v: F.when(F.col(v).isNotNull(), F.struct(*order, *[x for x in values if x not in order]))
    ends = known.groupBy(*keys, CHUNK).agg(*[end(v, at(v)).alias(v) for v in values])
    asked = rows.select(*keys, CHUNK).distinct().select(*keys, CHUNK, *[F.lit(None).cast(known.schema[v].dataType).alias(v) for v in values])
    spine = asked.unionByName(ends).groupBy(*keys, CHUNK).agg(*[F.first(v, ignorenulls=True).alias(v) for v in values])
    given = spine.select(*keys, CHUNK, *[F.last(v, ignorenulls=True).over(far).alias(f"_in_{v}") for v in values])
    filled = rows.withColumns({v: F.last(v, ignorenulls=True).over(near) for v in values})
    filled = filled.join(given, [*keys, CHUNK], "left")
    return filled.withColumns({v: F.coalesce(v, f"_in_{v}") for v in values}).drop(*[f"_in_{v}" for v in values])


def running_total(df: DataFrame, keys: list[str], value: Column, name: str, chunk: Column, order: list[str]) -> DataFrame:
    """Adds the running total of value in order, by chunks that follow the order too. order must be unique by key."""
    rows = df.withColumn("_v", value)
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.withColumn(CHUNK, chunk).groupBy(*keys, CHUNK).agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, CHUNK, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
    out = dealt(rows, keys, chunk).withColumn("_in", F.sum("_v").over(inside)).join(totals, [*keys, CHUNK])
    return out.withColumn(name, F.col("_in") + F.col("_before")).drop(CHUNK, "_v", "_in", "_before")


def numbered(df: DataFrame, keys: list[str], name: str, chunk: Column, order: list[str]) -> DataFrame:
    """Adds the number of each row in its key's order, from 1."""
    return running_total(df, keys, F.lit(1).cast("long"), name, chunk, order)


def union_times(series: list[DataFrame], keys: list[str], values: list[str], ts: str = "ts", chunk: Column | None = None) -> DataFrame:
    """Every key at every time that any row of any series has, with its last values up to then.

    One row for each pair of key and time. Values are null before a key's first one; of
    rows of a key at one time the greatest values count. Rows without a key or time are
    passed over. Keys are the few series to be laid side by side, so times are repeated
    for each of them, which is the size of the result.
    """
    rows = series[0]
    for more in series[1:]:
        rows = rows.unionByName(more)
    rows = rows.select(*keys, ts, *values).dropna(subset=[*keys, ts])
    chunk = chunk_of(rows, ts) if chunk is None else chunk
    spine = rows.select(ts).distinct().join(rows.select(*keys).distinct())
    every = dealt(spine.select(*keys, ts).unionByName(rows, allowMissingColumns=True), keys, chunk)
    # of the rows of a key and time the last one in order has its values
    last = Window.partitionBy(*keys, CHUNK, ts).orderBy(*[F.desc_nulls_last(v) for v in values])
    every = every.withColumn("_n", F.row_number().over(last))
    filled = carried(every, rows.withColumn(CHUNK, chunk), keys, [ts, *values], values)
    return filled.where("_n = 1").select(*keys, ts, *values)
