"""Rolling frames, recurrences and running totals over ordered series.

Rolling operators are row frames of the ordered window. What needs the whole past
(running totals, exponential averages) runs in two levels: inside chunks of a series,
which are dealt to tasks by key and chunk, and over one row a chunk or block.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .carry import CHUNK, dealt, running_total

_KINDS = {"double": T.DoubleType(), "long": T.LongType(), "boolean": T.BooleanType(), "string": T.StringType()}


def series(*keys: str, ts: str = "ts") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(ts)


def rolling(agg: Callable[[Column], Column], x: Column, w: WindowSpec, n: int, min_periods: int | None = None, shift: int = 0) -> Column:
    """An aggregate of the n rows that end ``shift`` rows ago; null below min_periods values."""
    frame = w.rowsBetween(-(n - 1) - shift, -shift)
    m = n if min_periods is None else min_periods
    return F.when(F.count(x).over(frame) >= m, agg(x).over(frame))


def rolling2(agg: Callable[[Column, Column], Column], x: Column, y: Column, w: WindowSpec, n: int, min_periods: int | None = None) -> Column:
    """The same for aggregates of two columns; rows where either is null do not count."""
    frame = w.rowsBetween(-(n - 1), 0)
    both = x.isNotNull() & y.isNotNull()
    x2, y2 = F.when(both, x), F.when(both, y)
    return F.when(F.count(x2).over(frame) >= (n if min_periods is None else min_periods), agg(x2, y2).over(frame))


def quantile(q: float) -> Callable[[Column], Column]:
    """Exact quantile with linear interpolation."""
    return lambda x: F.percentile(x, q)


def drawdown(x: Column, w: WindowSpec) -> Column:
    top = F.max(x).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.try_divide(x - top, top)


def running_sum(df: DataFrame, keys: list[str], value: Column, name: str, chunk: Column, ts: str = "ts") -> DataFrame:
    """Adds the running sum of value in order of ts, by chunks that ts orders too (a day, a month)."""
    return running_total(df, keys, value, name, chunk, [ts])


def widened(df: DataFrame, **columns: str) -> T.StructType:
    """The schema of df and further columns, as a new object (adding to df.schema would change df)."""
    more = T.StructType([T.StructField(n, _KINDS[k]) for n, k in columns.items()])
    return T.StructType([*df.schema.fields, *more.fields])


def in_utc(t: pa.Table) -> pa.Table:
    """t with its times named in UTC: tasks are handed them in the session's zone, and Spark takes them back in UTC only."""
    return t.cast(pa.schema([f.with_type(pa.timestamp("us", "UTC")) if pa.types.is_timestamp(f.type) and f.type.tz else f for f in t.schema]))


def recurrence(df: DataFrame, keys: list[str], value: Column, name: str, decay: float, chunk: Column, gain: float | None = None, ts: str = "ts") -> DataFrame:
    """Adds y with y[t] = decay * y[t-1] + gain * x[t], y[0] = x[0], null values passed over.

    The recurrence is linear: a block of a chunk turns its incoming value s into
    decay ** k * (s + the sum of gain * x * decay ** -i), which is a running sum. Blocks
    are as long as the powers stay far within a double. Their effects are chained over
    one row a block, and a chunk's incoming values are joined to its rows, which stay
    where they were dealt by key and chunk.
    """
    gain = 1 - decay if gain is None else gain
    base = max(decay, 1e-30)  # a decay of 0 forgets at once, and so does this one
    block = 1 << 16 if base >= 1 else min(1 << 16, max(1, int(230 / -math.log(base))))
    x = F.col("_x")
    up = lambda *by: Window.partitionBy(*keys, CHUNK, *by).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    power = lambda i: F.pow(F.lit(base), i)

    def local(rows: DataFrame) -> DataFrame:
        rows = dealt(rows.withColumn("_x", F.nanvl(value.cast("double"), F.lit(None).cast("double"))), keys, chunk)
        rows = rows.withColumn("_k", F.count(x).over(up()))
        rows = rows.withColumn("_block", F.floor(F.greatest(F.col("_k") - 1, F.lit(0)) / block).cast("int"))
        rows = rows.withColumn("_i", F.col("_k") - F.col("_block") * block)
        return rows.withColumn("_sum", F.coalesce(F.sum(gain * x * power(-F.col("_i"))).over(up("_block")), F.lit(0.0)))

    ends = local(df).groupBy(*keys, CHUNK, "_block").agg(
        F.max("_i").alias("_i"), F.max_by("_sum", F.struct("_i", ts)).alias("_sum"), F.min_by("_x", F.when(x.isNotNull(), F.struct(ts))).alias("_first")
    )

    def chain(t: pa.Table) -> pa.Table:
        t = t.sort_by([(CHUNK, "ascending"), ("_block", "ascending")])
        s, seeded, out, begins = 0.0, False, [], []
        for total, i, first in zip(t["_sum"].to_pylist(), t["_i"].to_pylist(), t["_first"].to_pylist()):
            begins.append(not seeded)
            if not seeded and i:  # as if the value before the first were the first itself
                s, seeded = first * (1 - gain) / decay if decay else 0.0, True
            out.append(s)
            s = base**i * (s + total)
        return in_utc(t.select([*keys, CHUNK, "_block"])).append_column("_in", pa.array(out, pa.float64())).append_column("_begins", pa.array(begins))

    given = ends.groupBy(*keys).applyInArrow(chain, widened(ends.select(*keys, CHUNK, "_block"), _in="double", _begins="boolean"))
    given = given.groupBy(*keys, CHUNK).agg(F.array_sort(F.collect_list(F.struct("_block", "_in", "_begins"))).alias("_given"))
    out = local(df).join(given, [*keys, CHUNK]).withColumn("_g", F.col("_given")[F.col("_block")])
    # rows of the first chunk before its first value have none
    whole = F.when(F.col("_k") > 0, power(F.col("_i")) * (F.col("_g._in") + F.col("_sum"))).when(~F.col("_g._begins"), F.col("_g._in"))
    return out.withColumn(name, whole).drop(CHUNK, "_x", "_k", "_block", "_i", "_sum", "_given", "_g")


def ema(df: DataFrame, keys: list[str], value: Column, span: int, name: str, chunk: Column | None = None, ts: str = "ts") -> DataFrame:
    """Exponential average with alpha = 2 / (span + 1), seeded by the first value."""
    chunk = F.date_trunc("month", ts) if chunk is None else chunk
    return recurrence(df, keys, value, name, 1 - 2 / (span + 1), chunk, ts=ts)
