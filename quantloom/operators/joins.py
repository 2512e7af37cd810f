"""As-of and range joins, planned as equi-joins and windows over chunks of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .carry import CHUNK, carried, chunk_of, dealt


def _asof(left: DataFrame, right: DataFrame, by: list[str], values: list[str], left_ts: str, right_ts: str, sides: tuple[int, int], onward: bool, chunk: Column | None) -> DataFrame:
    """Both sides in one order, in which right rows hand their values to left rows; sides order rows of one time."""
    r = right.dropna(subset=[*by, right_ts]).select(*by, F.col(right_ts).alias("_ts"), F.lit(sides[1]).alias("_side"), *[F.col(v).alias(f"_v_{v}") for v in values])
    own = left.select(*by, F.col(left_ts).alias("_ts"), F.lit(sides[0]).alias("_side"), F.struct(*left.columns).alias("_row"))
    both = own.unionByName(r, allowMissingColumns=True)
    chunk = chunk_of(both, "_ts") if chunk is None else chunk
    names = [f"_v_{v}" for v in values]
    filled = carried(dealt(both, by, chunk), r.withColumn(CHUNK, chunk), by, ["_ts", "_side", *names], names, onward)
    return filled.where("_row is not null").select("_row.*", *[F.col(f"_v_{v}").alias(v) for v in values])


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], values: list[str], left_ts: str = "ts", right_ts: str = "ts", strict: bool = False, chunk: Column | None = None) -> DataFrame:
    """Each left row with the last right values at or before its time (before, if strict).

    Both sides go through one shuffle by key and chunk of time and one ordered pass in
    each chunk; a chunk hands its last values on. Right rows are not paired with left
    rows. Right values that are null are passed over; of right rows with one time the
    greatest values count. Left rows without a key or time get nulls. ``chunk`` is an
    expression over ``_ts`` that follows it (by default days, months of dates).
    """
    return _asof(left, right, by, values, left_ts, right_ts, (0, 1) if strict else (1, 0), True, chunk)


def asof_forward(left: DataFrame, right: DataFrame, by: list[str], values: list[str], left_ts: str = "ts", right_ts: str = "ts", chunk: Column | None = None) -> DataFrame:
    """Each left row with the first right values strictly after its time; of right rows with one time the least values count."""
    return _asof(left, right, by, values, left_ts, right_ts, (1, 0), False, chunk)


def range_join(spans: DataFrame, points: DataFrame, by: list[str], start: str, end: str, ts: str = "ts", unit: str = "day") -> DataFrame:
    """Point rows with start < ts <= end beside each span, by keys and calendar bucket.

    A span is dealt to the buckets it touches, so the join is an equi-join on
    (keys, bucket) with a residual predicate, and long spans are many small pieces.
    A span that ends before it starts, or lacks a bound, holds no point.
    """
    step = F.expr(f"INTERVAL 1 {unit}")
    cells = spans.where(F.col(start) <= F.col(end)).withColumn("_b", F.explode(F.sequence(F.date_trunc(unit, start), F.date_trunc(unit, end), step)))
    pts = points.withColumn("_b", F.date_trunc(unit, F.col(ts)))
    keep = (F.col(ts) > F.col(start)) & (F.col(ts) <= F.col(end))
    return cells.join(pts, [*by, "_b"]).where(keep).drop("_b")


def aligned(rows: DataFrame, on: str, name: str, value: str, names: list[str] | None = None) -> DataFrame:
    """Series side by side: one row for each ``on`` that any of them has, one column a name, null where a series has no value there.

    Names not given are those of the table, in order.
    """
    if names is None:
        names = sorted(r[0] for r in rows.select(name).where(F.col(name).isNotNull()).distinct().collect())  # they are the columns
    return rows.groupBy(on).pivot(name, names).agg(F.max(value))


def daily_flag_to_bars(bars: DataFrame, daily: DataFrame, by: list[str], flag: str) -> DataFrame:
    """A flag of a day, known from the next day on, beside each bar."""
    return asof_backward(bars.withColumn("_d", F.to_date("ts")), daily.withColumnRenamed("day", "_d"), by, [flag], "_d", "_d", strict=True).drop("_d")


def as_of_contract(dates: DataFrame, contracts: DataFrame) -> DataFrame:
    """The contract in force at each date: the first whose expiry is after it, else the last one. Rows: symbol, ts; symbol, contract, expiry."""
    last = contracts.groupBy("symbol").agg(F.max_by("contract", "expiry").alias("_last"))
    found = asof_forward(dates, contracts, ["symbol"], ["contract"], "ts", "expiry")
    return found.join(last, "symbol", "left").withColumn("contract", F.coalesce("contract", "_last")).drop("_last")


def expiry_date(raw: Column) -> Column:
    """yyyymmdd, or yyyymm as the 15th of the month."""
    return F.to_date(F.when(F.length(raw) == 6, F.concat(raw, F.lit("15"))).otherwise(raw), "yyyyMMdd")


def fill_specs(df: DataFrame, dim: DataFrame, by: str, defaults: dict[str, float]) -> DataFrame:
    """A left join to a dimension, with defaults for keys it lacks."""
    return df.join(dim, by, "left").withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})
