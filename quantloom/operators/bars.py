"""Bar construction: time, Heikin-Ashi, volume and range bars, and resampling with calendar spines."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import in_utc, recurrence, running_sum, series

BAR_TYPES = ("time", "heikin_ashi", "volume", "range")


def bars_from_ticks(ticks: DataFrame, freq: str) -> DataFrame:
    """(symbol, ts, price, size) rows to open/high/low/close/volume/n bars; one partial aggregate, one shuffle."""
    start = F.window("ts", freq)["start"]
    return ticks.groupBy("symbol", start.alias("bar")).agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "ts").alias("close"), F.sum("size").alias("volume"), F.count("*").alias("n"),
    ).withColumnRenamed("bar", "ts")


def resample(bars: DataFrame, freq: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Coarser bars from finer ones; empty bins make no row."""
    start = F.window("ts", freq)["start"]
    return bars.groupBy(*keys, start.alias("bar")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
    ).withColumnRenamed("bar", "ts")


def calendar_spine(df: DataFrame, keys: list[str], day: str = "day", step: str = "1 day") -> DataFrame:
    """Every day (or step) of each key between its first and last."""
    ends = df.groupBy(*keys).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    return ends.select(*keys, F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {step}"))).alias(day))


#: Bin labels: the day; the Sunday that ends the week; the last day of the month.
HORIZONS = {
    "1d": lambda d: d,
    "1w": lambda d: F.date_add(F.date_trunc("week", d).cast("date"), 6),
    "1m": lambda d: F.last_day(d),
}


def resample_sum(df: DataFrame, keys: list[str], value: str, horizon: str = "1d", ts: str = "ts") -> DataFrame:
    """Sums by calendar bin; bins without rows inside a key's span are 0. Column names: keys, day, value."""
    daily = df.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.sum(value).alias(value))
    full = calendar_spine(daily, keys).join(daily, [*keys, "day"], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))
    if horizon == "1d":
        return full
    return full.groupBy(*keys, HORIZONS[horizon](F.col("day")).alias("day")).agg(F.sum(value).alias(value))


def heikin_ashi(bars: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Averaged bars. The open is the linear recurrence (previous open + previous close) / 2, so it runs in chunks."""
    w = series(*keys)
    close = (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4
    rows = bars.withColumn("_hc", close).withColumn("_x", F.coalesce(F.lag("_hc").over(w), F.col("open")))
    rows = recurrence(rows, list(keys), F.col("_x"), "_ho", 0.5, F.date_trunc("month", "ts"))
    return rows.withColumns(
        {"open": F.col("_ho"), "high": F.greatest("high", "_ho", "_hc"), "low": F.least("low", "_ho", "_hc"), "close": F.col("_hc")}
    ).drop("_hc", "_ho", "_x")


def volume_bars(bars: DataFrame, threshold: float, keys: tuple[str, ...] = ("symbol",), chunk: Column | None = None) -> DataFrame:
    """Bars of at least the volume: bucket = floor(running volume / threshold), stamped with the last bar in it."""
    chunk = F.to_date("ts") if chunk is None else chunk
    rows = running_sum(bars, list(keys), F.col("volume"), "_cum", chunk)
    rows = rows.withColumn("bucket", F.floor(F.round(F.col("_cum"), 6) / threshold))
    return rows.groupBy(*keys, "bucket").agg(
        F.max("ts").alias("ts"), F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
    )


def range_bars(bars: DataFrame, ticks: float, tick_size: float = 1.0, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Bars that close once their high and low are apart by ticks * tick_size; the next one starts at that close.

    A trailing part is kept if it has volume and a bar was made before it. The path
    decides, so each series is one ordered pass.
    """
    width = ticks * tick_size

    def one(t: pa.Table) -> pa.Table:
        t = in_utc(t).sort_by("ts")
        ts, cols = t["ts"].to_pylist(), [t[c].to_numpy() for c in ("open", "high", "low", "close", "volume")]
        out, at, high, low, vol = [], None, None, None, 0.0
        for i, (o, h, lo, c, v) in enumerate(zip(*cols)):
            if at is None:
                at, high, low = o, o, o
                high, low = max(cols[1][0], high), min(cols[2][0], low)
            high, low, vol = max(high, h), min(low, lo), vol + v
            if high - low >= width:
                out.append((ts[i], at, high, low, c, vol))
                at = high = low = c
                vol = 0.0
        if vol > 0 and out and len(ts) and ts[-1] != out[-1][0]:
            out.append((ts[-1], at, high, low, cols[3][-1], vol))
        key = [t[k][0].as_py() for k in keys]
        names = [*keys, "ts", "open", "high", "low", "close", "volume"]
        rows = [(*key, *r) for r in out]
        return pa.table({n: pa.array([r[j] for r in rows], t.schema.field(n).type) for j, n in enumerate(names)})

    names = [*keys, "ts", "open", "high", "low", "close", "volume"]
    src = bars.select(*names)
    return src.groupBy(*keys).applyInArrow(one, src.schema)


def build(bars: DataFrame, bar_type: str = "time", bar_size: float = 0.0, tick_size: float = 1.0) -> DataFrame:
    """The bar type asked for; time bars, unknown types and sizes that make no sense give the bars as they are."""
    if bar_type == "heikin_ashi":
        return heikin_ashi(bars)
    if bar_type == "volume" and bar_size > 0:
        return volume_bars(bars, bar_size)
    if bar_type == "range" and bar_size > 0:
        return range_bars(bars, bar_size, tick_size)
    return bars


def back_adjust(chunks: DataFrame) -> DataFrame:
    """Joins contracts into one series: each older contract is shifted by the gaps of all later rolls.

    Rows: symbol, contract, ts and prices (average too, where it exists). The gap of a roll is the first open of
    the newer contract less the last close of the older one, both unadjusted.
    """
    per = chunks.groupBy("symbol", "contract").agg(F.min("ts").alias("a"), F.min_by("open", "ts").alias("first_open"), F.max_by("close", "ts").alias("last_close"))
    w = Window.partitionBy("symbol").orderBy("a")
    gaps = per.withColumn("gap", F.lead("first_open").over(w) - F.col("last_close"))
    later = Window.partitionBy("symbol").orderBy(F.desc("a")).rowsBetween(Window.unboundedPreceding, 0)
    shift = gaps.select("symbol", "contract", F.coalesce(F.sum("gap").over(later), F.lit(0.0)).alias("_shift"))
    prices = [c for c in ("open", "high", "low", "close", "average") if c in chunks.columns]
    out = chunks.join(shift, ["symbol", "contract"])
    return out.withColumns({c: F.col(c) + F.col("_shift") for c in prices}).drop("_shift")


def keep_last(df: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """One row a key: the one that arrived last."""
    w = Window.partitionBy(*keys).orderBy(F.desc(arrival))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
