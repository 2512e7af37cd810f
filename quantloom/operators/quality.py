"""Data-quality checks on bars: one ordered pass for flags, one aggregate for counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..settings import TIMEFRAMES

# Limits that results must agree with.
MAX_GAP_MINUTES = {"1m": 30, "5m": 30, "30m": 180, "1h": 180}
MAX_JUMP = {"1m": 0.05, "5m": 0.05, "30m": 0.08, "1h": 0.08}
LEAST_SCORE = 0.95


def normalise_timeframes(frames: list[str] | None) -> list[str]:
    out = [f.lower() for f in frames or TIMEFRAMES]
    if bad := [f for f in out if f not in TIMEFRAMES]:
        raise ValueError(f"unknown timeframes: {bad}")
    return out


def flags(bars: DataFrame) -> DataFrame:
    """Every bar with gap, ohlc, volume and price flags. Rows: symbol, timeframe, ts, prices, volume, and average and contract if there are any."""
    w = Window.partitionBy("symbol", "timeframe").orderBy("ts")
    group = Window.partitionBy("symbol", "timeframe")
    pick = lambda table: F.element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))]), F.col("timeframe"))
    before = F.lag("ts").over(w)
    minutes = F.timestamp_diff("SECOND", before, F.col("ts")) / 60 if hasattr(F, "timestamp_diff") else (F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(before.cast("timestamp"))) / 60
    gap = (F.to_date(before) == F.to_date("ts")) & (minutes > pick(MAX_GAP_MINUTES))
    ohlc = (
        (F.col("high") < F.col("low")).cast("int")
        + ((F.col("high") < F.col("open")) | (F.col("high") < F.col("close"))).cast("int")
        + ((F.col("low") > F.col("open")) | (F.col("low") > F.col("close"))).cast("int")
    )
    mean, sd = F.avg("volume").over(group), F.stddev_samp("volume").over(group)
    odd_volume = F.when(sd > 0, F.abs(F.try_divide(F.col("volume") - mean, sd)) > 5).otherwise(False)
    price = F.lit(0)
    if "average" in bars.columns:
        price = price + F.coalesce(((F.col("average") < F.col("low")) | (F.col("average") > F.col("high"))).cast("int"), F.lit(0))
    if "contract" in bars.columns:
        rolled = F.lag("contract").over(w).isNotNull() & ~F.lag("contract").over(w).eqNullSafe(F.col("contract"))
        jump = F.abs(F.try_divide(F.col("close"), F.lag("close").over(w)) - 1) > pick(MAX_JUMP)
        price = price + F.coalesce((rolled & jump).cast("int"), F.lit(0))
    return bars.withColumns(
        {"gap": F.coalesce(gap, F.lit(False)), "gap_minutes": minutes, "ohlc_faults": ohlc, "odd_volume": F.coalesce(odd_volume, F.lit(False)), "price_faults": price}
    )


def validate(bars: DataFrame) -> DataFrame:
    """One row a series: counts, score, verdict and up to three example gaps."""
    total = F.count("*")
    out = flags(bars).groupBy("symbol", "timeframe").agg(
        total.alias("bars"), F.count_if("gap").alias("gaps"), F.sum("ohlc_faults").alias("ohlc_faults"), F.count_if("odd_volume").alias("odd_volumes"),
        F.sum("price_faults").alias("price_faults"), F.slice(F.array_sort(F.collect_list(F.when(F.col("gap"), F.col("ts")))), 1, 3).alias("first_gaps"),
    )
    faults = F.col("gaps") + 10 * F.col("ohlc_faults") + F.col("odd_volumes") + 25 * F.col("price_faults")
    out = out.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - faults / F.col("bars"))))
    return out.withColumn("is_valid", (F.col("score") >= LEAST_SCORE) & (F.col("price_faults") == 0))


def report(validated: DataFrame) -> str:
    """Plain text, one line a series; the validated table has one row a series."""
    rows = validated.orderBy("symbol", "timeframe").collect()
    lines = [f"{'PASS' if r.is_valid else 'FAIL'}  {r.symbol:<8}{r.timeframe:<5}bars {r.bars:>9,}  score {r.score:.4f}  gaps {r.gaps}  ohlc {r.ohlc_faults}  volume {r.odd_volumes}  price {r.price_faults}" for r in rows]
    return "\n".join([*lines, f"{sum(r.is_valid for r in rows)} of {len(rows)} series pass"])
