"""Exit analytics: excursions, forward PnL, regimes and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indicators import volatility_rank
from .joins import asof_backward, range_join

HORIZONS = (5, 15, 30, 60, 120, 240, 480, 720, 1440)


def _sign() -> Column:
    return F.when(F.col("direction") == "LONG", 1.0).otherwise(-1.0)


def excursions(trades: DataFrame, bars: DataFrame, by: list[str], multiplier: Column | None = None, unit: str = "day") -> DataFrame:
    """Adds mfe (at least 0) and mae (at most 0) in money, over bars after the entry up to the exit's bar; null without bars."""
    m = F.lit(1.0) if multiplier is None else multiplier
    hit = range_join(trades.select("trade_id", *by, "entry_time", "exit_time"), bars.select(*by, F.col("ts").alias("_t"), "high", "low"), by, "entry_time", "exit_time", "_t", unit)
    ends = hit.groupBy("trade_id").agg(F.max("high").alias("_hi"), F.min("low").alias("_lo"))
    out = trades.join(ends, "trade_id", "left")
    best = F.when(F.col("direction") == "LONG", F.col("_hi") - F.col("entry_price")).otherwise(F.col("entry_price") - F.col("_lo"))
    worst = F.when(F.col("direction") == "LONG", F.col("_lo") - F.col("entry_price")).otherwise(F.col("entry_price") - F.col("_hi"))
    size = F.abs("quantity") * m
    # greatest and least pass over nulls, so trades without bars are kept apart
    return out.withColumns({"mfe": F.when(best.isNotNull(), F.greatest(F.lit(0.0), best * size)), "mae": F.when(worst.isNotNull(), F.least(F.lit(0.0), worst * size))}).drop("_hi", "_lo")


def forward_pnl(trades: DataFrame, bars: DataFrame, by: list[str], horizons: tuple[int, ...] = HORIZONS, multiplier: Column | None = None) -> DataFrame:
    """Rows (trade_id, minutes, pnl, past_end): PnL after costs if the trade were closed that long after its entry.

    All horizons share one as-of join. Past the last bar the last close holds, and
    past_end says so.
    """
    m = F.lit(1.0) if multiplier is None else multiplier
    cost = F.coalesce("commission", F.lit(0.0)) + F.coalesce("slippage", F.lit(0.0))
    when = F.explode(F.array(*[F.lit(h) for h in horizons])).alias("minutes")
    want = trades.select("trade_id", *by, "entry_time", "entry_price", "quantity", "direction", cost.alias("cost"), when)
    want = want.withColumn("at", F.col("entry_time") + F.make_dt_interval(mins=F.col("minutes")))
    last = bars.groupBy(*by).agg(F.max("ts").alias("_last"))
    got = asof_backward(want, bars.select(*by, "ts", "close"), by, ["close"], "at", "ts").join(last, by, "left")
    pnl = _sign() * (F.col("close") - F.col("entry_price")) * F.abs("quantity") * m - F.col("cost")
    return got.select("trade_id", "minutes", pnl.alias("pnl"), (F.col("at") > F.col("_last")).alias("past_end"))


def entry_volatility(trades: DataFrame, bars: DataFrame, by: list[str], n: int = 50, history: int = 500) -> DataFrame:
    """Adds entry_volatility: rank of the rolling deviation of closes in its history, at the last bar up to the entry."""
    rows = volatility_rank(bars, n, history, "entry_volatility", 0, by)
    return asof_backward(trades, rows.select(*by, "ts", "entry_volatility"), by, ["entry_volatility"], "entry_time", "ts")


def enrich(trades: DataFrame, bars: DataFrame, by: list[str], horizons: tuple[int, ...] = HORIZONS, n: int = 50, history: int = 500) -> DataFrame:
    """Trades with holding_seconds, mfe, mae, entry_volatility and one pnl_decay_{h}m column a horizon."""
    decay = forward_pnl(trades, bars, by, horizons).groupBy("trade_id").pivot("minutes", list(horizons)).agg(F.first("pnl"))
    decay = decay.withColumnsRenamed({str(h): f"pnl_decay_{h}m" for h in horizons})
    hold = F.unix_timestamp(F.col("exit_time").cast("timestamp")) - F.unix_timestamp(F.col("entry_time").cast("timestamp"))
    out = entry_volatility(excursions(trades, bars, by), bars, by, n, history)
    return out.join(decay, "trade_id", "left").withColumn("holding_seconds", hold)


def reason_breakdown(trades: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """By exit reason: trades, wins (pnl of 0 or more), win rate, average and total."""
    by = [*(keys or []), "exit_reason"]
    return trades.groupBy(*by).agg(
        F.count("*").alias("trades"), F.count_if(F.col("pnl") >= 0).alias("wins"), (F.count_if(F.col("pnl") >= 0) / F.count("*") * 100).alias("win_rate"), F.avg("pnl").alias("avg_pnl"), F.sum("pnl").alias("total_pnl")
    )


def hold_minutes() -> Column:
    return (F.unix_timestamp(F.col("exit_time").cast("timestamp")) - F.unix_timestamp(F.col("entry_time").cast("timestamp"))) / 60


def holding_buckets(trades: DataFrame) -> DataFrame:
    """Five bins of holding time whose width follows the longest: bucket 0-4, label, average PnL and count; empty bins are 0."""
    rows = trades.select(hold_minutes().alias("m"), "pnl")
    top = rows.agg(F.coalesce(F.max("m"), F.lit(60.0)).alias("most")).withColumn("most", F.when(F.col("most") > 0, F.col("most")).otherwise(60.0))
    step = F.when(F.col("most") <= 60, 15).when(F.col("most") <= 240, 60).when(F.col("most") <= 1440, 360).otherwise(1440)
    top = top.select(step.alias("step"))
    unit = F.when(F.col("step") <= 60, F.lit(1)).when(F.col("step") == 360, F.lit(60)).otherwise(F.lit(1440))
    mark = F.when(F.col("step") <= 60, "m").when(F.col("step") == 360, "h").otherwise("d")
    at = lambda k: F.concat((F.col("step") * k / unit).cast("int").cast("string"), mark)
    b = F.col("bucket")
    label = F.when(b == 0, F.concat(F.lit("<"), at(1))).when(b == 4, F.concat(F.lit(">"), at(4))).otherwise(F.concat(at(b), F.lit("-"), at(b + 1)))
    placed = rows.where("m >= 0").join(F.broadcast(top)).withColumn("bucket", F.least(F.floor(F.col("m") / F.col("step")), F.lit(4)).cast("int"))
    got = placed.groupBy("bucket").agg(F.avg("pnl").alias("avg_pnl"), F.count("pnl").alias("n"))
    spine = top.select("step", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("bucket"))
    return spine.join(got, "bucket", "left").select("bucket", label.alias("label"), F.coalesce("avg_pnl", F.lit(0.0)).alias("avg_pnl"), F.coalesce("n", F.lit(0)).alias("n"))


def regime_buckets(trades: DataFrame, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """Average PnL and count by volatility at entry: Compression, Normal, Panic; bins closed on the right, 0 in the first."""
    v = F.col("entry_volatility")
    name = F.when(v < 0, None).when(v <= low, "Compression").when(v <= high, "Normal").when(v <= 1, "Panic")
    got = trades.withColumn("regime", name).where("regime is not null").groupBy("regime").agg(F.avg("pnl").alias("avg_pnl"), F.count("pnl").alias("n"))
    spine = trades.sparkSession.createDataFrame([("Compression",), ("Normal",), ("Panic",)], "regime string")
    return spine.join(F.broadcast(got), "regime", "left").select("regime", F.coalesce("avg_pnl", F.lit(0.0)).alias("avg_pnl"), F.coalesce("n", F.lit(0)).alias("n"))


def exit_summary(enriched: DataFrame, slots: DataFrame) -> DataFrame:
    """By strategy: mean mfe, mae and PnL after an hour, win rate and mean holding minutes."""
    a = enriched.groupBy("strategy").agg(
        F.avg("mfe").alias("avg_mfe"), F.avg("mae").alias("avg_mae"), F.avg("pnl_decay_60m").alias("avg_pnl_60m"), (F.count_if(F.col("pnl") > 0) / F.count("*") * 100).alias("win_rate"), F.avg(hold_minutes()).alias("avg_minutes")
    )
    return slots.select("strategy").distinct().join(a, "strategy", "left")


def decay_curve(forward: DataFrame, trades: DataFrame) -> DataFrame:
    """Mean forward PnL of each horizon up to the longest holding time."""
    most = trades.agg(F.max(hold_minutes()).alias("most"))
    c = forward.groupBy("minutes").agg(F.avg("pnl").alias("avg_pnl"), F.count("pnl").alias("n"))
    return c.join(F.broadcast(most)).where("minutes <= most").drop("most")


def page(rows: DataFrame, order: list[Column], number: int, size: int = 25) -> DataFrame:
    """One page of rows in order; a number outside the pages is the nearest page. order must end in a unique column."""
    total = rows.count()
    last = max(1, -(-total // size))
    n = min(max(1, number), last)
    return rows.orderBy(*order).offset((n - 1) * size).limit(size)


def downsample(rows: DataFrame, keys: list[str], most: int, ts: str = "ts") -> DataFrame:
    """Every k-th row of each key and its last one, so that about ``most`` stay."""
    w = Window.partitionBy(*keys).orderBy(ts)
    n, i = F.count("*").over(Window.partitionBy(*keys)), F.row_number().over(w)
    step = F.greatest(F.lit(1), F.ceil(n / most))
    return rows.withColumns({"_i": i, "_n": n, "_s": step}).where(((F.col("_i") - 1) % F.col("_s") == 0) | (F.col("_i") == F.col("_n"))).drop("_i", "_n", "_s")
