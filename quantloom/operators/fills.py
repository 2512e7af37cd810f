"""Fill prices and costs as column expressions, for studies that need no order state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions.stats import trunc
from ..settings import SPREAD_SHARE, RunSettings
from .carry import running_total
from .frames import overlapped
from .windows import rolling

SEQ_CHUNK = 1 << 16  # fills of a chunk of a running total


def limit_fill(side: Column, limit: Column, o: str = "open", h: str = "high", lo: str = "low") -> Column:
    """Price and phase of a limit order on a bar; null price: no fill. Better opens fill at the open."""
    buy = F.when(F.col(o) <= limit, F.struct(F.col(o).alias("price"), F.lit("OPEN").alias("phase"))).when(
        F.col(lo) <= limit, F.struct(limit.alias("price"), F.lit("INTRABAR").alias("phase"))
    )
    sell = F.when(F.col(o) >= limit, F.struct(F.col(o).alias("price"), F.lit("OPEN").alias("phase"))).when(
        F.col(h) >= limit, F.struct(limit.alias("price"), F.lit("INTRABAR").alias("phase"))
    )
    return F.when(side == "BUY", buy).otherwise(sell)


def stop_fill(side: Column, stop: Column, o: str = "open", h: str = "high", lo: str = "low") -> Column:
    """The same for a stop order; gaps through the stop fill at the open."""
    buy = F.when(F.col(o) >= stop, F.struct(F.col(o).alias("price"), F.lit("OPEN").alias("phase"))).when(
        F.col(h) >= stop, F.struct(stop.alias("price"), F.lit("INTRABAR").alias("phase"))
    )
    sell = F.when(F.col(o) <= stop, F.struct(F.col(o).alias("price"), F.lit("OPEN").alias("phase"))).when(
        F.col(lo) <= stop, F.struct(stop.alias("price"), F.lit("INTRABAR").alias("phase"))
    )
    return F.when(side == "BUY", buy).otherwise(sell)


def stop_limit_fill(side: Column, stop: Column, limit: Column, o: str = "open", h: str = "high", lo: str = "low") -> Column:
    """Triggered at the open: fills there only within the limit. Triggered later: needs both prices touched, fills at the limit."""
    at = lambda price, phase: F.struct(price.alias("price"), F.lit(phase).alias("phase"))
    buy = F.when(F.col(o) >= stop, F.when(F.col(o) <= limit, at(F.col(o), "OPEN"))).when(
        (F.col(h) >= stop) & (F.col(lo) <= limit), at(limit, "INTRABAR")
    )
    sell = F.when(F.col(o) <= stop, F.when(F.col(o) >= limit, at(F.col(o), "OPEN"))).when(
        (F.col(lo) <= stop) & (F.col(h) >= limit), at(limit, "INTRABAR")
    )
    return F.when(side == "BUY", buy).otherwise(sell)


def spread_ticks(bars: DataFrame, s: RunSettings, keys: tuple[str, ...] = ("symbol",), close: str = "close") -> DataFrame:
    """Adds ``spread_ticks`` from closes before the bar: steps = trunc((short vol - base vol) / base vol / step), ticks = round(base * mult ** steps)."""
    if s.spread_mode == "static":
        return bars.withColumn("spread_ticks", F.lit(max(0, s.spread_ticks)))

    def add(rows: DataFrame, w: WindowSpec) -> DataFrame:
        rows = rows.withColumn("_r", F.log(F.try_divide(F.col(close), F.lag(close).over(w))))
        return rows.withColumns({"_s": rolling(F.stddev_samp, F.col("_r"), w, s.spread_lookback, shift=1), "_b": rolling(F.stddev_samp, F.col("_r"), w, s.spread_baseline, 2, shift=1)})

    rows = overlapped(bars, list(keys), max(s.spread_lookback, s.spread_baseline) + 2, add)
    steps = trunc(F.try_divide(F.col("_s") - F.col("_b"), F.col("_b")) / max(s.spread_step, 1e-12))
    ticks = F.greatest(F.lit(0.0), F.bround(s.spread_ticks * F.pow(F.lit(s.spread_step_multiplier), steps)))
    ok = (F.col("_s") > 0) & (F.col("_b") > 0) & (F.lit(s.spread_step) > 0)
    return rows.withColumn("spread_ticks", F.when(ok, ticks).otherwise(max(0, s.spread_ticks)).cast("int")).drop("_r", "_s", "_b")


def order_cost(order_type: Column, quantity: Column, ticks: Column, tick_size: Column, multiplier: Column, s: RunSettings) -> Column:
    """Slippage and commission in cash of one order, by the profile of its type."""
    share, rate = F.lit(1.0), F.lit(s.commission_rate)
    for kind, v in (SPREAD_SHARE | s.spread_share).items():
        share = F.when(order_type == kind, F.lit(v)).otherwise(share)
    for kind, v in s.commission_by_type.items():
        rate = F.when(order_type == kind, F.lit(v)).otherwise(rate)
    used = F.greatest(F.lit(0.0), F.bround(ticks * share))
    slip = used * tick_size * multiplier * F.abs(quantity)
    return F.struct(used.alias("ticks"), slip.alias("slippage"), (F.abs(quantity) * rate).alias("commission"), (slip + F.abs(quantity) * rate).alias("total"))


def round_trip_cost(entry_type: Column, exit_type: Column, quantity: Column, ticks: Column, tick_size: Column, multiplier: Column, s: RunSettings) -> Column:
    a = order_cost(entry_type, quantity, ticks, tick_size, multiplier, s)
    b = order_cost(exit_type, quantity, ticks, tick_size, multiplier, s)
    return a["total"] + b["total"]


def vol_target_contracts(equity: Column, weight: Column, n_symbols: Column, sigma: Column, price: Column, multiplier: Column, margin_ratio: Column,
                         target_vol: float, duty_cycle: Column, max_expansion: float = 1.0, max_contracts: int | None = None) -> Column:
    """Contracts of a slot: its share of the risk budget over the money risk of one contract, within margin and limit."""
    dc = F.greatest(duty_cycle, F.lit(1e-4))
    budget = equity * target_vol * F.sqrt(weight) * F.least(1 / F.sqrt(dc), F.sqrt(F.lit(max_expansion))) / n_symbols
    raw = F.try_divide(budget, sigma * price * multiplier)
    margin = F.floor(F.try_divide(equity * weight / n_symbols, price * multiplier * margin_ratio))
    out = F.least(F.bround(raw), margin)
    if max_contracts is not None:
        out = F.least(out, F.lit(float(max_contracts)))
    ok = (price > 0) & (multiplier > 0) & (margin_ratio > 0) & (sigma > 0) & (weight > 0)
    return F.when(ok, F.greatest(F.lit(0.0), out)).otherwise(0.0).cast("long")


def fifo_match(fills: DataFrame, keys: list[str]) -> DataFrame:
    """Round trips from fills by first-in-first-out, as an overlap join of cumulative quantity intervals.

    Holds while a series of fills nets against opposite fills only (each key's buys
    and sells matched in order). Rows: keys, seq, side, quantity, price, ts. Cumulative
    quantities are summed by chunks of seq, exact to nine decimal places.

    An interval is dealt to the buckets of cumulative quantity it touches, which are
    as wide as the key's mean fill, so the join is an equi-join on (keys, bucket).
    A pair is kept in the bucket where its overlap begins.
    """
    # decimals add up to the same sum in any order, so sums over chunks are exact and both sides see one width
    exact = F.col("quantity").cast("decimal(28,9)")
    rows = running_total(fills, [*keys, "side"], exact, "_hi", F.floor(F.col("seq") / SEQ_CHUNK), ["seq"]).withColumn("_lo", F.col("_hi") - exact)
    mean = (F.sum(exact) / F.count("quantity")).cast("double")
    width = fills.groupBy(*keys).agg(F.when(mean > 0, mean).otherwise(1.0).alias("_width"))
    at = lambda c: F.floor(F.col(c).cast("double") / F.col("_width"))
    rows = rows.join(width, keys).withColumn("_bucket", F.explode(F.sequence(at("_lo"), at("_hi"))))
    pick = lambda side, p, *more: rows.where(F.col("side") == side).select(*keys, "_bucket", *more, *[F.col(c).alias(f"{p}_{c}") for c in ("seq", "price", "ts")], F.col("_lo").alias(f"{p}_lo"), F.col("_hi").alias(f"{p}_hi"))
    b, s = pick("BUY", "buy", "_width"), pick("SELL", "sell")
    qty = (F.least("buy_hi", "sell_hi") - F.greatest("buy_lo", "sell_lo")).cast("double")
    first = F.floor(F.greatest("buy_lo", "sell_lo").cast("double") / F.col("_width")) == F.col("_bucket")
    out = b.join(s, [*keys, "_bucket"]).where((F.col("buy_lo") < F.col("sell_hi")) & (F.col("sell_lo") < F.col("buy_hi")) & first).withColumn("quantity", qty)
    long = F.col("buy_seq") < F.col("sell_seq")
    return out.select(
        *keys, F.when(long, "LONG").otherwise("SHORT").alias("direction"), F.when(long, F.col("buy_ts")).otherwise(F.col("sell_ts")).alias("entry_time"),
        F.when(long, F.col("sell_ts")).otherwise(F.col("buy_ts")).alias("exit_time"), F.when(long, F.col("buy_price")).otherwise(F.col("sell_price")).alias("entry_price"),
        F.when(long, F.col("sell_price")).otherwise(F.col("buy_price")).alias("exit_price"), "quantity", ((F.col("sell_price") - F.col("buy_price")) * F.col("quantity")).alias("gross_pnl"),
        "buy_seq", "sell_seq",
    )
