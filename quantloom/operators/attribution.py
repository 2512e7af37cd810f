"""Where PnL and risk come from: slot series, decomposition, alpha and beta."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import t_pvalue
from .windows import running_sum, series

ANNUAL = 252.0


def bar_pnl(slot_pnl: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Cumulative PnL of slots to its change a bar, 0 on the first."""
    return slot_pnl.withColumn("pnl", F.coalesce(F.col("pnl") - F.lag("pnl").over(series(*keys, ts=ts)), F.lit(0.0)))


def slot_equity(slot_pnl: DataFrame, keys: list[str], initial: float, weight: Column, ts: str = "ts") -> DataFrame:
    """Adds equity: initial capital times weight plus the last known PnL, 0 before the first."""
    w = series(*keys, ts=ts).rowsBetween(Window.unboundedPreceding, 0)
    return slot_pnl.withColumn("equity", initial * weight + F.coalesce(F.last("pnl", ignorenulls=True).over(w), F.lit(0.0)))


def daily_slot_pnl(slot_pnl: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """End-of-day PnL changes over every calendar day; a day without rows keeps the level before it."""
    from .bars import calendar_spine

    last = slot_pnl.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.max_by("pnl", ts).alias("level"))
    full = calendar_spine(last, keys).join(last, [*keys, "day"], "left")
    w = Window.partitionBy(*keys).orderBy("day")
    full = full.withColumn("level", F.coalesce(F.last("level", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    return full.withColumn("pnl", F.col("level") - F.coalesce(F.lag("level").over(w), F.lit(0.0)))


def decomposition(trades: DataFrame, bars: DataFrame, tail: float = 0.95) -> DataFrame:
    """One row a strategy from trades (strategy, pnl, commission, slippage) and bar PnL (strategy, ts, pnl).

    closed_pnl, exec_cost, signal_pnl, pnl_share (of absolute closed PnL, or of bar
    PnL where there is none), risk_share (covariance with the whole over its
    variance), max_dd_pnl (between the top of cumulative PnL and the lowest point
    after it), tail_pnl (mean on the worst days of the whole) and sharpe_like.
    """
    closed = trades.groupBy("strategy").agg(
        F.sum("pnl").alias("closed_pnl"), (-F.abs(F.sum(F.coalesce("commission", F.lit(0.0))) + F.sum(F.coalesce("slippage", F.lit(0.0))))).alias("exec_cost")
    )
    whole = bars.groupBy("ts").agg(F.sum("pnl").alias("whole"))
    both = bars.join(whole, "ts")
    risk = both.groupBy("strategy").agg((F.covar_samp("pnl", "whole") / F.nullif(F.var_samp("whole"), F.lit(0.0))).alias("risk_share"), F.sum("pnl").alias("mtm"))
    # inside days and over one row a day, so no task takes every bar time
    path = running_sum(whole, [], F.col("whole"), "cum", F.to_date("ts"))
    top = path.agg(F.max_by("ts", F.struct("cum", -F.unix_micros(F.col("ts").cast("timestamp")))).alias("a"))
    after = path.join(F.broadcast(top)).where("ts >= a").groupBy("a").agg(F.min_by("ts", F.struct("cum", "ts")).alias("b"))
    dd = bars.join(F.broadcast(after)).where("ts between a and b").groupBy("strategy").agg(F.sum("pnl").alias("max_dd_pnl"))
    days = bars.groupBy("strategy", F.to_date("ts").alias("day")).agg(F.sum("pnl").alias("pnl"))
    total = days.groupBy("day").agg(F.sum("pnl").alias("total"))
    cut = total.agg(F.percentile("total", 1 - tail).alias("q"), F.count("*").alias("n"))
    worst = total.join(F.broadcast(cut)).where("n >= 20 and total <= q").select("day")
    tails = days.join(worst, "day", "leftsemi").groupBy("strategy").agg(F.avg("pnl").alias("tail_pnl"))
    like = days.groupBy("strategy").agg(F.when(F.stddev_samp("pnl") > 0, F.try_divide(F.avg("pnl"), F.stddev_samp("pnl")) * ANNUAL**0.5).otherwise(0.0).alias("sharpe_like"))
    out = risk
    for part in (closed, dd, tails, like):
        out = out.join(part, "strategy", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("closed_pnl", "exec_cost", "max_dd_pnl", "tail_pnl", "sharpe_like", "risk_share")})
    every = Window.partitionBy(F.lit(0))  # one row a strategy
    all_closed, all_mtm = F.sum(F.abs("closed_pnl")).over(every), F.sum(F.abs("mtm")).over(every)
    share = F.when(all_closed > 0, F.try_divide(F.col("closed_pnl"), all_closed)).when(all_mtm > 0, F.try_divide(F.col("mtm"), all_mtm)).otherwise(0.0) * 100
    return out.select(
        "strategy", "closed_pnl", "exec_cost", (F.col("closed_pnl") - F.col("exec_cost")).alias("signal_pnl"), share.alias("pnl_share"), (F.col("risk_share") * 100).alias("risk_share"),
        "max_dd_pnl", "tail_pnl", "sharpe_like",
    )


def duty_cycle(exposure: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Mean square of absolute notional relative to its largest value."""
    total = exposure.groupBy(*keys, ts).agg(F.sum(F.abs("notional")).alias("x"))
    most = F.max("x").over(Window.partitionBy(*keys))
    rel = total.withColumn("r", F.when(most > 1e-9, F.try_divide(F.col("x"), most)))
    return rel.groupBy(*keys).agg(F.avg(F.col("r") * F.col("r")).alias("duty_cycle"))


def closed_pnl(trades: DataFrame, history: DataFrame, by: list[str], ts: str = "ts") -> DataFrame:
    """Cumulative PnL of closed trades at each time of the history, for each value of ``by`` that trades have.

    A trade counts at the history's row of its exit time; one that closes between two
    rows is in neither, as the curve knows only the history's times.
    """
    sums = trades.groupBy(*by, F.col("exit_time").alias(ts)).agg(F.sum("pnl").alias("_p"))
    spine = history.select(ts).dropna().distinct().join(trades.select(*by).dropna().distinct())  # every kind of trade at every time: the size of the result
    rows = spine.join(sums, [*by, ts], "left").withColumn("_p", F.coalesce("_p", F.lit(0.0)))
    return running_sum(rows, by, F.col("_p"), "closed_pnl", F.date_trunc("month", ts), ts).select(*by, ts, "closed_pnl")


def main_symbol(trades: DataFrame) -> DataFrame:
    """The symbol each strategy trades most; ties to the smaller name."""
    c = trades.groupBy("strategy", "symbol").agg(F.count("*").alias("n"))
    return c.groupBy("strategy").agg(F.min_by("symbol", F.struct(-F.col("n"), "symbol")).alias("symbol"))


def alpha_beta(strategy_returns: DataFrame, instrument_returns: DataFrame, symbols: DataFrame) -> DataFrame:
    """Ordinary least squares of daily strategy returns on those of its symbol: beta, yearly alpha in percent, t of both.

    Rows: (strategy, day, ret), (symbol, day, ret), (strategy, symbol). Days both have count.
    """
    x = instrument_returns.select("symbol", "day", F.col("ret").alias("x")).where("x is not null")
    rows = strategy_returns.select("strategy", "day", F.col("ret").alias("y")).where("y is not null").join(symbols, "strategy").join(x, ["symbol", "day"])
    a = rows.groupBy("strategy", "symbol").agg(
        F.regr_slope("y", "x").alias("beta"), F.regr_intercept("y", "x").alias("_i"), F.regr_sxx("y", "x").alias("_sxx"), F.regr_syy("y", "x").alias("_syy"),
        F.regr_sxy("y", "x").alias("_sxy"), F.count("*").alias("n"), F.avg("x").alias("_mx"),
    )
    left = F.greatest(F.col("_syy") - F.col("beta") * F.col("_sxy"), F.lit(0.0)) / F.nullif(F.col("n") - 2, F.lit(0))
    se_i = F.sqrt(left * (1 / F.col("n") + F.col("_mx") * F.col("_mx") / F.nullif(F.col("_sxx"), F.lit(0.0))))
    se_b = F.sqrt(left / F.nullif(F.col("_sxx"), F.lit(0.0)))
    ok = (F.col("n") > 2) & (F.col("_sxx") > 0)
    return a.select(
        "strategy", "symbol", "n", F.when(ok, F.col("beta")).otherwise(0.0).alias("beta"), F.when(ok, F.col("_i") * ANNUAL * 100).otherwise(0.0).alias("alpha"),
        F.when(ok & (se_b > 0), F.try_divide(F.col("beta"), se_b)).alias("beta_t"), F.when(ok & (se_i > 0), F.try_divide(F.col("_i"), se_i)).alias("alpha_t"),
    )


def with_p_values(ab: DataFrame) -> DataFrame:
    df = (F.col("n") - 2).cast("double")
    return ab.withColumns({"beta_p": F.coalesce(t_pvalue("beta_t", df), F.lit(1.0)), "alpha_p": F.coalesce(t_pvalue("alpha_t", df), F.lit(1.0))})


def strategy_summary(trades: DataFrame, slots: DataFrame, strategy_returns: DataFrame | None = None, instrument_returns: DataFrame | None = None) -> DataFrame:
    """Trade statistics of each strategy with alpha and beta against the symbol it trades most."""
    from .metrics import strategy_stats

    out = strategy_stats(trades, slots)
    if strategy_returns is None or instrument_returns is None:
        return out.withColumns({"alpha": F.lit(0.0), "beta": F.lit(0.0), "alpha_p": F.lit(1.0), "beta_p": F.lit(1.0)})
    ab = with_p_values(alpha_beta(strategy_returns, instrument_returns, main_symbol(trades))).drop("n", "symbol", "alpha_t", "beta_t")
    return out.join(ab, "strategy", "left").withColumns({c: F.coalesce(c, F.lit(d)) for c, d in (("alpha", 0.0), ("beta", 0.0), ("alpha_p", 1.0), ("beta_p", 1.0))})
