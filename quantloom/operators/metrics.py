"""Run metrics: equity-curve and trade statistics as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import norm_cdf, norm_ppf, t_pvalue
from .windows import series

EULER = 0.5772156649015329


def returns(history: DataFrame, keys: list[str], value: str = "total_value", ts: str = "ts") -> DataFrame:
    """Adds ret: simple return from the row before, null where that is 0."""
    before = F.lag(value).over(series(*keys, ts=ts))
    return history.withColumn("ret", F.col(value) / F.nullif(before, F.lit(0.0)) - 1)


def quotient(a: Column, b: Column) -> Column:
    """a / b of doubles as SQL engines on IEEE numbers have it: infinite or NaN where b is 0, null where either is."""
    by_zero = F.when(F.isnan(a) | (a == 0), float("nan")).when(a > 0, float("inf")).when(a < 0, float("-inf"))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def curve_metrics(history: DataFrame, keys: list[str], risk_free: float = 0.02, value: str = "total_value", ts: str = "ts", guarded: bool = True) -> DataFrame:
    """One row a key: return, years, CAGR, bars a year, volatility, Sharpe (on CAGR), Sortino, drawdown, Calmar, t and p.

    What has no value is 0 (a Sortino ratio without losses, a Calmar ratio without a drawdown), and a curve within a
    day counts as a year. Unless ``guarded``: then each is what its formula gives, null, infinite or NaN.
    """
    w = series(*keys, ts=ts)
    rows = returns(history, keys, value, ts)
    top = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_dd", F.try_divide(F.col(value) - top, top))
    a = rows.groupBy(*keys).agg(
        F.min_by(value, ts).alias("_first"), F.max_by(value, ts).alias("_last"), F.count("*").alias("n_bars"), F.min(ts).alias("_a"), F.max(ts).alias("_b"),
        F.stddev_samp("ret").alias("_sd"), F.avg("ret").alias("_mean"), F.count("ret").alias("_n"), F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))).alias("_down"),
        F.min("_dd").alias("max_drawdown"), F.skewness("ret").alias("_skew"), F.kurtosis("ret").alias("_kurt"),
    )
    seconds = F.unix_timestamp(F.col("_b").cast("timestamp")) - F.unix_timestamp(F.col("_a").cast("timestamp"))
    days = F.floor(seconds / 86400)
    ratio = lambda x, y, known: F.when(known, F.try_divide(x, y)).otherwise(0.0) if guarded else quotient(x, y)
    zero = lambda x: F.coalesce(x, F.lit(0.0)) if guarded else x
    growth = quotient(F.col("_last"), F.col("_first")) - 1
    a = a.withColumn("total_return", F.when(F.col("_first") != 0, growth).otherwise(0.0) if guarded else growth)
    a = a.withColumn("years", F.when(days > 0, days / 365.25).otherwise(1.0) if guarded else days / 365.25)
    # a power of 1 is 1, an infinite one too
    power = F.when(F.col("total_return") == 0, 0.0).otherwise(F.pow(1 + F.col("total_return"), quotient(F.lit(1.0), F.col("years"))) - 1)
    a = a.withColumn("cagr", F.when(1 + F.col("total_return") > 0, power).otherwise(0.0) if guarded else power)
    a = a.withColumn("bars_per_year", quotient(F.col("n_bars").cast("double"), F.col("years")))
    a = a.withColumn("volatility", zero(F.col("_sd") * F.sqrt("bars_per_year")))
    over = F.col("cagr") - risk_free
    a = a.withColumn("sharpe", ratio(over, F.col("volatility"), F.col("volatility") > 0))
    down = F.col("_down") * F.sqrt("bars_per_year")
    a = a.withColumn("sortino", ratio(over, down, down > 0))
    a = a.withColumn("calmar", ratio(F.col("cagr"), F.abs("max_drawdown"), F.col("max_drawdown") != 0))
    t = F.col("_sd") / F.sqrt("_n")
    a = a.withColumn("t_stat", zero(ratio(F.col("_mean"), t, F.col("_sd") > 0))).withColumn("ret_sharpe", F.when(F.col("_sd") > 0, F.try_divide(F.col("_mean"), F.col("_sd"))))
    names = ["total_return", "years", "cagr", "n_bars", "bars_per_year", "volatility", "sharpe", "sortino", "max_drawdown", "calmar", "t_stat"]
    return a.select(*keys, *names, F.col("ret_sharpe"), F.col("_n").alias("n_returns"), F.col("_skew").alias("skew"), F.col("_kurt").alias("excess_kurtosis"))


def with_pvalue(metrics: DataFrame) -> DataFrame:
    """Adds p_value, two-sided, of t_stat; one row a key goes through Python."""
    return metrics.withColumn("p_value", F.coalesce(t_pvalue(F.col("t_stat"), (F.col("n_returns") - 1).cast("double")), F.lit(1.0)))


def deflated_sharpe(metrics: DataFrame, trials: DataFrame | None = None, n_trials: int = 1) -> DataFrame:
    """Adds dsr: the chance that the Sharpe ratio of returns is above what the best of the trials would show by luck.

    ``trials``: one column of Sharpe ratios, per period. Below 30 returns it is 0.
    """
    mean, sd, n = 0.0, 0.0, n_trials
    if trials is not None:
        c = trials.columns[0]
        row = trials.agg(F.avg(c), F.stddev_pop(c), F.count(c)).first()
        mean, sd, n = row[0] or 0.0, row[1] or 0.0, row[2]
    q = lambda p: norm_ppf(F.lit(float(p)))
    bar = F.lit(mean)
    if n > 1 and sd > 0:
        bar = mean + sd * ((1 - EULER) * q(1 - 1 / n) + EULER * q(1 - 1 / (n * 2.718281828459045)))
    sr = F.col("ret_sharpe")
    spread = F.sqrt(F.greatest((1 - F.col("skew") * sr + (F.col("excess_kurtosis") + 2) / 4 * sr * sr) / F.nullif(F.col("n_returns") - 1, F.lit(0)), F.lit(1e-300)))
    return metrics.withColumn("dsr", F.when((F.col("n_returns") >= 30) & sr.isNotNull(), norm_cdf((sr - bar) / spread)).otherwise(0.0))


def trade_stats(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, win rate (pnl above 0), profit factor (infinite without losses), averages, t of the mean."""
    win, loss = F.col("pnl") > 0, F.col("pnl") <= 0
    out = trades.groupBy(*keys).agg(
        F.count("pnl").alias("trades"), F.try_divide(F.count_if(win), F.count("pnl")).alias("win_rate"), F.sum("pnl").alias("total_pnl"),
        F.sum(F.when(win, F.col("pnl"))).alias("_won"), F.abs(F.sum(F.when(loss, F.col("pnl")))).alias("_lost"),
        F.avg("pnl").alias("avg_trade"), F.coalesce(F.avg(F.when(win, F.col("pnl"))), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(F.when(loss, F.col("pnl"))), F.lit(0.0)).alias("avg_loss"),
        F.min("pnl").alias("max_loss"), F.stddev_samp("pnl").alias("_sd"),
    )
    factor = F.when(F.col("_lost") > 0, F.try_divide(F.coalesce("_won", F.lit(0.0)), F.col("_lost"))).when(F.col("_won") > 0, float("inf")).otherwise(0.0)
    t = F.when(F.col("_sd") > 0, F.try_divide(F.col("avg_trade"), F.col("_sd") / F.sqrt("trades"))).otherwise(0.0)
    return out.withColumn("profit_factor", factor).withColumn("t_stat", t).drop("_won", "_lost", "_sd")


def strategy_stats(trades: DataFrame, slots: DataFrame, p_values: bool = True) -> DataFrame:
    """Trade statistics of every strategy in slots, those without trades too."""
    out = slots.select("strategy").distinct().join(trade_stats(trades, ["strategy"]), "strategy", "left")
    out = out.withColumn("trades", F.coalesce("trades", F.lit(0)))
    if p_values:
        out = out.withColumn("p_value", F.coalesce(t_pvalue(F.col("t_stat"), (F.col("trades") - 1).cast("double")), F.lit(1.0)))
    return out


def objective(stats: DataFrame, min_trades: int = 10, target_trades: int = 50, max_dd: float = 0.4) -> DataFrame:
    """Adds score: 0.7 Sharpe + 0.3 Sortino, damped by few trades and by drawdown (a fraction); -1 below min_trades, else at least 0."""
    base = 0.7 * F.col("sharpe") + 0.3 * F.col("sortino")
    enough = F.least(F.lit(1.0), F.col("trades") / max(1, target_trades))
    depth = F.least(F.lit(1.0), F.abs("max_drawdown") / max_dd)
    return stats.withColumn("score", F.when(F.col("trades") < min_trades, -1.0).otherwise(F.greatest(F.lit(0.0), base * enough * (1 - depth * depth))))


def capped_log_equity(value: Column, initial: float, floor_pct: float = -100.0, ruin: float = 0.01) -> Column:
    """Log of wealth relative to the start, with losses cut at a floor and ruin at a small positive ratio."""
    ret = F.greatest(value / initial - 1, F.lit(floor_pct / 100))
    return F.log(F.greatest(1 + ret, F.lit(ruin)))
