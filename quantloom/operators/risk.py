"""Risk transforms: drawdowns, value at risk, rolling risk, stress and correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import resample_sum
from .carry import CHUNK
from .frames import order_statistics, overlapped
from .windows import rolling

ANNUAL = 252.0
FLAT = 1e-8
MIN_CORR_ROWS = 5


def daily_equity(history: DataFrame, keys: list[str], value: str = "total_value", ts: str = "ts") -> DataFrame:
    """Last value of each day with rows: keys, day, equity, pnl (change from the day before) and ret."""
    w = Window.partitionBy(*keys).orderBy("day")
    out = history.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.max_by(value, ts).alias("equity"))
    before = F.lag("equity").over(w)
    return out.withColumns({"pnl": F.col("equity") - before, "ret": F.col("equity") / F.nullif(before, F.lit(0.0)) - 1})


def with_drawdown(daily: DataFrame, keys: list[str], value: str = "equity", order: str = "day") -> DataFrame:
    top = F.max(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return daily.withColumn("drawdown_pct", F.try_divide(F.col(value) - top, top) * 100)


def drawdown_episodes(dd: DataFrame, keys: list[str], order: str = "day") -> DataFrame:
    """Runs of negative drawdown: start, first lowest point, end (first recovery, or the last row), depth, days."""
    rows = dd.where("drawdown_pct is not null")
    w = Window.partitionBy(*keys).orderBy(order)
    rows = rows.withColumns(
        {
            "_island": F.sum((F.col("drawdown_pct") >= 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "_next": F.coalesce(F.lead(order).over(w), F.col(order)),
        }
    ).where("drawdown_pct < 0")
    return rows.groupBy(*keys, "_island").agg(
        F.min(order).alias("start"), F.min_by(order, F.struct("drawdown_pct", order)).alias("trough"), F.max("_next").alias("end"), F.min("drawdown_pct").alias("depth_pct"),
    ).select(*keys, "start", "trough", "end", "depth_pct", F.abs("depth_pct").alias("depth_abs_pct"), F.datediff("end", "start").cast("double").alias("duration_days"))


def var_es(daily: DataFrame, keys: list[str], primary: float = 0.95, tail: float = 0.99, pnl: str = "pnl") -> DataFrame:
    """Value at risk and expected shortfall at two levels, positive numbers, at least 0."""
    q = daily.where(F.col(pnl).isNotNull()).groupBy(*keys).agg(*[F.percentile(pnl, 1 - c).alias(f"_q{i}") for i, c in enumerate((primary, tail))])
    joined = daily.join(q, keys) if keys else daily.join(F.broadcast(q))
    named = ("primary", "tail")
    aggs = [F.greatest(F.lit(0.0), -F.first(f"_q{i}")).alias(f"var_{n}") for i, n in enumerate(named)]
    aggs += [F.greatest(F.lit(0.0), -F.avg(F.when(F.col(pnl) <= F.col(f"_q{i}"), F.col(pnl)))).alias(f"es_{n}") for i, n in enumerate(named)]
    return joined.groupBy(*keys).agg(*aggs)


def dist_stats(daily: DataFrame, keys: list[str], pnl: str = "pnl") -> DataFrame:
    """Skew, excess kurtosis (both biased), VaR and CVaR at 95, VaR at 99, mean and deviation."""
    base = daily.where(F.col(pnl).isNotNull())
    a = base.groupBy(*keys).agg(F.skewness(pnl).alias("skew"), F.kurtosis(pnl).alias("kurtosis"), F.avg(pnl).alias("mean"), F.stddev_samp(pnl).alias("std"))
    v = var_es(base, keys, pnl=pnl).select(*keys, F.col("var_primary").alias("var_95"), F.col("es_primary").alias("cvar_95"), F.col("var_tail").alias("var_99"))
    return a.join(v, keys)


def rolling_var_es(daily: DataFrame, keys: list[str], n: int, primary: float = 0.95, tail: float = 0.99) -> DataFrame:
    """Rolling VaR and ES of daily PnL and whether the day broke the VaR."""
    m = min(n, max(n // 2, 5))
    levels = {"_q_primary": 1 - primary, "_q_tail": 1 - tail}
    means = {"_m_primary": "_q_primary", "_m_tail": "_q_tail"}
    out = overlapped(daily.where("pnl is not null"), keys, n, lambda rows, w: order_statistics(rows, [*keys, CHUNK], "pnl", n, m, "day", levels, means), "day")
    for name in ("primary", "tail"):
        loss = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(0.0), -F.col(c)))
        out = out.withColumns({f"var_{name}": loss(f"_q_{name}"), f"es_{name}": loss(f"_m_{name}")})
        out = out.withColumn(f"breach_{name}", F.coalesce((F.col("pnl") <= -F.col(f"var_{name}")), F.lit(False)))
    return out.drop(*levels, *means)


def rolling_volatility(daily: DataFrame, keys: list[str], windows: tuple[int, ...]) -> DataFrame:
    """Annual volatility in percent over each number of days."""
    w = Window.partitionBy(*keys).orderBy("day")
    return daily.withColumns({f"vol_{n}d": rolling(F.stddev_samp, F.col("ret"), w, n) * (ANNUAL**0.5) * 100 for n in windows})


def rolling_sharpe(daily: DataFrame, keys: list[str], n: int = 90, risk_free: float = 0.0) -> DataFrame:
    """Adds sharpe over n daily returns; null where they hardly vary."""
    w = Window.partitionBy(*keys).orderBy("day")
    rows = daily.withColumn("_x", F.col("ret") - risk_free / ANNUAL)
    sd = rolling(F.stddev_samp, F.col("_x"), w, n)
    return rows.withColumn("sharpe", F.when(sd > FLAT, F.try_divide(rolling(F.avg, F.col("_x"), w, n), sd) * ANNUAL**0.5)).drop("_x")


def sharpe_of(ret: Column, risk_free: float = 0.0) -> Column:
    """Annual Sharpe ratio of daily returns as an aggregate; null where they hardly vary."""
    x = ret - risk_free / ANNUAL
    return F.when(F.stddev_samp(x) > FLAT, F.try_divide(F.avg(x), F.stddev_samp(x)) * ANNUAL**0.5)


def period_sharpe(daily: DataFrame, keys: list[str], horizon: str, risk_free: float = 0.0) -> DataFrame:
    """Sharpe ratio of returns compounded by week (1w) or month (1m)."""
    per, unit = {"1w": (52.0, "week"), "1m": (12.0, "month")}[horizon]
    bins = daily.where("ret is not null").groupBy(*keys, F.date_trunc(unit, "day").alias("bin")).agg((F.product(1 + F.col("ret")) - 1).alias("ret"))
    x = F.col("ret") - risk_free / per
    return bins.groupBy(*keys).agg(F.when(F.stddev_samp(x) > FLAT, F.try_divide(F.avg(x), F.stddev_samp(x)) * per**0.5).alias("sharpe"))


def daily_costs(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Commission and slippage by day of exit."""
    return trades.groupBy(*keys, F.to_date("exit_time").alias("day")).agg(F.sum(F.coalesce("commission", F.lit(0.0))).alias("commission"), F.sum(F.abs(F.coalesce("slippage", F.lit(0.0)))).alias("slippage"))


SCENARIOS = ("baseline", "volatility", "slippage", "commission", "combined")


def stress_paths(daily: DataFrame, costs: DataFrame, keys: list[str], volatility: float = 1.5, slippage: float = 2.0, commission: float = 2.0) -> DataFrame:
    """Daily PnL and equity under five scenarios; the first day keeps PnL 0.

    Volatility spreads PnL about its mean over the later days; costs are taken off
    again at (multiplier - 1) times.
    """
    w = Window.partitionBy(*keys).orderBy("day")
    rows = daily.join(costs, [*keys, "day"], "left").withColumn("_n", F.row_number().over(w))
    rows = rows.withColumn("pnl", F.when(F.col("_n") == 1, 0.0).otherwise(F.coalesce("pnl", F.lit(0.0))))
    rows = rows.withColumn("_start", F.first("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_mean", F.avg(F.when(F.col("_n") > 1, F.col("pnl"))).over(Window.partitionBy(*keys)))
    spread = F.when(F.col("_n") == 1, 0.0).otherwise(F.col("_mean") + (F.col("pnl") - F.col("_mean")) * volatility)
    later = F.when(F.col("_n") > 1, 1.0).otherwise(0.0)
    slip = later * F.coalesce("slippage", F.lit(0.0)) * (slippage - 1)
    comm = later * F.coalesce("commission", F.lit(0.0)) * (commission - 1)
    values = {"baseline": F.col("pnl"), "volatility": spread, "slippage": F.col("pnl") - slip, "commission": F.col("pnl") - comm, "combined": spread - slip - comm}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), values[n].alias("pnl")) for n in SCENARIOS])).alias("s")
    out = rows.select(*keys, "day", "_start", each).select(*keys, "day", "_start", "s.scenario", "s.pnl")
    run = Window.partitionBy(*keys, "scenario").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("equity", F.col("_start") + F.sum("pnl").over(run)).drop("_start")


def stress_summary(paths: DataFrame, keys: list[str], primary: float = 0.95, tail: float = 0.99, risk_free: float = 0.0) -> DataFrame:
    """One row a scenario: final PnL, end equity, VaR and ES, drawdown, Sharpe."""
    by = [*keys, "scenario"]
    w = Window.partitionBy(*by).orderBy("day")
    rows = with_drawdown(paths, by).withColumn("ret", F.col("equity") / F.nullif(F.lag("equity").over(w), F.lit(0.0)) - 1)
    a = rows.groupBy(*by).agg(
        F.sum("pnl").alias("final_pnl"), F.max_by("equity", "day").alias("end_equity"), F.min("drawdown_pct").alias("max_drawdown_pct"), sharpe_of(F.col("ret"), risk_free).alias("sharpe")
    )
    return a.join(var_es(rows, by, primary, tail), by)


def correlation(pnl: DataFrame, by: str, day: str = "day", value: str = "pnl", keys: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of series over the days both have. Long form: left, right, n, corr.

    The number of series is that of strategies or symbols, and pairs meet on the day.
    Each pair is computed once and given both ways.
    """
    keys = keys or []
    a = pnl.select(*keys, day, F.col(by).alias("left"), F.col(value).alias("_a"))
    b = pnl.select(*keys, day, F.col(by).alias("right"), F.col(value).alias("_b"))
    half = a.join(b, [*keys, day]).where(F.col("left") <= F.col("right")).groupBy(*keys, "left", "right").agg(F.count("*").alias("n"), F.corr("_a", "_b").alias("corr"))
    both = F.when(F.col("left") == F.col("right"), F.array(F.struct("left", "right"))).otherwise(F.array(F.struct("left", "right"), F.struct(F.col("right").alias("left"), F.col("left").alias("right"))))
    return half.where(F.col("n") >= MIN_CORR_ROWS).select(*keys, F.explode(both).alias("_p"), "n", "corr").select(*keys, "_p.left", "_p.right", "n", "corr")


def strategy_correlation(bar_pnl: DataFrame, horizon: str = "1d", by: str = "strategy", ts: str = "ts") -> DataFrame:
    """Correlation of strategies' PnL by calendar bin; bins without rows are 0 over the common span."""
    sums = resample_sum(bar_pnl, [by], "pnl", horizon, ts)
    return correlation(sums, by)


def exposure_correlation(exposure: DataFrame, horizon: str = "1d", ts: str = "ts") -> DataFrame:
    """Correlation of symbols' mean absolute notional by bin; short or flat series are left out."""
    from .bars import HORIZONS

    total = exposure.groupBy("symbol", F.col(ts).alias("ts")).agg(F.abs(F.sum("notional")).alias("x"))
    bins = total.groupBy("symbol", HORIZONS[horizon](F.to_date("ts")).alias("day")).agg(F.avg("x").alias("pnl"))
    fit = bins.groupBy("symbol").agg(F.count("*").alias("c"), F.stddev_samp("pnl").alias("s")).where((F.col("c") >= MIN_CORR_ROWS) & (F.col("s") > FLAT)).select("symbol")
    return correlation(bins.join(fit, "symbol", "leftsemi"), "symbol")


def histogram(daily: DataFrame, pnl: str = "pnl", base_cap: int = 40, base_floor: int = 10, detail: int = 3, detail_floor: int = 30, detail_cap: int = 120,
              width_factor: float = 2.0, sample_floor: int = 20, sample_cap: int = 160) -> DataFrame:
    """Equal-width bins: the most of Sturges', Freedman and Diaconis' and a root rule, within bounds. bin, center, n; empty bins too."""
    x = F.col(pnl)
    rows = daily.where(x.isNotNull())
    s = rows.agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.percentile(x, 0.25).alias("q1"), F.percentile(x, 0.75).alias("q3"))
    base = F.least(F.lit(base_cap), F.greatest(F.lit(base_floor), F.floor(F.sqrt("n"))))
    detailed = F.least(F.lit(detail_cap), F.greatest(F.lit(detail_floor), base * detail))
    sturges = F.ceil(F.log2(F.greatest("n", F.lit(1))) + 1)
    width = F.try_divide(width_factor * (F.col("q3") - F.col("q1")), F.cbrt("n"))
    fd = F.when((width > 0) & (F.col("hi") > F.col("lo")), F.ceil(F.try_divide(F.col("hi") - F.col("lo"), width))).otherwise(0)
    most = F.greatest(F.lit(sample_floor), F.least(F.lit(sample_cap), F.col("n")))
    s = s.withColumn("bins", F.least(most, F.greatest(sturges, fd, detailed)).cast("int"))
    # one value only: a bin of width 1 about it
    s = s.withColumns({"lo": F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")), "hi": F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi"))})
    step = (F.col("hi") - F.col("lo")) / F.col("bins")
    placed = rows.select(x.alias("_x")).join(F.broadcast(s)).withColumn("bin", F.least(F.floor((F.col("_x") - F.col("lo")) / step), F.col("bins") - 1).cast("int"))
    counts = placed.groupBy("bin").agg(F.count("*").alias("n"))
    spine = s.where("n > 0").select(F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"), "lo", step.alias("step"))
    return spine.join(counts, "bin", "left").select("bin", (F.col("lo") + (F.col("bin") + 0.5) * F.col("step")).alias("center"), F.coalesce("n", F.lit(0)).alias("n"))


def risk_profile(history: DataFrame, trades: DataFrame, keys: list[str], stress: dict[str, float] | None = None, windows: tuple[int, ...] = (21, 63), var_window: int = 63) -> dict[str, DataFrame]:
    """Every risk table of a scope: daily, episodes, var, rolling_var, rolling_vol, stress_paths, stress."""
    daily = with_drawdown(daily_equity(history, keys), keys)
    paths = stress_paths(daily_equity(history, keys), daily_costs(trades, keys), keys, **(stress or {}))
    return {
        "daily": daily, "episodes": drawdown_episodes(daily, keys), "var": var_es(daily, keys), "rolling_var": rolling_var_es(daily, keys, var_window),
        "rolling_vol": rolling_volatility(daily, keys, windows), "stress_paths": paths, "stress": stress_summary(paths, keys),
    }
