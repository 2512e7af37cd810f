"""The questions a results screen asks of one bundle, as functions that return DataFrames.

A bundle is what sources.bundles.load gives: history (ts, total_value), trades, and
for portfolios slot_pnl (slot_id, ts, pnl), exposure and slots (slot_id, strategy).
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import scope_token
from ..operators import attribution, exits, metrics, risk

ALL = "__all__"
POINTS = 2000
Bundle = dict[str, Any]


def _trades(b: Bundle, strategy: str = ALL) -> DataFrame:
    return b["trades"] if strategy == ALL else b["trades"].where(F.col("strategy") == strategy)


def _slots(b: Bundle) -> DataFrame:
    return b["slots"] if "slots" in b else b["trades"].select("strategy").distinct()


def scope_equity(b: Bundle, scope: str = "portfolio") -> DataFrame:
    """(run_id, ts, total_value) of the whole or of one strategy; the name matches whatever its case and blanks."""
    token = scope.replace("%20", " ").replace("+", " ").replace(" ", "").lower()
    if token in ("portfolio", "single") or "slot_pnl" not in b:
        return b["history"].select(F.lit("all").alias("run_id"), "ts", "total_value")
    named = b["slot_pnl"].join(b["slots"], "slot_id").where(scope_token(F.col("strategy")) == token)
    e = attribution.slot_equity(named, ["slot_id"], b["manifest"].get("initial_capital", 100_000.0), F.lit(1.0) / max(1, b["manifest"].get("slot_count", 1)))
    return e.groupBy("ts").agg(F.sum("equity").alias("total_value")).select(F.lit("all").alias("run_id"), "ts", "total_value")


def equity(b: Bundle) -> DataFrame:
    """Series over time: total, drawdown, and cumulative closed PnL of each strategy."""
    w = Window.partitionBy("series").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    h = b["history"].select(F.lit("total").alias("series"), "ts", F.col("total_value").alias("value"))
    top = F.max("value").over(w)
    dd = h.withColumn("value", (F.col("value") - top) / top * 100).withColumn("series", F.lit("drawdown"))
    per = b["trades"].groupBy(F.col("strategy").alias("series"), F.col("exit_time").alias("ts")).agg(F.sum("pnl").alias("value")).withColumn("value", F.sum("value").over(w))
    return h.unionByName(dd).unionByName(per)


def rolling_sharpe(b: Bundle, days: int = 90) -> DataFrame:
    d = risk.rolling_sharpe(risk.daily_equity(scope_equity(b), ["run_id"]), ["run_id"], days)
    return exits.downsample(d.select("run_id", F.col("day").alias("ts"), "sharpe"), ["run_id"], POINTS)


def pnl_distribution(b: Bundle, scope: str = "portfolio") -> DataFrame:
    return risk.histogram(risk.daily_equity(scope_equity(b, scope), ["run_id"]))


def _bar_pnl(b: Bundle) -> DataFrame:
    return attribution.bar_pnl(b["slot_pnl"].join(b["slots"], "slot_id"), ["slot_id"]).groupBy("strategy", "ts").agg(F.sum("pnl").alias("pnl"))


def decomposition(b: Bundle, sort_by: str = "closed_pnl") -> DataFrame:
    return attribution.decomposition(b["trades"], _bar_pnl(b)).orderBy(F.desc_nulls_last(sort_by), "strategy")


def strategy_correlation(b: Bundle, horizon: str = "1d") -> DataFrame:
    return risk.strategy_correlation(_bar_pnl(b), horizon)


def exposure_correlation(b: Bundle, horizon: str = "1d") -> DataFrame:
    return risk.exposure_correlation(b["exposure"], horizon)


def _profile(b: Bundle, scope: str, stress: dict[str, float] | None) -> dict[str, DataFrame]:
    t = b["trades"].withColumn("run_id", F.lit("all"))
    return risk.risk_profile(scope_equity(b, scope), t, ["run_id"], stress)


def risk_var(b: Bundle, scope: str = "portfolio", stress: dict[str, float] | None = None) -> DataFrame:
    return _profile(b, scope, stress)["rolling_var"]


def risk_drawdown(b: Bundle, scope: str = "portfolio", stress: dict[str, float] | None = None) -> DataFrame:
    return _profile(b, scope, stress)["daily"]


def risk_volatility(b: Bundle, scope: str = "portfolio", stress: dict[str, float] | None = None) -> DataFrame:
    return _profile(b, scope, stress)["rolling_vol"]


def risk_stress(b: Bundle, scope: str = "portfolio", stress: dict[str, float] | None = None) -> DataFrame:
    return _profile(b, scope, stress)["stress_paths"]


def risk_panel(b: Bundle, scope: str = "portfolio", stress: dict[str, float] | None = None) -> DataFrame:
    return _profile(b, scope, stress)["stress"]


def exit_mfe_mae(b: Bundle, strategy: str = ALL) -> DataFrame:
    return _trades(b, strategy).select("mfe", "mae", "pnl", F.when(F.col("pnl") >= 0, "winner").otherwise("loser").alias("side"))


def exit_decay(b: Bundle, strategy: str = ALL) -> DataFrame:
    t = _trades(b, strategy)
    cols = [c for c in t.columns if c.startswith("pnl_decay_")]
    long = t.select(F.explode(F.array(*[F.struct(F.lit(int(c[10:-1])).alias("minutes"), F.col(c).alias("pnl")) for c in cols])).alias("x")).select("x.*")
    return exits.decay_curve(long, t)


def exit_holding(b: Bundle, strategy: str = ALL) -> DataFrame:
    return exits.holding_buckets(_trades(b, strategy))


def exit_regime(b: Bundle, strategy: str = ALL) -> DataFrame:
    return exits.regime_buckets(_trades(b, strategy))


def exit_reason(b: Bundle, strategy: str = ALL) -> DataFrame:
    return exits.reason_breakdown(_trades(b, strategy)).orderBy(F.desc("total_pnl"), "exit_reason")


def exit_detail(b: Bundle, strategy: str = ALL, page: int = 1, size: int = 25) -> DataFrame:
    t = _trades(b, strategy)
    return exits.page(t, [F.desc("exit_time"), *[F.col(c) for c in t.columns if c != "exit_time"]], page, size)


def strategy_stats(b: Bundle) -> DataFrame:
    return metrics.strategy_stats(b["trades"], _slots(b))


def ribbon(b: Bundle) -> DataFrame:
    """The headline numbers: one row."""
    t = b["trades"].withColumn("run_id", F.lit("all"))
    curve = metrics.with_pvalue(metrics.curve_metrics(scope_equity(b), ["run_id"]))
    hold = t.groupBy("run_id").agg(F.max(exits.hold_minutes()).alias("max_hold"), F.min(exits.hold_minutes()).alias("min_hold"), F.avg(exits.hold_minutes()).alias("avg_hold"))
    return curve.join(metrics.trade_stats(t, ["run_id"]).withColumnRenamed("t_stat", "trade_t_stat"), "run_id", "left").join(hold, "run_id", "left")


def text_report(b: Bundle) -> str:
    """The headline numbers as 48 columns of text."""
    row = ribbon(b).first().asDict()
    lines = [f"{k.replace('_', ' '):<28}{v:>20,.4f}" if isinstance(v, float) else f"{k.replace('_', ' '):<28}{v!s:>20}" for k, v in row.items() if k != "run_id"]
    return "\n".join(["=" * 48, *lines, "=" * 48])
