"""Parameter search: folds, sampling, walk-forward and its verdict."""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import ceil
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..settings import RunSettings
from . import metrics


def folds(n_bars: int, n_folds: int = 5, test_share: float = 0.10, purge: int = 0, embargo: int = 0, anchored: bool = False) -> list[tuple[int, int, int, int]]:
    """(train_from, train_to, test_from, test_to), ends exclusive; test folds fill the tail, training ends purge + embargo bars before."""
    size = int(n_bars * test_share)
    if size < 1 or n_folds * size >= n_bars:
        raise ValueError("folds do not fit the bars")
    first = n_bars - n_folds * size
    out = []
    for k in range(n_folds):
        a = first + k * size
        stop = a - purge - embargo
        begin = 0 if anchored else k * size
        if stop <= begin:
            raise ValueError("purge and embargo leave no training bars")
        out.append((begin, stop, a, a + size))
    return out


def folds_by_series(bars: DataFrame, n_folds: int = 5, test_share: float = 0.10, purge: int = 0, embargo: int = 0, anchored: bool = False) -> DataFrame:
    """:func:`folds` of every symbol's own number of bars; a fold that leaves no training bars is left out."""
    n = bars.groupBy("symbol").agg(F.count("*").alias("n")).withColumn("size", F.floor(F.col("n") * test_share)).where((F.col("size") >= 1) & (n_folds * F.col("size") < F.col("n")))
    k = n.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))).withColumn("test_from", F.col("n") - n_folds * F.col("size") + F.col("fold") * F.col("size"))
    begin = F.lit(0).cast("long") if anchored else F.col("fold") * F.col("size")
    out = k.select("symbol", "fold", begin.alias("train_from"), (F.col("test_from") - purge - embargo).alias("train_to"), "test_from", (F.col("test_from") + F.col("size")).alias("test_to"))
    return out.where("train_from < train_to")


def numbered(bars: DataFrame) -> DataFrame:
    """bars with their place in each series."""
    return bars.withColumn("pos", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1)


def sample(space: dict[str, Any], n: int, seed: int = 42, best: list[tuple[float, dict]] | None = None, share: float = 0.25) -> list[dict[str, Any]]:
    """n parameter sets. With results of earlier ones, half are drawn near the better share of them, by the values these hold."""
    rng = np.random.default_rng(seed)
    top = [p for _, p in sorted(best or [], key=lambda x: -x[0])[: max(1, int(len(best or []) * share))]]

    def draw(name: str, spec: Any) -> Any:
        if isinstance(spec, list):
            pool = [p[name] for p in top] if top and rng.random() < 0.5 else spec
            return pool[int(rng.integers(len(pool)))]
        low, high, step = (*spec, None)[:3]
        if top and rng.random() < 0.5:
            x = top[int(rng.integers(len(top)))][name] + rng.normal() * (high - low) * 0.1
        else:
            x = rng.uniform(low, high)
        x = float(np.clip(x, low, high))
        if step:
            x = min(high, low + round((x - low) / step) * step)
        return int(round(x)) if all(isinstance(v, int) for v in spec) else round(x, 10)

    return [{k: draw(k, v) for k, v in space.items()} for _ in range(n)]


def scored(out: DataFrame, risk_free: float, min_trades: int, target_trades: int, max_dd: float) -> DataFrame:
    """A score a run from the rows of a sweep.

    A run has one history a symbol, and each is measured by itself. Over a run's symbols
    trades and PnL are summed, the win rate is that of all trades, the drawdown is
    the deepest, and what else there is, the score among it, is averaged.
    """
    from ..simulation import runs

    by = ["run_id", "symbol"]
    curve = metrics.curve_metrics(runs.history(out), by, risk_free)
    stats = metrics.trade_stats(runs.trades(out), by).select(*by, "trades", "win_rate", "profit_factor", "total_pnl", "avg_trade")
    both = curve.join(stats, by, "left").withColumn("trades", F.coalesce("trades", F.lit(0)))
    each = metrics.objective(both, min_trades, target_trades, max_dd)
    special = {
        "trades": F.sum("trades"), "total_pnl": F.sum("total_pnl"), "win_rate": F.try_divide(F.sum(F.col("win_rate") * F.col("trades")), F.sum("trades")),
        "avg_trade": F.try_divide(F.sum("total_pnl"), F.sum("trades")), "max_drawdown": F.max_by("max_drawdown", F.abs("max_drawdown")),
    }
    return each.groupBy("run_id").agg(*[special.get(c, F.avg(c)).alias(c) for c in each.columns if c not in by])


def optimise(bars: DataFrame, strategy: str, s: RunSettings, n_trials: int = 40, batch: int = 20, seed: int = 42, min_trades: int = 7, max_dd: float = 0.35) -> list[tuple[float, dict, dict]]:
    """Trials in batches, each one Spark job; (score, parameters, statistics), best first. One row a trial reaches the driver."""
    from ..simulation import runs
    from ..simulation.strategies import find

    space, found = find(strategy).space, []
    for k in range(ceil(n_trials / batch)):
        grid = sample(space, min(batch, n_trials - k * batch), seed + k, [(x[0], x[1]) for x in found])
        rows = scored(runs.sweep(bars, strategy, s, grid), s.risk_free_rate, min_trades, min_trades * 2, max_dd).collect()
        found += [(r.score, grid[int(r.run_id.rsplit("-", 1)[1])], r.asDict()) for r in rows]
    return sorted(found, key=lambda x: -x[0])


def scaled_min_trades(target_bars: int, reference_bars: int, base: int) -> int:
    return max(1, ceil(base * target_bars / max(1, reference_bars)))


@dataclass(frozen=True)
class FoldResult:
    fold: int
    params: dict[str, Any]
    is_score: float
    oos_score: float
    is_sharpe: float
    oos_sharpe: float
    oos_pnl: float
    oos_trades: int
    oos_win_rate: float
    is_win_rate: float

    @property
    def degradation(self) -> float:
        return 1 - self.oos_sharpe / self.is_sharpe if self.is_sharpe > 0 else 1.0

    @property
    def expected_value(self) -> float:
        return self.oos_pnl / self.oos_trades if self.oos_trades else 0.0


def streak(good: list[bool]) -> int:
    best = run = 0
    for g in good:
        run = run + 1 if g else 0
        best = max(best, run)
    return best


def verdict(results: list[FoldResult], min_sharpe: float = 0.3, pass_folds: int = 3, warn_folds: int = 2, pass_run: int = 2, warn_run: int = 1) -> tuple[str, list[str]]:
    """PASS, WARNING or FAIL by how many folds, and how many in a row, earn enough out of sample."""
    good = [r.oos_pnl > 0 and r.oos_sharpe >= min_sharpe for r in results]
    n, run = sum(good), streak(good)
    notes = []
    if results and float(np.median([r.degradation for r in results])) > 0.5:
        notes.append("out-of-sample Sharpe is less than half of in-sample")
    if any(r.oos_trades == 0 for r in results):
        notes.append("a fold had no trades out of sample")
    if n >= pass_folds and run >= pass_run:
        return ("WARNING" if notes else "PASS"), notes
    return ("WARNING" if n >= warn_folds and run >= warn_run else "FAIL"), notes


def fold_measures(folds: DataFrame, by: list[str], min_sharpe: float = 0.3, pass_folds: int = 3, warn_folds: int = 2, pass_run: int = 2, warn_run: int = 1) -> DataFrame:
    """One row a search: n_folds, good_folds, longest_run, degradation, idle_folds, expected_value, verdict.

    Rows of folds: by, fold, is_sharpe, oos_sharpe, oos_pnl, oos_trades. A fold is good
    if it earned out of sample at a Sharpe ratio of at least ``min_sharpe``. The run
    is the longest of good folds in order; degradation is the median of 1 - out-of-sample
    over in-sample Sharpe (1 where that is not positive); expected_value is PnL a trade over all
    folds. PASS becomes WARNING where the median is above a half or a fold had no trades.
    Null measures are not good and degrade by 1.
    """
    order = Window.partitionBy(*by).orderBy("fold")
    good = F.coalesce((F.col("oos_pnl") > 0) & (F.col("oos_sharpe") >= min_sharpe), F.lit(False))
    rows = folds.withColumn("_good", good)
    # folds of a run of good ones share the number of bad ones before them
    rows = rows.withColumn("_run", F.when(F.col("_good"), F.count_if(~F.col("_good")).over(order)))
    rows = rows.withColumn("_len", F.when(F.col("_good"), F.count("*").over(Window.partitionBy(*by, "_run"))).otherwise(0))
    loss = F.coalesce(F.when(F.col("is_sharpe") > 0, 1 - F.col("oos_sharpe") / F.col("is_sharpe")), F.lit(1.0))
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n_folds"), F.count_if("_good").alias("good_folds"), F.max("_len").alias("longest_run"), F.median(loss).alias("degradation"),
        F.count_if(F.coalesce("oos_trades", F.lit(0)) == 0).alias("idle_folds"), F.coalesce(F.try_divide(F.sum("oos_pnl"), F.sum("oos_trades")), F.lit(0.0)).alias("expected_value"),
    )
    enough = lambda n, run: (F.col("good_folds") >= n) & (F.col("longest_run") >= run)
    noted = (F.col("degradation") > 0.5) | (F.col("idle_folds") > 0)
    kind = F.when(enough(pass_folds, pass_run), F.when(noted, "WARNING").otherwise("PASS")).when(enough(warn_folds, warn_run), "WARNING").otherwise("FAIL")
    return out.withColumn("verdict", kind)


def consensus_table(folds: DataFrame, by: list[str], numbers: list[str], names: list[str]) -> DataFrame:
    """One row a search: the median of each number and the most frequent of each name (ties: the smaller) over its folds that earned, over all if none did."""
    earned = Window.partitionBy(*by)
    rows = folds.withColumn("_ok", F.coalesce(F.col("oos_pnl") > 0, F.lit(False)))
    rows = rows.withColumn("_any", F.max("_ok").over(earned)).where(F.col("_ok") | ~F.col("_any"))
    out = rows.groupBy(*by).agg(F.count("*").alias("n_folds"), *[F.median(c).alias(c) for c in numbers])
    for c in names:
        most = rows.where(F.col(c).isNotNull()).groupBy(*by, c).agg(F.count("*").alias("_n")).groupBy(*by).agg(F.min_by(c, F.struct(-F.col("_n"), F.col(c))).alias(c))
        out = out.join(most, by, "left")
    return out


def consensus(results: list[FoldResult]) -> dict[str, Any]:
    """Median of numbers and most frequent of others over the folds that earned."""
    rows = [r.params for r in results if r.oos_pnl > 0] or [r.params for r in results]
    out: dict[str, Any] = {}
    for k in rows[0] if rows else ():
        v = [p[k] for p in rows]
        if all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in v):
            m = float(np.median(v))
            out[k] = int(round(m)) if all(isinstance(x, int) for x in v) else m
        else:
            out[k] = max(sorted(set(map(str, v))), key=lambda x: sum(str(y) == x for y in v))
    return out


def walk_forward(bars: DataFrame, strategy: str, s: RunSettings, n_folds: int = 3, test_share: float = 0.1, n_trials: int = 8, purge: int = 0, embargo: int = 0, anchored: bool = False, min_trades: int = 1) -> dict[str, Any]:
    """Folds in turn: search on the training bars, then run the best set on the test bars of the same fold."""
    from ..simulation import runs

    ranges = folds_by_series(bars, n_folds, test_share, purge, embargo, anchored)
    rows = numbered(bars).join(ranges, "symbol")
    results = []
    for k in range(n_folds):
        # bars of the shortest series set how many trades a fold must have
        size = ranges.where(F.col("fold") == k).agg(F.min(F.col("test_to") - F.col("test_from")).alias("test"), F.min(F.col("train_to") - F.col("train_from")).alias("train")).first()
        if not size.test:
            continue
        part = lambda a, b: rows.where((F.col("fold") == k) & (F.col("pos") >= F.col(a)) & (F.col("pos") < F.col(b))).select(*bars.columns)  # noqa: E731, B023
        train = part("train_from", "train_to")
        found = optimise(train, strategy, s, n_trials, n_trials, 42 + k, min_trades)
        if not found or found[0][0] <= -1:
            continue
        score, params, inside = found[0]
        test = part("test_from", "test_to")
        out = runs.simulate(test, strategy, s.with_params(**params), f"fold-{k}")
        r = scored(out, s.risk_free_rate, scaled_min_trades(size.test, size.train, min_trades), min_trades * 2, 0.4).first()
        if r is None:
            continue
        results.append(FoldResult(k, params, score, r.score, inside["sharpe"], r.sharpe, r.total_pnl or 0.0, r.trades, r.win_rate or 0.0, inside["win_rate"] or 0.0))
    state, notes = verdict(results)
    return {"folds": results, "verdict": state, "notes": notes, "candidate": consensus(results)}


def verdict_matrix(rows: DataFrame) -> DataFrame:
    """(strategy, target, verdict) rows as one row a strategy and one column a target."""
    return rows.groupBy("strategy").pivot("target").agg(F.first("verdict"))


def batch(spark: SparkSession, strategies: list[str], symbols: list[str], timeframes: list[str]) -> DataFrame:
    """Every scenario of a batch."""
    t = lambda n, v: spark.createDataFrame([(x,) for x in v], f"{n} string")
    return t("strategy", strategies).crossJoin(t("symbol", symbols)).crossJoin(t("timeframe", timeframes))


def run_batch(bars: DataFrame, strategies: list[str], s: RunSettings) -> DataFrame:
    """One run a strategy and symbol over the bars of each timeframe: statistics, one row a scenario."""
    from functools import reduce

    from ..simulation import runs

    frames = [r[0] for r in bars.select("timeframe").distinct().collect()]
    parts = []
    for tf in frames:
        own = bars.where(F.col("timeframe") == tf).drop("timeframe")
        for name in strategies:
            out = runs.simulate(own, name, replace(s, timeframe=tf), f"{name}|{tf}").withColumn("run_id", F.concat_ws("|", "run_id", "symbol"))
            parts.append(out)
    out = reduce(DataFrame.unionByName, parts)
    stats = scored(out, s.risk_free_rate, 1, 10, 0.4)
    split = F.split("run_id", "\\|")
    return stats.withColumns({"strategy": split[0], "timeframe": split[1], "symbol": split[2]}).drop("run_id")


def batch_filter(stats: DataFrame, min_return: float = -0.80, max_drawdown: float = 0.80) -> DataFrame:
    return stats.where((F.col("total_return") >= min_return) & (F.abs("max_drawdown") <= max_drawdown))
