"""DataFrame operators against hand-computed cases and pandas."""

from datetime import date, datetime, timedelta

from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import stats, text, timing
from quantloom.operators import attribution, bars, exits, fills, indicators, joins, metrics, quality, risk, search
from quantloom.operators.windows import ema, running_sum
from quantloom.settings import RunSettings, with_instruments

T0 = datetime(2024, 1, 1)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s in ("A", "B"):
        c = 100 + np.cumsum(rng.normal(size=300))
        for i, x in enumerate(c):
            o = x + rng.normal() * 0.3
            rows.append((s, T0 + timedelta(hours=7 * i), float(o), float(max(o, x) + abs(rng.normal())), float(min(o, x) - abs(rng.normal())), float(x), float(rng.integers(1, 100))))
    return frame(spark, rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double").cache()


def by_symbol(df, *names):
    p = df.select("symbol", "ts", *names).toPandas().sort_values(["symbol", "ts"])
    return {s: g.reset_index(drop=True) for s, g in p.groupby("symbol")}


def test_ema_and_atr_equal_pandas(walk):
    got = by_symbol(indicators.atr(ema(walk, ["symbol"], F.col("close"), 10, "e"), 14), "e", "atr", "close", "high", "low")
    for g in got.values():
        assert np.allclose(g.e, g.close.ewm(span=10, adjust=False).mean())
        pc = g.close.shift()
        tr = pd.concat([g.high - g.low, (g.high - pc).abs(), (g.low - pc).abs()], axis=1).max(axis=1)
        assert np.allclose(g.atr, tr.ewm(span=14, adjust=False).mean())


def test_ema_passes_over_leading_nulls(walk):
    gap = walk.withColumn("x", F.when(F.col("ts") > F.lit("2024-02-20").cast("timestamp_ntz"), F.col("close")))
    for g in by_symbol(ema(gap, ["symbol"], F.col("x"), 5, "e"), "x", "e").values():
        want = g.x.ewm(span=5, adjust=False, ignore_na=True).mean()
        assert np.allclose(g.e.fillna(-1), want.fillna(-1))


def test_running_sum_and_rank_equal_pandas(walk):
    for g in by_symbol(running_sum(walk, ["symbol"], F.col("volume"), "c", F.to_date("ts")), "volume", "c").values():
        assert np.allclose(g.c, g.volume.cumsum())
    for g in by_symbol(indicators.volatility_regime(walk, 20, 60), "close", "vol_pct").values():
        want = g.close.rolling(20, 10).std().rolling(60, 30).rank(pct=True).shift()
        assert np.allclose(g.vol_pct.fillna(-1), want.fillna(-1))


def test_fractals_equal_the_plain_loop(walk):
    for g in by_symbol(indicators.fractal_levels(walk, 6), "high", "low", "fractal_high", "fractal_low").values():
        h, lo = g.high.to_numpy(), g.low.to_numpy()
        for t in range(len(g)):
            ups = [h[t - i] for i in range(1, 7) if t - i >= 1 and h[t - i] > h[t - i - 1] and h[t - i] > h[t - i + 1]]
            downs = [lo[t - i] for i in range(1, 7) if t - i >= 1 and lo[t - i] < lo[t - i - 1] and lo[t - i] < lo[t - i + 1]]
            assert (g.fractal_high[t] == max(ups)) if ups else pd.isna(g.fractal_high[t])
            assert (g.fractal_low[t] == min(downs)) if downs else pd.isna(g.fractal_low[t])


def test_heikin_ashi_and_range_bars(walk, spark):
    ha = by_symbol(bars.heikin_ashi(walk), "open", "close")
    for s, g in by_symbol(walk, "open", "high", "low", "close").items():
        c = (g.open + g.high + g.low + g.close) / 4
        o = [g.open[0]]
        for i in range(1, len(g)):
            o.append((o[-1] + c[i - 1]) / 2)
        assert np.allclose(ha[s].open, o) and np.allclose(ha[s].close, c)
    t = [("A", T0 + timedelta(minutes=i), p, p + 1.0, p - 1.0, p, 10.0) for i, p in enumerate((100.0, 103.0, 104.0, 104.5, 105.0))]
    r = bars.range_bars(frame(spark, t, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"), 5, 1.0).orderBy("ts").collect()
    assert [(x.open, x.high, x.low, x.close, x.volume) for x in r] == [(100.0, 104.0, 99.0, 103.0, 20.0), (103.0, 106.0, 103.0, 105.0, 30.0)]
    assert bars.build(walk, "nothing") is walk


def test_back_adjustment(spark):
    rows = [("X", c, T0 + timedelta(days=7 * i + d), o, o, o, cl, o) for i, (c, o, cl) in enumerate((("OLD", 80.0, 81.0), ("MID", 90.0, 91.0), ("NEW", 100.0, 101.0))) for d in (0,)]
    got = bars.back_adjust(frame(spark, rows, "symbol string, contract string, ts timestamp_ntz, open double, high double, low double, close double, average double")).orderBy("ts").collect()
    assert [r.close for r in got] == [99.0, 100.0, 101.0]


def test_quality_flags_rolls_and_bad_bars(spark):
    rows = [("X", "5m", T0 + timedelta(minutes=5 * i), 100.0, 101.0, 99.0, c, 10.0, a, k) for i, (c, a, k) in enumerate(((100.0, 100.0, "A"), (120.0, 100.0, "B"), (100.0, 150.0, "B")))]
    v = quality.validate(frame(spark, rows, "symbol string, timeframe string, ts timestamp_ntz, open double, high double, low double, close double, volume double, average double, contract string"))
    r = v.first()
    assert r.price_faults == 2 and not r.is_valid and r.ohlc_faults == 1
    assert "FAIL" in quality.report(v)


def test_asof_and_range_joins(spark):
    b = frame(spark, [("X", T0 + timedelta(minutes=m), c, c + 1, c - 1) for m, c in ((0, 10.0), (5, 11.0), (15, 12.0))], "symbol string, ts timestamp_ntz, close double, high double, low double")
    t = frame(spark, [(1, "X", T0, T0 + timedelta(minutes=15), 10.0, "LONG", 1.0, 0.0, 0.0, 5.0)], "trade_id long, symbol string, entry_time timestamp_ntz, exit_time timestamp_ntz, entry_price double, direction string, quantity double, commission double, slippage double, pnl double")
    got = {r.minutes: r.pnl for r in exits.forward_pnl(t, b, ["symbol"], (5, 15, 60)).collect()}
    assert got == {5: 1.0, 15: 2.0, 60: 2.0}
    assert [r.past_end for r in exits.forward_pnl(t, b, ["symbol"], (60,)).collect()] == [True]
    e = exits.excursions(t, b, ["symbol"]).first()
    assert (e.mfe, e.mae) == (3.0, 0.0)
    full = exits.enrich(t, b, ["symbol"], (5, 15), 2, 2).first()
    assert full.pnl_decay_5m == 1.0 and full.holding_seconds == 900
    q = frame(spark, [("X", T0 - timedelta(minutes=1)), ("X", T0 + timedelta(minutes=7))], "symbol string, ts timestamp_ntz")
    assert [r.close for r in joins.asof_backward(q, b, ["symbol"], ["close"]).orderBy("ts").collect()] == [None, 11.0]
    assert [r.close for r in joins.asof_forward(q, b, ["symbol"], ["close"]).orderBy("ts").collect()] == [10.0, 12.0]


def test_drawdown_episodes(spark):
    dd = [0, -5, -2, 0, 0, -3, -7, -1]
    rows = [("a", date(2024, 1, 1) + timedelta(days=i), float(x)) for i, x in enumerate(dd)]
    got = risk.drawdown_episodes(frame(spark, rows, "run_id string, day date, drawdown_pct double"), ["run_id"]).orderBy("start").collect()
    assert [(r.depth_pct, r.duration_days) for r in got] == [(-5.0, 2.0), (-7.0, 2.0)]


def test_slot_equity_fills_gaps(spark):
    rows = [("0", T0 + timedelta(days=i), v) for i, v in enumerate((None, 100.0, 50.0, 150.0))]
    got = attribution.slot_equity(frame(spark, rows, "slot_id string, ts timestamp_ntz, pnl double"), ["slot_id"], 100_000.0, F.lit(0.25)).orderBy("ts").collect()
    assert [r.equity for r in got] == [25000, 25100, 25050, 25150]


def test_rolling_sharpe_of_a_flat_line_is_null(spark):
    rows = [("a", T0 + timedelta(days=i), 100.0) for i in range(120)]
    d = risk.daily_equity(frame(spark, rows, "run_id string, ts timestamp_ntz, total_value double"), ["run_id"])
    assert risk.rolling_sharpe(d, ["run_id"]).where("sharpe is not null").count() == 0


def test_alpha_and_beta_are_found_again(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.01, 500)
    y = 1.5 * x + 0.0004 + rng.normal(0, 0.001, 500)
    days = [date(2022, 1, 1) + timedelta(days=i) for i in range(500)]
    ys = frame(spark, [("S", d, float(v)) for d, v in zip(days, y)], "strategy string, day date, ret double")
    xs = frame(spark, [("ES", d, float(v)) for d, v in zip(days, x)], "symbol string, day date, ret double")
    r = attribution.with_p_values(attribution.alpha_beta(ys, xs, frame(spark, [("S", "ES")], "strategy string, symbol string"))).first()
    assert abs(r.beta - 1.5) < 0.045 and abs(r.alpha - 10.08) < 2 and r.beta_p < 1e-6 and r.alpha_p < 0.01


def test_distributions(spark):
    known = {(2.0, 10.0): 0.07338803, (1.0, 1.0): 0.5, (0.0, 5.0): 1.0, (-1.0, 1.0): 0.5, (40.0, 3.0): 3.4e-05}
    rows = frame(spark, [*known, (None, 3.0), (1.0, None), (1.0, 0.0)], "t double, df double").select("t", "df", stats.t_pvalue("t", F.col("df")).alias("p")).collect()
    assert all(r.p == pytest.approx(known[r.t, r.df], abs=1e-6) if (r.t, r.df) in known else r.p is None for r in rows)
    xs = [-40.0, -20.0, -8.0, -7.07, -3.0, -0.1, 0.0, 0.3, 2.0, 6.0, 9.0]
    rows = frame(spark, [(x, NormalDist().cdf(x)) for x in xs], "x double, p double").select("x", "p", stats.norm_cdf(F.col("x")).alias("c"), stats.norm_ppf(F.col("p")).alias("q")).collect()
    assert all(r.c == pytest.approx(r.p, rel=1e-9, abs=1e-15) for r in rows) and all(r.q == pytest.approx(r.x, abs=1e-8) for r in rows if -5 < r.x < 5)
    # many degrees of freedom are the normal law
    assert frame(spark, [(1.7,)], "t double").select(stats.t_pvalue("t", F.lit(1e7))).first()[0] == pytest.approx(2 * NormalDist().cdf(-1.7), abs=1e-7)
    r = spark.range(1).select(stats.norm_cdf(F.lit(1.0)).alias("c"), stats.norm_ppf(F.lit(0.975)).alias("q"), stats.erf(F.lit(0.5)).alias("e"), stats.trunc(F.lit(-1.7)).alias("t")).first()
    assert r.c == pytest.approx(0.8413447) and r.q == pytest.approx(1.959964) and r.e == pytest.approx(0.5204999, abs=2e-7) and r.t == -1


def test_deflated_sharpe_falls_with_trials(spark):
    rng = np.random.default_rng(1)
    v = 100 * np.cumprod(1 + rng.normal(0.001, 0.01, 200))
    h = frame(spark, [("a", T0 + timedelta(days=i), float(x)) for i, x in enumerate(v)], "run_id string, ts timestamp_ntz, total_value double")
    m = metrics.curve_metrics(h, ["run_id"])
    one = metrics.deflated_sharpe(m).first().dsr
    many = metrics.deflated_sharpe(m, frame(spark, [(float(x),) for x in rng.normal(0, 0.05, 50)], "s double")).first().dsr
    assert 0.5 < one <= 1 and many < one


def test_trade_statistics_edges(spark):
    t = frame(spark, [("A", 10.0), ("A", 0.0), ("B", 5.0)], "strategy string, pnl double")
    got = {r.strategy: r for r in metrics.strategy_stats(t, frame(spark, [("A",), ("B",), ("C",)], "strategy string")).collect()}
    assert got["A"].win_rate == 0.5 and got["B"].profit_factor == float("inf") and got["C"].trades == 0 and got["C"].p_value == 1.0


def test_histogram_counts_everything(spark):
    d = frame(spark, [(float(x),) for x in range(100)], "pnl double")
    h = risk.histogram(d).toPandas()
    assert h.n.sum() == 100 and h.bin.is_unique
    assert risk.histogram(frame(spark, [(1.0,), (1.0,)], "pnl double")).agg(F.sum("n")).first()[0] == 2


def test_spread_widens_with_volatility(spark):
    calm = [100 + (0.1 if i % 2 else -0.1) for i in range(120)]
    wild = calm[:-25] + [100 + (3 if i % 2 else -3) for i in range(25)]
    rows = [(s, T0 + timedelta(minutes=i), float(v)) for s, series in (("c", calm), ("w", wild)) for i, v in enumerate(series)]
    got = {r.symbol: r.spread_ticks for r in fills.spread_ticks(frame(spark, rows, "symbol string, ts timestamp_ntz, close double"), RunSettings()).groupBy("symbol").agg(F.max_by("spread_ticks", "ts").alias("spread_ticks")).collect()}
    assert got["w"] > got["c"] == 1


def test_instruments_have_defaults(spark):
    got = {r.symbol: (r.tick_size, r.multiplier) for r in with_instruments(frame(spark, [("ES",), ("??",)], "symbol string")).collect()}
    assert got == {"ES": (0.25, 50.0), "??": (0.01, 1.0)}


def test_gates_and_text(spark):
    df = frame(spark, [(datetime(2024, 12, 30, h, 0),) for h in (1, 9, 15, 23)] + [(datetime(2025, 1, 2, 9),)], "ts timestamp_ntz")
    inside = lambda a, b: [r[0] for r in df.orderBy("ts").select(timing.session_active(F.col("ts"), a, b)).collect()]
    assert inside("09:00", "15:00") == [False, True, True, False, True] and inside("22:00", "02:00") == [True, False, False, True, False]
    k = df.withColumn("k", F.lit(1))
    assert timing.rebalance_gate(k, "weekly", ["k"]).where("rebalance").count() == 1
    assert timing.rebalance_gate(k, "daily", ["k"]).where("rebalance").count() == 2
    r = spark.range(1).select(text.money(F.lit(-1234.6)), text.duration(F.lit(1565.0)), text.scope_token(F.lit("My+Strat%20A")), text.p_value(F.lit(0.0001))).first()
    assert list(r) == ["-$1,235", "1d 2h 5m", "mystrata", "<0.001"]


def test_folds_and_verdicts():
    f = search.folds(100, 2, 0.1)
    assert f[0][2] == 80 and f[0][3] - f[0][2] == 10 and search.folds(100, 2, 0.1, 3, 2, True)[1] == (0, 85, 90, 100)
    with pytest.raises(ValueError):
        search.folds(10, 10, 0.1)
    good = lambda k, pnl=10.0, sharpe=1.0: search.FoldResult(k, {"a": k, "b": "x"}, 1, 1, 1.2, sharpe, pnl, 5, 0.5, 0.5)
    assert search.verdict([good(i) for i in range(3)])[0] == "PASS"
    assert search.verdict([good(0), good(1, -1.0), good(2)])[0] == "WARNING"
    assert search.verdict([good(0, -1.0)])[0] == "FAIL"
    assert search.consensus([good(0), good(2), good(4)]) == {"a": 2, "b": "x"}
    s = search.sample({"a": (1, 9, 2), "b": ["p", "q"], "c": (0.0, 1.0)}, 20)
    assert s == search.sample({"a": (1, 9, 2), "b": ["p", "q"], "c": (0.0, 1.0)}, 20) and all(x["a"] in (1, 3, 5, 7, 9) and 0 <= x["c"] <= 1 for x in s)


def test_kalman_and_adf(spark):
    rng = np.random.default_rng(2)
    x = 100 + np.cumsum(rng.normal(size=400))
    rows = [("P", T0 + timedelta(hours=i), float(a), float(2 * a)) for i, a in enumerate(x)]
    r = indicators.kalman_beta(frame(spark, rows, "symbol string, ts timestamp_ntz, x double, y double")).orderBy("ts").collect()
    assert r[0].kalman_beta is None and abs(r[-1].kalman_beta - 2) < 0.2


def plain_adf(x):
    """The unit-root t statistic by least squares over the levels themselves."""
    d = np.diff(x)
    a = np.column_stack([x[1:-1], d[:-1], np.ones(len(d) - 1)])
    beta, *_ = np.linalg.lstsq(a, d[1:], rcond=None)
    e = d[1:] - a @ beta
    return beta[0] / np.sqrt(e @ e / (len(e) - 3) * np.linalg.inv(a.T @ a)[0, 0])


def test_adf_equals_least_squares(spark):
    rng = np.random.default_rng(3)
    series = {"walk": 5000 + np.cumsum(rng.normal(size=90)), "noise": rng.normal(size=90), "flat": np.full(90, 7.0), "short": rng.normal(size=20)}
    rows = [(k, T0 + timedelta(hours=i), float(v)) for k, x in series.items() for i, v in enumerate(x)]
    got = {(r.symbol, r.ts): r for r in indicators.adf(frame(spark, rows, "symbol string, ts timestamp_ntz, close double"), 40).collect()}
    at = spark.createDataFrame([(float(plain_adf(series[k][i - 40 : i])), k, i) for k in ("walk", "noise") for i in range(40, 89)], "t double, k string, i int")
    for r in at.select("k", "i", indicators.adf_pvalue(F.col("t")).alias("p")).collect():
        assert got[r.k, T0 + timedelta(hours=r.i + 1)].adf_p == pytest.approx(r.p, abs=1e-7)
    assert got["noise", T0 + timedelta(hours=80)].adf_ok and not got["walk", T0 + timedelta(hours=80)].adf_ok
    assert len(got) == 290 and all(r.adf_p is None and not r.adf_ok for (k, _), r in got.items() if k in ("flat", "short"))


def test_pages_and_downsampling(spark):
    df = spark.range(60).withColumn("k", F.lit(1)).withColumnRenamed("id", "ts")
    assert [r.ts for r in exits.page(df, [F.col("ts")], 99).collect()] == list(range(50, 60))
    got = [r.ts for r in exits.downsample(df, ["k"], 10).orderBy("ts").collect()]
    assert got == [0, 6, 12, 18, 24, 30, 36, 42, 48, 54, 59]


def test_fold_measures_equal_the_verdict_of_each_search(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for k in range(40):
        folds = [(float(rng.normal(0.6, 0.5)), float(rng.normal(0.4, 0.4)), float(rng.normal(3, 4)), int(rng.integers(0, 6)), int(rng.integers(1, 4)), "ab"[int(rng.integers(2))]) for _ in range(5)]
        rows += [(f"s{k}", i, *f) for i, f in enumerate(folds)]
        res = [search.FoldResult(i, {"n": f[4], "m": f[5]}, 0, 0, f[0], f[1], f[2], f[3], 0, 0) for i, f in enumerate(folds)]
        good = [f[2] > 0 and f[1] >= 0.3 for f in folds]
        want[f"s{k}"] = (search.verdict(res)[0], search.streak(good), sum(good), float(np.median([r.degradation for r in res])), sum(f[2] for f in folds) / max(1, sum(f[3] for f in folds)), search.consensus(res))
    df = frame(spark, rows[::-1], "search string, fold int, is_sharpe double, oos_sharpe double, oos_pnl double, oos_trades int, n int, m string")
    got = {r.search: r for r in search.fold_measures(df, ["search"]).collect()}
    assert {k: (r.verdict, r.longest_run, r.good_folds) for k, r in got.items()} == {k: w[:3] for k, w in want.items()} and len({w[0] for w in want.values()}) == 3
    assert all(r.degradation == pytest.approx(want[k][3]) and r.expected_value == pytest.approx(want[k][4]) for k, r in got.items() if r.expected_value)
    medians = {r.search: r for r in search.consensus_table(df, ["search"], ["n"], ["m"]).collect()}
    used = {k: [r for r in rows if r[0] == k and r[4] > 0] or [r for r in rows if r[0] == k] for k in want}
    for k, r in medians.items():
        names = [x[7] for x in used[k]]
        assert r.n == float(np.median([x[6] for x in used[k]])) and r.m == min(sorted(set(names)), key=lambda v: -names.count(v))


def test_closed_pnl_counts_at_the_times_of_the_history(spark):
    h = frame(spark, [(T0 + timedelta(days=d),) for d in (0, 1, 2, 40)], "ts timestamp_ntz")
    t = frame(spark, [("LONG", T0 + timedelta(days=1), 5.0), ("LONG", T0 + timedelta(days=1, hours=1), 100.0), ("SHORT", T0, -1.0), ("LONG", T0 + timedelta(days=40), 2.0), ("LONG", T0 + timedelta(days=1), None)], "direction string, exit_time timestamp_ntz, pnl double")
    got = {(r.direction, (r.ts - T0).days): r.closed_pnl for r in attribution.closed_pnl(t, h, ["direction"]).collect()}
    assert got == {("LONG", 0): 0.0, ("LONG", 1): 5.0, ("LONG", 2): 5.0, ("LONG", 40): 7.0, ("SHORT", 0): -1.0, ("SHORT", 1): -1.0, ("SHORT", 2): -1.0, ("SHORT", 40): -1.0}
