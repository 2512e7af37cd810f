"""Queries without SQL over whole tables, against loops over the rows of a small events table."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from pyspark.sql import functions as F

from quantloom.operators import fills, joins, metrics, search
from quantloom.plans import queries, views

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """(folder, rows): 90 events of two types over six days; nine tenths have ids that no tenth divides."""
    rng = np.random.default_rng(5)
    rows, at = [], T0
    for i in range(1, 91):
        at += timedelta(seconds=int(rng.integers(60, 11_000)))
        rows.append((i, at, "AB"[int(rng.integers(2))], float(round(rng.uniform(1, 100), 2))))
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{d}/events.parquet")
    return d, rows


def hourly(rows):
    """{symbol: [(hour, high, low, close)]} in order of time."""
    bars = {}
    for _, ts, symbol, x in rows:
        hour = ts.replace(minute=0, second=0)
        own = bars.setdefault(symbol, [])
        if own and own[-1][0] == hour:
            own[-1] = (hour, max(own[-1][1], x), min(own[-1][2], x), x)
        else:
            own.append((hour, x, x, x))
    return bars


def close_at(bars, symbol, ts):
    return [c for t, _, _, c in bars[symbol] if t <= ts][-1]


def test_asof_close_of_every_trade(spark, events):
    d, rows = events
    bars = hourly(rows)
    got = {r.trade_id: (r.symbol, r.close) for r in queries.QUERIES["asof_close"](spark, d).collect()}
    assert got == {i: (s, close_at(bars, s, ts)) for i, ts, s, _ in rows}


def test_excursions_of_every_trade(spark, events):
    d, rows = events
    bars, want = hourly(rows), {}
    for i, ts, s, x in rows:
        seen = [(h, lo) for t, h, lo, _ in bars[s] if ts < t <= ts + timedelta(hours=1 + i % 30)]
        if seen:
            up, down = max(h for h, _ in seen) - x, min(lo for _, lo in seen) - x
            best, worst = (up, down) if i % 2 == 0 else (-down, -up)
            want[i] = (max(0.0, best * (1 + i % 5)), min(0.0, worst * (1 + i % 5)))
    got = {r.trade_id: (r.mfe, r.mae) for r in queries.QUERIES["range_join_mfe_mae"](spark, d).collect()}
    assert set(got) == set(want) and len(want) > 60
    assert all(got[i] == pytest.approx(want[i], abs=1e-5) for i in want)


def test_forward_pnl_of_every_trade(spark, events):
    d, rows = events
    bars, want = hourly(rows), {}
    for i, ts, s, x in rows:
        for m in (60, 240, 1440):
            due = ts + timedelta(minutes=m)
            want[i, m] = ((1 if i % 2 == 0 else -1) * (close_at(bars, s, due) - x) * (1 + i % 5) - 0.75, due > bars[s][-1][0])
    got = {(r.trade_id, r.minutes): (r.pnl, r.past_end) for r in queries.QUERIES["pnl_decay"](spark, d).collect()}
    assert set(got) == set(want)
    assert all(got[k][0] == pytest.approx(want[k][0], abs=1e-5) and got[k][1] == want[k][1] for k in want)


def test_holding_buckets_of_every_trade(spark, events):
    d, rows = events
    bins = [[x for i, _, _, x in rows if min(4, (1 + i % 30) // 24) == k] for k in range(5)]  # the longest is 30 hours, so bins are days
    got = queries.QUERIES["holding_buckets"](spark, d).orderBy("bucket").collect()
    assert [r.n for r in got] == [len(b) for b in bins] and sum(r.n for r in got) == len(rows)
    assert [r.avg_pnl for r in got] == pytest.approx([np.mean(b) if b else 0.0 for b in bins], abs=1e-5)
    assert [r.label for r in got] == ["<1d", "1d-2d", "2d-3d", "3d-4d", ">4d"]


def queue_matches(fills):
    """[(buy seq, sell seq, quantity)] of one series of (seq, side, quantity) in order, from a queue of open fills."""
    waiting, got = [], []
    for seq, side, q in fills:
        while q and waiting and waiting[0][1] != side:
            n = min(q, waiting[0][2])
            got.append((seq, waiting[0][0], n) if side == "BUY" else (waiting[0][0], seq, n))
            waiting[0][2] -= n
            q -= n
            if not waiting[0][2]:
                waiting.pop(0)
        if q:
            waiting.append([seq, side, q])
    return sorted(got)


def test_fifo_match_of_every_event(spark, events):
    d, rows = events
    rows = [*rows, (91, datetime(2024, 1, 9), "A", 5.0), (92, datetime(2024, 1, 10), "A", 6.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").write.mode("overwrite").parquet(f"{d}/more/events.parquet")
    price, want = {}, []
    for s in "AB":
        own = [(n + 1, "BUY" if r[0] % 2 == 0 else "SELL", 1.0 + r[0] % 3, r[3]) for n, r in enumerate(r for r in rows if r[2] == s)]
        price |= {(s, n): p for n, _, _, p in own}
        want += [(s, "LONG" if b < c else "SHORT", b, c, q) for b, c, q in queue_matches([x[:3] for x in own])]
    got = queries.QUERIES["fifo_match"](spark, f"{d}/more").collect()
    assert sorted((r.symbol, r.direction, r.buy_seq, r.sell_seq, r.quantity) for r in got) == sorted(want)
    assert all(r.gross_pnl == pytest.approx((price[r.symbol, r.sell_seq] - price[r.symbol, r.buy_seq]) * r.quantity, abs=1e-3) for r in got)


def test_fifo_match_pairs_no_rows_freely(spark):
    """Each fill meets the fills of its bucket only; uneven sizes, one fill as large as hundreds of others."""
    rng = np.random.default_rng(9)
    size = [400.0 if n == 300 else float(rng.integers(1, 5)) for n in range(1, 1201)]
    rows = [("X", n, "BUY" if rng.random() < 0.5 else "SELL", q, float(n), n) for n, q in enumerate(size, 1)]
    df = spark.createDataFrame(rows, "symbol string, seq long, side string, quantity double, price double, ts long")
    m = fills.fifo_match(df, ["symbol"])
    assert sorted((r.buy_seq, r.sell_seq, r.quantity) for r in m.collect()) == queue_matches([r[1:4] for r in rows])
    assert "_bucket" in next(x for x in m._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x)


def test_range_join_passes_over_spans_that_hold_no_time(spark):
    spans = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP_NTZ'2024-01-02 10:00:00', TIMESTAMP_NTZ'2024-01-01 09:00:00'), (2, TIMESTAMP_NTZ'2024-01-01 09:00:00', TIMESTAMP_NTZ'2024-01-03 09:00:00'), (3, NULL, TIMESTAMP_NTZ'2024-01-03 09:00:00') AS t(id, a, b)")
    points = spark.sql("SELECT 'k' AS k, TIMESTAMP_NTZ'2024-01-02 10:00:00' AS ts")
    got = joins.range_join(spans.withColumn("k", F.lit("k")), points, ["k"], "a", "b").collect()
    assert [r.id for r in got] == [2]


def test_asof_takes_the_greatest_of_equal_times(spark):
    left = spark.createDataFrame([("k", 5)], "k string, ts int")
    right = spark.createDataFrame([("k", 5, 2.0), ("k", 5, 7.0), ("k", 5, 3.0), ("k", 6, 1.0), ("k", 6, 0.5)], "k string, ts int, v double").repartition(3)
    assert joins.asof_backward(left, right, ["k"], ["v"]).first().v == 7.0 and joins.asof_forward(left, right, ["k"], ["v"]).first().v == 0.5


def test_recurrence_equals_a_loop(spark):
    from quantloom.operators.windows import recurrence

    rows = [("a", i, None if i % 7 == 3 else float((i * 37) % 11)) for i in range(400)] + [("b", 0, None), ("b", 1, 4.0)]
    got = {(r.symbol, r.ts): r.y for r in recurrence(spark.createDataFrame(rows, "symbol string, ts int, x double"), ["symbol"], F.col("x"), "y", 0.9, (F.col("ts") / 150).cast("int")).collect()}
    for k in ("a", "b"):
        y = None
        for _, i, x in [r for r in rows if r[0] == k]:
            y = y if x is None else x if y is None else 0.9 * y + 0.1 * x
            assert got[k, i] == (None if y is None else pytest.approx(y, rel=1e-12))


def test_folds_follow_each_series(spark):
    bars = spark.createDataFrame([("long", i) for i in range(100)] + [("short", i) for i in range(40)] + [("tiny", 0)], "symbol string, ts int")
    got = {(r.symbol, r.fold): tuple(r)[2:] for r in search.folds_by_series(bars, 2, 0.1, 3, 2, True).collect()}
    want = {(s, k): f for s, n in (("long", 100), ("short", 40)) for k, f in enumerate(search.folds(n, 2, 0.1, 3, 2, True))}
    assert got == want


def test_a_run_of_two_symbols_is_scored_by_symbol(spark, data):
    from quantloom.plans import views
    from quantloom.settings import RunSettings
    from quantloom.simulation import runs

    bars = views.bars(spark, data).where("symbol in ('click', 'view')")
    s = RunSettings(timeframe="1h", use_trading_hours=False, eod_close=None, spread_mode="static", params={"smapull_fast_sma_window": 5, "smapull_slow_sma_window": 10})
    whole = search.scored(runs.simulate(bars, "sma_pullback", s).cache(), 0.02, 1, 10, 0.4).first()
    each = [search.scored(runs.simulate(bars.where(F.col("symbol") == x), "sma_pullback", s), 0.02, 1, 10, 0.4).first() for x in ("click", "view")]
    assert whole.trades == sum(r.trades for r in each) and abs(whole.max_drawdown) == max(abs(r.max_drawdown) for r in each)
    assert whole.sharpe == pytest.approx(sum(r.sharpe for r in each) / 2) and whole.score == pytest.approx(sum(r.score for r in each) / 2)


def test_walk_forward_over_series_of_unlike_length(spark, data):
    from quantloom.plans import views
    from quantloom.settings import RunSettings

    bars = views.bars(spark, data).where("symbol = 'click' or (symbol = 'view' and ts < '2024-01-20')")
    s = RunSettings(timeframe="1h", use_trading_hours=False, eod_close=None, spread_mode="static")
    got = search.walk_forward(bars, "sma_pullback", s, n_folds=2, n_trials=2, purge=1)
    assert got["verdict"] in ("PASS", "WARNING", "FAIL") and len(got["folds"]) <= 2


@pytest.mark.parametrize("days", [1, 6])
def test_curve_metrics_of_a_curve_that_only_rises_are_those_of_its_sql(spark, tmp_path, days):
    """No loss and no drawdown: SQL gives null and an infinite ratio, of a single day nothing but its return; the operator by itself gives 0."""
    duckdb = pytest.importorskip("duckdb")
    rows = [(k, "12"[k % 2], 150_000.0 + 100 * k * k, T0 + timedelta(days=k)) for k in range(days)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderpriority string, o_totalprice double, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    got = queries.QUERIES["curve_metrics"](spark, str(tmp_path)).collect()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = c.execute(queries.ORACLES["curve_metrics"]).fetchall()
    assert [repr(tuple(r)) for r in got] == [repr(r) for r in want]
    m = metrics.curve_metrics(views.history(spark, str(tmp_path)), ["run_id"]).first()
    assert (got[0].sortino, m.sortino, m.calmar) == (None, 0.0, 0.0) and (days == 1 or got[0].calmar == float("inf"))
