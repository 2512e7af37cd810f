"""Rolling frames in overlapping ranges of a series, and order statistics that slide over them."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.operators import frames, indicators, risk
from quantloom.operators.bars import range_bars
from quantloom.operators.carry import CHUNK

T0 = datetime(2024, 1, 1)


def ticks(spark, counts, seed=3):
    """One symbol a list of rows by day; a few values are null."""
    rng, rows = random.Random(seed), []
    for k, days in counts.items():
        for d, n in enumerate(days):
            rows += [(k, T0 + timedelta(days=d, minutes=m), rng.choice([None, 1.0, 2.0]) if rng.random() < 0.2 else rng.gauss(0, 9)) for m in range(n)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double")


SHAPES = {"hot": [1, 40, 3, 3, 3, 55, 1, 1, 1, 30], "few": [2], None: [4, 0, 9], "even": [10] * 9}


@pytest.mark.parametrize("reach,size", [(1, 4), (7, 8), (25, 10), (200, 16)])
def test_ranges_see_what_the_whole_series_sees(spark, reach, size):
    df = ticks(spark, SHAPES)
    add = lambda rows, w: rows.withColumns({"s": F.sum("x").over(w.rowsBetween(-reach, 0)), "l": F.lag("x", reach).over(w), "c": F.count("*").over(w.rowsBetween(-reach, 0))})
    got = frames.overlapped(df, ["symbol"], reach, add, size=size)
    want = add(df, Window.partitionBy("symbol").orderBy("ts"))
    pick = lambda d: sorted(d.select("symbol", "ts", F.round("s", 6), "l", "c").collect(), key=str)
    assert pick(got) == pick(want)


def test_a_single_series_is_dealt_to_many_tasks_with_little_repeated(spark):
    df = ticks(spark, {"hot": [50] * 40})
    seen = {}

    def add(rows, w):
        seen["rows"] = rows
        return rows.withColumn("m", F.avg("x").over(w.rowsBetween(-9, 0)))

    out = frames.overlapped(df, ["symbol"], 10, add, size=100)
    assert out.count() == 2000
    sizes = [r["count"] for r in seen["rows"].groupBy("symbol", CHUNK).count().collect()]
    assert len(sizes) == 20 and max(sizes) <= 150 and sum(sizes) == 2000 + 19 * 50
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(symbol#" in plan and f", {CHUNK}#" in plan


def test_null_times_empty_tables_and_other_columns(spark):
    schema = "symbol string, ts timestamp_ntz, x double, _note string"
    add = lambda rows, w: rows.withColumn("n", F.count("x").over(w.rowsBetween(-2, 0)))
    assert frames.overlapped(spark.createDataFrame([], schema), ["symbol"], 3, add).collect() == []
    got = frames.overlapped(spark.createDataFrame([("a", None, 1.0, "p"), ("a", T0, None, "q"), (None, T0, 2.0, None)], schema), ["symbol"], 3, add)
    assert got.columns == ["symbol", "ts", "x", "_note", "n"]
    assert sorted((r.symbol or "", r._note or "", r.n) for r in got.collect()) == [("", "", 1), ("a", "p", 1), ("a", "q", 1)]


def test_order_statistics_equal_a_sort_of_every_frame(spark):
    df = ticks(spark, {"a": [30, 30, 30], "b": [3], "c": [1, 1, 1]})
    n, least = 11, 4
    use = lambda rows, w: frames.order_statistics(rows, ["symbol", CHUNK], "x", n, least, quantiles={"q": 0.3, "top": 1.0}, tails={"tail": "q"}, rank="p")
    got = frames.overlapped(df, ["symbol"], n, use, size=20).orderBy("symbol", "ts").toPandas()
    assert len(got) == 96
    for _, g in got.groupby("symbol"):
        x = g.x.tolist()
        for i, r in enumerate(g.itertuples()):
            v = sorted(y for y in x[max(0, i - n + 1) : i + 1] if not math.isnan(y))
            if len(v) < least:
                assert all(map(math.isnan, (r.q, r.top, r.tail, r.p)))
                continue
            q = np.quantile(v, 0.3)
            assert r.q == pytest.approx(q) and r.top == v[-1] and r.tail == pytest.approx(np.mean([y for y in v if y <= q + 1e-12]))
            if math.isnan(x[i]):
                assert math.isnan(r.p)
            else:
                assert r.p == pytest.approx((sum(y < x[i] for y in v) + (v.count(x[i]) + 1) / 2) / len(v))


def test_indicators_do_not_depend_on_where_ranges_are_cut(spark, monkeypatch):
    rng, rows, c = random.Random(5), [], 100.0
    for i in range(400):
        o, c = c, c + rng.gauss(0, 1)
        rows.append(("a", T0 + timedelta(hours=i), o, max(o, c) + rng.random(), min(o, c) - rng.random(), c, rng.random() * 9))
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    uses = [
        lambda b: indicators.bollinger(b, 12), lambda b: indicators.range_levels(b, 9, 2), lambda b: indicators.volume_ratio(b, 7), lambda b: indicators.poc_proxy(b, 7), lambda b: indicators.structure(b, 9),
        lambda b: indicators.volatility_regime(b, 8, 20), lambda b: indicators.trend_t(b, 14), lambda b: indicators.half_life(b, 16), lambda b: indicators.fractal_levels(b, 8),
        lambda b: indicators.squeeze(b, "volume", 15, 0.3, 4), lambda b: indicators.diamonds(b, 8, 8),
    ]
    pick = lambda d: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in d.collect())
    text = lambda d: [str(r) for r in pick(d)]
    whole = [text(use(bars)) for use in uses]
    short = frames.overlapped
    monkeypatch.setattr(indicators, "overlapped", lambda *a, **k: short(*a, **{**k, "size": 1}))
    for use, want in zip(uses, whole):
        assert text(use(bars)) == want


def test_rolling_var_of_days(spark):
    rng = random.Random(8)
    x = [rng.gauss(0, 5) for _ in range(80)]
    days = spark.createDataFrame([("r", (T0 + timedelta(days=i)).date(), v) for i, v in enumerate(x)], "run_id string, day date, pnl double")
    got = risk.rolling_var_es(days, ["run_id"], 20).orderBy("day").collect()
    for i, r in enumerate(got):
        v = sorted(x[max(0, i - 19) : i + 1])
        if len(v) < 10:
            assert r.var_primary is None and r.es_tail is None and not r.breach_primary
            continue
        q = float(np.quantile(v, 0.05))
        assert r.var_primary == pytest.approx(max(0, -q)) and r.es_primary == pytest.approx(max(0, -np.mean([y for y in v if y <= q])))
        assert r.breach_primary == (x[i] <= -r.var_primary)


def test_sessions_of_any_zone(spark):
    """Times pass through the kernels in a zone that is not called UTC."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    rows = [("a", T0 + timedelta(hours=i), 1.0 + i % 5, 2.0 + i % 5, 0.5, 1.0 + i % 5, 9.0) for i in range(60)]
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        for kind in ("timestamp", "timestamp_ntz"):
            bars = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double").withColumn("ts", F.col("ts").cast(kind))
            assert indicators.atr(bars, 5).count() == 60
            assert indicators.squeeze(bars, "close", 9, 0.5).select("ts").distinct().count() == 60
            assert indicators.kalman_beta(bars.withColumns({"x": F.col("open"), "y": F.col("close")})).count() == 60
            made = {r.ts for r in range_bars(bars, 2.0).collect()}
            assert made and made <= {r.ts for r in bars.collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
