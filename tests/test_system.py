"""Lake, bundles, jobs, runs, endpoints, streams and the driver's contract."""

import uuid
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quantloom.operators import search
from quantloom.plans import endpoints, queries, views
from quantloom.settings import RunSettings
from quantloom.simulation import portfolio, runs
from quantloom.sources import bundles, contracts
from quantloom.sources.lake import Lake
from quantloom.streaming import live

FREE = RunSettings(timeframe="1h", use_trading_hours=False, eod_close=None, spread_mode="static")
T0 = datetime(2024, 1, 1)


def some_bars(spark, n=5, symbol="ES", step=0):
    rows = [(symbol, "1h", T0 + timedelta(hours=step + i), 1.0, 2.0, 0.5, 1.5 + i, 10.0) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, timeframe string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


def test_lake_round_trip(spark, tmp_path):
    lake = Lake(spark, f"file://{tmp_path}/lake")
    assert lake.bars().count() == 0
    with pytest.raises(ValueError):
        lake.save(some_bars(spark).where("false"))
    lake.save(some_bars(spark).unionByName(some_bars(spark, 3, "6E")))
    assert [r.symbol for r in lake.symbols().collect()] == ["6E", "ES"]
    assert lake.load("ES", "1h", "2024-01-01 01:00:00", "2024-01-01 03:00:00").count() == 3
    lake.extend(some_bars(spark, 4, "ES", 3).withColumn("close", F.lit(99.0)))
    assert lake.load("ES", "1h").count() == 7 and lake.load("ES", "1h").where("close = 99").count() == 4 and lake.load("6E", "1h").count() == 3
    need = spark.createDataFrame([("ES", "1h"), ("NQ", "1h")], "symbol string, timeframe string")
    assert {r.symbol: r.state for r in lake.freshness(need, "2024-01-05 00:00:00").collect()} == {"ES": "fresh", "NQ": "missing"}
    with pytest.raises(RuntimeError):
        lake.require_fresh(need, "2024-02-01 00:00:00")
    assert {r.symbol: r.bars for r in lake.info().collect()} == {"ES": 7, "6E": 3}
    assert len(lake.fingerprint(need)) == 16 == len(lake.fingerprint(need.limit(0)))
    with pytest.raises(ValueError):
        lake.load("ES", "2h")


def test_contracts(spark):
    c = contracts.quarterly(spark, ["ES"], 2024, 2024).collect()
    assert [(r.contract, r.expiry) for r in c][:2] == [("ESH24", date(2024, 3, 15)), ("ESM24", date(2024, 6, 21))]
    assert contracts.weekly_chunks(date(2024, 1, 1), date(2024, 1, 10)) == [(date(2024, 1, 3), date(2024, 1, 10)), (date(2024, 1, 1), date(2024, 1, 3))]


def test_bundles_and_jobs(spark, tmp_path, data):
    path = f"file://{tmp_path}/b"
    assert bundles.inspect(spark, path)[0] == "missing"
    h = views.history(spark, data)
    bundles.save(spark, path, "single", {"history": h, "trades": views.trades(spark, data)}, {"sharpe": float("nan")}, {"slots": None})
    assert bundles.inspect(spark, path) == ("valid", [])
    b = bundles.load(spark, path)
    assert b["metrics"] == {"sharpe": None} and b["history"].count() == h.count()
    assert bundles.manifests(spark, f"{path}/manifest.json").first().run_type == "single"
    assert endpoints.ribbon(b).first().trades == b["trades"].count()
    assert endpoints.exit_reason(b).count() > 0 and endpoints.pnl_distribution(b).agg(F.sum("n")).first()[0] > 0
    assert endpoints.risk_panel(b).count() == 5 and endpoints.exit_detail(b, page=2).count() == 25
    assert endpoints.text_report(b).startswith("=" * 48)
    jobs = bundles.Jobs(spark, f"file://{tmp_path}/jobs")
    assert jobs.run("j1", lambda: {"n": 1})["status"] == "completed" and jobs.run("j2", lambda: 1 / 0)["status"] == "failed"
    assert {r.job_id: r.status for r in jobs.list().collect()} == {"j1": "completed", "j2": "failed"}
    assert bundles.rerunnable({"run_type": "portfolio", "slots": 1, "slot_weights": 1}) == (False, ["config"])
    s = bundles.scenario({"artifact_id": "a", "config": {"target_vol": 0.1}}, volatility=2.0)
    assert s["config"]["target_vol"] == 0.2 and s["baseline_run_id"] == "a"


def test_runs_agree_with_their_history(spark, data):
    out = runs.simulate(views.bars(spark, data, "4 hours"), "sma_pullback", FREE.with_params(smapull_fast_sma_window=5, smapull_slow_sma_window=12)).cache()
    t = runs.trades(out).groupBy("symbol").agg(F.sum("pnl").alias("pnl"), F.sum("quantity").alias("q"))
    f = runs.fills(out).groupBy("symbol").agg(F.sum("quantity").alias("fq"), F.count("*").alias("n"))
    last = runs.history(out).groupBy("symbol").agg(F.max_by("total_value", "ts").alias("v"))
    rows = t.join(f, "symbol").join(last, "symbol").collect()
    assert rows
    for r in rows:
        if r.fq == 2 * r.q:  # flat at the end
            assert r.v == pytest.approx(FREE.initial_capital + r.pnl)
    assert runs.fills(out).where("ts <= signal_ts").count() == 0


def test_portfolio_run(spark, data):
    slots = [portfolio.Slot("0", "sma_pullback", ("click",), 0.5, params={"smapull_fast_sma_window": 5, "smapull_slow_sma_window": 12}), portfolio.Slot("1", "channel_breakout", ("view",), 0.5, params={"chbrk_length": 5, "chbrk_ema_period": 10})]
    out = runs.simulate_portfolio(views.bars(spark, data, "4 hours"), slots, portfolio.PortfolioSettings(FREE, target_vol=0.9, vol_lookback=5)).cache()
    h, p = runs.history(out), runs.slot_pnl(out).groupBy("ts").agg(F.sum("pnl").alias("pnl"))
    assert h.join(p, "ts").where(F.abs(F.col("total_value") - 100000 - F.col("pnl")) > 1e-6).count() == 0 and h.count() > 0


def test_walk_forward_and_batches(spark, data):
    b = views.bars(spark, data, "6 hours").where("symbol in ('click', 'view')")
    r = search.walk_forward(b, "sma_pullback", FREE, n_folds=1, test_share=0.2, n_trials=2, min_trades=0)
    assert r["verdict"] in ("PASS", "WARNING", "FAIL") and len(r["folds"]) <= 1
    s = search.run_batch(b.withColumn("timeframe", F.lit("1h")), ["sma_pullback", "rfp_fractal"], FREE)
    assert s.count() == 4 and search.batch(spark, ["a", "b"], ["x"], ["1h", "5m"]).count() == 4


def test_streamed_bars_equal_batch_bars(spark, tmp_path, data):
    ticks = views.ticks(spark, data)
    ticks.repartition(4).write.parquet(f"{tmp_path}/in")
    name = "bars_" + uuid.uuid4().hex
    src = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 4).parquet(f"{tmp_path}/in").withColumn("ts", F.col("ts").cast("timestamp"))
    q = live.bars(src, "1 day").writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.symbol, str(r.ts)[:10]): (r.close, r.n) for r in spark.table(name).collect()}
    want = {(r.symbol, str(r.ts)[:10]): (r.close, r.n) for r in views.bars(spark, data, "1 day").collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(got) >= len(want) - 5  # the last window stays open


def test_streamed_strategy_equals_one_pass(spark, tmp_path, data):
    b = views.bars(spark, data, "4 hours").select("symbol", "ts", "open", "high", "low", "close")
    want = []
    for sym in ("click", "view"):
        m = live.Live(live.Crossing(), RunSettings(**{**FREE.__dict__, "symbol": sym}))
        for r in sorted(b.where(F.col("symbol") == sym).collect(), key=lambda r: r.ts):
            want += [(sym, f.ts, f.order.side, f.price) for f in m.step(r.asDict(), FREE.spread_ticks)]
    b = b.where("symbol in ('click', 'view')")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    name = "fills_" + uuid.uuid4().hex
    b.where(F.col("ts") < cut).coalesce(1).write.parquet(f"{tmp_path}/in")
    src = lambda: spark.readStream.schema(b.schema).parquet(f"{tmp_path}/in")
    start = lambda: live.simulate(src(), FREE).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).queryName(name).start()
    start().awaitTermination(120)
    b.where(F.col("ts") >= cut).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    start().awaitTermination(120)  # a new query takes the state up from the checkpoint
    got = [(r.symbol, r.ts, r.side, r.price) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert want and sorted(got) == sorted(want)


def test_sessions_and_distinct_ticks(spark, data):
    t = views.ticks(spark, data)
    assert live.sessions(t, "2 hours").agg(F.sum("n")).first()[0] == t.count()


def test_contract_of_the_driver(spark, data):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(queries.QUERIES) >= 70
    assert entry.entry(spark).count() > 0


def test_command_line(spark, tmp_path, data, capsys, monkeypatch):
    from quantloom import cli

    b = views.bars(spark, data, "4 hours").withColumn("timeframe", F.lit("1h"))
    Lake(spark, f"file://{tmp_path}/lake").save(b)
    for k, v in (("USE_TRADING_HOURS", "false"), ("EOD_CLOSE", "")):
        monkeypatch.setenv(f"QUANTLOOM_{k}", v)
    lake = ["--lake", f"file://{tmp_path}/lake"]
    assert cli.main(["backtest", *lake, "--strategy", "channel_breakout", "--symbols", "click,view", "--params", '{"chbrk_length": 5, "chbrk_ema_period": 10}', "--out", f"file://{tmp_path}/b"]) == 0
    assert bundles.inspect(spark, f"file://{tmp_path}/b")[0] == "valid" and cli.main(["report", "--bundle", f"file://{tmp_path}/b"]) == 0
    assert cli.main(["validate", *lake, "--symbols", "click"]) in (0, 1)
    (tmp_path / "p.json").write_text('{"slots": [{"strategy": "channel_breakout", "symbols": ["click"], "weight": 1.0, "params": {"chbrk_length": 5, "chbrk_ema_period": 10}}]}')
    assert cli.main(["portfolio", *lake, "--config", f"file://{tmp_path}/p.json", "--out", f"file://{tmp_path}/p"]) == 0
    assert bundles.inspect(spark, f"file://{tmp_path}/p")[0] == "valid" and "====" in capsys.readouterr().out
