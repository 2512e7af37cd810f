"""Footers, extension file by file, files that cannot be read."""

import os
from datetime import datetime, timedelta
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quantloom.sources.footers import footers
from quantloom.sources.lake import Lake, file_report, read_files

T0 = datetime(2024, 1, 1)
BAR = "symbol string, timeframe string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def bars(spark, days, symbol="ES", close=1.5, step=24):
    return spark.createDataFrame([(symbol, "1h", T0 + timedelta(hours=step * d), 1.0, 2.0, 0.5, close, 10.0) for d in days], BAR)


def files(lake):
    return {p: (os.path.getmtime(p), p.read_bytes()) for p in Path(lake.path.removeprefix("file://")).rglob("*.parquet")}


def test_a_tail_of_one_day_leaves_other_files(spark, tmp_path):
    lake = Lake(spark, f"file://{tmp_path}/lake")
    for part in (range(0, 10), range(10, 20), range(20, 30)):
        assert lake.extend(bars(spark, part)) == []
    lake.extend(bars(spark, range(0, 30), "6E/x y+%"))
    before = files(lake)
    gone = lake.extend(bars(spark, [29, 30], close=99.0))
    after = files(lake)
    kept = set(before) & set(after)
    assert 1 <= len(gone) < len(before) and len(before) - len(kept) == len(gone) and all(before[p] == after[p] for p in kept)
    got = {(r.symbol, r.ts): r.close for r in lake.bars().collect()}
    want = {("ES", T0 + timedelta(days=d)): 99.0 if d >= 29 else 1.5 for d in range(31)} | {("6E/x y+%", T0 + timedelta(days=d)): 1.5 for d in range(30)}
    assert got == want and lake.bars().count() == len(want)
    # inside a file, between files' days, and the same again
    assert len(lake.extend(bars(spark, [5], "6E/x y+%", 7.0))) >= 1 and lake.extend(bars(spark, [400])) == []
    lake.extend(bars(spark, [5], "6E/x y+%", 7.0))
    assert lake.bars().count() == len(want) + 1 and lake.bars().where("close = 7").count() == 1
    assert lake.extend(bars(spark, []).where("false")) == []


def test_a_lost_extension_is_mended_by_the_same_call(spark, tmp_path, monkeypatch):
    lake = Lake(spark, f"file://{tmp_path}/lake")
    lake.extend(bars(spark, range(5)))
    old = files(lake)
    lake.extend(bars(spark, [4, 5], close=2.0))
    for p, (_, raw) in old.items():  # as if old files had not gone yet
        p.write_bytes(raw)
    assert lake.bars().count() > 6
    lake.extend(bars(spark, [4, 5], close=2.0))
    lake.extend(bars(spark, range(4)))
    assert {r.ts.day: r.close for r in lake.bars().collect()} == {d + 1: 2.0 if d >= 4 else 1.5 for d in range(6)} and lake.bars().count() == 6


def test_footers_equal_a_scan_and_read_no_column(spark, tmp_path):
    lake = Lake(spark, f"file://{tmp_path}/lake")
    lake.save(bars(spark, range(200), step=1).unionByName(bars(spark, range(50), "NQ", step=1)))
    folder = f"{tmp_path}/lake/symbol=GC/timeframe=1h"
    os.makedirs(folder)
    at = pa.array([T0, None, T0 + timedelta(days=9)], pa.timestamp("us"))
    pq.write_table(pa.table({"ts": at, "close": [1.0, 2.0, 3.0]}), f"{folder}/a.parquet", write_statistics=False)
    pq.write_table(pa.table({"ts": at[1:2], "close": [2.0]}), f"{folder}/b.parquet")
    pq.write_table(pa.table({"ts": at[:0], "close": pa.array([], pa.float64())}), f"{folder}/c.parquet")
    scan = {(r.symbol, r.timeframe): tuple(r)[2:] for r in lake.bars().groupBy("symbol", "timeframe").agg(F.count("*"), F.min("ts"), F.max("ts")).collect()}
    f = lake.files().collect()
    assert {(r.symbol, r.timeframe): tuple(r)[2:] for r in lake.files().groupBy("symbol", "timeframe").agg(F.sum("rows"), F.min("first"), F.max("last")).collect()} == scan
    assert [r.scanned for r in f if r.path.endswith("/a.parquet")] == [True] and not any(r.scanned for r in f if not r.path.endswith("/a.parquet"))
    need = spark.createDataFrame([("GC", "1h"), ("NQ", "1h"), ("ZZ", "1h")], "symbol string, timeframe string")
    fresh = lake.freshness(need, "2024-01-20 00:00:00", 12)
    assert {r.symbol: r.state for r in fresh.collect()} == {"GC": "fresh", "NQ": "stale", "ZZ": "missing"}
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" in plan and "content" not in plan and "FileScan parquet" not in plan


def test_footers_of_zoned_times_and_other_zones(spark, tmp_path):
    at = pa.array([T0, T0 + timedelta(hours=1, microseconds=3)], pa.timestamp("us", "UTC"))
    pq.write_table(pa.table({"ts": at}), f"{tmp_path}/x_1h.parquet")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            r = footers(spark, f"file://{tmp_path}").first()
            assert (r.rows, r.first, r.last) == (2, T0, T0 + timedelta(hours=1, microseconds=3))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_bad_files_are_reported_and_the_others_read(spark, tmp_path):
    t = pa.table({"ts": pa.array([T0], pa.timestamp("us")), "close": [1.0]})
    for name in ("ES_1h", "BRK_B_30m", "NQ_2h", "plain", "CUT_1h"):
        pq.write_table(t, f"{tmp_path}/{name}.parquet")
    raw = (tmp_path / "CUT_1h.parquet").read_bytes()
    (tmp_path / "CUT_1h.parquet").write_bytes(raw[: len(raw) // 2])
    (tmp_path / "EMPTY_1h.parquet").write_bytes(b"")
    pq.write_table(pa.table({"close": [1.0]}), f"{tmp_path}/NOTS_1h.parquet")
    report = {r.path.rsplit("/", 1)[1]: r for r in file_report(spark, f"file://{tmp_path}").collect()}
    assert {k: r.state for k, r in report.items()} == {
        "ES_1h.parquet": "ok", "BRK_B_30m.parquet": "ok", "NQ_2h.parquet": "unknown timeframe", "plain.parquet": "unnamed", "CUT_1h.parquet": "bad", "NOTS_1h.parquet": "bad",
    }
    assert report["BRK_B_30m.parquet"].symbol == "BRK_B" and report["CUT_1h.parquet"].error
    (tmp_path / "NOTS_1h.parquet").unlink()
    got = read_files(spark, f"file://{tmp_path}", skip_bad=True)
    assert {(r.symbol, r.timeframe) for r in got.collect()} == {(r.symbol, r.timeframe) for r in report.values() if r.state == "ok"}
