"""Timers on late ticks, the sampler's densities, history from a source that is cut off."""

import math
import uuid
from datetime import datetime, timedelta
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions import timing
from quantloom.operators import tpe
from quantloom.streaming import clock

T0 = datetime(2024, 1, 1)


def test_one_flag_a_day_on_late_and_unordered_ticks(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(s, T0 + timedelta(minutes=int(m))) for s in ("A", "B") for m in rng.choice(6 * 1440, 400, replace=False)]
    rows += [("C", T0 + timedelta(hours=3)), (None, T0 + timedelta(hours=20))]  # C has no row after the close
    want = {(r.symbol, r.ts) for r in timing.eod_trigger(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz").dropna(), ["symbol"], "15:30").where("eod").collect()}
    # in order of time but for swaps of up to four hours, in six files; then a row far past the end, and one far too late
    order = sorted(rows, key=lambda r: r[1] + timedelta(minutes=int(rng.integers(0, 240))))
    parts = [order[k * len(order) // 6 : (k + 1) * len(order) // 6] for k in range(6)]
    parts += [[("A", T0 + timedelta(days=9))], [("A", T0 + timedelta(hours=15, minutes=30)), ("A", T0 + timedelta(days=12))]]
    schema = "symbol string, ts timestamp"
    name, key = "eod_" + uuid.uuid4().hex, "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for p in parts:  # one batch after another, each by a new run that takes the state up
            spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            q = clock.end_of_day(src, "15:30", "5 hours").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).queryName(name).start()
            q.awaitTermination(120)
            assert q.exception() is None
    finally:
        spark.conf.unset(key)
    got = [(r.symbol, r.ts) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) == 12


def plain_densities(rows, low, high, share):
    """Of one numeric parameter, kernels at the middles of cells; rows of (x, score)."""
    rows = [r for r in rows if r[1] is not None]
    edge = sorted((s for _, s in rows), reverse=True)[math.ceil(share * len(rows)) - 1]
    wide, out = (high - low) / tpe.CELLS, {}
    for side in (True, False):
        cells = [min(tpe.CELLS - 1, int((x - low) / (high - low) * tpe.CELLS)) for x, s in rows if (s >= edge) == side and x is not None and low <= x <= high]
        h = (high - low) / 5 / max(1, len(cells)) ** 0.2
        for k in range(tpe.CELLS):
            p = 1 / tpe.CELLS
            for c in cells:
                at = lambda e: NormalDist((c + 0.5) * wide, h).cdf(e * wide)  # noqa: B023, E731
                p += (at(k + 1) - at(k)) / (at(tpe.CELLS) - at(0))
            out[k, side] = p / (len(cells) + 1)
    return out


def test_densities_equal_a_plain_version_and_rank_candidates(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(x), "pq"[int(x > 5)], None if i % 17 == 0 else round(-abs(float(x) - 7), 1)) for i, x in enumerate(rng.uniform(-1, 10, 80))] + [(90, None, "z", 0.5)]
    trials = spark.createDataFrame(rows, "id int, x double, c string, score double")
    space = {"x": (0, 10), "c": ["p", "q", "r"]}
    got = {(r.param, r.value): (r.good, r.other) for r in tpe.densities(trials, space, "score", 0.2).collect()}
    want = plain_densities([(x, s) for _, x, _, s in rows], 0, 10, 0.2)
    assert len(got) == tpe.CELLS + 3
    for k in range(tpe.CELLS):
        assert got["x", str(k)] == (pytest.approx(want[k, True], rel=1e-9), pytest.approx(want[k, False], rel=1e-9))
    assert sum(g for (p, _), (g, _) in got.items() if p == "x") == pytest.approx(1) == sum(o for (p, _), (_, o) in got.items() if p == "c")
    cand = spark.createDataFrame([(1, 7.0, "q"), (2, 7.0, "q"), (3, 1.0, "p"), (4, None, None), (5, 99.0, "z"), (6, 7.0, "r")], "id int, x double, c string")
    r = {x.id: x for x in tpe.rated(cand, trials, space, "score", "id", 0.2).collect()}
    assert r[1].ratio == r[2].ratio > r[6].ratio and r[3].ratio < 0 and r[4].ratio == r[5].ratio == 0.0
    assert [x.id for x in tpe.best(cand, trials, space, "score", "id", 2, 0.2).collect()] == [1, 2]
    a, b = got["x", str(int(0.7 * tpe.CELLS))], got["c", "q"]
    assert r[1].ratio == pytest.approx(math.log(a[0] / a[1] * b[0] / b[1]), abs=1e-8)


def test_no_trials_make_all_candidates_alike(spark):
    trials = spark.createDataFrame([], "x double, score double")
    r = tpe.best(spark.createDataFrame([(2, 1.0), (1, 5.0)], "id int, x double"), trials, {"x": (0, 10)}, "score", "id", 5).collect()
    assert [(x.id, x.ratio) for x in r] == [(1, 0.0), (2, 0.0)]


# history in steps

FETCH = """
import json, os
from datetime import datetime, timedelta
import pyarrow as pa

def one(symbol, start, stop, options):
    with open(options["log"], "a") as f:
        f.write(f"{symbol} {start} {stop}\\n")
    if os.path.exists(options["stop_at"]) and str(start) >= open(options["stop_at"]).read():
        raise RuntimeError("the line is down")
    days = [start + timedelta(days=i) for i in range((stop - start).days)]
    ts = [datetime(d.year, d.month, d.day, 12) for d in days]
    price = pa.array([float(d.toordinal()) for d in days])
    yield pa.RecordBatch.from_arrays([pa.array([symbol] * len(ts)), pa.array(["x"] * len(ts)), pa.array(ts, pa.timestamp("us")), price, price, price, price, price, price],
        names=["symbol", "contract", "ts", "open", "high", "low", "close", "volume", "average"])
"""


def test_a_run_that_is_cut_off_resumes_without_gaps_or_doubles(spark, tmp_path):
    from quantloom.sources.contracts import BrokerHistory

    module = "fetch_" + uuid.uuid4().hex
    (tmp_path / f"{module}.py").write_text(FETCH)
    spark.sparkContext.addPyFile(f"{tmp_path}/{module}.py")
    spark.dataSource.register(BrokerHistory)
    flag = tmp_path / "down"

    def run(end):
        src = spark.readStream.format("broker_history").options(symbols="ES,NQ", start="2024-01-01", end=end, step="2", fetch=f"{module}:one", log=f"{tmp_path}/log", stop_at=str(flag)).load()
        q = src.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="0 seconds").start()
        try:
            q.processAllAvailable()
            return True
        except Exception:
            return False
        finally:
            q.stop()

    flag.write_text("2024-02-05")
    assert not run("2024-03-20")  # some steps were done, one fails half way
    part = {(r.symbol, r.ts) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert 0 < len(part) < 2 * 79
    flag.unlink()
    asked = len((tmp_path / "log").read_text().splitlines())
    assert run("2024-03-20") and run("2024-03-20") and run("2024-03-25")  # resumed; nothing new; five days more
    rows = [(r.symbol, r.ts.date().isoformat()) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    want = {(s, (T0 + timedelta(days=d)).date().isoformat()) for s in ("ES", "NQ") for d in range(84)}
    assert len(rows) == len(set(rows)) and set(rows) == want
    later = (tmp_path / "log").read_text().splitlines()[asked:]
    assert not any(x.split()[1] < "2024-01-15" for x in later)  # what was stored is not asked for again
