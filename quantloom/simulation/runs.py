"""Simulations as Spark jobs: signals in Catalyst, the kernel once a (run, symbol) group."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fills import spread_ticks
from ..operators.windows import rolling, series
from ..settings import MINUTES, RunSettings
from . import portfolio
from .orders import Bar
from .single import simulate as simulate_one
from .strategies import find

#: One table for everything a run makes; ``kind`` tells rows apart.
_OUT = pa.schema(
    [("run_id", pa.string()), ("symbol", pa.string()), ("kind", pa.string()), ("seq", pa.int32()), ("slot", pa.string()), ("ts", pa.timestamp("us")), ("entry_time", pa.timestamp("us")), ("signal_ts", pa.timestamp("us")),
     ("side", pa.string()), ("reason", pa.string()), ("phase", pa.string()), ("quantity", pa.float64()), ("price", pa.float64()), ("exit_price", pa.float64()), ("commission", pa.float64()), ("slippage", pa.float64()),
     ("pnl", pa.float64()), ("cash", pa.float64()), ("holdings", pa.float64()), ("total_value", pa.float64())]
)
_SQL = (
    "run_id string, symbol string, kind string, seq int, slot string, ts timestamp_ntz, entry_time timestamp_ntz, signal_ts timestamp_ntz, side string, reason string, phase string, "
    "quantity double, price double, exit_price double, commission double, slippage double, pnl double, cash double, holdings double, total_value double"
)


def _table(rows: list[dict[str, Any]]) -> pa.Table:
    return pa.table({f.name: pa.array([r.get(f.name) for r in rows], f.type) for f in _OUT}, schema=_OUT)


def _records(run_id: str, symbol: str, r: Any, slot: str | None = None) -> list[dict[str, Any]]:
    rows = []
    for i, f in enumerate(r.fills):
        rows.append(dict(run_id=run_id, symbol=f.order.symbol or symbol, kind="fill", seq=i, slot=f.order.slot or slot, ts=f.ts, signal_ts=f.order.signal_ts, side=f.order.side, reason=f.order.reason, phase=f.phase, quantity=f.quantity, price=f.price, commission=f.commission, slippage=f.slip))
    for i, item in enumerate(r.trades):
        own, t = item if isinstance(item, tuple) else (slot, item)
        rows.append(dict(run_id=run_id, symbol=t.symbol or symbol, kind="trade", seq=i, slot=own, ts=t.exit_time, entry_time=t.entry_time, signal_ts=t.signal_ts, side=t.direction, reason=t.exit_reason, quantity=t.quantity, price=t.entry_price, exit_price=t.exit_price, commission=t.commission, slippage=t.slippage, pnl=t.pnl))
    for i, (ts, cash, held, value) in enumerate(r.history):
        rows.append(dict(run_id=run_id, symbol=symbol, kind="history", seq=i, ts=ts, cash=cash, holdings=held, total_value=value))
    return rows


def fine_bars(rows: list[dict], fine: list[dict], timeframe: str, fine_timeframe: str) -> dict[Any, list[Bar]]:
    """Finer bars of each coarse bar, those after the coarse bar before it up to its own time, only where all are there."""
    want = MINUTES[timeframe] // MINUTES[fine_timeframe]
    out: dict[Any, list[Bar]] = {}
    j = 0
    for before, r in zip(rows, rows[1:]):
        while j < len(fine) and fine[j]["ts"] <= before["ts"]:
            j += 1
        k = j
        while k < len(fine) and fine[k]["ts"] <= r["ts"]:
            k += 1
        if k - j == want:
            out[r["ts"]] = [Bar(f["ts"], f["open"], f["high"], f["low"], f["close"]) for f in fine[j:k]]
        j = k
    return out


def prepared(bars: DataFrame, strategy: str, s: RunSettings) -> DataFrame:
    """Bars with the strategy's columns and the spread of each bar, by Catalyst."""
    cls = find(strategy)
    rows = spread_ticks(cls.signals(bars, s), s)
    return rows.select("symbol", "ts", "open", "high", "low", "close", "volume", *cls.columns, F.col("spread_ticks").alias("spread"))


def simulate(bars: DataFrame, strategy: str, s: RunSettings, run_id: str = "run", fine: DataFrame | None = None) -> DataFrame:
    """One strategy on every symbol of bars, each a run of its own with all the capital: rows of fills, trades and history.

    A run is sequential, so a group is one (run, symbol) series; runs are what is
    parallel. Orders resolve on finer bars where settings ask for it and ``fine`` has them.
    """
    rows = prepared(bars, strategy, s).withColumn("run_id", F.lit(run_id))

    def kernel(t: pa.Table, lower: pa.Table | None = None) -> pa.Table:
        if not len(t):
            return _table([])
        data = t.sort_by("ts").to_pylist()
        symbol = data[0]["symbol"]
        own = replace(s, symbol=symbol)
        parts = fine_bars(data, lower.sort_by("ts").to_pylist(), s.timeframe, s.intrabar_timeframe) if lower is not None and len(lower) and s.intrabar_timeframe else None
        series_ = [Bar(r["ts"], r["open"], r["high"], r["low"], r["close"]) for r in data]
        r = simulate_one(series_, data, find(strategy)(own), own, [x["spread"] or 0 for x in data], parts)
        return _table(_records(run_id, symbol, r))

    if fine is None:
        return rows.groupBy("run_id", "symbol").applyInArrow(lambda t: kernel(t), _SQL)
    low = fine.select("symbol", "ts", "open", "high", "low", "close").withColumn("run_id", F.lit(run_id))
    return rows.groupBy("run_id", "symbol").cogroup(low.groupBy("run_id", "symbol")).applyInArrow(lambda a, b: kernel(a, b), _SQL)


def sweep(bars: DataFrame, strategy: str, s: RunSettings, grid: Iterable[dict[str, Any]]) -> DataFrame:
    """A run for every parameter set, as one job: their plans are united and tasks take (run, symbol) groups in any order."""
    runs = [simulate(bars, strategy, s.with_params(**p), run_id=f"{strategy}-{i:04d}") for i, p in enumerate(grid)]
    return reduce(DataFrame.unionByName, runs)


def trades(out: DataFrame) -> DataFrame:
    return out.where("kind = 'trade'").select(
        "run_id", "symbol", "slot", F.col("side").alias("direction"), "entry_time", F.col("ts").alias("exit_time"), F.col("price").alias("entry_price"), "exit_price", "quantity", "pnl",
        (F.col("pnl") + F.col("commission")).alias("gross_pnl"), "commission", "slippage", F.col("reason").alias("exit_reason"), F.col("signal_ts").alias("entry_signal_time"), "seq",
    )


def fills(out: DataFrame) -> DataFrame:
    return out.where("kind = 'fill'").select("run_id", "symbol", "slot", "seq", "side", "reason", "phase", "quantity", F.col("price").alias("fill_price"), "commission", "slippage", "ts", "signal_ts")


def history(out: DataFrame) -> DataFrame:
    return out.where("kind = 'history'").select("run_id", "symbol", "ts", "cash", "holdings", "total_value")


def slot_pnl(out: DataFrame) -> DataFrame:
    return out.where("kind = 'slot'").select("run_id", F.col("slot").alias("slot_id"), "ts", "pnl")


def exposure(out: DataFrame) -> DataFrame:
    return out.where("kind = 'exposure'").select("run_id", F.col("slot").alias("slot_id"), "symbol", "ts", F.col("quantity").alias("qty"), F.col("holdings").alias("notional"))


def simulate_portfolio(bars: DataFrame, slots: list[portfolio.Slot], c: portfolio.PortfolioSettings, run_id: str = "portfolio", bars_per_year: float = 252.0 * 13) -> DataFrame:
    """Slots on shared capital. One run is one group, for its cash is one state; several runs are several groups.

    Signals, spreads and volatilities are columns of every slot's own plan; only
    rows in time order go through the kernel.
    """
    c.check(slots)
    parts = []
    wide: dict[str, str] = {}
    for slot in slots:
        s = replace(c.run, **{}).with_params(**slot.params)
        own = bars.where(F.col("symbol").isin(list(slot.symbols)))
        if "timeframe" in bars.columns:
            own = own.where(F.col("timeframe") == slot.timeframe)
        rows = prepared(own, slot.strategy, replace(s, symbol=slot.symbols[0]))
        w = series("symbol")
        ret = F.log(F.try_divide(F.col("close"), F.lag("close").over(w)))
        rows = rows.withColumn("_r", ret).withColumn("sigma", rolling(F.stddev_samp, F.col("_r"), w, c.vol_lookback) * bars_per_year**0.5).drop("_r")
        wide |= dict(rows.dtypes)
        parts.append(rows.withColumn("slot", F.lit(slot.id)))
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).withColumn("run_id", F.lit(run_id))

    def kernel(t: pa.Table) -> pa.Table:
        data: dict[tuple[str, str], dict] = {}
        for r in t.to_pylist():
            data.setdefault((r["slot"], r["symbol"]), {})[r["ts"]] = r
        machines = {(s.id, sym): find(s.strategy)(replace(c.run, symbol=sym).with_params(**s.params)) for s in slots for sym in s.symbols}
        out = portfolio.simulate(slots, machines, data, c)
        rows = _records(run_id, "", out)
        rows += [dict(run_id=run_id, kind="slot", seq=i, ts=ts, slot=slot, pnl=p) for i, (ts, slot, p) in enumerate(out.slot_pnl)]
        rows += [dict(run_id=run_id, kind="exposure", seq=i, ts=ts, slot=slot, symbol=sym, quantity=q, holdings=n) for i, (ts, slot, sym, q, n) in enumerate(out.exposure)]
        return _table(rows)

    return whole.groupBy("run_id").applyInArrow(kernel, _SQL)
