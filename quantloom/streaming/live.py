"""Streams of ticks and bars.

Ticks become bars in event-time windows behind a watermark. Strategies run on
bars as a stateful operator: the state of a symbol is its recent bars and its open
simulation, kept by Spark between batches, so a restart goes on from a checkpoint.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import replace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..settings import RunSettings
from ..simulation.orders import Bar, Book, Broker, Fill, Order, may_fill_now, stop_first
from ..simulation.single import Ledger, RiskState, costs_of, session_test


def distinct_ticks(ticks: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Ticks of one id once, within the watermark; state of older ones is dropped."""
    return ticks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def bars(ticks: DataFrame, freq: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Bars that are final: a window closes once the watermark has passed its end."""
    live = ticks if ticks.isStreaming is False else ticks.withWatermark("ts", delay)
    win = F.window("ts", freq)
    return live.groupBy("symbol", win.alias("w")).agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("size").alias("volume"), F.count("*").alias("n"),
    ).select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "n")


def sessions(ticks: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Runs of ticks without a longer gap: symbol, start, end, ticks and traded size."""
    live = ticks.withWatermark("ts", delay) if ticks.isStreaming else ticks
    return live.groupBy("symbol", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"), F.sum("size").alias("size")).select("symbol", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "size")


class Live:
    """The single loop in steps: what simulate() keeps between bars, so that it can be put away and taken up."""

    def __init__(self, machine: Any, s: RunSettings):
        costs = costs_of(s, s.symbol)
        self.s, self.machine = s, machine
        self.broker, self.book, self.ledger = Broker(costs), Book(), Ledger(s.initial_capital, costs.multiplier)
        self.risk = RiskState(s, day_start=s.initial_capital, peak=s.initial_capital)

    def step(self, row: dict, spread: float) -> list[Fill]:
        s, b = self.s, Bar(row["ts"], row["open"], row["high"], row["low"], row["close"])
        session, before = session_test(s)(b.ts), len(self.broker.fills)

        def fill_on(o: Order) -> Fill | None:
            if not may_fill_now(o, b.ts):
                return None
            f = self.broker.execute(o, b, spread, self.ledger.position)
            if f:
                self.ledger.apply(f)
            return f

        self.ledger.price = b.close
        self.book.expire(b.ts.date(), lambda t: t.date())
        self.book.process(fill_on, lambda o: o.priority or (not self.risk.today and session), lambda o: self.broker.preview(o, b, self.ledger.position) if may_fill_now(o, b.ts) else None, stop_first)
        self.risk.check(b.ts.date(), self.ledger.equity)
        if self.risk.halted:
            self.book.cancel(lambda o: not o.priority)
            q = self.ledger.position
            self.machine.reset()
            if q and not self.book.orders:
                self.book.submit([Order("SELL" if q > 0 else "BUY", abs(q), reason="RISK_LIQ", symbol=s.symbol)], b.ts)
        elif session:
            orders = self.machine.step(row, self.ledger.position, s)
            for o in orders:
                o.symbol = o.symbol or s.symbol
            self.book.submit(orders, b.ts)
        out = self.broker.fills[before:]
        self.broker.fills, self.broker.trades = [], []  # sent on; state stays small
        return out


class Crossing:
    """A strategy that needs no columns: two running means of closes; state is the last closes."""

    def __init__(self, fast: int = 5, slow: int = 20):
        self.fast, self.slow, self.closes, self.up = fast, slow, [], None

    def reset(self) -> None:
        self.up = None

    def step(self, row: dict, position: float, s: RunSettings) -> list[Order]:
        self.closes = (self.closes + [row["close"]])[-self.slow :]
        if len(self.closes) < self.slow:
            return []
        up = sum(self.closes[-self.fast :]) / self.fast > sum(self.closes) / self.slow
        turned, self.up = self.up is not None and up != self.up, up
        if not turned:
            return []
        change = (s.fixed_qty if up else -s.fixed_qty) - position
        return [Order("BUY" if change > 0 else "SELL", abs(change), reason="CROSS")] if change else []


FILL_SCHEMA = "symbol string, ts timestamp, side string, reason string, quantity double, price double, commission double, position double, equity double"


def simulate(bars_: DataFrame, s: RunSettings, machine: Any = None) -> DataFrame:
    """Fills of a strategy on a stream of bars (symbol, ts, prices), each symbol on its own.

    Bars of a batch are taken in order of time; one at or before the last seen is
    late and passed over, as the watermark upstream has closed its window.
    """
    made = pickle.dumps(machine or Crossing())

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = replace(s, symbol=key[0])
        if state.exists:
            live, last = pickle.loads(state.get[0])
        else:
            live, last = Live(pickle.loads(made), own), None
        rows = []
        for r in pd.concat(list(frames)).sort_values("ts").to_dict("records"):
            if last is not None and r["ts"] <= last:
                continue
            last = r["ts"]
            for f in live.step(r, own.spread_ticks):
                rows.append((key[0], f.ts, f.order.side, f.order.reason, f.quantity, f.price, f.commission, live.ledger.position, live.ledger.equity))
        state.update((pickle.dumps((live, last)),))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in FILL_SCHEMA.split(", ")])

    shape = bars_.select("symbol", F.col("ts").cast("timestamp").alias("ts"), "open", "high", "low", "close")
    return shape.groupBy("symbol").applyInPandasWithState(step, FILL_SCHEMA, "state binary", "append", GroupStateTimeout.NoTimeout)
