"""One strategy on one series: the bar loop."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from ..settings import SPREAD_SHARE, RunSettings, parse_hhmm
from .orders import Bar, Book, Broker, Costs, Fill, Order, may_fill_now, replay_winner, stop_first


def costs_of(s: RunSettings, symbol: str) -> Costs:
    tick, mult = s.instrument(symbol)
    return Costs(tick, mult, s.commission_rate, s.commission_by_type, SPREAD_SHARE | s.spread_share)


def session_test(s: RunSettings) -> Callable[[Any], bool]:
    a, b = parse_hhmm(s.trade_start, "trade_start"), parse_hhmm(s.trade_end, "trade_end")
    if not s.use_trading_hours or (a is None and b is None):
        return lambda ts: True

    def inside(ts: Any) -> bool:
        now = ts.hour * 60 + ts.minute + ts.second / 60
        after, before = a is None or now >= a, b is None or now <= b
        return (after or before) if a is not None and b is not None and a > b else (after and before)

    return inside


@dataclass
class RiskState:
    """Daily loss, drawdown and floor limits. A breach of the last two halts for good."""

    settings: RunSettings
    day: Any = None
    day_start: float = 0.0
    peak: float = 0.0
    today: bool = False
    for_good: bool = False

    def check(self, date: Any, equity: float) -> None:
        if self.for_good:
            return
        s = self.settings
        if self.day != date:
            self.day, self.day_start, self.today = date, equity, False
        if s.max_daily_loss is not None and equity - self.day_start < -s.max_daily_loss:
            self.today = True
        if s.max_drawdown_pct is not None and self.peak > 0 and (self.peak - equity) / self.peak > s.max_drawdown_pct:
            self.for_good = True
        if s.account_floor is not None and equity <= s.account_floor:
            self.for_good = True
        self.peak = max(self.peak, equity)

    @property
    def halted(self) -> bool:
        return self.today or self.for_good


class Ledger:
    """Cash accounting: a buy pays its whole value."""

    def __init__(self, cash: float, multiplier: float):
        self.cash, self.multiplier, self.position, self.price = cash, multiplier, 0.0, 0.0

    def apply(self, f: Fill) -> None:
        self.cash -= f.cost * self.multiplier + f.commission
        self.position += f.quantity * f.order.sign

    @property
    def holdings(self) -> float:
        return self.position * self.price * self.multiplier

    @property
    def equity(self) -> float:
        return self.cash + self.holdings


@dataclass
class Run:
    fills: list
    trades: list
    history: list[tuple]  # ts, cash, holdings, equity
    position: float


def simulate(
    bars: Sequence[Bar], rows: Sequence[dict] | None, machine: Any, s: RunSettings, spreads: Sequence[float], fine: dict[Any, list[Bar]] | None = None,
    report: Callable[[int, float], bool] | None = None,
) -> Run:
    """Bar by bar: expire, fill, mark, limits, strategy, end of day, snapshot.

    ``rows``: what the strategy sees of each bar (bars and signal columns).
    ``spreads``: ticks of each bar, from closes before it. ``fine``: complete finer
    bars of a coarse bar's time; where there are none, stops go first. ``report``
    may stop the run by returning True. Orders of a bar fill on later bars only.
    """
    costs = costs_of(s, s.symbol)
    broker, book, ledger = Broker(costs), Book(), Ledger(s.initial_capital, costs.multiplier)
    risk = RiskState(s, day_start=s.initial_capital, peak=s.initial_capital)
    active, eod_at = session_test(s), parse_hhmm(s.eod_close, "eod_close")
    closed_days: set = set()
    history: list[tuple] = []
    for i, b in enumerate(bars):
        if risk.for_good and not book.orders:
            break
        ts, today, spread, session = b.ts, b.ts.date(), spreads[i], active(b.ts)

        def fill_on(o: Order, at_close: bool = False, bar: Bar = b) -> Fill | None:
            f = broker.execute(o, bar, spread, ledger.position, at_close)
            if f:
                ledger.apply(f)
            return f

        def winner(orders: list[Order], bar: Bar = b) -> Order:
            if s.intrabar == "lower_timeframe" and fine and (parts := fine.get(bar.ts)):
                if (o := replay_winner(orders, parts, bar.ts, lambda _: ledger.position, broker)) is not None:
                    return o
            return stop_first(orders)

        ledger.price = b.close
        book.expire(today, lambda t: t.date())
        book.process(
            lambda o: fill_on(o) if may_fill_now(o, ts) else None,
            lambda o: o.priority or (not risk.today and session),
            lambda o: broker.preview(o, b, ledger.position) if may_fill_now(o, ts) else None,
            winner,
        )
        risk.check(today, ledger.equity)
        if report is not None and report(i, ledger.equity):
            break

        def flatten(reason: str) -> list[Order]:
            machine.reset()
            q = ledger.position
            return [Order("SELL" if q > 0 else "BUY", abs(q), reason=reason, symbol=s.symbol)] if q else []

        if risk.halted:
            book.cancel(lambda o: not o.priority)
            if not any(o.priority for o in book.orders):
                book.submit(flatten("RISK_LIQ"), ts)
            history.append((ts, ledger.cash, ledger.holdings, ledger.equity))
            continue
        if session:
            orders = machine.step(rows[i] if rows is not None else b, ledger.position, s)
            for o in orders:
                o.symbol = o.symbol or s.symbol
            book.submit(orders, ts)
        if eod_at is not None and today not in closed_days and ts.hour * 60 + ts.minute >= eod_at:
            # orders of this bar may not fill on it; older market orders fill at the close, others end
            book.cancel(lambda o: o.placed == ts)
            for o in book.take(lambda o: o.kind == "MARKET"):
                fill_on(o, at_close=True)
            book.cancel(lambda o: True)
            for o in flatten("EOD_CLOSE"):
                o.signal_ts = o.placed = ts
                fill_on(o, at_close=True)
            closed_days.add(today)
        history.append((ts, ledger.cash, ledger.holdings, ledger.equity))
    return Run(broker.fills, broker.trades, history, ledger.position)
