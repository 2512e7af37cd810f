"""The kernel against hand-computed cases and a plain restatement on random bars."""

from datetime import datetime, timedelta
from random import Random

import pytest

from quantloom.settings import RunSettings, apply_overrides, check_search_space, parse_hhmm
from quantloom.simulation.orders import Bar, Book, Broker, Costs, Order, bar_price
from quantloom.simulation.portfolio import FuturesLedger, PortfolioSettings, Slot, contracts, intent
from quantloom.simulation.portfolio import simulate as simulate_portfolio
from quantloom.simulation.runs import fine_bars
from quantloom.simulation.single import simulate
from quantloom.simulation.strategies import ALIASES, REGISTRY, SmaPullbackConfig, find

T0 = datetime(2025, 1, 1, 9, 30)
OPEN = RunSettings(symbol="X", tick_size=0.25, multiplier=1.0, spread_mode="static", spread_ticks=0, commission_rate=0.0, use_trading_hours=False, eod_close=None)


def bar(o, h, lo, c, i=0, minutes=30):
    return Bar(T0 + timedelta(minutes=minutes * i), o, h, lo, c)


class Script:
    """Orders by bar number."""

    def __init__(self, plan):
        self.plan, self.i = plan, -1

    def reset(self):
        pass

    def step(self, row, position, s):
        self.i += 1
        made = self.plan.get(self.i, [])
        return made(position) if callable(made) else list(made)


def run(bars, plan, s=OPEN, spread=0, fine=None):
    return simulate(bars, None, Script(plan), s, [spread] * len(bars), fine)


def broker(commission=2.5, tick=0.25, mult=50.0):
    return Broker(Costs(tick, mult, commission, share={"LIMIT": 0.0, "STOP_LIMIT": 0.0}))


def test_fills_at_the_next_open():
    bars = [bar(100 + i, 100.5 + i, 99.5 + i, 100 + i, i) for i in range(10)]
    r = run(bars, {1: [Order("BUY", 1)]})
    assert [(f.ts, f.price) for f in r.fills] == [(bars[2].ts, 102)]


def test_cash_identity():
    bars = [bar(100 + i, 101 + i, 99 + i, 100 + i, i) for i in range(10)]
    r = run(bars, {1: [Order("BUY", 2)], 5: [Order("SELL", 2)]}, spread=1)
    for ts, cash, held, total in r.history:
        assert total == pytest.approx(cash + held)
    assert r.history[-1][3] == pytest.approx(OPEN.initial_capital + sum(t.pnl for t in r.trades))


def test_drawdown_halt_liquidates_on_the_next_bar_and_stops():
    bars = [bar(p, p, p, p, i) for i, p in enumerate(range(100, 0, -10))]
    s = RunSettings(**{**OPEN.__dict__, "initial_capital": 1000.0, "max_drawdown_pct": 0.2})
    r = run(bars, {0: [Order("BUY", 9)]}, s)
    assert r.fills[-1].order.reason == "RISK_LIQ" and r.position == 0
    assert len(r.history) < len(bars)
    assert sum(f.order.reason == "RISK_LIQ" for f in r.fills) == 1


def test_session_gate_and_end_of_day():
    bars = [Bar(datetime(2025, 1, 1, 9) + timedelta(minutes=30 * i), 100 + i, 101 + i, 99 + i, 100 + i) for i in range(4)]
    s = RunSettings(**{**OPEN.__dict__, "use_trading_hours": True, "trade_start": "09:00", "trade_end": "10:30", "eod_close": "10:30"})
    r = run(bars, {0: [Order("BUY", 1)]}, s)
    assert [f.order.reason for f in r.fills] == ["SIGNAL", "EOD_CLOSE"] and r.fills[1].price == 103
    fresh = run(bars, {3: [Order("BUY", 1)]}, s)  # placed on the closing bar: never filled
    assert not fresh.fills and not fresh.trades


@pytest.mark.parametrize(
    "o,b,want",
    [
        (Order("BUY", 1, "LIMIT", limit=100), (98, 101, 97, 99), (98, "OPEN")),
        (Order("BUY", 1, "LIMIT", limit=100), (102, 103, 99, 101), (100, "INTRABAR")),
        (Order("SELL", 1, "STOP", stop=95), (90, 92, 88, 91), (90, "OPEN")),
        (Order("SELL", 1, "STOP", stop=95), (97, 98, 94, 96), (95, "INTRABAR")),
        (Order("BUY", 1, "STOP_LIMIT", stop=105, limit=101), (100, 106, 101, 105), (101, "INTRABAR")),
        (Order("BUY", 1, "STOP_LIMIT", stop=105, limit=106), (107, 108, 104, 107), (None, "OPEN")),
        (Order("SELL", 1, "LIMIT", limit=100), (99, 99.5, 98, 99), (None, "OPEN")),
    ],
)
def test_bar_prices(o, b, want):
    assert bar_price(o, Bar(T0, *b)) == want


def test_residues_keep_costs_in_proportion():
    b = broker()
    b.execute(Order("BUY", 4, symbol="X"), Bar(T0, 100, 100, 100, 100), 1, 0)
    for i in (1, 2):
        b.execute(Order("SELL", 2, symbol="X"), Bar(T0 + timedelta(hours=i), 101, 101, 101, 101), 1, 4)
    assert [t.commission for t in b.trades] == [10, 10] and [t.slippage for t in b.trades] == [50, 50]


def test_slippage_is_in_prices_and_not_taken_twice():
    b = broker()
    b.execute(Order("BUY", 1, symbol="X"), Bar(T0, 100, 100, 100, 100), 1, 0)
    b.execute(Order("SELL", 1, symbol="X"), Bar(T0, 101, 101, 101, 101), 1, 1)
    t = b.trades[0]
    assert (t.commission, t.slippage, t.pnl) == (5, 25, 20)


def test_reduce_only_never_opens():
    b = broker()
    o = Order("SELL", 3, symbol="X", reduce_only=True)
    assert b.execute(o, Bar(T0, 1, 1, 1, 1), 0, 0) is None and o.status == "CANCELLED"
    assert b.execute(Order("SELL", 3, symbol="X", reduce_only=True), Bar(T0, 1, 1, 1, 1), 0, 1).quantity == 1


def bracket(entry_limit=None):
    entry = Order("BUY", 1) if entry_limit is None else Order("BUY", 1, "LIMIT", limit=entry_limit)
    return [entry, Order("SELL", 1, "STOP", "SL", stop=95, reduce_only=True), Order("SELL", 1, "LIMIT", "TP", limit=105, reduce_only=True)]


def test_both_exits_on_one_bar_take_the_stop():
    bars = [bar(100, 101, 99, 100, 0), bar(100, 101, 99, 100, 1), bar(100, 106, 94, 100, 2)]
    r = run(bars, {0: bracket()})
    assert [(t.exit_reason, t.exit_price) for t in r.trades] == [("SL", 95)]


def test_finer_bars_decide_if_all_are_there():
    bars = [bar(100, 101, 99, 100, i) for i in range(2)] + [bar(100, 106, 94, 100, 2)]
    s = RunSettings(**{**OPEN.__dict__, "intrabar": "lower_timeframe", "intrabar_timeframe": "5m"})
    parts = [dict(ts=bars[1].ts + timedelta(minutes=5 * (k + 1)), open=100, high=106 if k == 2 else 101, low=94 if k == 4 else 99, close=100) for k in range(6)]
    rows = [dict(ts=b.ts) for b in bars]
    assert run(bars, {0: bracket()}, s, fine=fine_bars(rows, parts, "30m", "5m")).trades[0].exit_reason == "TP"
    assert run(bars, {0: bracket()}, s, fine=fine_bars(rows, parts[:-1], "30m", "5m")).trades[0].exit_reason == "SL"


def test_child_armed_inside_a_bar_may_only_stop_on_it():
    bars = [bar(100, 101, 99, 100, 0), bar(101, 106, 97, 104, 1), bar(104, 104.5, 103.5, 104, 2), bar(104, 106, 103, 105, 3)]
    r = run(bars, {0: bracket(98)})
    assert [(t.exit_reason, t.exit_time) for t in r.trades] == [("TP", bars[3].ts)]
    deep = [bars[0], bar(101, 106, 94, 104, 1)]
    assert run(deep, {0: bracket(98)}).trades[0].exit_reason == "SL"


def test_cancelled_parents_take_their_children():
    book = Book()
    book.submit(bracket(90), T0)
    assert [o.dormant for o in book.orders] == [False, True, True] and book.orders[1].group == book.orders[2].group
    book.cancel(lambda o: not o.reduce_only)
    assert not book.orders


def test_day_orders_expire_and_immediate_ones_end():
    bars = [Bar(datetime(2025, 1, 1 + i, 10), 100, 101, 99, 100) for i in range(4)]
    r = run(bars, {0: [Order("BUY", 1, "LIMIT", limit=50, tif="DAY")], 1: [Order("BUY", 1, "STOP", stop=200, tif="IOC")]})
    assert not r.fills


def test_daily_loss_halts_for_the_day_only():
    bars = [Bar(datetime(2025, 1, 1, 10) + timedelta(hours=h), p, p, p, p) for h, p in ((0, 100), (1, 100), (2, 50), (3, 50), (24, 50), (25, 50))]
    s = RunSettings(**{**OPEN.__dict__, "max_daily_loss": 20.0})
    r = run(bars, {0: [Order("BUY", 1)], 2: [Order("BUY", 1)], 3: [Order("BUY", 1)]}, s)
    assert [f.order.reason for f in r.fills][:2] == ["SIGNAL", "RISK_LIQ"] and r.position == 1


def plain(bars, plan):
    """Market, limit and stop orders without brackets, restated."""
    resting, position, cash, fills = [], 0.0, OPEN.initial_capital, []
    for i, b in enumerate(bars):
        keep = []
        for side, q, kind, price in resting:
            s = 1 if side == "BUY" else -1
            if kind == "MARKET":
                p = b.open
            elif kind == "LIMIT":
                p = b.open if s * (b.open - price) <= 0 else price if (b.low <= price if s > 0 else b.high >= price) else None
            else:
                p = b.open if s * (b.open - price) >= 0 else price if (b.high >= price if s > 0 else b.low <= price) else None
            if p is None:
                keep.append((side, q, kind, price))
            else:
                position += s * q
                cash -= s * q * p
                fills.append((b.ts, side, q, p))
        resting = keep + plan.get(i, [])
    return fills, position, cash


def test_random_orders_match_the_plain_version():
    rnd = Random(5)
    for _ in range(60):
        price, bars = 100.0, []
        for i in range(40):
            o = price + rnd.choice((-2, -1, 0, 1, 2))
            c = o + rnd.randint(-3, 3)
            bars.append(bar(o, max(o, c) + rnd.randint(0, 2), min(o, c) - rnd.randint(0, 2), c, i))
            price = c
        plan = {i: [(rnd.choice(("BUY", "SELL")), float(rnd.randint(1, 3)), rnd.choice(("MARKET", "LIMIT", "STOP")), 100.0 + rnd.randint(-8, 8))] for i in range(0, 40, 3)}
        make = lambda x: [Order(s, q, k, limit=p if k == "LIMIT" else None, stop=p if k == "STOP" else None) for s, q, k, p in x]
        r = run(bars, {i: make(x) for i, x in plan.items()})
        fills, position, cash = plain(bars, plan)
        assert [(f.ts, f.order.side, f.quantity, f.price) for f in r.fills] == fills
        assert r.position == position and r.history[-1][1] == pytest.approx(cash)
        assert sum(t.quantity for t in r.trades) * 2 + abs(position) == sum(f.quantity for f in r.fills)


def test_futures_ledger():
    b = FuturesLedger(100_000)
    b.apply("0", "ES", 4000, 1, 2.5, 50)
    assert b.cash == 99_997.5
    b.apply("0", "ES", 4100, 1, 0, 50)
    assert b.avg["0", "ES"] == 4050
    b.last["0", "ES"] = 4100
    assert b.equity == pytest.approx(99_997.5 + 50 * 100)
    b.apply("0", "ES", 4100, -3, 0, 50)
    assert b.avg["0", "ES"] == 4100 and b.qty["0", "ES"] == -1 and b.cash == 99_997.5 + 5000


def test_intents_and_sizes():
    buy, sell = Order("BUY", 1), Order("SELL", 1)
    assert intent([buy], 0) == (1, "OPEN") and intent([], 2) == (1, "HOLD") and intent([buy], 2) == (1, "HOLD")
    assert intent([sell], 2) == (0, "CLOSE") and intent([sell], 2, turned=-1) == (-1, "REVERSE")
    c = PortfolioSettings(target_vol=0.1, max_expansion=1.0)
    assert contracts(1_000_000, Slot("0", "x", ("ES",), 1.0), c, 0.2, 4000, 50, 0.1) == 2  # 100,000 over 40,000 is 2.5: to the even
    assert contracts(1_000_000, Slot("0", "x", ("ES",), 1.0), c, 0.0, 4000, 50, 0.1) == 0
    with pytest.raises(ValueError):
        c.check([Slot("0", "x", ("ES",), 0.5)])


def test_portfolio_loop_shares_capital():
    slots = [Slot("0", "a", ("A",), 0.5), Slot("1", "b", ("B",), 0.5)]
    c = PortfolioSettings(RunSettings(**{**OPEN.__dict__, "symbol": ""}), target_vol=0.5, max_expansion=1.0)
    rows = lambda step: {T0 + timedelta(minutes=30 * i): dict(ts=T0 + timedelta(minutes=30 * i), open=100 + step * i, high=101 + step * i, low=99 + step * i, close=100 + step * i, sigma=0.5, spread=0) for i in range(6)}
    machines = {("0", "A"): Script({0: [Order("BUY", 1)], 3: [Order("SELL", 1)]}), ("1", "B"): Script({1: [Order("SELL", 1)]})}
    r = simulate_portfolio(slots, machines, {("0", "A"): rows(1), ("1", "B"): rows(-1)}, c)
    assert [(f.order.symbol, f.order.side, f.ts) for f in r.fills] == [("A", "BUY", T0 + timedelta(minutes=30)), ("B", "SELL", T0 + timedelta(minutes=60)), ("A", "SELL", T0 + timedelta(minutes=120))]
    assert r.history[-1][3] == pytest.approx(100_000 + sum(p for ts, _, p in r.slot_pnl if ts == r.history[-1][0]))
    assert [s for s, _ in r.trades] == ["0"]


def test_registry_and_parameters():
    assert len(REGISTRY) == 7 and len(ALIASES) == 5 and find("sma") is REGISTRY["sma_pullback"]
    assert find("quantloom.simulation.strategies.OrderBlock") is REGISTRY["ict_ob"]
    with pytest.raises(KeyError):
        find("nothing")
    with pytest.raises(ValueError):
        apply_overrides(SmaPullbackConfig(), {"smapull_fast": 3}, "smapull")
    for cls in REGISTRY.values():
        check_search_space(cls.space)
        cls(OPEN.with_params(**{k: (v[0]) for k, v in cls.space.items()}))
    assert parse_hhmm("09:05") == 545 and parse_hhmm(" ") is None
    with pytest.raises(ValueError):
        parse_hhmm("25:00")
