"""Orders, fills, round trips and the book of resting orders."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import count

DONE = ("FILLED", "CANCELLED", "REJECTED")


@dataclass(slots=True)
class Order:
    side: str
    quantity: float
    kind: str = "MARKET"
    reason: str = "SIGNAL"
    limit: float | None = None
    stop: float | None = None
    tif: str = "GTC"
    reduce_only: bool = False
    symbol: str = ""
    slot: str = ""
    id: int = -1
    signal_ts: object = None
    placed: object = None
    status: str = "NEW"
    group: int | None = None
    role: str | None = None
    parent: int | None = None
    dormant: bool = False
    armed_at: object = None
    armed_phase: str | None = None

    @property
    def sign(self) -> int:
        return 1 if self.side == "BUY" else -1

    @property
    def protective(self) -> bool:
        return self.reduce_only and self.kind != "MARKET"

    @property
    def priority(self) -> bool:
        """Risk and end-of-day orders pass session and halt gates."""
        return "RISK" in self.reason or self.reason == "EOD_CLOSE"


@dataclass(slots=True)
class Bar:
    ts: object
    open: float
    high: float
    low: float
    close: float


@dataclass(slots=True)
class Fill:
    order: Order
    quantity: float
    price: float
    commission: float
    slip: float  # price units per contract
    ts: object
    phase: str

    @property
    def cost(self) -> float:
        return self.price * self.quantity * self.order.sign


@dataclass(slots=True)
class Trade:
    symbol: str
    direction: str
    entry_time: object
    exit_time: object
    entry_price: float
    exit_price: float
    quantity: float
    pnl: float
    commission: float
    slippage: float
    exit_reason: str
    signal_ts: object


def valid(o: Order) -> bool:
    if o.quantity <= 0 or o.side not in ("BUY", "SELL"):
        return False
    return {"MARKET": True, "LIMIT": o.limit is not None, "STOP": o.stop is not None, "STOP_LIMIT": o.limit is not None and o.stop is not None}.get(o.kind, False)


def bar_price(o: Order, b: Bar, at_close: bool = False) -> tuple[float | None, str]:
    """Price and phase on a bar before costs; None: no fill. Mirrors the column rules in operators/fills.py."""
    if o.kind == "MARKET":
        return (b.close, "CLOSE") if at_close else (b.open, "OPEN")
    if at_close:
        return None, "CLOSE"
    buy = o.side == "BUY"
    if o.kind == "LIMIT":
        if (b.open <= o.limit) if buy else (b.open >= o.limit):
            return b.open, "OPEN"
        if (b.low <= o.limit) if buy else (b.high >= o.limit):
            return o.limit, "INTRABAR"
        return None, "OPEN"
    opened = (b.open >= o.stop) if buy else (b.open <= o.stop)
    touched = (b.high >= o.stop) if buy else (b.low <= o.stop)
    if o.kind == "STOP":
        return (b.open, "OPEN") if opened else (o.stop, "INTRABAR") if touched else (None, "OPEN")
    if opened:
        return (b.open, "OPEN") if ((b.open <= o.limit) if buy else (b.open >= o.limit)) else (None, "OPEN")
    if touched and ((b.low <= o.limit) if buy else (b.high >= o.limit)):
        return o.limit, "INTRABAR"
    return None, "OPEN"


@dataclass
class Costs:
    """Tick size, money per point, spread share and commission by order type."""

    tick: float
    multiplier: float
    commission: float
    by_type: dict[str, float] = field(default_factory=dict)
    share: dict[str, float] = field(default_factory=dict)

    def rate(self, kind: str) -> float:
        return self.by_type.get(kind, self.commission)

    def ticks(self, kind: str, spread: float) -> int:
        return max(0, round(spread * self.share.get(kind, 1.0)))


class Broker:
    """Turns orders into fills on bars and fills into round trips, first in first out."""

    def __init__(self, costs: Costs):
        self.costs = costs
        self.fills: list[Fill] = []
        self.trades: list[Trade] = []
        self.open: dict[tuple[str, str], list[list]] = {}  # of (fill, quantity left)

    def executable(self, o: Order, position: float) -> float:
        if not o.reduce_only:
            return o.quantity
        return min(o.quantity, max(0.0, -position * o.sign))

    def preview(self, o: Order, b: Bar, position: float) -> float | None:
        if not valid(o) or self.executable(o, position) <= 0:
            return None
        return bar_price(o, b)[0]

    def execute(self, o: Order, b: Bar, spread: float, position: float, at_close: bool = False) -> Fill | None:
        if not valid(o):
            o.status = "REJECTED"
            return None
        quantity = self.executable(o, position)
        if quantity <= 0:
            o.status = "CANCELLED" if o.reduce_only else "REJECTED"
            return None
        o.quantity = quantity
        price, phase = bar_price(o, b, at_close)
        if price is None:
            if o.tif == "IOC":
                o.status = "CANCELLED"
            return None
        slip = self.costs.ticks(o.kind, spread) * self.costs.tick
        o.status = "FILLED"
        fill = Fill(o, quantity, price + slip * o.sign, quantity * self.costs.rate(o.kind), slip, b.ts, phase)
        self.fills.append(fill)
        self._match(fill)
        return fill

    def _match(self, f: Fill) -> None:
        lots = self.open.setdefault((f.order.slot, f.order.symbol), [])
        left, m = f.quantity, self.costs.multiplier
        while left > 1e-12 and lots and lots[0][0].order.sign != f.order.sign:
            entry, have = lots[0]
            q = min(left, have)
            move = (f.price - entry.price) * entry.order.sign * q * m
            commission = (entry.commission / entry.quantity + f.commission / f.quantity) * q
            self.trades.append(
                Trade(
                    f.order.symbol, "LONG" if entry.order.sign > 0 else "SHORT", entry.ts, f.ts, entry.price, f.price, q, move - commission, commission,
                    (abs(entry.slip) + abs(f.slip)) * m * q, f.order.reason, entry.order.signal_ts,
                )
            )
            left -= q
            if have - q > 1e-12:
                lots[0][1] = have - q
            else:
                lots.pop(0)
        if left > 1e-12:
            lots.append([f, left])


def role_of(kind: str) -> str:
    return "STOP" if kind in ("STOP", "STOP_LIMIT") else "TARGET"


class Book:
    """Resting orders in order of arrival, with brackets, one-cancels-other groups and dormant children."""

    def __init__(self) -> None:
        self.orders: list[Order] = []
        self._ids = count()

    def submit(self, orders: list[Order], ts: object) -> None:
        """Places a batch. One entry with opposite protective orders is their parent; two or more protective orders are one group."""
        for o in orders:
            o.id = next(self._ids)
            o.signal_ts = ts if o.signal_ts is None else o.signal_ts
            o.placed = ts if o.placed is None else o.placed
            o.status = "SUBMITTED" if o.status == "NEW" else o.status
        guards = [o for o in orders if o.protective]
        entries = [o for o in orders if not o.reduce_only]
        if len(guards) >= 2:
            group = next((o.group for o in guards if o.group is not None), guards[0].id)
            for o in guards:
                o.group = group if o.group is None else o.group
        for o in orders:
            if o.reduce_only and o.role is None:
                o.role = role_of(o.kind)
        if len(entries) == 1 and guards and all(g.side != entries[0].side for g in guards):
            for g in guards:
                if g.parent is None:
                    g.parent, g.dormant = entries[0].id, True
        self.orders += orders

    def cancel(self, which: Callable[[Order], bool]) -> None:
        gone = {o.id for o in self.orders if which(o)}
        while more := {o.id for o in self.orders if o.parent in gone} - gone:
            gone |= more
        for o in self.orders:
            if o.id in gone:
                o.status = "CANCELLED"
        self.orders = [o for o in self.orders if o.id not in gone]

    def take(self, which: Callable[[Order], bool]) -> list[Order]:
        out = [o for o in self.orders if which(o)]
        self.orders = [o for o in self.orders if not which(o)]
        return out

    def expire(self, today: object, date_of: Callable[[object], object]) -> None:
        self.cancel(lambda o: o.tif == "DAY" and o.placed is not None and date_of(o.placed) < today)

    def _children(self, o: Order, fill: Fill | None) -> None:
        for c in self.orders:
            if c.parent == o.id and c.status not in DONE:
                if fill is None:
                    c.status = "CANCELLED"
                else:
                    c.quantity, c.dormant, c.armed_at, c.armed_phase = fill.quantity, False, fill.ts, fill.phase

    def _try(self, o: Order, attempt: Callable[[Order], Fill | None]) -> Fill | None:
        fill = attempt(o)
        if fill is not None:
            self._children(o, fill)
        elif o.status in ("CANCELLED", "REJECTED"):
            self._children(o, None)
        return fill

    def process(self, attempt: Callable, may: Callable[[Order], bool], preview: Callable, winner: Callable[[list[Order]], Order]) -> list[Fill]:
        """Passes over the book until a pass fills nothing; children armed by a fill take part in the next pass."""
        fills: list[Fill] = []
        moved = True
        while moved:
            moved, seen = False, set()
            alive = {o.id for o in self.orders if o.status not in DONE}
            for o in list(self.orders):
                key = ("g", o.group) if o.group is not None else ("o", o.id)
                if key in seen:
                    continue
                seen.add(key)
                members = [x for x in self.orders if x.status not in DONE and ((x.group == o.group) if o.group is not None else x.id == o.id)]
                ready = []
                for x in members:
                    if x.dormant and x.parent not in alive:
                        x.status = "CANCELLED"
                    elif not x.dormant and may(x):
                        ready.append(x)
                if not ready:
                    continue
                if len(ready) == 1:
                    if (f := self._try(ready[0], attempt)) is not None:
                        fills.append(f)
                        moved = True
                        for s in members if o.group is not None else ():
                            if s.id != ready[0].id and s.status not in DONE:
                                s.status = "CANCELLED"
                                self._children(s, None)
                    continue
                hit = [x for x in ready if preview(x) is not None]
                if not hit:
                    continue
                best = winner(hit)
                if (f := self._try(best, attempt)) is not None:
                    fills.append(f)
                    moved = True
                    for s in members:
                        if s.id != best.id and s.status not in DONE:
                            s.status = "CANCELLED"
                            self._children(s, None)
            self.orders = [o for o in self.orders if o.status not in DONE]
        return fills


def stop_first(orders: list[Order]) -> Order:
    """The pessimistic choice where a bar proves more than one fill."""
    return min(orders, key=lambda o: ((o.role or role_of(o.kind)) != "STOP", o.id))


def may_fill_now(o: Order, ts: object) -> bool:
    """A child armed inside this bar may only be a stop on it."""
    return o.parent is None or o.armed_at != ts or o.armed_phase != "INTRABAR" or (o.role or role_of(o.kind)) == "STOP"


def replay_winner(orders: list[Order], fine: list[Bar], ts: object, position: Callable[[Order], float], broker: Broker) -> Order | None:
    """The order that fills first on finer bars; None where no bar, or two on one bar, decide nothing (then stops go first on that bar)."""
    for b in fine:
        hit = [o for o in orders if may_fill_now(o, ts) and broker.preview(o, b, position(o)) is not None]
        if hit:
            return stop_first(hit)
    return None
