"""Time-of-day predicates and rebalance gates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import parse_hhmm


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def session_active(ts: Column, start: str | None, end: str | None, enabled: bool = True) -> Column:
    """HH:MM window with both ends in it; one side may be open; a start after the end wraps midnight."""
    a, b = parse_hhmm(start, "start"), parse_hhmm(end, "end")
    if not enabled or (a is None and b is None):
        return F.lit(True)
    # seconds count: 15:00:30 is after a 15:00 end
    now = minute_of_day(ts) * 60 + F.second(ts)
    after = now >= a * 60 if a is not None else F.lit(True)
    before = now <= b * 60 if b is not None else F.lit(True)
    return (after | before) if a is not None and b is not None and a > b else (after & before)


def hour_mask(ts: Column, start: int, end: int, enabled: bool = True) -> Column:
    """Whole hours from start, end not in it; wraps midnight; start = end is the whole day."""
    if not enabled or start == end:
        return F.lit(True)
    h = F.hour(ts)
    return (h >= start) & (h < end) if start < end else (h >= start) | (h < end)


def direction_gate(direction: str, long_ok: Column, short_ok: Column) -> tuple[Column, Column]:
    """Masks a side that the trade direction excludes."""
    d = direction.lower()
    return (long_ok if d in ("both", "long") else F.lit(False)), (short_ok if d in ("both", "short") else F.lit(False))


def rebalance_gate(df: DataFrame, frequency: str, keys: list[str], ts: str = "ts") -> DataFrame:
    """Adds ``rebalance``: every bar, or the first bar of a day or ISO week."""
    if frequency in ("intrabar", "bar"):
        return df.withColumn("rebalance", F.lit(True))
    period = {"daily": F.to_date(ts), "weekly": F.date_trunc("week", ts)}[frequency]
    w = Window.partitionBy(*keys, period).orderBy(ts)
    return df.withColumn("rebalance", F.row_number().over(w) == 1)


def eod_trigger(df: DataFrame, keys: list[str], close: str | None, ts: str = "ts") -> DataFrame:
    """Adds ``eod``: the first bar of each day at or after the closing time."""
    at = parse_hhmm(close, "close")
    if at is None:
        return df.withColumn("eod", F.lit(False))
    past = minute_of_day(F.col(ts)) >= at
    w = Window.partitionBy(*keys, F.to_date(ts), past).orderBy(ts)
    return df.withColumn("eod", past & (F.row_number().over(w) == 1))
