"""Schemas of the domain tables and the checks on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BARS = "symbol string, timeframe string, ts timestamp_ntz, open double, high double, low double, close double, volume double, average double, contract string"
ORDERS = (
    "id string, symbol string, quantity double, side string, order_type string, reason string, timestamp timestamp_ntz, limit_price double, stop_price double, "
    "time_in_force string, placed_at timestamp_ntz, status string, reduce_only boolean, oco_group_id string, oco_role string, parent_order_id string"
)
FILLS = "run_id string, seq int, symbol string, side string, order_type string, reason string, quantity double, fill_price double, commission double, slippage double, cost double, ts timestamp_ntz, phase string"
TRADES = (
    "run_id string, slot_id string, strategy string, symbol string, direction string, entry_time timestamp_ntz, exit_time timestamp_ntz, entry_price double, exit_price double, "
    "quantity double, pnl double, gross_pnl double, commission double, slippage double, exit_reason string, entry_signal_time timestamp_ntz"
)
HISTORY = "run_id string, ts timestamp_ntz, cash double, holdings double, total_value double"
SLOT_PNL = "run_id string, ts timestamp_ntz, slot_id string, pnl double"
EXPOSURE = "run_id string, ts timestamp_ntz, slot_id string, symbol string, qty double, notional double"
EPISODES = "start date, trough date, end date, depth_pct double, depth_abs_pct double, duration_days double"
PRICES = ("open", "high", "low", "close")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """df itself; an error names what is missing."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinities of every floating column as null, so that aggregates skip them."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == F.lit(float("inf")))
    return df.withColumns({f.name: F.when(~bad(f.name), F.col(f.name)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))})
