"""Run settings, cost profile and instrument data, as plain immutable values."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, fields, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIMEFRAMES = ("1m", "5m", "30m", "1h")
MINUTES = {"1m": 1, "5m": 5, "30m": 30, "1h": 60}

# Contract data (symbol, tick size, money per point) that results depend on.
INSTRUMENTS = {
    "ES": (0.25, 50.0), "NQ": (0.25, 20.0), "CL": (0.01, 1000.0), "GC": (0.10, 100.0), "SI": (0.005, 5000.0), "NG": (0.001, 10000.0),
    "PL": (0.10, 50.0), "YM": (1.0, 5.0), "RTY": (0.10, 50.0), "ZC": (0.25, 50.0), "ZB": (0.03125, 1000.0), "6A": (0.00005, 100000.0),
    "6B": (0.0001, 62500.0), "6C": (0.00005, 100000.0), "6E": (0.00005, 125000.0), "6J": (0.0000005, 12500000.0), "6S": (0.00005, 125000.0),
}
UNKNOWN_INSTRUMENT = (0.01, 1.0)
ORDER_TYPES = ("MARKET", "LIMIT", "STOP", "STOP_LIMIT")
SPREAD_SHARE = {"MARKET": 1.0, "STOP": 1.0, "LIMIT": 0.0, "STOP_LIMIT": 0.0}


# The names and defaults of a run's public settings.
@dataclass(frozen=True)
class RunSettings:
    symbol: str = "ES"
    timeframe: str = "30m"
    bar_type: str = "time"
    bar_size: float = 0.0
    initial_capital: float = 100_000.0
    risk_free_rate: float = 0.02
    commission_rate: float = 2.5
    fixed_qty: float = 1.0
    margin_ratio: float = 0.10
    spread_mode: str = "adaptive_volatility"
    spread_ticks: int = 1
    spread_step: float = 0.10
    spread_step_multiplier: float = 1.5
    spread_lookback: int = 20
    spread_baseline: int = 100
    spread_share: dict[str, float] = field(default_factory=dict)
    commission_by_type: dict[str, float] = field(default_factory=dict)
    intrabar: str = "pessimistic"
    intrabar_timeframe: str | None = None
    use_trading_hours: bool = True
    trade_start: str | None = "06:00"
    trade_end: str | None = "15:00"
    eod_close: str | None = "15:30"
    max_daily_loss: float | None = None
    max_drawdown_pct: float | None = None
    account_floor: float | None = None
    tick_size: float | None = None
    multiplier: float | None = None
    params: dict[str, Any] = field(default_factory=dict)

    def with_params(self, **params: Any) -> "RunSettings":
        return replace(self, params=self.params | params)

    def instrument(self, symbol: str) -> tuple[float, float]:
        tick, mult = INSTRUMENTS.get(symbol, UNKNOWN_INSTRUMENT)
        return self.tick_size or tick, self.multiplier or mult

    @classmethod
    def from_env(cls, prefix: str = "QUANTLOOM_", **over: Any) -> "RunSettings":
        """Environment variables named after fields, then what is passed."""
        found: dict[str, Any] = {}
        for f in fields(cls):
            raw = os.environ.get(prefix + f.name.upper())
            if raw is not None:
                kind = type(f.default) if f.default is not None and not callable(f.default) else str
                found[f.name] = raw.lower() in ("1", "true", "yes") if kind is bool else None if raw == "" else kind(raw)
        return cls(**(found | over))


def instruments(spark: SparkSession, margin_ratio: float = 0.10) -> DataFrame:
    """The contract dimension: symbol, tick_size, multiplier, margin_ratio."""
    rows = [(s, t, m, margin_ratio) for s, (t, m) in INSTRUMENTS.items()]
    return spark.createDataFrame(rows, "symbol string, tick_size double, multiplier double, margin_ratio double")


def with_instruments(df: DataFrame, margin_ratio: float = 0.10) -> DataFrame:
    """Contract data beside each row by symbol, defaults where a symbol is unknown. The dimension has a fixed size."""
    dim = F.broadcast(instruments(df.sparkSession, margin_ratio))
    out = df.join(dim, "symbol", "left")
    defaults = {"tick_size": UNKNOWN_INSTRUMENT[0], "multiplier": UNKNOWN_INSTRUMENT[1], "margin_ratio": margin_ratio}
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def parse_hhmm(value: str | None, name: str = "time") -> int | None:
    """Minutes since midnight of HH:MM; None for blank."""
    if value is None or not value.strip():
        return None
    m = re.fullmatch(r"(\d{1,2}):(\d{2})", value.strip())
    if not m or int(m[1]) > 23 or int(m[2]) > 59:
        raise ValueError(f"{name} must be HH:MM, not {value!r}")
    return int(m[1]) * 60 + int(m[2])


FORBIDDEN = ("date", "time", "year", "month", "day", "symbol")


def check_search_space(space: dict[str, Any], most: int = 6) -> None:
    """Rejects search spaces with too many parameters or ones that fit the calendar."""
    if len(space) > most:
        raise ValueError(f"{len(space)} parameters; {most} at most")
    if bad := [k for k in space if any(f == part for f in FORBIDDEN for part in k.lower().split("_"))]:
        raise ValueError(f"parameters that may not be searched: {bad}")


def apply_overrides(config: Any, params: dict[str, Any], prefix: str) -> Any:
    """config with fields named {prefix}_{field} in params replaced. Unknown names with the prefix are errors."""
    own = {k[len(prefix) + 1 :]: v for k, v in params.items() if k.startswith(prefix + "_")}
    known = {f.name for f in fields(config)}
    if unknown := sorted(set(own) - known):
        raise ValueError(f"unknown parameters for {prefix}: {unknown}")
    return replace(config, **own)
