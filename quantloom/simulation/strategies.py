"""Registered strategies: signal columns in Catalyst, and a small state machine for the kernel."""

from __future__ import annotations

from dataclasses import dataclass
from importlib import import_module
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timing import hour_mask
from ..operators import indicators as ind
from ..operators.joins import daily_flag_to_bars
from ..operators.windows import ema, quantile, rolling, series
from ..settings import RunSettings, apply_overrides
from .orders import Order


class Strategy:
    """Signals are columns over all series at once; ``step`` sees one bar's row and the live position."""

    prefix = ""
    config: type = object
    space: dict[str, Any] = {}
    columns: tuple[str, ...] = ()

    def __init__(self, s: RunSettings):
        self.cfg = apply_overrides(self.config(), s.params, self.prefix)
        self.reset()

    @classmethod
    def signals(cls, bars: DataFrame, s: RunSettings) -> DataFrame:
        return cls.plan(bars, apply_overrides(cls.config(), s.params, cls.prefix), s)

    @classmethod
    def plan(cls, bars: DataFrame, c: Any, s: RunSettings) -> DataFrame:
        return bars

    def reset(self) -> None:
        """Forgets the position, after a liquidation."""

    def step(self, row: dict, position: float, s: RunSettings) -> list[Order]:
        raise NotImplementedError

    def allowed(self, long_ok: Any, short_ok: Any) -> tuple[bool, bool]:
        d = self.cfg.trade_direction.lower()
        return bool(long_ok) and d in ("both", "long"), bool(short_ok) and d in ("both", "short")


@dataclass(frozen=True)
class Shock:
    use_shock_filter: bool = True
    shock_atr_window: int = 14
    shock_max_gap_atr: float = 1.0
    shock_max_range_atr: float = 2.5
    shock_max_close_change_atr: float = 1.75


def shock_column(bars: DataFrame, c: Shock) -> DataFrame:
    if not c.use_shock_filter:
        return bars.withColumn("shock_ok", F.lit(True))
    return ind.shocks(bars, c.shock_atr_window, c.shock_max_gap_atr, c.shock_max_range_atr, c.shock_max_close_change_atr).drop("gap_atr", "range_atr", "change_atr")


class Bracketed(Strategy):
    """Market entries with stop and target kept here and checked on closed bars; the stop counts first."""

    def reset(self) -> None:
        self.side: str | None = None
        self.stop = self.target = 0.0

    def leave(self, row: dict, s: RunSettings) -> list[Order] | None:
        """The exit order if a level was touched, [] while in a trade, None when flat."""
        if self.side is None:
            return None
        long = self.side == "LONG"
        stopped = row["low"] <= self.stop if long else row["high"] >= self.stop
        reached = row["high"] >= self.target if long else row["low"] <= self.target
        if not (stopped or reached):
            return []
        self.reset()
        return [Order("SELL" if long else "BUY", s.fixed_qty, reason="STOP_LOSS" if stopped else "TAKE_PROFIT")]

    def enter(self, long: bool, stop: float, target: float, reason: str, s: RunSettings) -> list[Order]:
        self.side, self.stop, self.target = "LONG" if long else "SHORT", stop, target
        return [Order("BUY" if long else "SELL", s.fixed_qty, reason=reason)]


# Names and defaults of the strategy's public parameters.
@dataclass(frozen=True)
class SmaPullbackConfig:
    fast_sma_window: int = 50
    slow_sma_window: int = 200
    atr_window: int = 14
    atr_sl_mult: float = 2.0
    rr_ratio: float = 3.0
    trade_direction: str = "both"


class SmaPullback(Bracketed):
    prefix, config, columns = "smapull", SmaPullbackConfig, ("signal", "atr")
    space = {
        "smapull_fast_sma_window": (20, 80, 10), "smapull_slow_sma_window": (120, 300, 30), "smapull_atr_window": (10, 30, 5),
        "smapull_atr_sl_mult": (1.25, 3.0, 0.25), "smapull_rr_ratio": (1.5, 4.0, 0.5), "smapull_trade_direction": ["both", "long", "short"],
    }

    @classmethod
    def plan(cls, bars, c, s):
        w = series("symbol")
        fast, slow = rolling(F.avg, F.col("close"), w, c.fast_sma_window), rolling(F.avg, F.col("close"), w, c.slow_sma_window)
        touch = (F.col("low") <= fast) & (F.col("high") >= fast)
        side = F.when(touch & (F.col("close") > slow), 1).when(touch & (F.col("close") < slow), -1).otherwise(0)
        return ind.atr(bars, c.atr_window).withColumn("signal", F.coalesce(side, F.lit(0)))

    def step(self, row, position, s):
        if row["atr"] is None:
            return []
        out = self.leave(row, s)
        if out is not None:
            return out
        long, short = self.allowed(row["signal"] > 0, row["signal"] < 0)
        if not (long or short):
            return []
        d, sign = row["atr"] * self.cfg.atr_sl_mult, 1 if long else -1
        return self.enter(long, row["close"] - sign * d, row["close"] + sign * d * self.cfg.rr_ratio, "PULLBACK_LONG" if long else "PULLBACK_SHORT", s)


# Names and defaults of the strategy's public parameters.
@dataclass(frozen=True)
class ChannelConfig(Shock):
    length: int = 50
    ema_period: int = 200
    entry_buffer_ticks: int = 1
    trade_direction: str = "long"
    shock_max_gap_atr: float = 1.25
    shock_max_range_atr: float = 3.0
    shock_max_close_change_atr: float = 2.0


class ChannelBreakout(Strategy):
    prefix, config, columns = "chbrk", ChannelConfig, ("above", "below", "up_stop", "down_stop", "shock_ok")
    space = {
        "chbrk_length": (20, 120, 10), "chbrk_ema_period": (50, 400, 25), "chbrk_entry_buffer_ticks": (1, 4, 1), "chbrk_shock_max_gap_atr": (0.75, 2.0, 0.25),
        "chbrk_shock_max_range_atr": (2.0, 4.0, 0.25), "chbrk_shock_max_close_change_atr": (1.25, 3.0, 0.25),
    }

    @classmethod
    def plan(cls, bars, c, s):
        room = s.instrument(s.symbol)[0] * max(1, c.entry_buffer_ticks)
        rows = ind.range_levels(ema(bars, ["symbol"], F.col("close"), c.ema_period, "_ema"), c.length)
        rows = rows.withColumns({"above": F.col("close") > F.col("_ema"), "below": F.col("close") < F.col("_ema"), "up_stop": F.col("level_high") + room, "down_stop": F.col("level_low") - room})
        return shock_column(rows, c).drop("_ema", "level_high", "level_low")

    def step(self, row, position, s):
        one = lambda side, price, why: [Order(side, s.fixed_qty, "STOP", why, stop=price, tif="IOC")]
        up, down = row["up_stop"], row["down_stop"]
        if position > 0:
            return one("SELL", down, "CHBRK_LONG_EXIT_STOP") if down is not None else []
        if position < 0:
            return one("BUY", up, "CHBRK_SHORT_EXIT_STOP") if up is not None else []
        long, short = self.allowed(up is not None and row["above"] and row["shock_ok"], down is not None and row["below"] and row["shock_ok"])
        return one("BUY", up, "CHBRK_LONG_ENTRY") if long else one("SELL", down, "CHBRK_SHORT_ENTRY") if short else []


# Names and defaults of the strategy's public parameters.
@dataclass(frozen=True)
class ThreeBarConfig(Shock):
    regime_window: int = 50
    extreme_lookback: int = 5
    trade_direction: str = "long"
    entry_atr_window: int = 14
    entry_limit_atr_frac: float = 0.10


class ThreeBarReversion(Strategy):
    prefix, config, columns = "tbar", ThreeBarConfig, ("long_sig", "short_sig", "atr", "last_of_day", "is_last", "shock_ok")
    space = {
        "tbar_regime_window": (30, 120, 10), "tbar_extreme_lookback": (3, 9, 1), "tbar_entry_atr_window": (10, 30, 5), "tbar_entry_limit_atr_frac": (0.05, 0.30, 0.05),
        "tbar_shock_max_gap_atr": (0.75, 1.75, 0.25), "tbar_shock_max_range_atr": (1.75, 3.25, 0.25),
    }

    @classmethod
    def plan(cls, bars, c, s):
        from pyspark.sql import Window

        w, d = series("symbol"), Window.partitionBy("symbol").orderBy("day")
        daily = bars.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.max_by("close", "ts").alias("c"))
        daily = daily.withColumn("bull", F.when(F.count("c").over(d.rowsBetween(-c.regime_window + 1, 0)) >= c.regime_window, F.col("c") > F.avg("c").over(d.rowsBetween(-c.regime_window + 1, 0))))
        rows = daily_flag_to_bars(bars, daily.select("symbol", "day", "bull"), ["symbol"], "bull")
        rows = ind.atr(rows, c.entry_atr_window)
        c1, c2 = F.lag("close").over(w), F.lag("close", 2).over(w)
        low, high = rolling(F.min, F.col("low"), w, c.extreme_lookback), rolling(F.max, F.col("high"), w, c.extreme_lookback)
        falls = (F.col("close") < c1) & (c1 < c2) & (F.col("low") <= low)
        rises = (F.col("close") > c1) & (c1 > c2) & (F.col("high") >= high)
        nxt = F.lead(F.to_date("ts")).over(w)
        rows = rows.withColumns(
            {
                "long_sig": F.coalesce(falls & F.col("bull"), F.lit(False)), "short_sig": F.coalesce(rises & ~F.col("bull"), F.lit(False)),
                "is_last": nxt.isNull(), "last_of_day": nxt.isNull() | (nxt != F.to_date("ts")),
            }
        )
        return shock_column(rows, c).drop("bull")

    def reset(self):
        self.side = self.waiting = self.exit_day = None

    def step(self, row, position, s):
        today = row["ts"].date()
        if self.waiting is not None:
            if position:
                self.side, self.exit_day, self.waiting = ("LONG" if position > 0 else "SHORT"), today, None
            elif today != self.waiting:
                self.reset()
        if self.side is not None:
            if today == self.exit_day and row["last_of_day"]:
                side = "SELL" if self.side == "LONG" else "BUY"
                self.reset()
                return [Order(side, s.fixed_qty, reason="EOD_FLAT")]
            return []
        if self.waiting is not None or row["is_last"] or row["atr"] is None:
            return []
        long, short = self.allowed(row["long_sig"] and row["shock_ok"], row["short_sig"] and row["shock_ok"])
        if not (long or short):
            return []
        self.waiting = today
        away = row["atr"] * self.cfg.entry_limit_atr_frac
        price = row["close"] - away if long else row["close"] + away
        return [Order("BUY" if long else "SELL", s.fixed_qty, "LIMIT", "MR3_LONG" if long else "MR3_SHORT", limit=price, tif="DAY")]


class Breakout(Strategy):
    """Stop entries out of a tight range; one protective bracket once in a trade."""

    tag = ""
    columns = ("long_sig", "short_sig", "long_entry", "short_entry", "long_stop", "short_stop", "long_goal", "short_goal", "shock_ok")

    @classmethod
    def breakout(cls, rows, c, ratio, upper, lower, lookback, q, memory, atr_n, s):
        w = series("symbol")
        room = s.instrument(s.symbol)[0] * max(1, c.entry_buffer_ticks)
        m = min(lookback, max(5, lookback // 2))
        rows = rows.withColumn("_tight", F.coalesce(F.col(ratio) <= rolling(quantile(q), F.col(ratio), w, lookback, m), F.lit(False)))
        recent = F.coalesce(F.max(F.col("_tight").cast("int")).over(w.rowsBetween(-memory, -1)) == 1, F.lit(False))
        wider = F.coalesce(F.col(ratio) > F.lag(ratio).over(w) * c.width_expansion_factor, F.lit(False))
        rows = rows.withColumns({"_recent": recent, "_wider": wider})
        rows = ind.atr(ind.volume_ratio(ind.range_levels(rows, c.breakout_lookback), c.volume_window), atr_n)
        ready = F.col("_recent") & F.col("_wider") & (F.col("volume_ratio") >= c.breakout_volume_ratio)
        move = F.greatest(F.col("level_high") - F.col("level_low"), F.col("atr")) * c.target_rr
        up, down = F.col("level_high") + room, F.col("level_low") - room
        rows = rows.withColumns(
            {
                "long_sig": F.coalesce(ready & (F.col("close") > F.col("level_high")) & (F.col("high") >= F.col(upper)), F.lit(False)),
                "short_sig": F.coalesce(ready & (F.col("close") < F.col("level_low")) & (F.col("low") <= F.col(lower)), F.lit(False)),
                "long_entry": up, "short_entry": down, "long_stop": F.col("level_low") - F.col("atr") * c.stop_atr_buffer, "short_stop": F.col("level_high") + F.col("atr") * c.stop_atr_buffer,
                "long_goal": up + move, "short_goal": down - move,
            }
        )
        return shock_column(rows, c)

    def reset(self):
        self.plan_, self.live, self.sent = None, None, False

    def step(self, row, position, s):
        if position:
            side = "long" if position > 0 else "short"
            if self.live is None or self.live[0] != side:
                levels = self.plan_ if self.plan_ and self.plan_[0] == side else (side, row[f"{side}_stop"], row[f"{side}_goal"])
                self.live, self.plan_, self.sent = levels, None, False
            if self.sent or self.live[1] is None or self.live[2] is None:
                return []
            self.sent = True
            out, name = "SELL" if side == "long" else "BUY", f"{self.tag}_{side.upper()}"
            return [
                Order(out, s.fixed_qty, "STOP", f"{name}_SL", stop=self.live[1], reduce_only=True),
                Order(out, s.fixed_qty, "LIMIT", f"{name}_TP", limit=self.live[2], reduce_only=True),
            ]
        self.reset()
        long, short = self.allowed(row["long_sig"] and row["shock_ok"], row["short_sig"] and row["shock_ok"])
        if long == short:
            return []
        side = "long" if long else "short"
        at, stop, goal = row[f"{side}_entry"], row[f"{side}_stop"], row[f"{side}_goal"]
        if None in (at, stop, goal) or not ((stop < at < goal) if long else (goal < at < stop)):
            return []
        self.plan_ = (side, stop, goal)
        return [Order("BUY" if long else "SELL", s.fixed_qty, "STOP", f"{self.tag}_{side.upper()}_ENTRY", stop=at, tif="IOC")]


# Names and defaults of the strategy's public parameters.
@dataclass(frozen=True)
class SqueezeConfig(Shock):
    bb_window: int = 20
    bb_num_std: float = 2.0
    squeeze_lookback: int = 120
    squeeze_quantile: float = 0.20
    squeeze_memory: int = 5
    width_expansion_factor: float = 1.05
    breakout_lookback: int = 20
    volume_window: int = 20
    breakout_volume_ratio: float = 1.30
    atr_window: int = 14
    stop_atr_buffer: float = 0.50
    target_rr: float = 1.75
    entry_buffer_ticks: int = 1
    trade_direction: str = "short"
    shock_max_gap_atr: float = 1.50
    shock_max_range_atr: float = 3.50
    shock_max_close_change_atr: float = 2.25


class BollingerSqueeze(Breakout):
    prefix, config, tag = "bbsq", SqueezeConfig, "BBSQ"
    space = {"bbsq_bb_window": (14, 30, 2), "bbsq_breakout_lookback": (10, 40, 5), "bbsq_breakout_volume_ratio": (1.10, 2.00, 0.10), "bbsq_target_rr": (1.25, 3.0, 0.25)}

    @classmethod
    def plan(cls, bars, c, s):
        rows = ind.bollinger(bars, c.bb_window, c.bb_num_std)
        return cls.breakout(rows, c, "bb_ratio", "bb_upper", "bb_lower", c.squeeze_lookback, c.squeeze_quantile, c.squeeze_memory, c.atr_window, s)


# Names and defaults of the strategy's public parameters.
@dataclass(frozen=True)
class TighteningConfig(Shock):
    kc_ema_window: int = 20
    kc_atr_window: int = 20
    kc_atr_mult: float = 1.5
    tightening_lookback: int = 100
    tightening_quantile: float = 0.25
    tightening_memory: int = 5
    width_expansion_factor: float = 1.03
    breakout_lookback: int = 20
    volume_window: int = 20
    breakout_volume_ratio: float = 1.25
    risk_atr_window: int = 14
    stop_atr_buffer: float = 0.60
    target_rr: float = 1.60
    entry_buffer_ticks: int = 1
    trade_direction: str = "long"
    shock_max_gap_atr: float = 1.50
    shock_max_range_atr: float = 3.75
    shock_max_close_change_atr: float = 2.25


class KeltnerTightening(Breakout):
    prefix, config, tag = "kctg", TighteningConfig, "KCTG"
    space = {"kctg_kc_ema_window": (14, 30, 2), "kctg_breakout_lookback": (10, 40, 5), "kctg_breakout_volume_ratio": (1.10, 2.00, 0.10), "kctg_target_rr": (1.25, 3.0, 0.25)}

    @classmethod
    def plan(cls, bars, c, s):
        rows = ind.keltner(bars, c.kc_ema_window, c.kc_atr_window, c.kc_atr_mult)
        return cls.breakout(rows, c, "kc_ratio", "kc_upper", "kc_lower", c.tightening_lookback, c.tightening_quantile, c.tightening_memory, c.risk_atr_window, s)


# Names and defaults of the strategy's public parameters.
@dataclass(frozen=True)
class FractalConfig(Shock):
    penetration_ticks: float = 2.0
    atr_length: int = 14
    atr_mult_tp: float = 2.0
    atr_mult_sl: float = 2.0
    ibs_buy_threshold: float = 0.7
    ibs_sell_threshold: float = 0.3
    lookback_bars: int = 10
    start_hour: int = 2
    end_hour: int = 15
    enable_time_filter: bool = True
    trade_direction: str = "both"
    shock_max_range_atr: float = 2.75
    shock_max_close_change_atr: float = 1.8
    use_stretch_filter: bool = True
    stretch_baseline_window: int = 20
    stretch_atr_window: int = 14
    stretch_max_long_atr: float = 2.0
    stretch_max_short_atr: float = 2.0


class FractalPivot(Bracketed):
    prefix, config, columns = "rfp", FractalConfig, ("long_sig", "short_sig", "atr")
    space = {
        "rfp_lookback_bars": (5, 18, 1), "rfp_penetration_ticks": (1.0, 8.0, 1.0), "rfp_atr_mult_tp": (1.5, 4.0, 0.5), "rfp_atr_mult_sl": (1.0, 3.0, 0.25),
        "rfp_ibs_buy_threshold": (0.60, 0.85, 0.05), "rfp_ibs_sell_threshold": (0.15, 0.40, 0.05),
    }

    @classmethod
    def plan(cls, bars, c, s):
        depth = s.instrument(s.symbol)[0] * c.penetration_ticks
        rows = shock_column(ind.atr(ind.fractal_levels(bars, max(3, c.lookback_bars)), c.atr_length), c)
        if c.use_stretch_filter:
            rows = ind.stretch(rows, c.stretch_baseline_window, c.stretch_atr_window, c.stretch_max_long_atr, c.stretch_max_short_atr)
        else:
            rows = rows.withColumns({"long_ok": F.lit(True), "short_ok": F.lit(True)})
        ibs = (F.col("close") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-5))
        lo, hi, inside = F.col("fractal_low"), F.col("fractal_high"), hour_mask(F.col("ts"), c.start_hour, c.end_hour, c.enable_time_filter)
        buy = inside & (F.col("low") < lo) & (F.col("close") > lo) & (F.col("open") > lo) & (ibs > c.ibs_buy_threshold) & (lo - F.col("low") >= depth)
        sell = inside & (F.col("high") > hi) & (F.col("close") < hi) & (F.col("open") < hi) & (ibs < c.ibs_sell_threshold) & (F.col("high") - hi >= depth)
        buy, sell = F.coalesce(buy, F.lit(False)), F.coalesce(sell, F.lit(False))
        return rows.withColumns({"long_sig": buy & ~sell & F.col("shock_ok") & F.col("long_ok"), "short_sig": sell & ~buy & F.col("shock_ok") & F.col("short_ok")})

    def step(self, row, position, s):
        if row["atr"] is None:
            return []
        out = self.leave(row, s)
        if out is not None:
            return out
        long, short = self.allowed(row["long_sig"], row["short_sig"])
        if not (long or short):
            return []
        sign, a = (1 if long else -1), row["atr"]
        return self.enter(long, row["close"] - sign * a * self.cfg.atr_mult_sl, row["close"] + sign * a * self.cfg.atr_mult_tp, "RFP_LONG" if long else "RFP_SHORT", s)


# Names and defaults of the strategy's public parameters.
@dataclass(frozen=True)
class OrderBlockConfig:
    ob_impulse_atr_mult: float = 0.75
    ob_max_age_bars: int = 48
    atr_window: int = 14
    atr_tp_mult: float = 3.0
    min_rr_ratio: float = 3.0
    sl_offset_ticks: int = 2
    trade_direction: str = "both"
    trend_sma_window: int | None = 1000
    use_vol_filter: bool = True
    vol_regime_window: int = 50
    vol_history_window: int = 500
    vol_min_pct: float = 0.20
    vol_max_pct: float = 0.80


class OrderBlock(Bracketed):
    """Retests of a zone left by a sweep and an impulse."""

    prefix, config, columns = "ict", OrderBlockConfig, ("atr", "bull_zone", "bear_zone", "zone_high", "zone_low", "bias", "regime_ok", "n_bar")
    space = {
        "ict_ob_impulse_atr_mult": (0.6, 1.6, 0.2), "ict_ob_max_age_bars": (12, 72, 6), "ict_atr_window": (10, 24, 2), "ict_atr_tp_mult": (2.0, 5.0, 0.5), "ict_min_rr_ratio": (1.5, 4.0, 0.5),
        "ict_sl_offset_ticks": (0, 4, 1),
    }

    @classmethod
    def plan(cls, bars, c, s):
        w = series("symbol")
        rows = ind.atr(bars, c.atr_window)
        h1, l1, h2, l2 = F.lag("high", 2).over(w), F.lag("low", 2).over(w), F.lag("high").over(w), F.lag("low").over(w)
        impulse = F.abs(F.col("close") - F.col("open")) >= F.col("atr") * c.ob_impulse_atr_mult
        bias = F.lit(None).cast("int")
        if c.trend_sma_window:
            mean = rolling(F.avg, F.col("close"), w, c.trend_sma_window)
            bias = F.when(mean.isNotNull(), F.when(F.col("close") > mean, 1).otherwise(-1))
        rows = rows.withColumns(
            {
                "bull_zone": F.coalesce((l2 < l1) & (l2 < F.col("low")) & (F.col("close") > h2) & impulse, F.lit(False)),
                "bear_zone": F.coalesce((h2 > h1) & (h2 > F.col("high")) & (F.col("close") < l2) & impulse, F.lit(False)),
                "zone_high": h2, "zone_low": l2, "bias": bias, "n_bar": F.row_number().over(w) - 1,
            }
        )
        if not c.use_vol_filter:
            return rows.withColumn("regime_ok", F.lit(True))
        return ind.volatility_regime(rows, c.vol_regime_window, c.vol_history_window, c.vol_min_pct, c.vol_max_pct)

    def __init__(self, s):
        self.zone = None
        super().__init__(s)

    def step(self, row, position, s):
        if row["atr"] is None or row["n_bar"] < 3:
            return []
        out = self.leave(row, s)
        if out:
            return out
        for kind in ("bull", "bear"):  # a new zone replaces one of its own kind only
            if row[f"{kind}_zone"] and (self.zone is None or self.zone[0] == kind):
                self.zone = (kind, row["zone_high"], row["zone_low"], row["n_bar"])
        if self.zone and row["n_bar"] - self.zone[3] > self.cfg.ob_max_age_bars:
            self.zone = None
        if self.side is not None or self.zone is None:
            return []
        kind, high, low, _ = self.zone
        bull, close = kind == "bull", row["close"]
        if bull:
            hit = row["low"] <= high and close > row["open"] and close >= low
        else:
            hit = row["high"] >= low and close < row["open"] and close <= high
        if not hit:
            if (bull and close < low) or (not bull and close > high):
                self.zone = None
            return []
        long, short = self.allowed(bull, not bull)
        if not (long or short) or not row["regime_ok"] or (row["bias"] is not None and (row["bias"] > 0) != bull):
            return []
        sign, room = (1 if bull else -1), self.cfg.sl_offset_ticks * s.instrument(s.symbol)[0]
        stop = (low if bull else high) - sign * room
        risk = (close - stop) * sign
        if risk <= 0:
            return []
        self.zone = None
        return self.enter(bull, stop, close + sign * max(row["atr"] * self.cfg.atr_tp_mult, risk * self.cfg.min_rr_ratio), "OB_LONG" if bull else "OB_SHORT", s)


REGISTRY: dict[str, type[Strategy]] = {
    "sma_pullback": SmaPullback, "channel_breakout": ChannelBreakout, "three_bar_mr": ThreeBarReversion, "bollinger_squeeze_breakout": BollingerSqueeze,
    "keltner_tightening_breakout": KeltnerTightening, "rfp_fractal": FractalPivot, "ict_ob": OrderBlock,
}
ALIASES = {"sma": "sma_pullback", "channel": "channel_breakout", "three_bar": "three_bar_mr", "rfp": "rfp_fractal", "ict": "ict_ob"}


def find(name: str) -> type[Strategy]:
    """A registered id, an alias, or a dotted path to a class."""
    key = name.strip().lower()
    if (k := ALIASES.get(key, key)) in REGISTRY:
        return REGISTRY[k]
    if "." in name:
        module, _, cls = name.rpartition(".")
        return getattr(import_module(module), cls)
    raise KeyError(f"unknown strategy {name!r}; known: {', '.join(sorted(REGISTRY))}")
