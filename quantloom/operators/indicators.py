"""Indicators and trade filters: functions that add columns to bars (symbol, ts, open, high, low, close, volume).

A filter adds a boolean column; where its history is too short it allows, unless
said otherwise.
"""

from __future__ import annotations

from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.stats import norm_cdf
from .carry import CHUNK
from .frames import order_statistics, overlapped
from .windows import ema, in_utc, rolling, rolling2, series, widened

KEYS = ["symbol"]


def true_range(w, high: str = "high", low: str = "low", close: str = "close") -> Column:
    before = F.lag(close).over(w)
    return F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - before), F.abs(F.col(low) - before))


def atr(bars: DataFrame, span: int, name: str = "atr", keys: list[str] = KEYS) -> DataFrame:
    """Average true range: exponential with alpha = 2 / (span + 1)."""
    rows = bars.withColumn("_tr", true_range(series(*keys)))
    return ema(rows, keys, F.col("_tr"), span, name).drop("_tr")


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0, x: str = "close", keys: list[str] = KEYS) -> DataFrame:
    """Adds bb_mid, bb_upper, bb_lower, bb_width and bb_ratio (width over the mid, at least 1e-9)."""
    rows = overlapped(bars, keys, n, lambda rows, w: rows.withColumns({"bb_mid": rolling(F.avg, F.col(x), w, n), "_sd": rolling(F.stddev_samp, F.col(x), w, n)}))
    rows = rows.withColumns({"bb_upper": F.col("bb_mid") + k * F.col("_sd"), "bb_lower": F.col("bb_mid") - k * F.col("_sd")})
    rows = rows.withColumn("bb_width", F.col("bb_upper") - F.col("bb_lower"))
    return rows.withColumn("bb_ratio", F.col("bb_width") / F.greatest(F.abs("bb_mid"), F.lit(1e-9))).drop("_sd")


def keltner(bars: DataFrame, n: int = 20, atr_n: int = 14, m: float = 1.5, keys: list[str] = KEYS) -> DataFrame:
    """Adds kc_mid (exponential), kc_upper, kc_lower, kc_width and kc_ratio."""
    rows = atr(ema(bars, keys, F.col("close"), n, "kc_mid"), atr_n, "_atr", keys)
    rows = rows.withColumns({"kc_upper": F.col("kc_mid") + m * F.col("_atr"), "kc_lower": F.col("kc_mid") - m * F.col("_atr")})
    rows = rows.withColumn("kc_width", F.col("kc_upper") - F.col("kc_lower"))
    return rows.withColumn("kc_ratio", F.col("kc_width") / F.greatest(F.abs("kc_mid"), F.lit(1e-9))).drop("_atr")


def range_levels(bars: DataFrame, n: int, shift: int = 1, keys: list[str] = KEYS) -> DataFrame:
    """Adds level_high and level_low: extremes of the n bars that end ``shift`` bars ago."""

    def add(rows: DataFrame, w: WindowSpec) -> DataFrame:
        return rows.withColumns({"level_high": rolling(F.max, F.col("high"), w, n, shift=shift), "level_low": rolling(F.min, F.col("low"), w, n, shift=shift)})

    return overlapped(bars, keys, n + shift, add)


def volume_ratio(bars: DataFrame, n: int, keys: list[str] = KEYS) -> DataFrame:
    return overlapped(bars, keys, n, lambda rows, w: rows.withColumn("volume_ratio", F.col("volume") / F.nullif(rolling(F.avg, F.col("volume"), w, n), F.lit(0.0))))


def poc_proxy(bars: DataFrame, n: int, keys: list[str] = KEYS) -> DataFrame:
    """Adds poc: closes weighted by volume over n bars."""

    def add(rows: DataFrame, w: WindowSpec) -> DataFrame:
        total = rolling(F.sum, F.col("volume"), w, n)
        return rows.withColumn("poc", rolling(F.sum, F.col("close") * F.col("volume"), w, n) / F.nullif(total, F.lit(0.0)))

    return overlapped(bars, keys, n, add)


def structure(bars: DataFrame, n: int, keys: list[str] = KEYS) -> DataFrame:
    """Adds higher_lows and lower_highs: the extreme of the last half window against the half before."""
    half = max(1, n // 2)

    def add(rows: DataFrame, w: WindowSpec) -> DataFrame:
        rows = rows.withColumns({"_l": rolling(F.min, F.col("low"), w, half), "_h": rolling(F.max, F.col("high"), w, half)})
        masks = {"higher_lows": F.col("_l") > F.lag("_l", half).over(w), "lower_highs": F.col("_h") < F.lag("_h", half).over(w)}
        return rows.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in masks.items()}).drop("_l", "_h")

    return overlapped(bars, keys, 2 * half, add)


def candles(bars: DataFrame) -> DataFrame:
    """Adds body_share, upper_share and lower_share of the bar's range; 0 where the range is 0."""
    span = F.col("high") - F.col("low")
    share = lambda x: F.when(span > 0, F.try_divide(x, span)).otherwise(0.0)
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    return bars.withColumns({"body_share": share(F.abs(F.col("close") - F.col("open"))), "upper_share": share(F.col("high") - top), "lower_share": share(bottom - F.col("low"))})


def volatility_regime(bars: DataFrame, n: int = 50, history: int = 500, low: float = 0.2, high: float = 0.8, keys: list[str] = KEYS) -> DataFrame:
    """Adds vol_pct (rank of the bar before's volatility within its history) and regime_ok."""
    rows = volatility_rank(bars, n, history, "vol_pct", 1, keys)
    return rows.withColumn("regime_ok", F.coalesce(F.col("vol_pct").between(low, high), F.lit(True)))


def volatility_rank(bars: DataFrame, n: int, history: int, name: str, ago: int = 0, keys: list[str] = KEYS) -> DataFrame:
    """Adds the rank, within its history, of the deviation of the n closes that end ``ago`` bars ago."""

    def add(rows: DataFrame, w: WindowSpec) -> DataFrame:
        rows = rows.withColumn("_sd", rolling(F.stddev_samp, F.col("close"), w, n, n // 2))
        rows = order_statistics(rows, [*keys, CHUNK], "_sd", history, history // 2, rank="_pct")
        return rows.withColumn(name, F.lag("_pct", ago).over(w) if ago else F.col("_pct")).drop("_sd", "_pct")

    return overlapped(bars, keys, n + history + ago, add)


def shocks(bars: DataFrame, atr_n: int = 14, gap: float = 1.0, spread: float = 2.5, change: float = 1.75, keys: list[str] = KEYS) -> DataFrame:
    """Adds gap_atr, range_atr, change_atr (in units of the ATR before) and shock_ok."""
    w = series(*keys)
    rows = atr(bars, atr_n, "_atr", keys)
    ref, before = F.lag("_atr").over(w), F.lag("close").over(w)
    rows = rows.withColumns(
        {"gap_atr": F.try_divide(F.abs(F.col("open") - before), ref), "range_atr": F.try_divide(F.abs(F.col("high") - F.col("low")), ref), "change_atr": F.try_divide(F.abs(F.col("close") - before), ref)}
    )
    ok = (F.col("gap_atr") <= gap) & (F.col("range_atr") <= spread) & (F.col("change_atr") <= change)
    return rows.withColumn("shock_ok", F.coalesce(ok, F.lit(True))).drop("_atr")


def stretch(bars: DataFrame, n: int = 20, atr_n: int = 14, long_max: float = 1.75, short_max: float = 1.75, keys: list[str] = KEYS) -> DataFrame:
    """Adds stretch_atr ((close - exponential mean) / ATR before), long_ok and short_ok."""
    rows = atr(ema(bars, keys, F.col("close"), n, "_mid"), atr_n, "_atr", keys)
    rows = rows.withColumn("stretch_atr", F.try_divide(F.col("close") - F.col("_mid"), F.lag("_atr").over(series(*keys))))
    return rows.withColumns(
        {"long_ok": F.coalesce(F.col("stretch_atr") <= long_max, F.lit(True)), "short_ok": F.coalesce(F.col("stretch_atr") >= -short_max, F.lit(True))}
    ).drop("_mid", "_atr")


def trend_t(bars: DataFrame, n: int, max_t: float = 2.0, keys: list[str] = KEYS) -> DataFrame:
    """Adds trend_t (rolling slope over its error, from the bar before) and trend_ok. Residuals are each bar's own."""
    m = n // 2

    def add(rows: DataFrame, w: WindowSpec) -> DataFrame:
        rows = rows.withColumn("_i", (F.row_number().over(w) - 1).cast("double"))
        var = rolling(F.var_samp, F.col("_i"), w, n, m)
        slope = rolling2(F.covar_samp, F.col("close"), F.col("_i"), w, n, m) / F.nullif(var, F.lit(0.0))
        rows = rows.withColumns({"_v": var, "_s": slope, "_a": rolling(F.avg, F.col("close"), w, n, m) - slope * rolling(F.avg, F.col("_i"), w, n, m)})
        rows = rows.withColumn("_e", F.col("close") - (F.col("_a") + F.col("_s") * F.col("_i")))
        error = F.sqrt(F.greatest(rolling(F.var_samp, F.col("_e"), w, n, m) / F.nullif((n - 1) * F.col("_v"), F.lit(0.0)), F.lit(0.0)))
        rows = rows.withColumn("_t", F.col("_s") / F.nullif(error, F.lit(0.0)))
        return rows.withColumn("trend_t", F.lag("_t").over(w)).drop("_i", "_v", "_s", "_a", "_e", "_t")

    rows = overlapped(bars, keys, 2 * n + 1, add)
    return rows.withColumn("trend_ok", F.coalesce(F.abs("trend_t") <= max_t, F.lit(True)))


def half_life(bars: DataFrame, n: int = 100, most: float = 50.0, least_speed: float = 1e-4, cap: float = 500.0, x: str = "close", keys: list[str] = KEYS) -> DataFrame:
    """Adds half_life (from the bar before) and half_life_ok, which blocks where there is none."""
    m = n // 2

    def add(rows: DataFrame, w: WindowSpec) -> DataFrame:
        before = F.lag(x).over(w)
        rows = rows.withColumns({"_y": before, "_d": F.col(x) - before})
        slope = rolling2(F.covar_samp, F.col("_y"), F.col("_d"), w, n, m) / F.nullif(rolling(F.var_samp, F.col("_y"), w, n, m), F.lit(0.0))
        rows = rows.withColumn("_k", slope).withColumn("_h", F.when(F.col("_k") < -abs(least_speed), F.least(-log(2) / F.col("_k"), F.lit(cap))))
        return rows.withColumn("half_life", F.lag("_h").over(w)).drop("_y", "_d", "_k", "_h")

    rows = overlapped(bars, keys, n + 2, add)
    return rows.withColumn("half_life_ok", F.coalesce(F.col("half_life") <= most, F.lit(False)))


def fractal_levels(bars: DataFrame, n: int, keys: list[str] = KEYS) -> DataFrame:
    """Adds fractal_high and fractal_low: extreme confirmed three-bar pivots among the n bars before.

    A pivot at bar i needs bar i + 1, so from bar t only pivots up to t - 1 count and
    the look at the next bar never passes t.
    """

    def add(rows: DataFrame, w: WindowSpec) -> DataFrame:
        up = (F.col("high") > F.lag("high").over(w)) & (F.col("high") > F.lead("high").over(w))
        down = (F.col("low") < F.lag("low").over(w)) & (F.col("low") < F.lead("low").over(w))
        rows = rows.withColumns({"_up": F.when(up, F.col("high")), "_down": F.when(down, F.col("low"))})
        frame = w.rowsBetween(-n, -1)
        return rows.withColumns({"fractal_high": F.max("_up").over(frame), "fractal_low": F.min("_down").over(frame)}).drop("_up", "_down")

    return overlapped(bars, keys, n + 2, add)


def squeeze(bars: DataFrame, width: str, n: int, q: float, recent: int = 1, keys: list[str] = KEYS) -> DataFrame:
    """Adds squeeze_at (rolling quantile of a width column), squeezed, and recently_squeezed (any of the ``recent`` bars before)."""

    def add(rows: DataFrame, w: WindowSpec) -> DataFrame:
        rows = order_statistics(rows, [*keys, CHUNK], width, n, max(5, n // 2), quantiles={"squeeze_at": q})
        rows = rows.withColumn("squeezed", F.coalesce(F.col(width) <= F.col("squeeze_at"), F.lit(False)))
        return rows.withColumn("recently_squeezed", F.coalesce(F.max(F.col("squeezed").cast("int")).over(w.rowsBetween(-recent, -1)) == 1, F.lit(False)))

    return overlapped(bars, keys, n + recent, add)


def diamonds(bars: DataFrame, n: int, trend_n: int, slope_ratio: float = 0.15, contraction: float = 0.75, least_height: float = 2.5, atr_n: int = 14, keys: list[str] = KEYS) -> DataFrame:
    """Adds diamond_top, diamond_bottom, diamond_upper, diamond_lower and diamond_height.

    A first half that widens and a second that narrows, large enough against the
    ATR, after a trend: up makes a top, down a bottom.
    """
    n = max(8, n)
    first = max(4, n // 2)

    def add(rows: DataFrame, w: WindowSpec) -> DataFrame:
        given = [c for c in rows.columns if c != "_atr"]
        rows = rows.withColumn("_i", F.row_number().over(w).cast("double"))
        wide, narrow, whole = w.rowsBetween(-(n - 1), -(n - first)), w.rowsBetween(-(n - first - 1), 0), w.rowsBetween(-(n - 1), 0)
        trend = w.rowsBetween(-(n - 1) - trend_n, -n)
        slope = lambda x, frame: F.regr_slope(F.col(x), F.col("_i")).over(frame)
        full = F.count("*").over(whole) == n
        rows = rows.withColumns(
            {
                "_eh": slope("high", wide), "_el": slope("low", wide), "_ch": slope("high", narrow), "_cl": slope("low", narrow), "_tr": slope("close", trend), "_tn": F.count("close").over(trend),
                "_w1": F.max("high").over(wide) - F.min("low").over(wide), "_up": F.max("high").over(narrow), "_lo": F.min("low").over(narrow),
                "_hh": F.max("high").over(whole) - F.min("low").over(whole), "_cut": F.col("_atr") * slope_ratio / first, "_full": full & (F.col("_atr") > 0),
            }
        )
        shape = (
            F.col("_full") & (F.col("_eh") > F.col("_cut")) & (F.col("_el") < -F.col("_cut")) & (F.col("_ch") < -F.col("_cut")) & (F.col("_cl") > F.col("_cut"))
            & (F.col("_up") - F.col("_lo") <= F.col("_w1") * contraction) & (F.col("_hh") >= F.col("_atr") * least_height) & (F.col("_tn") >= max(4, trend_n // 2))
        )
        out = rows.withColumns(
            {
                "diamond_top": F.coalesce(shape & (F.col("_tr") > F.col("_cut") * 0.5), F.lit(False)), "diamond_bottom": F.coalesce(shape & (F.col("_tr") < -F.col("_cut") * 0.5), F.lit(False)),
                "diamond_upper": F.when(F.col("_full"), F.col("_up")), "diamond_lower": F.when(F.col("_full"), F.col("_lo")), "diamond_height": F.when(F.col("_full"), F.col("_hh")),
            }
        )
        return out.drop(*[c for c in out.columns if c.startswith("_") and c not in given])

    return overlapped(atr(bars, atr_n, "_atr", keys), keys, n + trend_n + 1, add)


def kalman_beta(pairs: DataFrame, q: float = 1e-5, r: float = 1e-3, x: str = "x", y: str = "y", keys: list[str] = KEYS) -> DataFrame:
    """Adds kalman_beta, known from the bar before: slope of y on x by a two-state filter, both scaled by the first x.

    Rows of the two series must already be joined on time. The recurrence is not
    linear in what it has seen, so each series is one ordered pass.
    """

    def one(t: pa.Table) -> pa.Table:
        t = in_utc(t).sort_by("ts")
        a, b = t[x].to_numpy(), t[y].to_numpy()
        scale = a[0] if len(a) and a[0] else 1.0
        state, cov, out = np.array([0.0, 1.0]), np.eye(2), [None]
        for u, v in zip(a / scale, b / scale):
            cov = cov + q * np.eye(2)
            h = np.array([1.0, u])
            ch = cov @ h
            gain = ch / (h @ ch + r)
            state = state + gain * (v - h @ state)
            cov = cov - np.outer(gain, h @ cov)
            out.append(float(state[1]))
        return t.append_column("kalman_beta", pa.array(out[: len(a)], pa.float64()))

    return pairs.groupBy(*keys).applyInArrow(one, widened(pairs, kalman_beta="double"))


# MacKinnon (1994) response surface of the unit-root t statistic with a constant, one variable.
_ADF_MAX, _ADF_MIN, _ADF_STAR = 2.74, -18.83, -1.61
_ADF_SMALL = (2.1659, 1.4412, 0.038269)
_ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def adf_pvalue(t: Column) -> Column:
    """Of the unit-root t statistic, by the surface."""
    surface = lambda coef: sum((c * F.pow(t, F.lit(float(k))) for k, c in enumerate(coef)), F.lit(0.0))
    return F.when(t > _ADF_MAX, 1.0).when(t < _ADF_MIN, 0.0).when(t.isNotNull(), norm_cdf(F.when(t <= _ADF_STAR, surface(_ADF_SMALL)).otherwise(surface(_ADF_LARGE))))


def adf(bars: DataFrame, n: int = 72, freq: str = "1 hour", most: float = 0.05, keys: list[str] = KEYS) -> DataFrame:
    """Adds adf_p (of the n closes of ``freq`` bins that were complete before the bar) and adf_ok.

    The test regresses changes on the level before and the change before, with a
    constant. Its second moments are those of a row frame of n - 2 bins, of levels
    relative to the series' first one. There is no p-value below n closes or where the
    regression is singular; then the last one before holds.
    """
    from .joins import asof_backward

    step = F.expr(f"INTERVAL {freq}")
    edge = F.window(F.col("ts") - F.expr("INTERVAL 1 MICROSECOND"), freq)["start"] + step  # bins closed on the right
    coarse = bars.groupBy(*keys, edge.alias("bin")).agg(F.max_by("close", "ts").alias("c"))
    w = Window.partitionBy(*keys).orderBy("bin")
    # y on a and b: the change, the level before it, the change before it
    rows = coarse.select(*keys, "bin", "c", (F.lag("c").over(w) - F.first("c").over(w)).alias("a"), (F.col("c") - F.lag("c").over(w)).alias("y"), (F.lag("c").over(w) - F.lag("c", 2).over(w)).alias("b"))
    m, frame = n - 2, w.rowsBetween(-(n - 2), -1)  # the bins before this one
    cov = lambda p, q: F.covar_samp(p, q).over(frame)
    rows = rows.withColumns(
        {"_n": F.count("b").over(frame), "_aa": cov("a", "a"), "_bb": cov("b", "b"), "_ab": cov("a", "b"), "_ay": cov("a", "y"), "_by": cov("b", "y"), "_yy": cov("y", "y")}
    )
    c = {k: F.col(f"_{k}") for k in ("aa", "bb", "ab", "ay", "by", "yy")}
    det = c["aa"] * c["bb"] - c["ab"] * c["ab"]
    slope, other = (c["bb"] * c["ay"] - c["ab"] * c["by"]) / F.col("_det"), (c["aa"] * c["by"] - c["ab"] * c["ay"]) / F.col("_det")
    left = F.greatest(c["yy"] - slope * c["ay"] - other * c["by"], F.lit(0.0)) * (m - 1) / (m - 3)
    t = slope / F.sqrt(F.greatest(left, F.lit(1e-300)) * c["bb"] / F.col("_det") / (m - 1))
    rows = rows.withColumn("_det", F.when((F.col("_n") == m) & (det > 1e-10 * c["aa"] * c["bb"]), det))
    tested = rows.withColumn("_t", t).where(F.col("_n") == m).select(*keys, "bin", adf_pvalue(F.col("_t")).alias("adf_p"))
    out = asof_backward(bars, tested, keys, ["adf_p"], "ts", "bin", strict=True)
    return out.withColumn("adf_ok", F.coalesce(F.col("adf_p") <= most, F.lit(False)))
