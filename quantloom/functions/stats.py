"""Distribution functions that Spark SQL lacks, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from math import log, pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rational form of the normal tail, numerator and denominator from the highest power (Hart, 1968).
_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_BELOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
# A first guess of the normal quantile, from the lowest power (Abramowitz and Stegun, 26.2.23).
_GUESS_TOP, _GUESS_BELOW = (2.515517, 0.802853, 0.010328), (1.0, 1.432788, 0.189269, 0.001308)
# Stirling's series of the log-gamma function, coefficients of 1/z, 1/z**3, ...
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680)


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x evaluated once."""
    return F.transform(F.array(x), f)[0]


def _poly(x: Column, highest_first: tuple[float, ...]) -> Column:
    out = F.lit(highest_first[0])
    for c in highest_first[1:]:
        out = out * x + c
    return out


def norm_cdf(x: Column) -> Column:
    """Of the standard normal, to about 1e-15; null for null."""
    return _let(x, _norm_cdf)


def _norm_cdf(x: Column) -> Column:
    a = F.abs(x)
    bell = F.exp(-a * a / 2)
    far = a
    for k in (0.65, 4, 3, 2, 1):
        far = F.lit(0.65) + a if k == 0.65 else a + k / far
    tail = F.when(a < 7.07, bell * _poly(a, _TOP) / _poly(a, _BELOW)).when(a < 37, bell / far / sqrt(2 * pi)).otherwise(F.lit(0.0))
    return F.when(x > 0, 1 - tail).when(x.isNotNull(), tail)


def norm_ppf(p: Column) -> Column:
    """The quantile, null outside (0, 1): a guess and four of Halley's steps on the lower half."""

    def whole(p: Column) -> Column:
        low = F.least(p, 1 - p)

        def step(x: Column, _: Column) -> Column:
            return _let((_norm_cdf(x) - low) * sqrt(2 * pi) * F.exp(x * x / 2), lambda u: x - u / (1 + x * u / 2))

        guess = _let(F.sqrt(-2 * F.log(low)), lambda t: _poly(t, _GUESS_TOP[::-1]) / _poly(t, _GUESS_BELOW[::-1]) - t)
        x = F.aggregate(F.sequence(F.lit(1), F.lit(4)), guess, step)
        return F.when((p > 0) & (p < 1), F.when(p < 0.5, x).otherwise(-x))

    return _let(p, whole)


def log_gamma(x: Column) -> Column:
    """Of positive numbers: Stirling's series at x + 10, brought back by the recurrence."""
    return _let(x, _log_gamma)


def _log_gamma(x: Column) -> Column:
    z = x + 10
    series = F.lit(0.0)
    for k, c in enumerate(_STIRLING):
        series = series + c / F.pow(z, F.lit(2.0 * k + 1))
    back = x
    for k in range(1, 10):
        back = back * (x + k)
    return (z - 0.5) * F.log(z) - z + log(2 * pi) / 2 + series - F.log(back)


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function by its continued fraction (modified Lentz), on the side where that converges."""
    near = x < (a + 1) / (a + b + 2)
    p, q, v = F.when(near, a).otherwise(b), F.when(near, b).otherwise(a), F.when(near, x).otherwise(1 - x)
    tiny = 1e-300
    safe = lambda c: F.when(F.abs(c) > tiny, c).otherwise(tiny)

    def step(s: Column, m: Column) -> Column:
        even = m * (s["q"] - m) * s["v"] / ((s["p"] + 2 * m - 1) * (s["p"] + 2 * m))
        odd = -(s["p"] + m) * (s["p"] + s["q"] + m) * s["v"] / ((s["p"] + 2 * m) * (s["p"] + 2 * m + 1))
        d1, c1 = 1 / safe(1 + even * s["d"]), safe(1 + even / s["c"])
        d2, c2 = 1 / safe(1 + odd * d1), safe(1 + odd / c1)
        return F.struct(s["p"], s["q"], s["v"], c2.alias("c"), d2.alias("d"), (s["h"] * (d1 * c1) * (d2 * c2)).alias("h"))

    d = 1 / safe(1 - (p + q) * v / (p + 1))
    start = F.struct(p.alias("p"), q.alias("q"), v.alias("v"), F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"))
    steps = F.transform(F.sequence(F.lit(1), F.least(F.lit(40) + F.ceil(4 * F.sqrt(p + q)), F.lit(20_000)).cast("int")), lambda m: m.cast("double"))
    fraction = F.aggregate(steps, start, step, lambda s: s["h"])
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    inside = front * fraction / p
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(F.when(near, inside).otherwise(1 - inside))


def t_pvalue(t: Column | str, df: Column) -> Column:
    """P(|T| >= |t|) of Student's t; null where t or df is null or df is not positive."""
    t = F.col(t) if isinstance(t, str) else t
    df = F.when(df > 0, df.cast("double"))
    x = _let(df, lambda d: d / (d + t * t))
    return F.when(t.isNotNull() & df.isNotNull() & ~F.isnan(t), _let(F.struct((df / 2).alias("a"), x.alias("x")), lambda s: incomplete_beta(s["a"], F.lit(0.5), s["x"])))


def trunc(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x))


def erf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26; absolute error below 1.5e-7."""
    a = F.abs(x)
    t = 1 / (1 + 0.3275911 * a)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-a * a))
