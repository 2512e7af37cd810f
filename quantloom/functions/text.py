"""Formatting and scope tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(c: Column) -> Column:
    return F.when(c.isNull(), "n/a").otherwise(F.concat(F.when(c < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(c), 0)))


def percent(c: Column, digits: int = 2) -> Column:
    return F.when(c.isNull(), "n/a").otherwise(F.concat(F.format_number(c, digits), F.lit("%")))


def ratio(c: Column, digits: int = 2) -> Column:
    return F.when(c.isNull() | F.isnan(c), "n/a").when(F.abs(c) == float("inf"), "inf").otherwise(F.format_number(c, digits))


def p_value(c: Column) -> Column:
    return F.when(c.isNull(), "n/a").when(c < 0.001, "<0.001").otherwise(F.format_number(c, 3))


def duration(minutes: Column) -> Column:
    """1d 2h 3m; parts that are zero are left out."""
    m = F.floor(minutes).cast("long")
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit)))
    out = F.concat_ws(" ", part(F.floor(m / 1440), "d"), part(F.floor(m % 1440 / 60), "h"), part(m % 60, "m"))
    return F.when(minutes.isNull(), "n/a").when(out == "", "0m").otherwise(out)


def scope_token(c: Column) -> Column:
    """A risk scope without regard to case, plus signs, %20 and blanks."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, "%20|\\+", " "), "\\s+", ""))
