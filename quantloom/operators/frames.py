"""Rolling frames over long series: ranges of rows with the rows before them, and order statistics.

A frame of n rows needs only the n - 1 rows before its own. So a series is cut into
ranges of whole units of time (days, months), each range gets the last rows before it
as well, and ranges of one series run in different tasks.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .carry import CHUNK, chunk_of
from .windows import in_utc, widened

RANGE = 1 << 16  # rows of a range, beside its last unit and the rows before it


def overlapped(df: DataFrame, keys: list[str], reach: int, use: Callable[[DataFrame, WindowSpec], DataFrame], ts: str = "ts", unit: Column | None = None, size: int = RANGE) -> DataFrame:
    """What ``use`` adds to the rows of df, where it looks at most ``reach`` rows back.

    ``use`` gets rows and the ordered window of their range, and keeps the columns it is
    given. A unit is a bin of time whose rows stay together; ranges are cut from one count
    a unit. Rows whose key or time is null make series and units of their own.
    """
    unit = chunk_of(df, ts) if unit is None else unit
    size = max(size, 4 * reach)  # then rows serve two further ranges at most
    counts = df.groupBy(*keys, unit.alias("_unit")).agg(F.count("*").alias("_n"))
    line = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(line.orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    units = counts.withColumn("_before", before).withColumn(CHUNK, F.floor(F.col("_before") / size))
    # the first rows of the next two ranges, known to the last unit of a range and handed to the others
    starts = units.groupBy(*keys, CHUNK).agg(F.min("_before").alias("_start"), F.collect_list(F.struct("_unit", "_n", "_before")).alias("_units"))
    nexts = [F.lead(F.struct(CHUNK, "_start"), k).over(line.orderBy(CHUNK)) for k in (1, 2)]
    starts = starts.withColumn("_next", F.array(*nexts)).select(*keys, CHUNK, "_next", F.inline("_units"))
    near = F.filter("_next", lambda s: s["_start"] < F.col("_before") + F.col("_n") + reach)
    to = F.concat(F.array(CHUNK), F.transform(near, lambda s: s[CHUNK]))
    places = starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_unit").alias("_u"), to.alias("_to"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_unit").eqNullSafe(F.col("_u")))
    rows = df.withColumn("_unit", unit).join(places, same).select(*df.columns, F.col("_to")[0].alias("_home"), F.explode("_to").alias(CHUNK))
    rows = rows.select(*df.columns, CHUNK, (F.col(CHUNK) == F.col("_home")).alias("_own")).repartition(*keys, CHUNK)
    return use(rows, Window.partitionBy(*keys, CHUNK).orderBy(ts)).where("_own").drop(CHUNK, "_own")


def order_statistics(rows: DataFrame, by: list[str], value: str, n: int, least: int, ts: str = "ts", quantiles: dict[str, float] | None = None, tails: dict[str, str] | None = None, rank: str | None = None) -> DataFrame:
    """Adds order statistics of the last n rows, null where they hold fewer than ``least`` values.

    ``quantiles``: column to share, with linear interpolation. ``tails``: column to one
    of those, the mean of the values up to it. ``rank``: the share of the row's own value,
    ties averaged. Null and NaN values are passed over. ``by`` must bound a group's rows
    (see :func:`overlapped`); a sorted list of the frame slides over them.
    """
    quantiles, tails = quantiles or {}, tails or {}
    names = [*quantiles, *tails, *([rank] if rank else [])]
    schema = widened(rows, **{k: "double" for k in names})

    def slide(t: pa.Table) -> pa.Table:
        t = in_utc(t).sort_by(ts)
        x = [None if v is None or v != v else float(v) for v in t[value].to_pylist()]
        out: dict[str, list] = {k: [] for k in names}
        kept: list[float] = []
        for i, v in enumerate(x):
            if i >= n and x[i - n] is not None:
                del kept[bisect_left(kept, x[i - n])]
            if v is not None:
                insort(kept, v)
            m = len(kept)
            full = m >= max(least, 1)
            for k, q in quantiles.items():
                if full:
                    at = q * (m - 1)
                    low = int(at)
                    a, b = kept[low], kept[min(low + 1, m - 1)]
                    out[k].append(a if a == b or at == low else (low + 1 - at) * a + (at - low) * b)
                else:
                    out[k].append(None)
            for k, q in tails.items():
                part = kept[: bisect_right(kept, out[q][-1])] if full else []
                out[k].append(sum(part) / len(part) if part else None)
            if rank:
                less = bisect_left(kept, v) if full and v is not None else 0
                out[rank].append((less + (bisect_right(kept, v) - less + 1) / 2) / m if full and v is not None else None)
        for k in names:
            t = t.append_column(k, pa.array(out[k], pa.float64()))
        return t

    return rows.groupBy(*by).applyInArrow(slide, schema)
