"""The sampler of a tree of Parzen estimators, over a table of trials.

Trials are split into good and other ones by score. For each parameter both sides have
a density, and candidates are ranked by how much likelier the good side makes them.
A numeric density is a sum of normal kernels on ``CELLS`` cells of the parameter's range,
so it is an aggregate of a fixed number of rows however many trials there are.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import norm_cdf

CELLS = 64


def split(trials: DataFrame, score: str, good_share: float) -> DataFrame:
    """Adds ``good``: the best share of the trials, and all that tie with the last of these. Trials without a score are left out."""
    scored = trials.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    # the score of the k-th best trial, k = ceil(share * n)
    edge = scored.agg(F.expr(f"percentile_disc({good_share}) WITHIN GROUP (ORDER BY `{score}` DESC)").alias("_edge"))
    return scored.join(F.broadcast(edge)).withColumn("good", F.col(score) >= F.col("_edge")).drop("_edge")


def _cell(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(CELLS - 1), F.floor((x - low) / (high - low) * CELLS))).cast("int")


def densities(trials: DataFrame, space: dict[str, Any], score: str, good_share: float = 0.25) -> DataFrame:
    """(param, value, good, other): probability of each cell (its number as text) or category on both sides.

    Numeric: every trial's kernel is cut at the range and has a width of a fifth of it
    over n ** 0.2; one uniform kernel stands beside them, so no cell has probability
    0. Category: counts plus one over all. Values that are null, or outside the space,
    count for no density.
    """
    rows = split(trials, score, good_share)
    out = None
    for name, spec in space.items():
        if isinstance(spec, list):
            side = rows.where(F.col(name).isin(spec)).groupBy(F.col(name).cast("string").alias("value")).agg(F.count_if("good").alias("a"), F.count_if(~F.col("good")).alias("b"))
            every = rows.sparkSession.createDataFrame([(str(v),) for v in spec], "value string")
            one = every.join(F.broadcast(side), "value", "left").na.fill(0)
            total = one.agg(F.sum("a").alias("_a"), F.sum("b").alias("_b"))
            one = one.join(F.broadcast(total)).select("value", ((F.col("a") + 1) / (F.col("_a") + len(spec))).alias("good"), ((F.col("b") + 1) / (F.col("_b") + len(spec))).alias("other"))
        else:
            low, high = float(spec[0]), float(spec[1])
            x = F.col(name).cast("double")
            counts = rows.where(x.between(low, high)).groupBy(_cell(x, low, high).alias("c")).agg(F.count_if("good").alias("a"), F.count_if(~F.col("good")).alias("b"))
            total = counts.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("_a"), F.coalesce(F.sum("b"), F.lit(0)).alias("_b"))
            cells = rows.sparkSession.range(CELLS).select(F.col("id").cast("int").alias("cell"))
            wide = (high - low) / CELLS

            def mass(n: Column) -> Column:
                """Of a kernel at the middle of cell c inside a cell, of what of it lies in the range."""
                h = F.lit((high - low) / 5) / F.pow(F.greatest(n, F.lit(1)).cast("double"), F.lit(0.2))
                at = lambda e: norm_cdf((e * wide - (F.col("c") + 0.5) * wide) / h)
                return (at(F.col("cell") + 1) - at(F.col("cell"))) / (at(F.lit(CELLS)) - at(F.lit(0)))

            # CELLS rows on both sides
            both = cells.join(F.broadcast(counts)).join(F.broadcast(total)).groupBy("cell").agg(F.sum(F.col("a") * mass(F.col("_a"))).alias("a"), F.sum(F.col("b") * mass(F.col("_b"))).alias("b"))
            one = cells.join(both, "cell", "left").na.fill(0.0).join(F.broadcast(total))
            p = lambda s: ((F.col(s) + 1 / CELLS) / (F.col(f"_{s}") + 1)).alias("good" if s == "a" else "other")
            one = one.select(F.col("cell").cast("string").alias("value"), p("a"), p("b"))
        one = one.select(F.lit(name).alias("param"), "value", "good", "other")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("the space has no parameters")
    return out


def rated(candidates: DataFrame, trials: DataFrame, space: dict[str, Any], score: str, id_col: str, good_share: float = 0.25) -> DataFrame:
    """candidates with ``ratio``: the log of how much likelier the good side makes them, to 9 decimal places so that equal ones tie.

    A parameter that a candidate has no value of, or one outside the space, adds nothing.
    """
    table = densities(trials, space, score, good_share)
    value = lambda n, spec: F.col(n).cast("string") if isinstance(spec, list) else F.when(F.col(n).between(spec[0], spec[1]), _cell(F.col(n).cast("double"), float(spec[0]), float(spec[1])).cast("string"))
    long = candidates.select(F.col(id_col).alias("_id"), F.explode(F.array(*[F.struct(F.lit(n).alias("param"), value(n, s).alias("value")) for n, s in space.items()])).alias("p"))
    gain = long.select("_id", "p.*").join(F.broadcast(table), ["param", "value"]).groupBy("_id").agg(F.round(F.sum(F.log(F.col("good") / F.col("other"))), 9).alias("ratio"))
    out = candidates.join(gain, candidates[id_col] == gain["_id"], "left").drop("_id")
    return out.withColumn("ratio", F.coalesce("ratio", F.lit(0.0)))


def best(candidates: DataFrame, trials: DataFrame, space: dict[str, Any], score: str, id_col: str, k: int, good_share: float = 0.25) -> DataFrame:
    """The k candidates of the highest ratio, ties to the smaller id."""
    return rated(candidates, trials, space, score, id_col, good_share).orderBy(F.desc("ratio"), id_col).limit(k)
