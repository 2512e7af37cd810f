"""Domain views over the driver's tables: ticks, bars, trades, slot PnL, history and exposure; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators.bars import bars_from_ticks

CAPITAL = 100_000.0
LEVEL = 140_000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value is not null")
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("price"), F.col("value").alias("size"))


def bars(spark: SparkSession, sf_dir: str, freq: str = "1 hour") -> DataFrame:
    return bars_from_ticks(ticks(spark, sf_dir), freq)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trade a line item; ids are dense within an order."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))
    i = table(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")
    i = i.withColumn("trade_id", F.col("l_orderkey") * 1000 + F.row_number().over(w))
    j = i.join(o, i["l_orderkey"] == o["o_orderkey"])
    return j.select(
        "trade_id", F.col("o_orderpriority").alias("strategy"), F.col("l_returnflag").alias("symbol"), F.when(F.col("l_linestatus") == "O", "LONG").otherwise("SHORT").alias("direction"),
        F.least("o_orderdate", "l_shipdate").alias("entry_time"), F.greatest("o_orderdate", "l_shipdate").alias("exit_time"), F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("entry_price"), (F.col("l_extendedprice") * (0.05 - F.col("l_discount"))).alias("pnl"),
        (F.col("l_extendedprice") * F.col("l_tax") * 0.01).alias("commission"), (F.col("l_extendedprice") * F.col("l_discount") * 0.01).alias("slippage"),
        F.concat("l_returnflag", "l_linestatus").alias("exit_reason"),
    )


def slot_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(strategy, day, pnl): money made that day; one row where there were orders."""
    o = table(spark, sf_dir, "orders")
    day = F.to_date(F.col("o_orderdate").cast("timestamp_ntz"))
    return o.groupBy(F.col("o_orderpriority").alias("strategy"), day.alias("day")).agg(F.round(F.sum((F.col("o_totalprice") - LEVEL) / 1000), 5).alias("pnl"))


def slot_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(strategy, ts, pnl): cumulative PnL by day."""
    w = Window.partitionBy("strategy").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return slot_steps(spark, sf_dir).select("strategy", F.col("day").cast("timestamp_ntz").alias("ts"), F.round(F.sum("pnl").over(w), 5).alias("pnl"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, ts, total_value) of the whole: one row a day, from daily totals."""
    d = slot_steps(spark, sf_dir).groupBy("day").agg(F.round(F.sum("pnl"), 5).alias("pnl"))
    w = Window.partitionBy("run_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("run_id", F.lit("all"))
    return d.select("run_id", F.col("day").cast("timestamp_ntz").alias("ts"), F.round(CAPITAL + F.sum("pnl").over(w), 5).alias("total_value"))


def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.to_date(F.col("o_orderdate").cast("timestamp_ntz"))
    return o.groupBy(F.col("o_orderpriority").alias("strategy"), F.col("o_orderstatus").alias("symbol"), day.cast("timestamp_ntz").alias("ts")).agg(F.round(F.sum("o_totalprice"), 2).alias("notional"))


BAR_SQL = """SELECT event_type AS symbol, {bin} AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, ts) AS close, sum(value) AS volume, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2"""
HOUR = BAR_SQL.format(bin="date_trunc('hour', ts)")
DAY = BAR_SQL.format(bin="date_trunc('day', ts)")
TRADES = """SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
    l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS trade_id,
  o_orderpriority AS strategy, l_returnflag AS symbol, CASE WHEN l_linestatus = 'O' THEN 'LONG' ELSE 'SHORT' END AS direction,
  least(o_orderdate, l_shipdate) AS entry_time, greatest(o_orderdate, l_shipdate) AS exit_time, l_quantity AS quantity,
  l_extendedprice / l_quantity AS entry_price, l_extendedprice * (0.05 - l_discount) AS pnl,
  l_extendedprice * l_tax * 0.01 AS commission, l_extendedprice * l_discount * 0.01 AS slippage,
  l_returnflag || l_linestatus AS exit_reason FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
STEPS = """SELECT o_orderpriority AS strategy, CAST(o_orderdate AS DATE) AS day, round(sum((o_totalprice - 140000) / 1000), 5) AS pnl
  FROM orders GROUP BY 1, 2"""
TOTALS = f"SELECT day, round(sum(pnl), 5) AS pnl FROM ({STEPS}) GROUP BY 1"
EQUITY = f"SELECT day, round(100000 + sum(pnl) OVER (ORDER BY day), 5) AS equity FROM ({TOTALS})"
DAILY = f"SELECT day, equity, equity - lag(equity) OVER (ORDER BY day) AS pnl, equity / lag(equity) OVER (ORDER BY day) - 1 AS ret FROM ({EQUITY})"
EXPOSURE = "SELECT o_orderpriority AS strategy, o_orderstatus AS symbol, CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS notional FROM orders GROUP BY 1, 2, 3"
