"""The bar lake: Parquet partitioned by symbol and timeframe."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bars import keep_last
from ..schema import BARS, require_columns
from ..session import cut
from ..settings import TIMEFRAMES
from .footers import footers, partition_value


class Lake:
    """Reads and writes bars below one path, in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def bars(self) -> DataFrame:
        """All bars; an empty table where the lake does not exist yet."""
        if not self._exists():
            return self.spark.createDataFrame([], BARS)
        # a schema of our own: partition values such as "6E" or "1h" stay text
        return self.spark.read.schema(BARS).parquet(self.path)

    def load(self, symbol: str | Iterable[str], timeframe: str | Iterable[str] = "5m", start: str | None = None, end: str | None = None) -> DataFrame:
        """Bars of symbols and timeframes with both ends of the range in it. Partitions and row groups are pruned."""
        many = lambda x: [x] if isinstance(x, str) else list(x)
        frames = [t.lower() for t in many(timeframe)]
        if bad := [t for t in frames if t not in TIMEFRAMES]:
            raise ValueError(f"unknown timeframes: {bad}")
        out = self.bars().where(F.col("symbol").isin(many(symbol)) & F.col("timeframe").isin(frames))
        if start is not None:
            out = out.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
        if end is not None:
            out = out.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
        return out

    def load_all(self, symbol: str) -> DataFrame:
        return self.load(symbol, TIMEFRAMES)

    def save(self, bars: DataFrame) -> None:
        """Replaces the partitions that bars has rows of. Zoned times become UTC without zone. An empty table is refused."""
        require_columns(bars, "symbol", "timeframe", "ts", "open", "high", "low", "close", "volume")
        if bars.isEmpty():
            raise ValueError("no bars to save")
        missing = {c: F.lit(None).cast(t) for c, t in (("average", "double"), ("contract", "string")) if c not in bars.columns}
        rows = bars.withColumns({**missing, "ts": F.col("ts").cast("timestamp_ntz")})
        names = [x.split()[0] for x in BARS.split(", ")]
        # by ranges of time too, so that a long series is several sorted files written by several tasks
        rows = rows.select(*names).repartitionByRange("symbol", "timeframe", "ts").sortWithinPartitions("symbol", "timeframe", "ts")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "timeframe").parquet(self.path)

    def files(self) -> DataFrame:
        """One row a file, from footers: symbol, timeframe, and the columns of :func:`footers.footers`."""
        if not self._exists():
            return self.spark.createDataFrame([], "symbol string, timeframe string, path string, size long, rows long, first timestamp_ntz, last timestamp_ntz, scanned boolean, error string")
        all_ = footers(self.spark, self.path)
        return all_.select(partition_value(F.col("path"), "symbol").alias("symbol"), partition_value(F.col("path"), "timeframe").alias("timeframe"), *all_.columns)

    def extend(self, new: DataFrame) -> list[str]:
        """Merges bars into the lake; of bars with one time the newer arrival stays. Returns the paths of the files that were replaced.

        Copy on write by file: only files whose range of times meets days of the new bars
        are read and written anew; others keep their names and bytes. New files are
        complete before old ones go. If the job is lost in between, both stand there and
        bars are twice in the lake until the same call is made again, which mends it.
        """
        require_columns(new, "symbol", "timeframe", "ts", "open", "high", "low", "close", "volume")
        names = [x.split()[0] for x in BARS.split(", ")]
        kinds = dict(x.split() for x in BARS.split(", "))
        rows = cut(new.select(*[F.col(c).cast(kinds[c]).alias(c) if c in new.columns else F.lit(None).cast(kinds[c]).alias(c) for c in names]).withColumn("_n", F.lit(1)))
        days = rows.groupBy("symbol", "timeframe", F.to_date("ts").alias("_day")).agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
        known = self.files().where("error is null").select("symbol", "timeframe", "path", "first", "last")
        hit = days.join(known, ["symbol", "timeframe"]).where("_a <= last and _b >= first").select("path").distinct()
        touched = sorted(r.path for r in hit.collect())  # names of the files to be replaced
        both = rows
        if touched:
            plain = [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in touched]  # names, not patterns
            old = self.spark.read.schema(BARS).option("basePath", self.path).parquet(*plain)
            both = old.select(*names).withColumn("_n", F.lit(0)).unionByName(rows)
        merged = cut(keep_last(both, ["symbol", "timeframe", "ts"], "_n").drop("_n"))
        merged.repartitionByRange("symbol", "timeframe", "ts").sortWithinPartitions("symbol", "timeframe", "ts").write.mode("append").partitionBy("symbol", "timeframe").parquet(self.path)
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for p in touched:
            at = hadoop.Path(p)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, False)
        return touched

    def symbols(self) -> DataFrame:
        return self.bars().select("symbol").distinct().orderBy("symbol")

    def info(self, symbol: str | None = None) -> DataFrame:
        """Rows, first, last and megabytes of each series."""
        b = self.bars() if symbol is None else self.bars().where(F.col("symbol") == symbol)
        b = b.select("symbol", "timeframe", "ts", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("z")) if self._exists() else b.select("symbol", "timeframe", "ts", F.lit("").alias("f"), F.lit(0).alias("z"))
        files = b.groupBy("symbol", "timeframe", "f").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"), F.max("z").alias("z"))
        return files.groupBy("symbol", "timeframe").agg(F.sum("n").alias("bars"), F.min("a").alias("first"), F.max("b").alias("last"), (F.sum("z") / 1e6).alias("megabytes"))

    def freshness(self, required: DataFrame, now: str, max_days: int = 10) -> DataFrame:
        """required (symbol, timeframe) rows with last, days and state: fresh, stale or missing. Times come from footers; no column is read where these have them."""
        last = self.files().groupBy("symbol", "timeframe").agg(F.max("last").alias("last"))
        out = required.join(last, ["symbol", "timeframe"], "left")
        days = F.datediff(F.lit(now).cast("timestamp_ntz"), F.col("last"))
        return out.withColumn("days", days).withColumn("state", F.when(F.col("last").isNull(), "missing").when(F.col("days") > max_days, "stale").otherwise("fresh"))

    def require_fresh(self, required: DataFrame, now: str, max_days: int = 10) -> None:
        bad = self.freshness(required, now, max_days).where("state <> 'fresh'").orderBy("symbol", "timeframe").limit(20).collect()
        if bad:
            raise RuntimeError("; ".join(f"{r.symbol} {r.timeframe}: {r.state}" for r in bad))

    def fingerprint(self, required: DataFrame) -> str:
        """16 hex digits over the series asked for and when their files changed."""
        if not self._exists():
            return "0" * 16
        per = self.bars().select("symbol", "timeframe", F.col("_metadata.file_modification_time").alias("m")).groupBy("symbol", "timeframe").agg(F.max("m").alias("m"))
        per = per.join(required, ["symbol", "timeframe"], "leftsemi")
        row = per.agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(F.concat_ws(":", "symbol", "timeframe", F.col("m").cast("string"))))), 256).alias("h")).first()
        return row.h[:16]


NAME = r"([^/]+)_([^_/]+)\.parquet$"  # SYMBOL_timeframe.parquet


def _named(path: F.Column) -> dict[str, F.Column]:
    """Symbol and timeframe of a flat file's path; a symbol may have underscores, a timeframe has none."""
    return {"symbol": F.regexp_extract(path, NAME, 1), "timeframe": F.lower(F.regexp_extract(path, NAME, 2))}


def read_files(spark: SparkSession, path: str, skip_bad: bool = False) -> DataFrame:
    """Flat files named SYMBOL_timeframe.parquet, with both taken from the name; unknown timeframes are left out.

    With ``skip_bad`` files that cannot be read are passed over; :func:`file_report` tells which.
    """
    raw = spark.read.option("ignoreCorruptFiles", str(skip_bad).lower()).parquet(path)
    out = raw.withColumns(_named(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))))
    return out.where(F.col("timeframe").isin(list(TIMEFRAMES))).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def file_report(spark: SparkSession, path: str) -> DataFrame:
    """One row a flat file: symbol, timeframe, path, size, rows, first, last, scanned, error, state.

    State: ``ok``, ``unknown timeframe`` or ``unnamed`` (read_files leaves both out), or ``bad``
    (the footer cannot be read or has no ts).
    """
    all_ = footers(spark, path).withColumns(_named(F.col("path")))
    named, known = F.col("symbol") != "", F.col("timeframe").isin(list(TIMEFRAMES))
    state = F.when(F.col("error").isNotNull(), "bad").when(~named, "unnamed").when(~known, "unknown timeframe").otherwise("ok")
    return all_.select("symbol", "timeframe", "path", "size", "rows", "first", "last", "scanned", "error", state.alias("state"))
