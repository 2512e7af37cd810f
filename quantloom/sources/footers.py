"""What the footers of Parquet files say: rows, first and last time, and which files cannot be read.

Files are listed by Spark and each footer is read in a task, so a table's size costs
nothing but its number of files. A file whose footer has no statistics has its one
time column read instead; a file that is no Parquet file is a row with an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OUT = pa.schema([("path", pa.string()), ("size", pa.int64()), ("rows", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("scanned", pa.bool_()), ("error", pa.string())])
_EPOCH = datetime(1970, 1, 1)


def _micros(t) -> int:
    t = t.astimezone(timezone.utc).replace(tzinfo=None) if t.tzinfo else t
    d = t - _EPOCH
    return (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds


def _facts(path: str, ts: str) -> tuple[int, int | None, int | None, bool]:
    """Rows, first and last time in microseconds, and whether the column itself had to be read."""
    import pyarrow.compute as pc
    import pyarrow.parquet as pq
    from pyarrow import fs

    # Spark names a file plainly, a URI is escaped
    scheme, _, rest = path.partition(":")
    store, at = fs.FileSystem.from_uri(f"{scheme}:{'' if rest.startswith('//') else '//'}{quote(rest, safe='/:@')}")
    with store.open_input_file(at) as f:
        file = pq.ParquetFile(f)
        meta = file.metadata
        k = meta.schema.names.index(ts)
        groups = [meta.row_group(g).column(k).statistics for g in range(meta.num_row_groups) if meta.row_group(g).num_rows]
        if all(s is not None and (s.has_min_max or s.null_count == s.num_values + s.null_count > 0) for s in groups):
            some = [s for s in groups if s.has_min_max]
            ends = (min(_micros(s.min) for s in some), max(_micros(s.max) for s in some)) if some else (None, None)
            return meta.num_rows, *ends, False
        ends = pc.min_max(file.read(columns=[ts])[ts])
        first, last = (None if ends[x].as_py() is None else _micros(ends[x].as_py()) for x in ("min", "max"))
        return meta.num_rows, first, last, True


def footers(spark: SparkSession, path: str, ts: str = "ts") -> DataFrame:
    """One row a file below path: path, size, rows, first, last, scanned, error.

    ``first`` and ``last`` are null for a file without rows or times; ``scanned`` says
    that the footer had no statistics and the column was read. A file that cannot be
    read, or lacks the column, has its ``error`` and nothing else. Files of no bytes are
    passed over, as Spark's scans do.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path", F.col("length").alias("size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows.append((p, size, *_facts(p, ts), None))
                except (OSError, ValueError, pa.ArrowException) as e:  # this file's own fault; the others are read
                    rows.append((p, size, None, None, None, None, f"{type(e).__name__}: {e}"[:500]))
            cols = list(zip(*rows)) if rows else [()] * len(_OUT)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT)], schema=_OUT)

    got = files.mapInArrow(run, "path string, size long, rows long, first long, last long, scanned boolean, error string")
    time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz").alias(c)
    # NTZ values are read as UTC, and so they are shown, whatever the session's zone
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        time = lambda c: F.to_utc_timestamp(F.timestamp_micros(c), F.current_timezone()).cast("timestamp_ntz").alias(c)
    return got.select("path", "size", "rows", time("first"), time("last"), "scanned", "error")


def partition_value(path: F.Column, name: str) -> F.Column:
    """The value of a partition column in a path, unescaped."""
    raw = F.regexp_extract(path, f"/{name}=([^/]+)/", 1)
    return F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
