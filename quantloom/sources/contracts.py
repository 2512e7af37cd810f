"""Quarterly contracts and the offline form of broker history."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

QUARTERS = {3: "H", 6: "M", 9: "U", 12: "Z"}


def third_friday(year: int, month: int) -> date:
    first = date(year, month, 1)
    return first + timedelta(days=(4 - first.weekday()) % 7 + 14)


def quarterly(spark: SparkSession, symbols: list[str], first_year: int, last_year: int) -> DataFrame:
    """(symbol, contract, expiry) in order of expiry; expiry is the third Friday."""
    rows = [(s, f"{s}{code}{y % 100:02d}", third_friday(y, m)) for s in symbols for y in range(first_year, last_year + 1) for m, code in QUARTERS.items()]
    return spark.createDataFrame(rows, "symbol string, contract string, expiry date").orderBy("symbol", "expiry")


def weekly_chunks(start: date, stop: date) -> list[tuple[date, date]]:
    """Week-long requests from stop back to start."""
    out = []
    while stop > start:
        out.append((max(start, stop - timedelta(days=7)), stop))
        stop = out[-1][0]
    return out


class _Chunk(InputPartition):
    def __init__(self, symbol: str, start: date, stop: date):
        self.symbol, self.start, self.stop = symbol, start, stop


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[_Chunk]:
        a, b = date.fromisoformat(self.options["start"]), date.fromisoformat(self.options["end"])
        return [_Chunk(s, *c) for s in self.options["symbols"].split(",") for c in weekly_chunks(a, b)]

    def read(self, p: _Chunk) -> Iterator[pa.RecordBatch]:
        """Asks the plug-in named in ``fetch`` (module:function) for one chunk; it keeps the broker's pace itself."""
        from importlib import import_module

        module, _, name = self.options["fetch"].partition(":")
        yield from getattr(import_module(module), name)(p.symbol, p.start, p.stop, self.options)


class _Steps(DataSourceStreamReader):
    """The same chunks as a stream, whose offset is the day up to which all symbols are loaded.

    Each batch takes ``step`` weeks (all that is left, if not given) from there on. Spark
    writes a batch's offsets ahead of it and its end behind it, so a run that is cut off asks
    again for the chunks of its last batch only, and a sink that keeps batches apart (files, a
    table) gets each row once. A later ``end`` goes on where the last run stopped.
    """

    def __init__(self, options: dict[str, str]):
        self.reader, self.options = _Reader(options), options
        self.end, self.at = date.fromisoformat(options["end"]), None

    def initialOffset(self) -> dict:
        return {"day": self.options["start"]}

    def latestOffset(self) -> dict:
        step = self.options.get("step")
        at = date.fromisoformat((self.at or self.initialOffset())["day"])
        # the first call after a restart may be behind what is done; Spark then asks for nothing twice
        self.at = {"day": max(at, min(self.end, at + timedelta(weeks=int(step)) if step else self.end)).isoformat()}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[_Chunk]:
        a, b = date.fromisoformat(start["day"]), date.fromisoformat(end["day"])
        if self.at is None or self.at["day"] < end["day"]:
            self.at = end
        return [_Chunk(s, *c) for s in self.options["symbols"].split(",") for c in weekly_chunks(a, b)]

    def read(self, p: _Chunk) -> Iterator[pa.RecordBatch]:
        return self.reader.read(p)

    def commit(self, end: dict) -> None:
        pass


class BrokerHistory(DataSource):
    """spark.read or spark.readStream, format("broker_history"): one partition a symbol and week, filled by a plug-in function."""

    @classmethod
    def name(cls) -> str:
        return "broker_history"

    def schema(self) -> str:
        return "symbol string, contract string, ts timestamp_ntz, open double, high double, low double, close double, volume double, average double"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> _Steps:
        return _Steps(dict(self.options))
