"""End-of-day flags on live rows by event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..settings import parse_hhmm

DAY_MS = 86_400_000
OUT = "symbol string, ts timestamp"


class EndOfDay(StatefulProcessor):
    """State of a symbol: for each open day the earliest row at or after the closing time. The day's timer hands it out."""

    def __init__(self, close_minute: int):
        self.close_minute = close_minute

    def init(self, handle) -> None:
        self.handle = handle
        self.first = handle.getMapState("first", "day long", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        for part in rows:
            us = part["us"]
            day, minute = us // (DAY_MS * 1000), us // 60_000_000 % 1440
            for d, t in us[minute >= self.close_minute].groupby(day).min().items():
                end = (int(d) + 1) * DAY_MS
                if end <= mark:  # the day's flag is out already
                    continue
                if not self.first.containsKey((int(d),)):
                    self.handle.registerTimer(end)
                    self.first.updateValue((int(d),), (int(t),))
                elif t < self.first.getValue((int(d),))[0]:
                    self.first.updateValue((int(d),), (int(t),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        day = expiredTimerInfo.getExpiryTimeInMs() // DAY_MS - 1
        us = self.first.getValue((day,))[0]
        self.first.removeKey((day,))
        yield pd.DataFrame({"symbol": pd.Series([key[0]], dtype=object), "ts": pd.to_datetime([us], unit="us")})

    def close(self) -> None:
        pass


def end_of_day(rows: DataFrame, close: str, delay: str = "1 hour") -> DataFrame:
    """(symbol, ts): of each symbol and day the first row at or after the closing time, as a stream in append mode.

    Rows may come late and out of order within ``delay``: a day's flag is handed out
    once the watermark has passed the day's end, so it is final, and comes once.
    Later rows of that day change nothing, and its state is gone. Days are those of UTC. A
    symbol keeps a few numbers for each day that is open. The session needs the RocksDB
    state store (``spark.sql.streaming.stateStore.providerClass``). Rows without a symbol
    or time are passed over.
    """
    minute = parse_hhmm(close, "close")
    if minute is None:
        raise ValueError("an end of day needs a closing time")
    live = rows.dropna(subset=["symbol", "ts"]).withWatermark("ts", delay).select("symbol", "ts", F.unix_micros("ts").alias("us"))
    return live.groupBy("symbol").transformWithStateInPandas(EndOfDay(minute), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
