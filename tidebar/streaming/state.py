"""The last bars of every symbol as keyed state.

``transformWithStateInPandas`` keeps a symbol's bars as a list in the state store, ordered
by time, of which only the last ``size`` stay. A symbol that has ``ready`` bars gives a row
for each batch that brings it new ones, over its last ``ready`` bars. With ``idle`` a symbol
that has had no bar for so long (in processing time) gives up its state and a last row.

The state store must be the one of RocksDB (``ROCKS`` sets it); the list is rewritten once a
batch and symbol, at most ``size`` bars. Bars that fail the checks never reach the state.
A bar that is older than all that are kept of a full symbol falls out at once; one with the time of
a kept bar stands beside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.validate import valid_bar

ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
SIZE = 1000
READY = 100
OUT = "symbol string, n bigint, first_ts timestamp, last_ts timestamp, last_close double, mean_close double, high double, low double, gone boolean"
_BAR = T.StructType([T.StructField("ts", T.TimestampType()), *(T.StructField(c, T.DoubleType()) for c in ("high", "low", "close"))])


class RingBuffer(StatefulProcessor):
    def __init__(self, size: int = SIZE, ready: int = READY, idle_ms: int | None = None):
        self.size, self.ready, self.idle_ms = size, ready, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bars = handle.getListState("bars", _BAR)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = [(r.ts, r.high, r.low, r.close) for part in rows for r in part[["ts", "high", "low", "close"]].itertuples(index=False)]
        held = [tuple(bar) for bar in self.bars.get()] if self.bars.exists() else []
        # times of the state come back as plain ones
        bars = sorted(((pd.Timestamp(t).tz_localize(None), *rest) for t, *rest in [*held, *fresh]), key=lambda b: b[0])[-self.size :]
        self.bars.put([(b[0].to_pydatetime(), *b[1:]) for b in bars])
        if self.idle_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        if len(bars) >= self.ready:
            yield self._row(key, bars, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        bars = [(pd.Timestamp(b[0]), *tuple(b)[1:]) for b in self.bars.get()] if self.bars.exists() else []
        self.bars.clear()
        if bars:
            yield self._row(key, bars, True)

    def _row(self, key, bars: list[tuple], gone: bool) -> pd.DataFrame:
        last = bars[-self.ready :]
        closes = [b[3] for b in last]
        return pd.DataFrame(
            {
                "symbol": [key[0]], "n": [len(bars)], "first_ts": [last[0][0]], "last_ts": [last[-1][0]], "last_close": [closes[-1]],
                "mean_close": [sum(closes) / len(closes)], "high": [max(b[1] for b in last)], "low": [min(b[2] for b in last)], "gone": [gone],
            }
        )

    def close(self) -> None:
        pass


def ring_buffer(bars: DataFrame, size: int = SIZE, ready: int = READY, idle_ms: int | None = None) -> DataFrame:
    """A row a symbol and batch over its last ``ready`` bars, from where it has so many on."""
    mode = "None" if idle_ms is None else "ProcessingTime"
    return bars.filter(valid_bar()).groupBy("symbol").transformWithStateInPandas(RingBuffer(size, ready, idle_ms), OUT, "Append", mode)
