"""Parabolic stop and reverse: a recurrence that switches direction.

While it rises the stop moves towards the highest high by a growing share (``step`` more with
each new high, ``most`` at last), never above the two lows before; a low below it turns it
around: it starts again from that high, and mirrored while it falls. The first bar has
none, the second sets the direction by its close against the first.

Where it turns depends on all bars before, and the steps don't compose, so a symbol's bars
go through one task in a stream with a few numbers of state. Bars that lack a high, low or
close have none and are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Stop:
    def __init__(self, step: float = 0.02, most: float = 0.2):
        self.step, self.most = step, most
        self.bars: list[tuple[float, float, float]] = []  # the last two
        self.rising = self.value = self.reached = self.rate = None

    def __call__(self, high: float | None, low: float | None, close: float | None) -> tuple[float | None, bool | None]:
        if high is None or low is None or close is None:
            return None, None
        before, self.bars = self.bars, [*self.bars[-1:], (high, low, close)]
        if not before:
            return None, None
        if self.value is None:
            h, lo, c = before[-1]
            self.rising, self.rate = close >= c, self.step
            self.value, self.reached = (lo, max(h, high)) if self.rising else (h, min(lo, low))
            return self.value, self.rising
        at = self.value + self.rate * (self.reached - self.value)
        at = min(at, *(b[1] for b in before)) if self.rising else max(at, *(b[0] for b in before))
        if low < at if self.rising else high > at:
            self.rising, at, self.reached, self.rate = not self.rising, self.reached, low if self.rising else high, self.step
        elif (high > self.reached) if self.rising else (low < self.reached):
            self.reached, self.rate = high if self.rising else low, min(self.rate + self.step, self.most)
        self.value = at
        return at, self.rising


def parabolic(bars: DataFrame, step: float = 0.02, most: float = 0.2) -> DataFrame:
    """``bars`` with ``sar`` and ``sar_rising``; rows without a time go."""
    columns = bars.columns
    at = [columns.index(c) for c in ("symbol", "high", "low", "close")]
    schema = T.StructType([*bars.schema.fields, T.StructField("sar", T.DoubleType()), T.StructField("sar_rising", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, stop = object(), None
        for batch in batches:
            out = []
            for key, high, low, close in zip(*(batch.column(k).to_pylist() for k in at)):
                if key != symbol:
                    symbol, stop = key, Stop(step, most)
                out.append(stop(high, low, close))
            yield pa.record_batch([*batch.columns, pa.array([v for v, _ in out], pa.float64()), pa.array([r for _, r in out], pa.bool_())], names=[*columns, "sar", "sar_rising"])

    return bars.filter(F.col("ts").isNotNull()).repartition("symbol").sortWithinPartitions("symbol", "ts").mapInArrow(run, schema)
