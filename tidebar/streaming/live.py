"""Predictions of a running stream: a sink, and the stream's health."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def prediction_sink(predictions: DataFrame, folder: str, checkpoint: str, predict: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Writes each micro-batch as JSON below ``folder``, a folder a batch, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        (predict(batch) if predict else batch).write.mode("overwrite").json(f"{folder.rstrip('/')}/batch={number}")

    return predictions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Health(StreamingQueryListener):
    """Counts batches, rows and failures of the session's streams; ``unhealthy`` after more than ``most`` failures."""

    def __init__(self, most: int = 10):
        self.most, self.batches, self.rows, self.failures, self.slowest_ms = most, 0, 0, 0, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.batches += 1
        self.rows += event.progress.numInputRows
        self.slowest_ms = max(self.slowest_ms, event.progress.batchDuration)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.failures += event.exception is not None

    @property
    def unhealthy(self) -> bool:
        return self.failures > self.most

    def summary(self) -> dict[str, int | bool]:
        return {"batches": self.batches, "rows": self.rows, "failures": self.failures, "slowest_ms": self.slowest_ms, "healthy": not self.unhealthy}


def with_defaults(predictions: DataFrame, **neutral: float) -> DataFrame:
    """Missing values of predictions replaced by neutral ones."""
    return predictions.fillna(neutral)
