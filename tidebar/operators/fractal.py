"""Hurst exponent and fractal dimension of the closes before each bar.

Both need a small regression per window that window expressions can't state, so
they run in Arrow batches: bars are dealt by symbol and sorted by time, and the
windows are views on the values with the last ones of the batch before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import types as T

HURST = 100
FRACTAL = 50
STEPS = 8
_TOGETHER = 4096


def _slopes(x: np.ndarray, y: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares slope of each row of ``y`` over ``x`` where ``ok``, and how many points it has."""
    n = ok.sum(axis=1)
    y = np.where(ok, y, 0.0)
    few = np.maximum(n, 1)
    mx, my = (ok * x).sum(axis=1) / few, y.sum(axis=1) / few
    dx = np.where(ok, x - mx[:, None], 0.0)
    square = (dx * dx).sum(axis=1)
    return (dx * (y - my[:, None])).sum(axis=1) / np.where(square > 0, square, 1.0), n


def hurst(windows: np.ndarray) -> np.ndarray:
    """Rescaled-range exponent of each row, in [0.1, 0.9]; 0.4 for flat ones, 0.5 for ones with holes, 0.45 where no fit is possible."""
    whole = np.isfinite(windows).all(axis=1)
    values = np.where(whole[:, None], windows, 0.0)
    moves = np.diff(values, axis=1)
    sizes = np.arange(2, min(values.shape[1] // 4, 20) + 1)
    logs = np.zeros((len(values), len(sizes)))
    ok = np.zeros(logs.shape, bool)
    for at, size in enumerate(sizes):
        count = moves.shape[1] // size
        part = moves[:, : count * size].reshape(len(values), count, size)
        spread = part.std(axis=2)
        good = spread > 1e-12
        path = np.cumsum(part - part.mean(axis=2, keepdims=True), axis=2)
        ratio = np.where(good, (path.max(axis=2) - path.min(axis=2)) / np.where(good, spread, 1.0), 0.0).sum(axis=1) / np.maximum(good.sum(axis=1), 1)
        ok[:, at] = ratio > 0
        logs[:, at] = np.log(np.where(ratio > 0, ratio, 1.0))
    slope, n = _slopes(np.log(sizes.astype(float)), logs, ok)
    out = np.where(n < 3, 0.45, np.clip(slope, 0.1, 0.9))
    out = np.where(np.ptp(values, axis=1) < 1e-12, 0.4, out)
    return np.where(whole, out, 0.5)


def dimension(windows: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Curve-length dimension of each row, in [0.5, 2.5]; 1.5 for flat ones and ones with holes."""
    whole = np.isfinite(windows).all(axis=1)
    values = np.where(whole[:, None], windows, 0.0)
    n = values.shape[1]
    logs = np.zeros((len(values), steps))
    ok = np.zeros(logs.shape, bool)
    for k in range(1, steps + 1):
        parts = [values[:, m::k] for m in range(k)]
        lengths = [np.abs(np.diff(p, axis=1)).sum(axis=1) * (n - 1) / ((p.shape[1] - 1) * k) / k for p in parts if p.shape[1] > 1]
        mean = np.mean(lengths, axis=0) if lengths else np.zeros(len(values))
        ok[:, k - 1] = mean > 0
        logs[:, k - 1] = np.log(np.where(mean > 0, mean, 1.0))
    slope, points = _slopes(np.log(1.0 / np.arange(1, steps + 1)), logs, ok)
    flat = ~whole | (np.ptp(values, axis=1) < 1e-12) | (points < 2)
    return np.where(flat, 1.5, np.clip(slope, 0.5, 2.5))


def measures(bars: DataFrame) -> DataFrame:
    """``bars`` with ``hurst`` (of the 100 closes before) and ``fractal_dimension`` (of the 50 before); null in the warm-up."""
    columns = bars.columns
    schema = T.StructType([*bars.schema.fields, T.StructField("hurst", T.DoubleType()), T.StructField("fractal_dimension", T.DoubleType())])
    at = [columns.index(c) for c in ("symbol", "close")]

    def before(values: np.ndarray, new: int, width: int, measure) -> np.ndarray:
        """The measure of the ``width`` values before each of the last ``new`` ones; NaN where there are fewer."""
        out = np.full(new, np.nan)
        if len(values) > width:
            windows = sliding_window_view(values[:-1], width)[-new:]
            for start in range(0, len(windows), _TOGETHER):
                part = windows[start : start + _TOGETHER]
                first = new - len(windows) + start
                out[first : first + len(part)] = measure(part)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, held = object(), np.empty(0)
        for batch in batches:
            keys = np.array(batch.column(at[0]).to_pylist(), object)
            closes = batch.column(at[1]).cast(pa.float64()).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            h, d = [], []
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if keys[a] != symbol:
                    symbol, held = keys[a], np.empty(0)
                values = np.concatenate([held, closes[a:b]])
                h.append(before(values, b - a, HURST, hurst))
                d.append(before(values, b - a, FRACTAL, dimension))
                held = values[-HURST:]
            made = [pa.array(np.concatenate(x) if x else np.empty(0), from_pandas=True) for x in (h, d)]
            yield pa.record_batch([*batch.columns, *made], names=[*columns, "hurst", "fractal_dimension"])

    return bars.repartition("symbol").sortWithinPartitions("symbol", "ts").mapInArrow(run, schema)
