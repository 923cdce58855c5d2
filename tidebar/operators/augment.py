"""Seeded augmentation of sequences: jitter, scaling, magnitude and time warp.

Input rows are (symbol, seq, features array<array<double>>) as ``sequences.tensors``
gives them. Randomness is keyed with the seed, the symbol and the sequence, so
results don't depend on partitions or order. The first ``exempt`` columns, prices
and volume, stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

KINDS = ("jitter", "scaling", "magnitude_warp", "time_warp")


def _curve(rng: np.random.Generator, n: int, knots: int, spread: float) -> np.ndarray:
    """A line through random knots around 1."""
    return np.interp(np.arange(n), np.linspace(0, n - 1, knots), rng.normal(1.0, spread, knots))


def augmented(x: np.ndarray, kind: str, rng: np.random.Generator, spread: float = 0.05, exempt: int = 0) -> np.ndarray:
    out = x.copy()
    part = x[:, exempt:]
    if not part.size:
        return out
    n = len(x)
    if kind == "jitter":
        out[:, exempt:] = part + rng.normal(0, spread, part.shape)
    elif kind == "scaling":
        out[:, exempt:] = part * rng.normal(1.0, spread, part.shape[1])
    elif kind == "magnitude_warp":
        out[:, exempt:] = part * _curve(rng, n, 4, spread)[:, None]
    elif kind == "time_warp":
        at = np.cumsum(np.maximum(_curve(rng, n, 4, spread), 0.01))
        at = (at - at[0]) / (at[-1] - at[0]) * (n - 1) if n > 1 else at * 0
        out[:, exempt:] = np.stack([np.interp(at, np.arange(n), part[:, k]) for k in range(part.shape[1])], axis=1)
    else:
        raise ValueError(f"unknown augmentation {kind!r}")
    return out


def augment(rows: DataFrame, kind: str, seed: int = 1, spread: float = 0.05, exempt: int = 0) -> DataFrame:
    """``rows`` with augmented features."""
    if kind not in KINDS:
        raise ValueError(f"unknown augmentation {kind!r}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for symbol, seq, features in zip(batch["symbol"], batch["seq"], batch["features"]):
                rng = np.random.default_rng(xxhash.xxh3_64_intdigest(f"{seed}:{kind}:{symbol}:{seq}"))
                made.append(augmented(np.array([list(r) for r in features], float), kind, rng, spread, exempt).tolist())
            yield batch.assign(features=made)

    return rows.mapInPandas(run, rows.schema)
