"""Search over several parameters of all targets and horizons at once.

A first design spreads points over each target's box of parameters, every one as far from
the others as it can be, and holds the defaults and any points that are given (a grid,
say), so the result is never worse than theirs on the same rows. Rounds then propose a batch
within a region around each best point; the region grows where the round before was
better and halves where it was not. A batch of all targets and horizons is counted in one
pass over the summaries, which are written once; only class counts reach the driver.
Points follow from the seed alone.
"""

from __future__ import annotations

from dataclasses import fields, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import checkpointed
from .sequences import summaries_by_horizon
from .targets import Parameters, _plans

#: Least and most of each parameter that is searched.
SPACE = {
    "price_level": {"bandwidth": (0.05, 1.0), "neutral": (0.1, 0.6), "low": (0.02, 0.3), "high": (0.7, 0.98)},
    "stop_level": {"bandwidth": (0.05, 1.0), "neutral": (0.1, 0.6), "low": (0.02, 0.3), "high": (0.7, 0.98)},
    "direction": {"sensitivity": (0.2, 3.0), "extreme": (1.2, 4.0)},
    "volatility": {"bandwidth": (0.02, 0.8), "extreme": (1.2, 4.0)},
    "sentiment": {"sensitivity": (0.05, 2.0), "extreme": (1.2, 4.0)},
    "volume": {"bandwidth": (0.05, 1.5), "extreme": (1.2, 4.0)},
}
START, BATCH, ROUNDS, SEED = 12, 8, 5, 17
Point = dict[str, float]


def spread(pool: np.ndarray, held: np.ndarray, count: int) -> np.ndarray:
    """``count`` points of ``pool``, each the farthest from ``held`` and those before it."""
    chosen = []
    off = np.min(((pool[:, None] - held[None]) ** 2).sum(2), axis=1) if len(held) else np.full(len(pool), np.inf)
    for _ in range(count):
        at = int(off.argmax())
        chosen.append(pool[at])
        off = np.minimum(off, ((pool - pool[at]) ** 2).sum(1))
    return np.array(chosen)


def score(counts: list[int]) -> float:
    """Mean distance of the class shares from 20 % over 20, with 1000 for a missing class or ten for each time beyond ten of the smallest."""
    n = sum(counts)
    if not n:
        return float("inf")
    share = [100.0 * c / n for c in counts]
    ratio = max(share) / min(share) if min(share) else 0.0
    return sum(abs(p - 20) for p in share) / 5 / 20 + (1000.0 if not min(share) else max(0.0, ratio - 10) * 10)


def counted(held: DataFrame, length: int, tried: dict[tuple[str, int], list[Point]]) -> dict[tuple[str, int, int], list[int]]:
    """Class counts of each point of each (target, horizon), in one pass over summaries with their ``horizon``."""
    parts = []
    for target in SPACE:
        own = [(h, k, p) for (t, h), points in tried.items() if t == target for k, p in enumerate(points)]
        if not own:
            continue
        points = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(k).alias("k"), *[F.lit(float(p[n])).alias(n) for n in SPACE[target]]) for h, k, p in own])
        rows = held.withColumn("_p", F.explode(F.filter(points, lambda p: p["horizon"] == F.col("horizon"))))
        varied = replace(getattr(Parameters(), target), **{n: F.col(f"_p.{n}") for n in SPACE[target]})
        plan = _plans(length, replace(Parameters(), **{target: varied}))[target](rows)
        parts.append(plan.rows.select(F.lit(target).alias("target"), "horizon", F.col("_p.k").alias("k"), plan.cls.cast("int").alias("class")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionAll(part)
    made = rows.filter("class is not null").groupBy("target", "horizon", "k").agg(*[F.count_if(F.col("class") == c).alias(f"n{c}") for c in range(5)])
    return {(r["target"], r["horizon"], r["k"]): [r[f"n{c}"] for c in range(5)] for r in made.collect()}


def searched(
    bars: DataFrame, length: int, step: int, horizons: tuple[int, ...], given: dict[str, list[Point]] | None = None, start: int = START, batch: int = BATCH, rounds: int = ROUNDS, seed: int = SEED
) -> dict[tuple[str, int], tuple[float, Point]]:
    """(score, parameters) of the best point of each target and horizon, in ``rounds`` passes."""
    held = checkpointed(summaries_by_horizon(bars, length, step, horizons))
    best: dict[tuple[str, int], tuple[float, Point]] = {}
    radius: dict[tuple[str, int], float] = {}
    seen: dict[tuple[str, int], list[np.ndarray]] = {}
    for turn in range(rounds):
        tried: dict[tuple[str, int], list[Point]] = {}
        for number, key in enumerate((t, h) for t in SPACE for h in horizons):
            target, box = key[0], SPACE[key[0]]
            low, high = np.array([b[0] for b in box.values()]), np.array([b[1] for b in box.values()])
            scaled = lambda p: (np.array([p[n] for n in box]) - low) / (high - low)  # noqa: B023, E731
            rng = np.random.default_rng((seed, turn, number))
            pool = rng.random((256, len(box)))
            if turn == 0:
                default = getattr(Parameters(), target)
                points = [{n: float(getattr(default, n)) for n in box}, *[{n: float(p.get(n, getattr(default, n))) for n in box} for p in (given or {}).get(target, [])]]
                fresh, radius[key], seen[key] = spread(pool, np.array([scaled(p) for p in points]), start), 0.25, []
            else:
                centre, points = scaled(best[key][1]), []
                pool = np.clip(centre + (2 * pool - 1) * radius[key], 0.0, 1.0)
                fresh = spread(pool, np.array(seen[key]), batch)
            points += [dict(zip(box, (low + x * (high - low)).round(6).tolist())) for x in fresh]
            seen[key] += [scaled(p) for p in points]
            tried[key] = points
        found = counted(held, length, tried)
        for key, points in tried.items():
            scores = [(score(found.get((*key, k), [0] * 5)), k) for k in range(len(points))]
            least, k = min(scores)
            better = key not in best or least < best[key][0]
            if turn:
                radius[key] = min(0.5, radius[key] * 1.5) if better else radius[key] / 2
            if better:
                best[key] = least, points[k]
    return best


def as_rows(bars: DataFrame, found: dict[tuple[str, int], tuple[float, Point]]) -> DataFrame:
    """(target, horizon, score, parameter, value) of searched points."""
    rows = [(t, h, round(s, 6), n, v) for (t, h), (s, p) in found.items() for n, v in p.items()]
    return bars.sparkSession.createDataFrame(rows, "target string, horizon int, score double, parameter string, value double")


def parameters(found: dict[tuple[str, int], tuple[float, Point]], horizon: int) -> Parameters:
    """Parameters of all targets for one horizon."""
    own = {t: p for (t, h), (_, p) in found.items() if h == horizon}
    return Parameters(**{f.name: replace(getattr(Parameters(), f.name), **own.get(f.name, {})) for f in fields(Parameters)})
