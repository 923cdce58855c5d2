"""Calibration of five-class probabilities on rows that were held out from training.

``fit`` finds the temperature of least negative log likelihood, how much each class's labels
are to be smoothed, the calibration error as a whole and by class, and the strength of
mixing. The likelihood is convex in one over the temperature, so a few passes with a
ladder of candidates each find the least; a pass returns one number a candidate, whatever the number of rows.

Probabilities and logits are array columns in class order; a class counts from 0. Rows
with a null array, a null member or no class take no part in fitting, and their
calibrated probabilities are null.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import checkpointed
from .measures import class_calibration_error
from .metrics import expected_calibration_error

CLASSES = 5
# Temperatures that are accepted; range and steps of the ladder's logarithms.
ACCEPTED = (0.5, 5.0)
LADDER, WIDTH, ROUNDS = 16, math.log(16.0), 4
# Smoothing at most; base strength of mixing and its range.
MOST_SMOOTHING = 0.3
MIXING, MIXING_RANGE = 0.2, (0.1, 0.5)
_LEAST = 1e-10


def _members(x: Column) -> list[Column]:
    return [F.get(x, F.lit(k)) for k in range(CLASSES)]


def _kept(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(_LEAST)), F.lit(1.0 - _LEAST)))  # least and greatest pass over nulls


def logits_of(p: Column) -> Column:
    """Logarithms of probabilities that are kept from 0 and 1."""
    return F.when(p.isNotNull(), F.array(*[F.log(_kept(x)) for x in _members(p)]))


def at_temperature(logits: Column, temperature: Column) -> Column:
    """Probabilities of five logits at a temperature; null without logits. Members are written out, so that the whole stays compiled code."""
    z = _members(logits)
    powers = [F.exp((x - F.greatest(*z)) / temperature) for x in z]
    total = sum(powers[1:], powers[0])
    return F.when(logits.isNotNull(), F.array(*[e / total for e in powers]))


def likelihoods(rows: DataFrame, logits: str, actual: str, temperatures: list[float]) -> list[float | None]:
    """Mean negative log likelihood of the actual class at each temperature, all in one pass; None without rows."""
    z = _members(F.col(logits))
    top = F.greatest(*z)
    off = rows.select(*[(x - top).alias(f"z{k}") for k, x in enumerate(z)], (F.get(F.col(logits), F.col(actual)) - top).alias("own"))
    names = [f"z{k}" for k in range(CLASSES)]
    made = [F.avg(F.log(sum((F.exp(F.col(n) / t) for n in names[1:]), F.exp(F.col(names[0]) / t))) - F.col("own") / t) for t in temperatures]
    return list(off.agg(*[m.alias(f"t{k}") for k, m in enumerate(made)]).first())


def ladder(middle: float, width: float) -> list[float]:
    """Temperatures around the middle, evenly spaced in their logarithms; the middle is one of them."""
    return [middle * math.exp(width * (2.0 * k / LADDER - 1.0)) for k in range(LADDER + 1)]


def best_of(rows: DataFrame, logits: str, actual: str, rounds: int = ROUNDS) -> tuple[float, float, float]:
    """(temperature, its mean negative log likelihood, that of temperature 1), the least of equals.

    Temperature 1 stays unless the best is better and from 0.5 to 5. Without rows: (1, NaN, NaN).
    """
    middle, width, found = 1.0, WIDTH, {}
    for _ in range(rounds):
        tried = ladder(middle, width)
        values = likelihoods(rows, logits, actual, tried)
        if values[0] is None:
            return 1.0, math.nan, math.nan
        found |= dict(zip(tried, values))
        middle = min(found, key=lambda t: (found[t], t))
        width *= 2.0 / LADDER
    plain = found[1.0]
    if found[middle] < plain and ACCEPTED[0] <= middle <= ACCEPTED[1]:
        return middle, found[middle], plain
    return 1.0, plain, plain


@dataclass(frozen=True)
class Calibration:
    """What ``fit`` found; ``rows`` is how many rows took part."""

    temperature: float
    nll: float
    plain_nll: float
    ece: float
    class_ece: tuple[float, ...]
    smoothing: tuple[float, ...]
    mixing: float
    rows: int

    def calibrated(self, p: Column) -> Column:
        """Probabilities at the fitted temperature."""
        return at_temperature(logits_of(p), F.lit(self.temperature))

    def label(self, actual: Column) -> Column:
        """The class as five shares, smoothed by the class's own amount; null without a class."""
        eps = F.get(F.array(*[F.lit(e) for e in self.smoothing]), actual.cast("int"))
        shares = F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda k: F.when(k == actual, 1.0 - eps).otherwise(0.0) + eps / CLASSES)
        return F.when(actual.between(0, CLASSES - 1), shares)


def usable(p: str, actual: str) -> Column:
    """Rows that can take part: five members that are numbers, and a class."""
    x = F.col(p)
    return x.isNotNull() & (F.size(x) == CLASSES) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v)) & F.col(actual).between(0, CLASSES - 1)


def smoothing_of(rows: DataFrame, p: str, actual: str) -> DataFrame:
    """(class, confidence, accuracy, smoothing): mean probability of each class, share of its rows that are found, and the amount by which to smooth.

    The amount is the excess of confidence over accuracy times one more than itself, from 0 to 0.3;
    a class without rows has accuracy 0. Equal probabilities are won by the later class.
    """
    made = rows.select(F.posexplode(p).alias("class", "q"), F.col(actual).alias("_actual"), (F.size(p) - 1 - F.array_position(F.reverse(p), F.array_max(p)) + 1).alias("_top"))
    own = F.col("_actual") == F.col("class")
    per = made.groupBy("class").agg(F.avg("q").alias("confidence"), F.coalesce(F.avg(F.when(own, (F.col("_top") == F.col("class")).cast("double"))), F.lit(0.0)).alias("accuracy"))
    gap = F.col("confidence") - F.col("accuracy")
    return per.withColumn("smoothing", F.when(gap > 0, F.least(gap * (1 + gap), F.lit(MOST_SMOOTHING))).otherwise(0.0))


def fit(rows: DataFrame, p: str, actual: str, bins: int = 15) -> Calibration:
    """Calibration from rows of probabilities and classes. Without usable rows nothing is changed (temperature 1, no smoothing) and errors are NaN."""
    held = rows.filter(usable(p, actual)).select(F.col(p).alias("p"), F.col(actual).cast("int").alias("actual"))
    logs = checkpointed(held.select(logits_of(F.col("p")).alias("z"), "actual"))  # read by every pass
    n = logs.count()
    if not n:
        return Calibration(1.0, math.nan, math.nan, math.nan, (math.nan,) * CLASSES, (0.0,) * CLASSES, MIXING, 0)
    temperature, nll, plain = best_of(logs, "z", "actual")
    scaled = checkpointed(logs.select(at_temperature(F.col("z"), F.lit(temperature)).alias("p"), "actual"))
    top = scaled.select(F.array_max("p").alias("confidence"), (F.array_position("p", F.array_max("p")) - 1 == F.col("actual")).alias("correct"))
    ece = expected_calibration_error(top, "confidence", "correct", bins).first()[0]
    by_class = {r["class"]: r["ece"] for r in class_calibration_error(scaled, "p", "actual", bins).collect()}
    amounts = {r["class"]: r["smoothing"] for r in smoothing_of(scaled, "p", "actual").collect()}
    mixing = min(max(MIXING * (1 + min(ece * 2.0, 1.0)), MIXING_RANGE[0]), MIXING_RANGE[1])
    classes = range(CLASSES)
    return Calibration(temperature, nll, plain, ece, tuple(by_class.get(k, math.nan) for k in classes), tuple(amounts.get(k, 0.0) for k in classes), mixing, n)


def entropy_of(p: Column) -> Column:
    """Entropy over its largest value, 1 for equal probabilities."""
    return sum((-_kept(x) * F.log(_kept(x)) for x in _members(p)), F.lit(0.0)) / math.log(CLASSES)


def entropy_adaptive(rows: DataFrame, logits: str, base: float, ramp: float = 1.0, *keys: str) -> DataFrame:
    """Adds ``temperature`` and ``adapted``, probabilities at a temperature that follows the mean entropy of the rows of a batch.

    A batch is named by ``keys``; without any, all rows are one. Its temperature is the base times
    0.75 for equal probabilities and up to 1.25 for certain ones, and ``ramp`` below 1 keeps it that
    much nearer to 1. Rows without logits have no part in the mean and get null. The
    mean is an aggregate by batch that is joined back, so a batch may be of any size.
    """
    mean = F.avg(entropy_of(at_temperature(F.col(logits), F.lit(base))))
    own = 1.0 + (base * (0.75 + 0.5 * (1.0 - mean)) - 1.0) * F.lit(min(ramp, 1.0))
    names = [f"_batch_{k}" for k in range(len(keys))]
    per = rows.groupBy(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)]).agg(own.alias("temperature"))
    if keys:
        same = [F.col(f"`{k}`").eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
        held = rows.join(per, same, "left").drop(*names)
    else:
        held = rows.join(F.broadcast(per))  # one row
    return held.withColumn("adapted", F.when(F.col(logits).isNotNull(), at_temperature(F.col(logits), F.col("temperature"))))
