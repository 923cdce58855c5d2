"""Audits of targets and sequences, light features, output forms and prepared sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import div
from .sequences import expected_count, members


def target_audit(targets: DataFrame) -> DataFrame:
    """By target: rows, undefined ones, classes that occur, largest and smallest share, mean strength, and whether all five occur."""
    counts = targets.groupBy("target", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("strength").alias("s"))
    held = F.col("class").isNotNull()
    per = counts.groupBy("target").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(~held, F.col("n"))), F.lit(0)).alias("n_undefined"),
        F.count("class").cast("int").alias("n_classes"),
        F.max(F.when(held, F.col("n"))).alias("_most"),
        F.min(F.when(held, F.col("n"))).alias("_least"),
        F.sum(F.when(held, F.col("n"))).alias("_all"),
        F.sum("s").alias("_s"),
    )
    return per.select("target", "n_rows", "n_undefined", "n_classes", div("_most", "_all").alias("most"), div("_least", "_all").alias("least"), div("_s", "_all").alias("strength"), (F.col("n_classes") == 5).alias("complete"))


def light_features(bars: DataFrame, length: int, step: int, horizon: int, columns: tuple[str, ...] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    """(symbol, seq, {column}_first, _middle, _last): each column at a sequence's first, middle and last bar."""
    m = members(bars, length, step, horizon).filter("part = 's'")
    places = {"first": 0, "middle": length // 2, "last": length - 1}
    made = [F.max(F.when(F.col("k") == at, F.col(c))).alias(f"{c}_{name}") for c in columns for name, at in places.items()]
    return m.filter(F.col("k").isin(list(places.values()))).groupBy("symbol", "seq").agg(*made)


def candle_sentiment(smoothing: int = 3) -> dict[str, Column]:
    """Each bar's log volume ratio to the bar before less its price change, and the mean of the last ones."""
    own = Window.partitionBy("symbol").orderBy("ts")
    before = F.lag("volume").over(own)
    score = F.when((F.col("volume") > 0) & (before > 0), F.log(F.col("volume") / before)) - F.col("ret")
    return {"candle_sentiment": score, "candle_sentiment_mean": F.avg(score).over(own.rowsBetween(-(smoothing - 1), 0))}


def output(p: Column, centres: tuple[float, ...], share: float = 0.8) -> dict[str, Column]:
    """Forms of a prediction: the expected value, the most probable one, and the least and greatest centre within the central share."""
    cumulated = F.transform(p, lambda x, k: F.aggregate(F.slice(p, 1, k + 1), F.lit(0.0), lambda s, v: s + v))
    low, high = (1 - share) / 2, (1 + share) / 2
    values = F.array(*[F.lit(float(c)) for c in centres])
    first = lambda limit: F.array_min(F.filter(F.zip_with(values, cumulated, lambda v, c: F.when(c >= limit, v)), lambda v: v.isNotNull()))
    return {
        "expected": sum((F.get(p, F.lit(k)) * c for k, c in enumerate(centres)), F.lit(0.0)),
        "likely": F.get(values, F.array_position(p, F.array_max(p)).cast("int") - 1),
        "lower": first(low),
        "upper": F.coalesce(first(high - 1e-9), F.lit(float(max(centres)))),
    }


def resampled(x: Column, n: int) -> Column:
    """An array drawn on the straight lines between its values at ``n`` even places, both ends included."""
    size = F.size(x)
    at = lambda k: k * (size - 1) / F.lit(float(n - 1))
    low = lambda k: F.least(F.floor(at(k)).cast("int"), size - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.get(x, low(k)) + (F.get(x, F.least(low(k) + 1, size - 1)) - F.get(x, low(k))) * (at(k) - low(k)))


def best_overlap(rows: int, length: int, horizon: int, wanted: int) -> float:
    """The least overlap, in steps of a bar, that gives ``wanted`` sequences; the one of single-bar steps if none does."""
    low, high = 1, length  # bars from one start to the next
    if expected_count(rows, length, high, horizon) >= wanted:
        return 0.0
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if expected_count(rows, length, middle, horizon) >= wanted else (low, middle - 1)
    return 1.0 - low / length


def prepared(tensors: DataFrame, labelled: DataFrame, split: str) -> DataFrame:
    """(symbol, seq, features, class) of one part of a split; only training parts should be augmented."""
    chosen = labelled.filter(F.col("split") == split).select("symbol", "seq", "class")
    return tensors.join(chosen, ["symbol", "seq"])


def wanted_counts(counts: DataFrame, share: float = 0.5, ratio: float = 2.0) -> DataFrame:
    """(class, n, extra): how many rows augmentation adds to each class to reach the nearest-rank percentile of the counts, at most ``ratio`` - 1 times its own."""
    every = Window.partitionBy()
    ranked = counts.withColumns({"_r": F.row_number().over(Window.orderBy("n", "class")) - 1, "_m": F.count(F.lit(1)).over(every)})
    goal = F.max(F.when(F.col("_r") == F.floor((F.col("_m") - 1) * share + 0.5), F.col("n"))).over(every)
    return ranked.select("class", "n", F.greatest(F.least(goal - F.col("n"), F.floor(F.col("n") * (ratio - 1))), F.lit(0)).cast("bigint").alias("extra"))
