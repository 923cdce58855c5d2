"""Levels, bandwidths and scores that adapt to a sequence's own spread and volatility."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import clamp, div
from .sequences import members


def variation(s_mean: Column, s_std: Column) -> Column:
    """Coefficient of variation; 0.02 around no price."""
    return F.when(s_mean > 1e-8, s_std / s_mean).otherwise(0.02)


def percentile_levels(s: DataFrame, length: int) -> DataFrame:
    """(symbol, seq, low, high): percentile shares from the balance of prices around their weighted centre and their variation.

    The centre weighs bars by the square of their place. Sequences of fewer than five bars get 0.1 and 0.9.
    """
    centre = F.aggregate(F.transform("s_path", lambda x, k: x * (k + 1) * (k + 1)), F.lit(0.0), lambda a, x: a + x) / F.lit(float(sum(k * k for k in range(1, length + 1))))
    rows = s.withColumn("_c", centre)
    below = F.size(F.filter("s_path", lambda x: x < F.col("_c"))) / F.size("s_path")
    cv = variation(F.col("s_mean"), F.col("s_std"))
    shift = F.when(cv < 0.01, 0.05).when(cv > 0.04, -0.05).otherwise(0.0)
    low = F.when(below < 0.4, 0.05).when(below > 0.6, 0.15).otherwise(0.1)
    high = F.when(below < 0.4, 0.85).when(below > 0.6, 0.95).otherwise(0.9)
    if length < 5:
        return rows.select("symbol", "seq", F.lit(0.1).alias("low"), F.lit(0.9).alias("high"))
    return rows.select("symbol", "seq", clamp(low + shift, 0.02, 0.25).alias("low"), clamp(high - shift, 0.75, 0.98).alias("high"))


def bandwidth(s_mean: Column, s_std: Column, base: float, momentum: float = 1.0) -> Column:
    """The base times the variation over 2 %, within 0.3 and 3; a fifth of a momentum factor above 1 comes on top."""
    return base * clamp(variation(s_mean, s_std) / 0.02, 0.3, 3.0) * (1 + max(momentum - 1.0, 0.0) * 0.2)


def _ranges(bars: DataFrame, length: int, step: int, horizon: int) -> DataFrame:
    """True range shares from each part's second bar, with their running mean ``atr`` inside the part."""
    own = Window.partitionBy("symbol", "seq", "part").orderBy("k")
    m = members(bars, length, step, horizon)
    before = F.lag("close").over(own)
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    m = m.withColumn("share", F.when((F.col("k") >= 1) & (tr > 0) & (F.col("close") > 0), tr / F.col("close")))
    return m.filter("k >= 1").withColumn("atr", F.avg("share").over(own.rowsBetween(Window.unboundedPreceding, 0)))


def atr_statistics(bars: DataFrame, length: int, step: int, horizon: int, sensitivity: float = 0.2) -> DataFrame:
    """(symbol, seq, mean, std, median, q25, q75, bandwidth) of a sequence's running true range share.

    Quartiles stand at floor(n / 4) and floor(3 n / 4); the bandwidth is the
    sensitivity times the variation over 0.5, within 0.4 and 2.5, and within 0.05 and 1.
    """
    rows = _ranges(bars, length, step, horizon).filter("part = 's' and atr is not null")
    s = rows.groupBy("symbol", "seq").agg(F.avg("atr").alias("mean"), F.stddev_pop("atr").alias("std"), F.array_sort(F.collect_list("atr")).alias("v"))
    n = F.size("v")
    at = lambda k: F.get("v", F.floor(k).cast("int"))
    median = F.when(n % 2 == 0, (at(n / 2 - 1) + at(n / 2)) / 2).otherwise(at(n / 2))
    cv = F.when(F.col("mean") > 1e-8, F.col("std") / F.col("mean")).otherwise(0.5)
    return s.select("symbol", "seq", "mean", "std", median.alias("median"), at(n / 4).alias("q25"), at(3 * n / 4).alias("q75"), clamp(sensitivity * clamp(cv / 0.5, 0.4, 2.5), 0.05, 1.0).alias("bandwidth"))


def volatility_score(bars: DataFrame, length: int, step: int, horizon: int, least: float = 0.005, moderate: float = 0.2, extreme: float = 0.4) -> DataFrame:
    """(symbol, seq, ratio, trend, weighted, persistence, score, class): how volatility changes from sequence to horizon.

    The score combines the ratio of mean true range shares, the change of their trend,
    the ratio of their volume-weighted means and their steadiness, in logarithms.
    """
    rows = _ranges(bars, length, step, horizon)
    at = F.col("k").cast("double")
    per = rows.groupBy("symbol", "seq", "part").agg(
        F.greatest(F.coalesce(F.avg("share"), F.lit(least)), F.lit(least)).alias("atr"),
        F.coalesce(F.try_divide(F.covar_pop("atr", at), F.var_pop(F.when(F.col("atr").isNotNull(), at))), F.lit(0.0)).alias("slope"),
        F.greatest(F.coalesce(F.try_divide(F.sum(F.col("share") * F.col("volume")), F.sum(F.when(F.col("share").isNotNull(), F.col("volume")))), F.avg("share"), F.lit(least)), F.lit(least)).alias("weighted"),
        F.when(F.count("atr") < 2, 0.5).otherwise(1 / (1 + F.when(F.avg("atr") > 0, F.stddev_pop("atr") / F.avg("atr")).otherwise(1.0))).alias("steady"),
    )
    of = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    both = per.groupBy("symbol", "seq").agg(*[of(p, c).alias(f"{p}_{c}") for p in "sh" for c in ("atr", "slope", "weighted", "steady")])
    both = both.filter("h_atr is not null").select(
        "symbol",
        "seq",
        (F.col("h_atr") / F.col("s_atr")).alias("ratio"),
        (F.col("h_slope") - F.col("s_slope")).alias("trend"),
        (F.col("h_weighted") / F.col("s_weighted")).alias("weighted"),
        ((F.col("s_steady") + F.col("h_steady")) / 2).alias("persistence"),
    )
    logs = F.log("ratio") + F.tanh(F.col("trend") * 10) * 0.3 / 0.4 + F.log("weighted") * 0.2 / 0.4 + (F.col("persistence") - 0.5) * 0.1 / 0.4
    scored = both.withColumn("score", F.exp(logs))
    x = F.col("score")
    cls = F.when(x <= 1 - extreme, 0).when(x <= 1 - moderate, 1).when(x < 1 + moderate, 2).when(x < 1 + extreme, 3).otherwise(4)
    return scored.withColumn("class", cls)


# arrays of features


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row, however often the body names it, inside lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(x: Column, of: Callable[[Column], Column] = lambda v: v) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + of(v))


def array_zscore(x: Column) -> Column:
    def scored(s: Column) -> Column:
        v, mean = s["v"], s["mean"]
        std = F.sqrt(div(_sum(v, lambda y: (y - mean) * (y - mean)), F.size(v)))
        return _let(F.greatest(std, F.lit(1e-6)), lambda d: F.transform(v, lambda y: (y - mean) / d))

    return _let(x, lambda v: _let(F.struct(v.alias("v"), div(_sum(v), F.size(v)).alias("mean")), scored))


def array_minmax(x: Column) -> Column:
    def scaled(s: Column) -> Column:
        low, high = s["low"], s["high"]
        return F.transform(s["v"], lambda y: F.when(high > low, (y - low) / (high - low)).otherwise(0.0))

    return _let(x, lambda v: _let(F.struct(v.alias("v"), F.array_min(v).alias("low"), F.array_max(v).alias("high")), scaled))


def array_robust(x: Column) -> Column:
    """Less the median, over the quartile range (nearest rank); without range only shifted."""

    def shifted(s: Column) -> Column:
        n = F.size(s["v"])
        at = lambda p: F.get(s["ordered"], F.floor((n - 1) * p + 0.5).cast("int"))
        spread = at(0.75) - at(0.25)
        parts = F.struct(at(0.5).alias("median"), F.when(spread > 0, spread).otherwise(1.0).alias("spread"))
        return _let(parts, lambda m: F.transform(s["v"], lambda y: (y - m["median"]) / m["spread"]))

    # nulls stand last: what is beyond the others' number is null
    return _let(x, lambda v: _let(F.struct(v.alias("v"), F.sort_array(F.array_compact(v)).alias("ordered")), shifted))


def sequence_moments(tensors: DataFrame, names: list[str]) -> DataFrame:
    """(symbol, seq, feature, mean, std, low, high, range) of each feature of sequences (``features``: bars of feature values)."""
    long = tensors.select("symbol", "seq", F.explode("features").alias("row")).select("symbol", "seq", F.posexplode("row").alias("k", "x"))
    s = long.groupBy("symbol", "seq", "k").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("low"), F.max("x").alias("high"))
    return s.select("symbol", "seq", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("k") + 1).alias("feature"), "mean", "std", "low", "high", (F.col("high") - F.col("low")).alias("range"))
