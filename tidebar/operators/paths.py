"""Statistics of a sequence's path of prices, from one array a sequence.

Favourable and adverse excursion: how far the path goes above and below its start, as a
share of it, and the same for every start within it, over all bars after that start: the mean
of the largest rises and of the largest falls. Entropy: of the moves in ``bins`` equal
bins between the least and the largest, over the logarithm of ``bins``. Hurst: the slope of the
logarithm of the mean rescaled range against that of the length, over whole halves and
the whole of the moves; 0.5 where it has no value.

One pass of array functions a sequence; no window, no row a start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def later_best(path: Column, largest: bool) -> Column:
    """For each start but the last, the largest (least) value after it."""
    pick = F.greatest if largest else F.least
    backwards = F.reverse(path)
    none = F.array().cast("array<double>")
    start = F.struct(F.lit(None).cast("double").alias("best"), none.alias("all"))
    step = lambda acc, x: F.struct(pick(acc["best"], x).alias("best"), F.concat(acc["all"], F.array(acc["best"])).alias("all"))
    # what is best so far is that of the bars after x
    return F.aggregate(backwards, start, step, lambda acc: F.reverse(F.filter(acc["all"], lambda v: v.isNotNull())))


def _rescaled(moves: Column) -> Column:
    """Range of the sums of deviations over the deviation, null without spread."""
    n = F.size(moves)
    mean = F.try_divide(_sum(moves), n)
    std = F.sqrt(F.try_divide(_sum(F.transform(moves, lambda x: (x - mean) * (x - mean))), n))
    start = F.struct(F.lit(0.0).alias("at"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x - mean
        return F.struct(at.alias("at"), F.least(acc["low"], at).alias("low"), F.greatest(acc["high"], at).alias("high"))

    reach = F.aggregate(moves, start, step, lambda acc: acc["high"] - acc["low"])
    return F.when(std > 1e-12, reach / std)


def path_statistics(paths: DataFrame, path: str = "path", bins: int = 10) -> DataFrame:
    """(symbol, seq, rise, fall, mean_rise, mean_fall, entropy, hurst) of arrays of positive prices with two values at least."""
    p = F.col(path)
    first = F.get(p, F.lit(0))
    rows = paths.filter(F.size(p) > 1).select(
        "symbol", "seq", p.alias("_p"), (F.array_max(p) / first - 1).alias("rise"), (F.array_min(p) / first - 1).alias("fall"),
        later_best(p, True).alias("_up"), later_best(p, False).alias("_down"),
        F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda k: F.log(F.get(p, k) / F.get(p, k - 1))).alias("_m"),
    )
    starts = F.slice("_p", 1, F.size("_up"))
    mean = lambda best: _sum(F.zip_with(best, starts, lambda x, a: x / a - 1)) / F.size("_up")
    low, high = F.array_min("_m"), F.array_max("_m")
    bin_of = lambda x: F.least(F.floor((x - low) / (high - low) * bins), F.lit(bins - 1))
    share = lambda k: F.size(F.filter("_m", lambda x: bin_of(x) == k)) / F.size("_m")
    entropy = F.aggregate(F.sequence(F.lit(0), F.lit(bins - 1)), F.lit(0.0), lambda s, k: s - F.when(share(k) > 0, share(k) * F.log(share(k))).otherwise(0.0)) / F.log(F.lit(float(bins)))
    rows = rows.withColumns({"mean_rise": mean(F.col("_up")), "mean_fall": mean(F.col("_down")), "entropy": F.when(high > low, entropy).otherwise(0.0)})
    half = F.floor(F.size("_m") / 2).cast("int")
    halves = [_rescaled(F.slice("_m", 1, half)), _rescaled(F.slice("_m", half + 1, half))]
    rows = rows.withColumns({"_h": (halves[0] + halves[1]) / 2, "_w": _rescaled(F.slice("_m", 1, half * 2))})
    slope = F.log(F.col("_w") / F.col("_h")) / F.log(F.lit(2.0))
    return rows.withColumn("hurst", F.coalesce(F.when((F.col("_h") > 0) & (F.col("_w") > 0) & (half > 1), slope), F.lit(0.5))).select("symbol", "seq", "rise", "fall", "mean_rise", "mean_fall", "entropy", "hurst")
