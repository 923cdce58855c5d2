"""How diverse a set of sequences is: in time, in bar shapes and in market conditions; weighted scores and farthest-first selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import checkpointed


def temporal(rows: DataFrame, *keys: str) -> DataFrame:
    """1 less the coefficient of variation of the gaps between starts, 0 at least."""
    gap = F.col("seq") - F.lag("seq").over(Window.partitionBy(*keys).orderBy("seq"))
    seen = rows.withColumn("_g", gap.cast("double"))
    score = F.greatest(1 - F.coalesce(F.try_divide(F.stddev_pop("_g"), F.avg("_g")), F.lit(0.0)), F.lit(0.0))
    return seen.groupBy(*keys).agg(score.alias("temporal"))


def feature_space(bars: DataFrame, features: list[str], bins: int = 5) -> DataFrame:
    """By feature: 1 less the mean distance of the shares of equal-width bins from even, in units of the worst case."""
    bounds = bars.agg(*[F.min(c).alias(f"lo_{c}") for c in features], *[F.max(c).alias(f"hi_{c}") for c in features])
    long = bars.join(F.broadcast(bounds)).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("feature"),
                        F.least(F.floor(F.try_divide((F.col(c) - F.col(f"lo_{c}")) * bins, F.col(f"hi_{c}") - F.col(f"lo_{c}"))), F.lit(bins - 1)).alias("bin"),
                    )
                    for c in features
                ]
            )
        )
    )
    counts = long.groupBy("feature").agg(F.count("bin").alias("n"), *[F.count_if(F.col("bin") == k).alias(f"n{k}") for k in range(bins)])
    off = sum((F.abs(F.col(f"n{k}") / F.col("n") - 1.0 / bins) for k in range(bins)), F.lit(0.0))
    return counts.select("feature", (1 - off / (2.0 - 2.0 / bins)).alias("diversity"))


def market_conditions(summary: DataFrame) -> DataFrame:
    """Counts of bear, side and bull sequences, by the change of the weighted close against its 33rd and 67th nearest-rank percentiles."""
    move = F.try_divide(F.col("h_wclose") - F.col("s_wclose"), F.col("s_wclose"))
    rows = summary.select("symbol", move.alias("m"))
    own = Window.partitionBy("symbol")
    ranked = rows.withColumns({"_r": F.row_number().over(own.orderBy("m")) - 1, "_n": F.count(F.lit(1)).over(own)})
    at = lambda p: F.max(F.when(F.col("_r") == F.floor((F.col("_n") - 1) * p + 0.5), F.col("m"))).over(own)
    ranked = ranked.withColumns({"_a": at(0.33), "_b": at(0.67)})
    kind = F.when(F.col("m") < F.col("_a"), "bear").when(F.col("m") > F.col("_b"), "bull").otherwise("side")
    return ranked.groupBy("symbol", kind.alias("market")).agg(F.count(F.lit(1)).alias("n"))


def repeated_sequences(rows: DataFrame, features: str = "features") -> DataFrame:
    """Groups of sequences with equal feature arrays: the smallest start and the number in each group of two or more."""
    marked = rows.select("symbol", "seq", F.md5(F.to_json(F.struct(features)).cast("binary")).alias("mark"))
    return marked.groupBy("symbol", "mark").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n")).filter("n > 1")


# The parts of the weighted score: features, time, market, target.
WEIGHTS = (0.3, 0.25, 0.25, 0.2)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _unit(v: Column) -> Column:
    """The array over its length; null without length."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm))


def conditions(features: Column) -> Column:
    """Mean true range, slope of the close, mean volume over mean close, and the range of prices over it, of bars (open, high, low, close, volume) as an array of arrays."""
    of = lambda k: F.transform(features, lambda r: r[k])
    close, volume, n = of(3), of(4), F.size(features)
    mean = _sum(close) / n
    steps = F.sequence(F.lit(1), n - 1)
    ranges = F.transform(
        steps, lambda k: F.greatest(features[k][1] - features[k][2], F.abs(features[k][1] - features[k - 1][3]), F.abs(features[k][2] - features[k - 1][3]))
    )
    middle = (n - 1) / 2
    slope = _sum(F.transform(close, lambda y, k: (k - middle) * (y - mean))) / _sum(F.transform(close, lambda y, k: (k - middle) * (k - middle)))
    spread = F.try_divide(F.array_max(of(1)) - F.array_min(of(2)), mean)
    return F.array(F.when(n > 1, _sum(ranges) / (n - 1)).otherwise(0.0), F.when(n > 1, slope).otherwise(0.0), F.when(mean > 0, _sum(volume) / n / mean).otherwise(0.0), spread)


def described(tensors: DataFrame) -> DataFrame:
    """(symbol, seq, unit, market): sequences of bars (open, high, low, close, volume) as one array of length 1, and their market conditions as another."""
    return tensors.select("symbol", "seq", _unit(F.flatten("features")).alias("unit"), _unit(conditions(F.col("features"))).alias("market"))


def weighted(rows: DataFrame, size: int, *keys: str) -> DataFrame:
    """Rows (keys, symbol, seq, class, unit, market) with ``feature``, ``temporal``, ``market_part``, ``target`` and ``composite``, each 0 to 1.

    Feature and market: the mean cosine distance to all others of the group, from the sum of all
    arrays of length 1: no pairs. Temporal: the distance of the start from the middle of the group's range in
    half ranges. Target: 0.2 to 0.8, more for rarer classes. A row alone is 1, 1, 0.5 and 0.2. Arrays without length are left out of the
    sums and are 1. ``size``: numbers in ``unit``. Means are held within 0 and 1, not each pair.
    """
    sums = [F.sum(F.get("unit", F.lit(k))).alias(f"_u{k}") for k in range(size)] + [F.sum(F.get("market", F.lit(k))).alias(f"_m{k}") for k in range(4)]
    groups = rows.groupBy(*keys).agg(F.min("seq").alias("_low"), F.max("seq").alias("_high"), F.count(F.lit(1)).alias("_n"), F.count("unit").alias("_nu"), F.count("market").alias("_nm"), *sums)
    groups = groups.withColumns({"_su": F.array(*[f"_u{k}" for k in range(size)]), "_sm": F.array(*[f"_m{k}" for k in range(4)])}).select(*keys, "_low", "_high", "_n", "_nu", "_nm", "_su", "_sm")
    same = rows.groupBy(*keys, "class").agg(F.count(F.lit(1)).alias("_same"))
    near = lambda v, total: _sum(F.zip_with(v, total, lambda x, y: x * y)) - _sum(F.transform(v, lambda x: x * x))
    # those without length are at 1 from all
    part = lambda v, total, n, alone: F.when(F.col("_n") == 1, alone).when(F.col(v).isNull(), 1.0).otherwise(F.greatest(F.least(1 - near(F.col(v), F.col(total)) / (F.col("_n") - 1), F.lit(1.0)), F.lit(0.0)))
    half = F.floor((F.col("_high") - F.col("_low")) / 2)
    middle = F.floor((F.col("_high") + F.col("_low")) / 2)
    both = rows.join(groups, list(keys)).join(same, [*keys, "class"])
    both = both.withColumns(
        {
            "feature": part("unit", "_su", "_nu", 1.0),
            "temporal": F.when(half > 0, F.least(F.abs(F.col("seq") - middle) / half, F.lit(1.0))).otherwise(1.0),
            "market_part": part("market", "_sm", "_nm", 0.5),
            "target": 0.2 + 0.6 * (1 - F.col("_same") / F.col("_n")),
        }
    )
    total = sum((w * F.col(c) for w, c in zip(WEIGHTS, ("feature", "temporal", "market_part", "target"))), F.lit(0.0))
    return both.withColumn("composite", total).drop("_low", "_high", "_n", "_nu", "_nm", "_su", "_sm", "_same")


def farthest_first(rows: DataFrame, count: int, key: str) -> DataFrame:
    """Of each group ``count`` rows (the key, symbol, seq, place; each column once): the strongest, then round by round the one that is farthest from all taken before.

    A distance is the weighted sum of the cosine distances of ``unit`` and ``market``, of the starts over the group's
    range, and 1 for another class. One pass a round: rows meet their group's picks, of which there are at
    most ``count`` a group; ties go to the smaller (symbol, seq). A null key is a group of its own. Picks are kept in the shared folder.
    """
    ends = rows.groupBy(F.col(key).alias("_of")).agg((F.max("seq") - F.min("seq")).alias("_span"))
    held = checkpointed(rows.join(ends, F.col(key).eqNullSafe(F.col("_of"))).select("_of", "symbol", "seq", "class", "strength", "unit", "market", "_span"))
    cosine = lambda a, b: F.coalesce(1 - _sum(F.zip_with(a, b, lambda x, y: x * y)), F.lit(1.0))

    def off(p: Column) -> Column:
        time = F.coalesce(F.try_divide(F.abs(F.col("seq") - p["seq"]), F.col("_span")), F.lit(0.0))
        other = F.when(F.col("class").eqNullSafe(p["class"]), 0.0).otherwise(1.0)
        return WEIGHTS[0] * cosine(F.col("unit"), p["unit"]) + WEIGHTS[1] * time + WEIGHTS[2] * cosine(F.col("market"), p["market"]) + WEIGHTS[3] * other

    picks = held.limit(0).select("_of", F.struct("symbol", "seq", "class", "unit", "market").alias("pick"), F.lit(0).alias("place"))
    for place in range(count):
        if not place:
            ranked_ = held.withColumn("_by", F.coalesce("strength", F.lit(-1.0)))
        else:
            taken = picks.groupBy(F.col("_of").alias("_to")).agg(F.collect_list("pick").alias("_picks"))
            met = held.join(taken, F.col("_of").eqNullSafe(F.col("_to")))
            free = ~F.exists("_picks", lambda p: p["symbol"].eqNullSafe(F.col("symbol")) & p["seq"].eqNullSafe(F.col("seq")))
            ranked_ = met.filter(free).withColumn("_by", F.array_min(F.transform("_picks", off)))
        best = F.min(F.struct((-F.round("_by", 12)).alias("by"), "symbol", "seq", F.struct("symbol", "seq", "class", "unit", "market").alias("pick"))).alias("best")
        found = checkpointed(ranked_.groupBy("_of").agg(best).select("_of", "best.pick", F.lit(place).alias("place")))
        if found.isEmpty():
            break
        picks = picks.unionAll(found)
    group = [F.col("_of").alias(key)] if key not in ("symbol", "seq") else []
    return picks.select(*group, "pick.symbol", "pick.seq", "place")
