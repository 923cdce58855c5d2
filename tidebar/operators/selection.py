"""Features by what they tell of a class: importance from the data, and the choice of a set.

Importance comes from two aggregates over the rows, whatever their number: counts of
(feature, bin, class), at most ``bins`` + 1 times the classes for each feature, and moments of
(feature, class). The choice then runs over the table of features and their
correlations; its size follows from the schema, not from the rows.

A null or NaN feature is a bin of its own and has no part in the moments; an infinite one
lies in the outer bin. Rows without a class are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import correlations, select_features

BINS = 10


def importance(rows: DataFrame, features: list[str], target: str, bins: int = BINS) -> DataFrame:
    """(feature, information, ratio, importance), each from 0 to 1.

    ``information``: what the feature's bin (equal widths from its least to its most) tells of the
    class, over the entropy of the class; ``ratio``: variance between classes over all of it;
    ``importance``: their mean. All are 0 where a feature or the class doesn't vary.
    The rows are read twice; write them first if they are dear to make.
    """
    held = rows.filter(F.col(target).isNotNull()).select(F.col(target).alias("class"), *[F.col(f"`{f}`").cast("double").alias(f) for f in features])
    long = held.unpivot("class", features, "feature", "x").withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    finite = F.when(F.abs("x") < float("inf"), F.col("x"))
    ends = long.groupBy("feature").agg(F.min(finite).alias("low"), F.max(finite).alias("high"))
    # a row a feature
    placed = long.join(F.broadcast(ends), "feature")
    share = F.try_divide(F.col("x") - F.col("low"), F.col("high") - F.col("low"))
    place = F.when(F.col("x").isNull(), -1).when(F.col("x") == float("inf"), bins - 1).when(F.col("x") == -float("inf"), 0)
    placed = placed.withColumn("bin", place.otherwise(F.coalesce(F.least(F.floor(share * bins), F.lit(bins - 1)), F.lit(0))).cast("int"))

    value = F.when(F.abs("x") < float("inf"), F.col("x"))
    cells = placed.groupBy("feature", "class", "bin").agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("m"), F.sum(value).alias("s"), F.avg(value).alias("mean"), F.var_pop(value).alias("var"))
    own, of_class, of_bin = Window.partitionBy("feature"), Window.partitionBy("feature", "class"), Window.partitionBy("feature", "bin")
    p = F.col("n") / F.sum("n").over(own)
    parts = cells.withColumns({"p": p, "pc": F.sum("n").over(of_class) / F.sum("n").over(own), "pb": F.sum("n").over(of_bin) / F.sum("n").over(own)})
    told = parts.groupBy("feature").agg(F.sum(F.col("p") * F.log(F.col("p") / (F.col("pc") * F.col("pb")))).alias("told"), F.sum(F.col("p") * -F.log("pc")).alias("all"))
    mean = F.try_divide(F.sum("s").over(own), F.sum("m").over(own))
    mean_class = F.try_divide(F.sum("s").over(of_class), F.sum("m").over(of_class))
    spread = cells.withColumns({"a": mean, "c": mean_class}).groupBy("feature").agg(
        F.sum(F.col("m") * (F.col("c") - F.col("a")) * (F.col("c") - F.col("a"))).alias("between"),
        F.sum(F.col("m") * (F.col("var") + (F.col("mean") - F.col("a")) * (F.col("mean") - F.col("a")))).alias("total"),
    )
    both = told.join(spread, "feature")
    limited = lambda x: F.least(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    made = both.select("feature", limited(F.try_divide("told", F.when(F.col("all") > 1e-12, F.col("all")))).alias("information"), limited(F.try_divide("between", F.when(F.col("total") > 1e-12, F.col("total")))).alias("ratio"))
    return made.withColumn("importance", (F.col("information") + F.col("ratio")) / 2)


def chosen(
    rows: DataFrame, features: list[str], target: str, limit: float = 0.95, threshold: float = 0.0, least: int = 1, most: int = 50, preferred: Callable[[str], bool] | None = None, wanted: Callable[[str], bool] | None = None
) -> list[tuple[str, float]]:
    """(feature, importance) of the chosen features, the most important first, equal ones by name.

    Of each pair correlated beyond ``limit`` the one that is not ``preferred`` goes, else the longer name. Of the rest
    only ``wanted`` names stay, with others in the order given where fewer than ``least`` would be left. Then
    those of at least ``threshold`` are taken: ``most`` at most, and ``least`` if there are as many.
    """
    if not 0 < least <= most:
        raise ValueError("least and most must be in order and above 0")
    pairs = [tuple(r) for r in correlations(rows, features).collect()] if len(features) > 1 else []
    left = select_features(pairs, features, limit, preferred)
    if wanted:
        named = [f for f in left if wanted(f)]
        left = named + [f for f in left if f not in named][: max(0, least - len(named))]
    if not left:
        return []
    ranked = sorted(((r["feature"], r["importance"]) for r in importance(rows, left, target).collect()), key=lambda r: (-r[1], r[0]))
    count = sum(v >= threshold for _, v in ranked)
    return ranked[: min(max(count, least), most)]


def eliminated(rows: DataFrame, features: list[str], target: str, least: int = 5, share: float = 0.2) -> list[str]:
    """The features left when, round by round, a ``share`` of them (one at least) goes, until ``least`` are left.

    Those go whose importance less the mean correlation with the others that are still there is
    lowest, equal ones by name from the end. Importance and correlations come from the rows once.
    """
    worth = {r["feature"]: r["importance"] for r in importance(rows, features, target).collect()}
    alike: dict[tuple[str, str], float] = {}
    if len(features) > 1:
        for a, b, r in correlations(rows, features).collect():
            alike[a, b] = alike[b, a] = abs(r)
    left = list(features)
    while len(left) > least:
        def score(f: str) -> float:
            return worth.get(f, 0.0) - sum(alike[f, g] for g in left if g != f) / max(1, len(left) - 1)  # noqa: B023

        order = sorted(left, key=lambda f: (-score(f), f))
        left = order[: max(least, len(left) - max(1, int(len(left) * share)))]
    return left
