"""Statistics, outliers and normalisation of numeric columns, by symbol or over a whole table.

Percentiles follow the nearest-rank rule round(p (n - 1)). By symbol they come from
ranks in the symbol's window. Over a whole table (``global_rank``) approximate
percentiles give ever narrower ranges of values around each rank, until few are left to
be counted by value, so no task sorts the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import div, finite
from ..functions.windows import by_symbol
from .ranks import ranked

#: Different values that are counted on the driver.
FEW = 10_000


def column_stats(rows: DataFrame, c: str, key: str = "symbol") -> DataFrame:
    """By key: mean, population deviation, min, max, median and quartiles (nearest rank) of finite values."""
    x = rows.filter(finite(c)).select(key, F.col(c).alias("x"))
    w = Window.partitionBy(key).orderBy("x")
    places = x.withColumns({"_r": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(key))})
    at = lambda p: F.max(F.when(F.col("_r") == F.floor((F.col("_n") - 1) * p + 0.5), F.col("x")))
    return places.groupBy(key).agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), at(0.5).alias("median"), at(0.25).alias("q25"), at(0.75).alias("q75")
    )


def global_rank(df: DataFrame, c: str, shares: list[float], accuracy: int = 10_000) -> list[float | None]:
    """Exact nearest-rank percentiles of a column of any size.

    Approximate percentiles bound the value, and again within those bounds, until
    the values between are few; their counts are then summed on the driver.
    """
    x = df.filter(finite(c)).select(F.col(c).cast("double").alias("x"))
    n = x.count()
    if n == 0:
        return [None for _ in shares]
    slack = 2.0 / accuracy
    found = []
    for p in shares:
        rank, within, below, held = int((n - 1) * p + 0.5), x, 0, n
        while True:
            own = min(1.0, max(0.0, (rank - below) / max(1, held - 1)))
            low, high = within.agg(F.percentile_approx("x", [max(0.0, own - slack), min(1.0, own + slack)], accuracy)).first()[0]
            between = F.col("x").between(low, high)
            less, some, kinds = within.agg(F.count_if(F.col("x") < low), F.count_if(between), F.count_distinct(F.when(between, F.col("x")))).first()
            below, within = below + less, within.filter(between)
            if kinds <= FEW or some == held:
                break
            held = some
        counts = sorted(tuple(r) for r in within.groupBy("x").count().collect()) if kinds <= FEW else _middle(within, rank - below)
        for value, m in counts:
            below += m
            if below > rank:
                break
        found.append(value)
    return found


def _middle(x: DataFrame, rank: int) -> list[tuple[float, int]]:
    """The value of that rank where bounds no longer shrink, with a count that ends the search."""
    places = ranked(x.withColumn("tie", F.monotonically_increasing_id()), [], ["x", "tie"])
    return [(places.filter(F.col("rank") == rank).first()["x"], rank + 1)]


def with_stats(rows: DataFrame, c: str, key: str = "symbol") -> DataFrame:
    """``rows`` joined with the statistics of a column (``mean`` ... ``q75``); one small row a key."""
    return rows.join(column_stats(rows, c, key), key, "left")


def iqr_bounds(k: float = 1.5) -> tuple[Column, Column]:
    spread = F.col("q75") - F.col("q25")
    return F.when(spread > 0, F.col("q25") - k * spread), F.when(spread > 0, F.col("q75") + k * spread)


def zscore_bounds(k: float = 3.0) -> tuple[Column, Column]:
    return F.when(F.col("std") > 0, F.col("mean") - k * F.col("std")), F.when(F.col("std") > 0, F.col("mean") + k * F.col("std"))


def is_outlier(c: str, bounds: tuple[Column, Column]) -> Column:
    """Outside the bounds; constant columns have none."""
    return F.coalesce((F.col(c) < bounds[0]) | (F.col(c) > bounds[1]), F.lit(False))


def capped(c: str, bounds: tuple[Column, Column]) -> Column:
    return F.when(bounds[0].isNull() | F.col(c).isNull(), F.col(c)).otherwise(F.least(F.greatest(F.col(c), bounds[0]), bounds[1]))


def modified_z(rows: DataFrame, c: str, limit: float = 3.5, key: str = "symbol") -> DataFrame:
    """Adds ``mod_z`` = 0.6745 (x - median) / MAD and ``outlier``; null and false where the MAD is 0."""
    mid = column_stats(rows, c, key).select(key, F.col("median").alias("_med"))
    off = rows.join(mid, key, "left").withColumn("_off", F.abs(F.col(c) - F.col("_med")))
    mad = column_stats(off, "_off", key).select(key, F.col("median").alias("_mad"))
    z = F.try_divide(0.6745 * (F.col(c) - F.col("_med")), F.col("_mad"))
    return off.join(mad, key, "left").withColumn("mod_z", z).withColumn("outlier", F.coalesce(F.abs(F.col("mod_z")) > limit, F.lit(False))).drop("_med", "_off", "_mad")


def interpolated(c: str, outlier: str) -> Column:
    """Outliers replaced on the line between their nearest finite neighbours (which may be outliers themselves)."""
    back, ahead = by_symbol().rowsBetween(Window.unboundedPreceding, -1), by_symbol().rowsBetween(1, Window.unboundedFollowing)
    good = F.when(finite(c), F.struct(F.col(c).alias("v"), F.col("i").alias("i")))
    a, b = F.last(good, True).over(back), F.first(good, True).over(ahead)
    line = a["v"] + (b["v"] - a["v"]) * F.try_divide((F.col("i") - a["i"]).cast("double"), (b["i"] - a["i"]).cast("double"))
    return F.when(F.col(outlier), F.coalesce(line, a["v"], b["v"], F.col(c))).otherwise(F.col(c))


def normalized(c: str, how: str) -> Column:
    """robust, minmax or standard, from statistics columns; columns without spread stay as they are."""
    shift, scale = {
        "robust": (F.col("median"), F.col("q75") - F.col("q25")),
        "minmax": (F.col("min"), F.col("max") - F.col("min")),
        "standard": (F.col("mean"), F.col("std")),
    }[how]
    return F.when(scale > 0, div(F.col(c) - shift, scale)).otherwise(F.col(c))


def quantile_rank(c: str, key: str = "symbol") -> Column:
    """Rank among the key's values, 0 to 1; equal values share the lowest."""
    return F.percent_rank().over(Window.partitionBy(key).orderBy(c))
