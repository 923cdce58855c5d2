"""Checks of bars and feature tables. Each returns a report or the rows that pass; none stops the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import div, finite
from ..functions.windows import by_symbol


def valid_bar() -> Column:
    """Finite positive prices, ordered, and a volume of 0 or more."""
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    ok = (F.col("volume") >= 0) & (F.col("high") >= F.col("low")) & (F.col("high") >= F.col("close")) & (F.col("low") <= F.col("close"))
    for p in prices:
        ok = ok & finite(p) & (p > 0)
    return F.coalesce(ok, F.lit(False))


def ohlc_report(bars: DataFrame) -> DataFrame:
    """By symbol: rows, rows that break the order of prices, negative prices and volumes, flat columns."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))  # noqa: E741
    broken = (h < l) | (h < o) | (h < c) | (l > o) | (l > c)
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(broken).alias("n_broken"),
        F.count_if(F.least(o, h, l, c) < 0).alias("n_negative_price"),
        F.count_if(F.col("volume") < 0).alias("n_negative_volume"),
        F.count_if(~valid_bar()).alias("n_invalid"),
        (F.max(c) - F.min(c) < 1e-12).alias("flat"),
    )


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def schema_info(df: DataFrame) -> DataFrame:
    """A row a column: its type, nulls and rows."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"`{c}`").alias("n_null")) for c, t in df.dtypes])
    return counts.select("_n", F.inline(rows)).select("column", "type", "n_null", F.col("_n").alias("n_rows"))


def scalars(bars: DataFrame) -> DataFrame:
    """Typical price, range, change and change in percent of each bar."""
    change = F.col("close") - F.col("open")
    return bars.withColumns({"typical": (F.col("high") + F.col("low") + F.col("close")) / 3, "range": F.col("high") - F.col("low"), "change": change, "change_pct": div(change, "open") * 100})


def timeframe(bars: DataFrame, gaps: int = 99) -> DataFrame:
    """(symbol, minutes): upper median of the first positive gaps between times; at least 1."""
    gap = F.unix_timestamp("ts") - F.lag(F.unix_timestamp("ts")).over(by_symbol())
    first = bars.withColumns({"_i": F.row_number().over(by_symbol()), "_g": gap}).filter((F.col("_i") <= gaps + 1) & (F.col("_g") > 0))
    seen = first.groupBy("symbol").agg(F.array_sort(F.collect_list("_g")).alias("g"))
    return seen.select("symbol", F.greatest(F.floor(F.get("g", F.floor(F.size("g") / 2).cast("int")) / 60), F.lit(1)).alias("minutes"))


def trim_leading(rows: DataFrame, features: list[str]) -> DataFrame:
    """Each symbol's rows from the first in which all features are finite; column ``bad`` marks later ones that are not."""
    ok = None
    for c in features:
        ok = finite(c) if ok is None else ok & finite(c)
    seen = rows.withColumn("bad", (~ok).cast("int"))
    started = F.max(1 - F.col("bad")).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    return seen.withColumn("_on", started).filter("_on = 1").drop("_on")


def recent_clean(rows: DataFrame, features: list[str], length: int) -> DataFrame:
    """(symbol, last_ts): the last bar that ends ``length`` rows without a hole."""
    ok = None
    for c in features:
        ok = finite(c) if ok is None else ok & finite(c)
    frame = by_symbol().rowsBetween(-(length - 1), 0)
    marked = rows.withColumn("_bad", (~ok).cast("int")).withColumns({"_b": F.sum("_bad").over(frame), "_n": F.count("_bad").over(frame)})
    return marked.filter((F.col("_b") == 0) & (F.col("_n") == length)).groupBy("symbol").agg(F.max("ts").alias("last_ts"))


def sanitize(c: str, low: float, high: float, default: float) -> Column:
    """Values outside [low, high], infinite ones included, become the default; NaN and null stay."""
    x = F.col(c)
    return F.when(x.isNull() | F.isnan(x), x).when((x < low) | (x > high), F.lit(default)).otherwise(x)


def feature_report(rows: DataFrame, features: list[str]) -> DataFrame:
    """A row a feature: finite, missing and infinite values, and the verdict (error over half bad, warning over a tenth)."""
    made = []
    for c in features:
        x = F.col(c)
        missing = x.isNull() | F.isnan(x)
        made += [F.count_if(missing).alias(f"m_{c}"), F.count_if(~missing & (F.abs(x) == float("inf"))).alias(f"i_{c}")]
    counts = rows.agg(F.count(F.lit(1)).alias("n"), *made)
    table = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("n_missing"), F.col(f"i_{c}").alias("n_infinite")) for c in features])
    bad = F.try_divide(F.col("n_missing") + F.col("n_infinite"), F.col("n"))
    verdict = F.when(bad > 0.5, "error").when(bad > 0.1, "warning").otherwise("ok")
    return counts.select("n", F.inline(table)).select("feature", "n_missing", "n_infinite", (F.col("n") - F.col("n_missing") - F.col("n_infinite")).alias("n_finite"), verdict.alias("verdict"))


def enough_rows(bars: DataFrame, horizon: int) -> DataFrame:
    """By symbol: rows, and whether they are at least twice the horizon."""
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) >= 2 * horizon).alias("enough"))


def prediction_readiness(bars: DataFrame, least: int) -> DataFrame:
    """By symbol: rows, bad bars, repeated times, and whether there are enough rows without repeated times to predict from."""
    n, repeated = F.count(F.lit(1)), F.count(F.lit(1)) - F.count_distinct("ts")
    bad = F.count_if(~F.coalesce(valid_bar(), F.lit(False)))
    return bars.groupBy("symbol").agg(n.alias("n_rows"), bad.alias("n_bad"), repeated.alias("n_repeated"), ((n >= least) & (repeated == 0)).alias("ready"))


def required_rows(length: int, horizon: int, warmup: int) -> int:
    """Bars that one sequence with its horizon needs after the features' warm-up."""
    return warmup + length + horizon


def check_periods(**periods: int) -> None:
    """Every period must be positive; ``fast`` below ``slow`` where both are given."""
    bad = [n for n, v in periods.items() if v < 1]
    if bad:
        raise ValueError(f"periods must be positive: {', '.join(sorted(bad))}")
    if "fast" in periods and "slow" in periods and periods["fast"] >= periods["slow"]:
        raise ValueError("the fast period must be below the slow one")


def check_schema(rows: DataFrame, expected: dict[str, str]) -> list[str]:
    """What differs from the expected columns and simple type names, in words."""
    found = dict(rows.dtypes)
    return [f"{c}: missing" if c not in found else f"{c}: {found[c]} instead of {t}" for c, t in expected.items() if found.get(c) != t]


def repeated_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """Every row of keys that occur more than once, with its ``place`` among them, from 1."""
    from pyspark.sql import Window as W

    own = W.partitionBy(*keys)
    marked = rows.withColumns({"_n": F.count(F.lit(1)).over(own), "place": F.row_number().over(own.orderBy(*keys))})
    return marked.filter("_n > 1").drop("_n")
