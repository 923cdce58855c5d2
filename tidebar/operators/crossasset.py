"""Features of the whole market at a time, computed once per time and joined back to every symbol.

Symbols are aligned by time, so gaps and late starts don't shift one against
another. Rows of a symbol that lack the look-back give no contribution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import div, safe_corr
from ..functions.windows import exc, lag, with_base


def dominance(bars: DataFrame, base: str) -> DataFrame:
    """(ts, dominance): the base symbol's volume over that of all, 0 without volume."""
    share = F.try_divide(F.sum(F.when(F.col("symbol") == base, F.col("volume")).otherwise(0.0)), F.sum("volume"))
    return bars.groupBy("ts").agg(F.coalesce(share, F.lit(0.0)).alias("dominance"))


def price_ratio(bars: DataFrame, a: str, b: str) -> DataFrame:
    """(ts, price_ratio): close of a over close of b, where both exist."""
    of = lambda s: F.max(F.when(F.col("symbol") == s, F.col("close")))
    return bars.groupBy("ts").agg(of(a).alias("_a"), of(b).alias("_b")).select("ts", div("_a", "_b").alias("price_ratio")).filter("price_ratio is not null")


def sentiment(bars: DataFrame, n: int = 20) -> DataFrame:
    """(ts, sentiment): mean over symbols of 0.5, moved by return times volume spike unless prices are volatile."""
    b = with_base(bars)
    mean_volume = F.avg("volume").over(exc(n))
    b = b.withColumns(
        {
            "_held": F.count("close").over(exc(n)) == n,
            "_spike": F.coalesce(div("volume", mean_volume), F.lit(1.0)),
            "_vol": div(F.stddev_pop("close").over(exc(n)), F.avg("close").over(exc(n))),
            "_move": F.when(F.col("c1") > 0, F.col("ret")).otherwise(0.0),
        }
    )
    push = F.col("_move") * F.col("_spike")
    score = (
        F.when(F.col("_vol") > 0.05, 0.5)
        .when((F.col("_move") > 0) & (F.col("_spike") > 1.5), 0.5 + F.least(push, F.lit(0.5)))
        .when((F.col("_move") < 0) & (F.col("_spike") > 1.5), 0.5 + F.greatest(push, F.lit(-0.5)))
        .otherwise(0.5)
    )
    return b.filter("_held").groupBy("ts").agg(F.avg(score).alias("sentiment"))


def mean_correlation(bars: DataFrame, n: int = 20) -> DataFrame:
    """(ts, correlation): mean Pearson correlation of all symbol pairs over their n common bars before.

    The number of symbols is a market's, not the data's: pairs are joined on time.
    """
    left = bars.select("ts", F.col("symbol").alias("s1"), F.col("close").alias("x"))
    right = bars.select("ts", F.col("symbol").alias("s2"), F.col("close").alias("y"))
    frame = Window.partitionBy("s1", "s2").orderBy("ts").rowsBetween(-n, -1)
    pairs = left.join(right, "ts").filter("s1 < s2").withColumn("_c", F.when(F.count("x").over(frame) == n, safe_corr("x", "y", frame)))
    return pairs.groupBy("ts").agg(F.avg("_c").alias("correlation")).filter("correlation is not null")


def market_momentum(bars: DataFrame, n: int = 10) -> DataFrame:
    """(ts, momentum): tanh of the mean relative change over n bars."""
    b = bars.withColumn("_m", div(F.col("close") - lag("close", n), lag("close", n)))
    return b.groupBy("ts").agg(F.tanh(F.avg("_m")).alias("momentum")).filter("momentum is not null")


def volatility_clusters(bars: DataFrame, short: int = 10, long: int = 20) -> DataFrame:
    """(ts, clustering): mean ratio of recent to longer deviation of returns, its distance from 1, at most 1."""
    b = with_base(bars)
    frame = lambda k: Window.partitionBy("symbol").orderBy("ts").rowsBetween(-(k - 1), -1)
    held = F.count("ret").over(frame(long)) == long - 1
    b = b.withColumn("_r", F.when(held, div(F.stddev_pop("ret").over(frame(short)), F.stddev_pop("ret").over(frame(long)))))
    return b.groupBy("ts").agg(F.avg("_r").alias("_m")).filter("_m is not null").select("ts", F.least(F.abs(F.col("_m") - 1), F.lit(1.0)).alias("clustering"))


def with_market(bars: DataFrame, base: str, second: str) -> DataFrame:
    """``bars`` with all market features as ``cross_*`` columns, 0 where missing."""
    made: list[tuple[DataFrame, str]] = [
        (dominance(bars, base), "dominance"),
        (price_ratio(bars, second, base), "price_ratio"),
        (sentiment(bars), "sentiment"),
        (mean_correlation(bars), "correlation"),
        (market_momentum(bars), "momentum"),
        (volatility_clusters(bars), "clustering"),
    ]
    market = made[0][0]
    for table, _ in made[1:]:
        market = market.join(table, "ts", "left")
    named: list[Column] = [F.coalesce(F.col(n), F.lit(0.0)).alias(f"cross_{n}") for _, n in made]
    out = bars.join(market.select("ts", *named), "ts", "left")
    return out.select(*bars.columns, *[f"cross_{n}" for _, n in made])


def require(bars: DataFrame, symbols: list[str], least: int = 2) -> list[str]:
    """The named symbols that the bars have; fewer than ``least`` are an error. One row a symbol is looked at."""
    found = {r[0] for r in bars.filter(F.col("symbol").isin(symbols)).select("symbol").distinct().collect()}
    if len(found) < least:
        raise ValueError(f"{least} symbols are needed, found {sorted(found)}")
    return [s for s in symbols if s in found]
