"""Scores of predictions and characteristics of series, by symbol, over ``with_base`` bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import clamp, div
from ..functions.windows import by_symbol, ever

# Factor of the composite score by market regime.
REGIME_FACTOR = {"high_volatility": 0.9, "low_volatility": 1.1, "bull": 1.05, "bear": 1.05, "medium_volatility": 1.0, "range_bound": 0.95}
# Factor of the true range by volatility label.
ATR_FACTOR = {"VERY_LOW": 0.7, "LOW": 0.85, "MEDIUM": 1.0, "HIGH": 1.3, "VERY_HIGH": 1.6}


def strategy_return(signal: Column, ret: Column) -> Column:
    """Return of a position taken by the signal from -1 to 1: 0.8 beyond 0.5, 0.4 beyond 0.2, none between."""
    size = F.when(F.abs(signal) > 0.5, 0.8).when(F.abs(signal) > 0.2, 0.4).otherwise(0.0)
    return ret * F.signum(signal) * size


def regime(b: DataFrame) -> DataFrame:
    """(symbol, regime): one of six, by the deviation of returns and the change between the halves' mean closes."""
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    half = b.withColumn("_h", F.col("i") < F.floor(n / 2))
    s = half.groupBy("symbol").agg(F.stddev_pop("ret").alias("v"), F.avg(F.when(F.col("_h"), F.col("close"))).alias("a"), F.avg(F.when(~F.col("_h"), F.col("close"))).alias("c"), F.count(F.lit(1)).alias("n"))
    v, t = F.coalesce("v", F.lit(0.02)), F.coalesce(F.try_divide(F.col("c") - F.col("a"), F.col("a")), F.lit(0.0))
    named = F.when(F.col("n") < 20, "medium_volatility").when(v > 0.05, "high_volatility").when(v < 0.02, "low_volatility").when(t > 0.1, "bull").when(t < -0.1, "bear").when(F.abs(t) < 0.05, "range_bound").otherwise("medium_volatility")
    return s.select("symbol", named.alias("regime"), v.alias("volatility"), t.alias("trend"))


def objective_scores(b: DataFrame, predicted: str, actual: str, signal: str) -> DataFrame:
    """By symbol: scores from 0 to 1 of errors, direction, Sharpe ratio and drawdown, and their composite with the regime's factor.

    Compounding runs as a sum of logarithms; a loss of everything ends it.
    """
    rows = b.withColumn("_g", strategy_return(clamp(signal, -1, 1), F.col("ret")))
    rows = rows.withColumn("_v", F.exp(F.sum(F.when(F.col("_g") > -1, F.log1p("_g")).otherwise(0.0)).over(ever())))
    rows = rows.withColumns({"_p": F.greatest(F.max("_v").over(ever()), F.lit(1.0)), "_dp": F.col(predicted) - F.lag(predicted).over(by_symbol()), "_da": F.col(actual) - F.lag(actual).over(by_symbol())})
    off = F.col(predicted) - F.col(actual)
    scores = rows.groupBy("symbol").agg(
        (1 / (1 + F.avg(F.abs(off)))).alias("mae"),
        (1 / (1 + F.sqrt(F.avg(off * off)))).alias("rmse"),
        (1 / (1 + F.avg(F.when(F.abs(F.col(actual)) > 1e-8, F.abs(off / F.col(actual)))))).alias("mape"),
        F.coalesce(clamp((F.try_divide(F.avg("_g"), F.stddev_pop("_g")) + 1) / 3, 0, 1), F.lit(0.0)).alias("sharpe"),
        (1 - F.max(F.least((F.col("_p") - F.col("_v")) / F.col("_p"), F.lit(1.0)))).alias("drawdown"),
        F.avg(F.when(F.col("_dp").isNotNull() & F.col("_da").isNotNull(), (F.signum("_dp") == F.signum("_da")).cast("double"))).alias("direction"),
    )
    factor = F.lit(1.0)
    for name, value in REGIME_FACTOR.items():
        factor = F.when(F.col("regime") == name, value).otherwise(factor)
    total = F.col("mae") * 0.2 + F.col("direction") * 0.3 + F.col("sharpe") * 0.25 + F.col("drawdown") * 0.25
    return scores.join(regime(b).select("symbol", "regime"), "symbol").withColumn("composite", clamp(total * factor, 0, 1))


def class_calibration_error(rows: DataFrame, p: str, actual: str, bins: int = 15) -> DataFrame:
    """(class, ece): each class against the rest, over equal-width bins of its probability."""
    long = rows.select(F.posexplode(p).alias("class", "q"), actual)
    at = F.least(F.floor(F.col("q") * bins), F.lit(bins - 1)).cast("int")
    per = long.groupBy("class", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("q").alias("q"), F.avg((F.col(actual) == F.col("class")).cast("double")).alias("a"))
    return per.groupBy("class").agg(F.try_divide(F.sum(F.col("n") * F.abs(F.col("q") - F.col("a"))), F.sum("n")).alias("ece"))


def _nearest(c: str, *shares: float) -> list[Column]:
    """Nearest-rank values round(p (n - 1)) as aggregates; needs ``_r`` (from 0) and ``_n``."""
    return [F.max(F.when(F.col("_r") == F.floor((F.col("_n") - 1) * p + 0.5), F.col(c))) for p in shares]


def adaptive_bounds(b: DataFrame, c: str = "close") -> DataFrame:
    """By symbol: extremes, five percentiles, and from the last value the fall, rise and range in percent; ``iqr`` in percent of the median."""
    own = Window.partitionBy("symbol")
    rows = b.withColumns({"_r": F.row_number().over(own.orderBy(c)) - 1, "_n": F.count(F.lit(1)).over(own)})
    names = ("p10", "p25", "p50", "p75", "p90")
    s = rows.groupBy("symbol").agg(F.min(c).alias("low"), F.max(c).alias("high"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.max_by(c, "ts").alias("last"), *[x.alias(n) for x, n in zip(_nearest(c, 0.1, 0.25, 0.5, 0.75, 0.9), names)])
    last = F.col("last")
    percent = lambda x: F.when(last > 0, F.greatest(x, F.lit(0.0)) / last * 100).otherwise(0.0)
    return s.withColumns(
        {"iqr": F.coalesce(div(F.col("p75") - F.col("p25"), "p50") * 100, F.lit(0.0)), "fall": percent(last - F.col("low")), "rise": percent(F.col("high") - last), "range": percent(F.col("high") - F.col("low"))}
    )


def within_deviations(x: Column, mean: Column, std: Column, k: float = 3.0) -> Column:
    """A value brought back to k deviations from the mean; unchanged without deviation."""
    return F.when(std > 0, F.greatest(F.least(x, mean + k * std), mean - k * std)).otherwise(x)


def balance_confidence(targets: DataFrame, quality: float = 1.0) -> DataFrame:
    """(target, balance), and the mean of balances and data quality within 0.1 and 0.95: entropy of the classes over its largest value, 0.1 for a single class."""
    counts = targets.filter("class is not null").groupBy("target", "class").agg(F.count(F.lit(1)).alias("n"))
    share = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("target")))
    per = share.groupBy("target").agg((-F.sum(F.col("p") * F.log2("p"))).alias("h"), F.count(F.lit(1)).alias("k"))
    per = per.select("target", F.when(F.col("k") <= 1, 0.1).otherwise(F.try_divide(F.col("h"), F.log2("k"))).alias("balance"))
    every = Window.partitionBy()
    return per.withColumn("overall", clamp((F.sum("balance").over(every) + quality) / (F.count(F.lit(1)).over(every) + 1), 0.1, 0.95))


def five_numbers(rows: DataFrame, c: str, key: str) -> DataFrame:
    """By key: count, least, quartiles at floor(n / 4), floor(n / 2) and floor(3 n / 4) of the sorted values, and most."""
    own = Window.partitionBy(key)
    held = rows.filter(F.col(c).isNotNull()).withColumns({"_r": F.row_number().over(own.orderBy(c)) - 1, "_n": F.count(F.lit(1)).over(own)})
    at = lambda k: F.max(F.when(F.col("_r") == F.floor(F.col("_n") * k / 4), F.col(c)))
    return held.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(c).alias("least"), at(1).alias("q1"), at(2).alias("median"), at(3).alias("q3"), F.max(c).alias("most"))


def linear_correction(rows: DataFrame, p: str, actual: str, classes: int = 5) -> DataFrame:
    """Adds ``corrected``: each class's probability on the line fitted to its outcomes, at least 0.001, scaled to 1.

    A class whose probability doesn't vary keeps its mean outcome. One row of lines is joined.
    """
    hit = lambda k: (F.col(actual) == k).cast("double")
    q = lambda k: F.get(p, F.lit(k))
    slopes = [F.coalesce(F.try_divide(F.covar_pop(q(k), hit(k)), F.var_pop(q(k))), F.lit(0.0)).alias(f"_b{k}") for k in range(classes)]
    means = [x for k in range(classes) for x in (F.avg(q(k)).alias(f"_m{k}"), F.avg(hit(k)).alias(f"_h{k}"))]
    lines = rows.agg(*slopes, *means).select(F.array(*[F.struct(F.col(f"_b{k}").alias("b"), (F.col(f"_h{k}") - F.col(f"_b{k}") * F.col(f"_m{k}")).alias("a")) for k in range(classes)]).alias("_lines"))
    both = rows.join(F.broadcast(lines))
    raw = F.zip_with(p, "_lines", lambda x, l: F.greatest(l["a"] + l["b"] * x, F.lit(0.001)))  # noqa: E741
    total = F.aggregate(raw, F.lit(0.0), lambda s, x: s + x)
    return both.withColumn("corrected", F.transform(raw, lambda x: x / total)).drop("_lines")


def best_temperature(grid: DataFrame) -> DataFrame:
    """The temperature of the least ``nll`` from rows (temperature, nll), from 0.5 to 5 and only if better than 1; else 1."""
    held = grid.filter((F.col("temperature") >= 0.5) & (F.col("temperature") <= 5.0))
    best = held.agg(F.min(F.struct("nll", "temperature")).alias("best"), F.max(F.when(F.col("temperature") == 1.0, F.col("nll"))).alias("plain"))
    better = F.col("best.nll") < F.col("plain")
    return best.select(F.when(better, F.col("best.temperature")).otherwise(1.0).alias("temperature"), F.when(better, F.col("best.nll")).otherwise(F.col("plain")).alias("nll"), "plain")


def characteristics(b: DataFrame, c: str = "close") -> DataFrame:
    """By symbol: volatility, trend per bar over the mean, quality, share beyond three deviations, autocorrelation of returns, share of zeros.

    Quality is 1 less half of the missing share and 0.3 of the share of repeated times.
    """
    own = Window.partitionBy("symbol")
    rows = b.withColumns({"_m": F.avg(c).over(own), "_s": F.stddev_pop(c).over(own), "_r1": F.lag("ret").over(by_symbol())})
    pair = F.when(F.col("_r1").isNotNull(), F.col("ret"))
    late = F.when(F.col("ret").isNotNull(), F.col("_r1"))
    trend = F.try_divide(F.try_divide(F.covar_pop(c, F.col("i").cast("double")), F.var_pop(F.col("i").cast("double"))), F.avg(c))
    return rows.groupBy("symbol").agg(
        F.stddev_pop("ret").alias("volatility"),
        trend.alias("trend"),
        (1 - 0.5 * F.avg(F.col(c).isNull().cast("double")) - 0.3 * (1 - F.count_distinct("ts") / F.count(F.lit(1)))).alias("quality"),
        F.avg(F.coalesce((F.abs(F.col(c) - F.col("_m")) > 3 * F.col("_s")), F.lit(False)).cast("double")).alias("extreme"),
        F.try_divide(F.covar_pop(pair, late), F.stddev_pop(pair) * F.stddev_pop(late)).alias("autocorrelation"),
        F.avg((F.col(c) == 0).cast("double")).alias("zeros"),
    )


def sequence_atr(b: DataFrame, n: int) -> Column:
    """Mean true range of the last n bars in percent of their closes; the first bar of a symbol counts its range."""
    share = F.coalesce(F.col("tr"), F.col("high") - F.col("low")) / F.when(F.col("close") > 0, F.col("close")) * 100
    return F.avg(share).over(by_symbol().rowsBetween(-(n - 1), 0))


def adjusted_atr(atr: Column, label: Column) -> Column:
    """A range in percent by the predicted volatility: tighter where it is low, wider where it is high; any other label leaves it."""
    out = None
    for name, factor in ATR_FACTOR.items():
        out = F.when(label == name, atr * factor) if out is None else out.when(label == name, atr * factor)
    return out.otherwise(atr)


def pinball(actual: Column, quantile: Column, share: float) -> Column:
    """Loss of a quantile prediction."""
    off = actual - quantile
    return F.greatest(share * off, (share - 1) * off)
