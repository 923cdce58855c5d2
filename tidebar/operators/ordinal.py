"""Ordered classes: penalties, trading scores, sample weights, smoothing, and reports of backtests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Penalty of a prediction (column) for an actual class (row), strong down to strong up.
PENALTY = (
    (0.0, 0.3, 0.5, 1.5, 2.0),
    (0.3, 0.0, 0.3, 1.2, 1.8),
    (0.8, 0.4, 0.0, 0.4, 0.8),
    (1.8, 1.2, 0.3, 0.0, 0.3),
    (2.0, 1.5, 0.5, 0.3, 0.0),
)
# Trading score of a prediction (row) for an actual class (column).
SCORE = (
    (1.0, 0.9, 0.7, 0.0, -0.5),
    (1.0, 1.0, 0.8, 0.0, 0.0),
    (0.5, 0.6, 1.0, 0.6, 0.5),
    (0.0, 0.0, 0.8, 1.0, 1.0),
    (-0.5, 0.0, 0.7, 0.9, 1.0),
)


def looked_up(table: tuple[tuple[float, ...], ...], row: Column, column: Column) -> Column:
    return F.get(F.get(F.array(*[F.array(*[F.lit(v) for v in r]) for r in table]), row), column)


def weighted(rows: DataFrame, actual: str, predicted: str, share: float = 0.3) -> DataFrame:
    """Adds ``weight``: 1 plus a share of the penalty, scaled so that all weights sum to the number of rows."""
    raw = rows.withColumn("_w", 1 + share * looked_up(PENALTY, F.col(actual), F.col(predicted)))
    total = raw.agg(F.try_divide(F.count("_w"), F.sum("_w")).alias("_scale"))
    return raw.join(F.broadcast(total)).withColumn("weight", F.col("_w") * F.col("_scale")).drop("_w", "_scale")


def smoothed(p: Column) -> Column:
    """Probabilities mixed with a bell around the first peak, 0.7 to 0.3, scaled to 1."""
    peak = F.array_position(p, F.array_max(p)).cast("int") - 1
    raw = F.transform(p, lambda x, k: x * 0.7 + F.array_max(p) * F.exp(-0.5 * (k - peak) * (k - peak)) * 0.3)
    total = F.aggregate(raw, F.lit(0.0), lambda s, x: s + x)
    return F.transform(raw, lambda x: x / total)


def backtest_report(rows: DataFrame, predicted: str, actual: str, *keys: str) -> DataFrame:
    """By key: rows, accuracy, share within a class, mean distance and penalty, trading quality in percent, critical errors and a verdict.

    A critical error predicts the wrong side, or a strong move where none comes.
    """
    p, a = F.col(predicted), F.col(actual)
    held = rows.filter(p.between(0, 4) & a.between(0, 4))
    off = F.abs(p - a)
    critical = (F.signum(p - 2) * F.signum(a - 2) < 0) | ((F.abs(p - 2) == 2) & (a == 2))
    out = held.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((p == a).cast("double")).alias("accuracy"),
        F.avg((off <= 1).cast("double")).alias("within_one"),
        F.avg(off.cast("double")).alias("distance"),
        F.avg(looked_up(PENALTY, a, p)).alias("penalty"),
        ((F.avg(looked_up(SCORE, p, a)) + 0.5) / 1.5 * 100).alias("quality"),
        F.avg(critical.cast("double")).alias("critical"),
    )
    verdict = F.when(F.col("quality") >= 80, "good").when(F.col("quality") >= 60, "fair").otherwise("poor")
    return out.withColumn("verdict", verdict)


def report_lines(report: DataFrame, *keys: str) -> DataFrame:
    """A report as rows (keys, measure, value), to write as CSV or JSON."""
    measures = [c for c in report.columns if c not in (*keys, "verdict")]
    return report.select(*keys, *[F.col(c).cast("double").alias(c) for c in measures]).unpivot(list(keys), measures, "measure", "value")


def mixed_up(rows: DataFrame, p: str, seed: int = 5, least: float = 0.7) -> DataFrame:
    """Adds ``mixed``: each row's array mixed with that of the next row in a keyed order, with a share from ``least`` to 1 of its own.

    The order and the shares follow from digests of (symbol, t), so reruns agree. Rows are
    paired within one of 64 groups of the digest, so that no task orders all.
    """
    from pyspark.sql import Window

    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), "symbol", F.col("t").cast("string")).cast("binary"))
    keyed = rows.withColumn("_d", digest).withColumn("_g", F.conv(F.substring("_d", 1, 2), 16, 10).cast("int") % 64)
    own = Window.partitionBy("_g").orderBy("_d")
    other = F.coalesce(F.lead(p).over(own), F.first(p).over(Window.partitionBy("_g").orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)))
    share = least + (1 - least) * F.conv(F.substring("_d", 3, 6), 16, 10).cast("double") / float(1 << 24)
    both = keyed.withColumns({"_o": other, "_s": share})
    return both.withColumn("mixed", F.zip_with(p, "_o", lambda x, y: x * F.col("_s") + y * (1 - F.col("_s")))).drop("_d", "_g", "_o", "_s")
