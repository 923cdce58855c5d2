"""Evaluation of predictions: classification, regression, trading and calibration measures, all by aggregation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import div


def confusion(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    return rows.groupBy(F.col(predicted).alias("predicted"), F.col(actual).alias("actual")).agg(F.count(F.lit(1)).alias("n"))


def per_class(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    """By class: precision, recall, F1 (0 where undefined) and support."""
    table = confusion(rows, predicted, actual)
    sides = table.select(F.col("predicted").alias("class"), F.col("n").alias("p"), F.lit(0).alias("a"), F.when(F.col("predicted") == F.col("actual"), F.col("n")).otherwise(0).alias("hit"))
    sides = sides.unionByName(table.select(F.col("actual").alias("class"), F.lit(0).alias("p"), F.col("n").alias("a"), F.lit(0).alias("hit")))
    sums = sides.groupBy("class").agg(F.sum("p").alias("p"), F.sum("a").alias("support"), F.sum("hit").alias("hit"))
    made = sums.withColumns({"precision": F.coalesce(div("hit", "p"), F.lit(0.0)), "recall": F.coalesce(div("hit", "support"), F.lit(0.0))})
    both = F.col("precision") + F.col("recall")
    return made.withColumn("f1", F.coalesce(div(2 * F.col("precision") * F.col("recall"), both), F.lit(0.0))).select("class", "precision", "recall", "f1", "support", "hit")


def classification(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    """One row: accuracy, macro F1 and F1 weighed by support."""
    c = per_class(rows, predicted, actual)
    return c.agg(
        div(F.sum("hit"), F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), div(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1")
    )


def regression(rows: DataFrame, predicted: str, actual: str, *keys: str) -> DataFrame:
    """MSE, RMSE, MAE, R2 and MAPE (over non-zero actuals, in percent)."""
    p, a = F.col(predicted), F.col(actual)
    rows = rows.filter(p.isNotNull() & a.isNotNull())
    mse = F.avg((p - a) * (p - a))
    return rows.groupBy(*keys).agg(
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        F.avg(F.abs(p - a)).alias("mae"),
        (1 - F.try_divide(mse, F.var_pop(a))).alias("r2"),
        (F.avg(F.when(a != 0, F.abs((p - a) / a))) * 100).alias("mape"),
    )


def sharpe(returns: DataFrame, c: str, *keys: str, risk_free: float = 0.0) -> DataFrame:
    """(mean - risk-free) over the sample deviation; 0 without one."""
    return returns.groupBy(*keys).agg(F.coalesce(F.try_divide(F.avg(c) - risk_free, F.stddev_samp(c)), F.lit(0.0)).alias("sharpe"))


def max_drawdown(prices: DataFrame, c: str, key: str = "symbol") -> DataFrame:
    """Largest fall below the running peak, as a share of the peak."""
    w = Window.partitionBy(key).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    seen = prices.withColumn("_peak", F.max(c).over(w))
    return seen.groupBy(key).agg(F.max(F.coalesce(div(F.col("_peak") - F.col(c), "_peak"), F.lit(0.0))).alias("max_drawdown"))


def directional_accuracy(rows: DataFrame, predicted: str, actual: str, *keys: str) -> DataFrame:
    """Share of rows whose predicted and actual changes have the same sign."""
    rows = rows.filter(F.col(predicted).isNotNull() & F.col(actual).isNotNull())
    return rows.groupBy(*keys).agg(F.avg((F.signum(predicted) == F.signum(actual)).cast("double")).alias("directional_accuracy"))


def reliability(rows: DataFrame, confidence: str, correct: str, bins: int = 15) -> DataFrame:
    """By equal-width bin: count, mean confidence and accuracy."""
    at = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def expected_calibration_error(rows: DataFrame, confidence: str, correct: str, bins: int = 15) -> DataFrame:
    """Mean distance of confidence and accuracy over the bins, weighed by count; 0 without rows."""
    r = reliability(rows, confidence, correct, bins)
    return r.agg(F.coalesce(F.try_divide(F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))), F.sum("n")), F.lit(0.0)).alias("ece"))


def correlations(rows: DataFrame, features: list[str]) -> DataFrame:
    """(a, b, r): Pearson correlation of every pair of features, in one aggregation; 0 on constant ones."""
    pairs = [(a, b) for k, a in enumerate(features) for b in features[k + 1 :]]
    r = lambda a, b: F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0))
    one = rows.agg(*[r(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])))


def select_features(table: list[tuple[str, str, float]], features: list[str], limit: float = 0.95, preferred: Callable[[str], bool] | None = None) -> list[str]:
    """Features left when, of each pair correlated beyond the limit, the one that is not ``preferred`` goes, else the longer name (the later of equals)."""
    gone: set[str] = set()
    for a, b, r in sorted(table):
        if abs(r) > limit and a not in gone and b not in gone:
            gone.add(max((a, b), key=lambda n: (not preferred(n) if preferred else False, len(n), n)))
    return [f for f in features if f not in gone]


# confidence of five-class probabilities, an array column in class order


def top(p: Column) -> Column:
    return F.array_max(p)


def calibrated_confidence(m: Column) -> Column:
    """Piecewise linear in the largest probability."""
    # Lower end, value there, slope.
    pieces = ((0.50, 0.85, 0.30), (0.42, 0.80, 0.625), (0.35, 0.70, 1.4285714286), (0.30, 0.55, 3.0), (0.25, 0.42, 2.60), (0.20, 0.25, 3.40))
    out = None
    for start, value, rise in pieces:
        made = F.lit(value) + (m - start) * rise
        out = F.when(m >= start, made) if out is None else out.when(m >= start, made)
    return out.otherwise(m * 2.0)


def entropy_confidence(p: Column) -> Column:
    """1 less the entropy over ln 5."""
    h = F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log(x)).otherwise(0.0))
    return 1 - h / F.log(F.lit(5.0))


def combined_confidence(p: Column) -> Column:
    """0.6 calibrated, 0.25 entropy and 0.15 deviation confidence, within 0.20 and 0.98."""
    m = top(p)
    spread = F.greatest((m - 0.2) / 0.8, F.lit(0.0))
    return F.least(F.greatest(calibrated_confidence(m) * 0.6 + entropy_confidence(p) * 0.25 + spread * 0.15, F.lit(0.20)), F.lit(0.98))


def softmax(logits: Column) -> Column:
    m = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - m))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def iqr_filter(rows: DataFrame, c: str, k: float = 1.5) -> DataFrame:
    """Rows whose value lies within the quartiles at places n / 4 and 3 n / 4 of the sorted values, widened by k ranges."""
    w = Window.partitionBy("symbol").orderBy(c)
    ranked = rows.withColumns({"_r": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    own = Window.partitionBy("symbol")
    at = lambda p: F.max(F.when(F.col("_r") == F.floor(F.col("_n") * p), F.col(c))).over(own)
    ranked = ranked.withColumns({"_a": at(0.25), "_b": at(0.75)})
    spread = F.col("_b") - F.col("_a")
    return ranked.filter((F.col(c) >= F.col("_a") - k * spread) & (F.col(c) <= F.col("_b") + k * spread)).drop("_r", "_n", "_a", "_b")


def ensemble(rows: DataFrame, value: str, confidence: str, *keys: str) -> DataFrame:
    """By key: the mean of a value weighed by confidence, the mean confidence and the number of predictions."""
    return rows.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col(value) * F.col(confidence)), F.sum(confidence)).alias("value"), F.avg(confidence).alias("confidence"), F.count(F.lit(1)).alias("n")
    )


def unpivoted(predictions: DataFrame) -> DataFrame:
    """Wide predictions to rows (symbol, t, prediction_type, value)."""
    kinds = [c for c in predictions.columns if c not in ("symbol", "t")]
    return predictions.unpivot(["symbol", "t"], kinds, "prediction_type", "value")
