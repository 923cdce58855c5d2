"""From class probabilities to predictions: expected moves, labels, calibration, statistics of a symbol's series, sinks.

Probabilities are array columns of five in class order, worst first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import div
from ..functions.windows import by_symbol, exc, inc

MOVES = (-1.5, -0.5, 0.0, 0.5, 1.5)
LABELS = ("dump", "down", "sideways", "up", "pump")


def _dot(p: Column, weights: tuple[float, ...]) -> Column:
    return sum((F.get(p, F.lit(k)) * w for k, w in enumerate(weights) if w), F.lit(0.0))


def direction_metrics(p: Column, bandwidth: Column) -> dict[str, Column]:
    """Expected move, upside, downside, their ratio (10 at most) and the probability of a break-out."""
    up = _dot(p, tuple(max(m, 0.0) for m in MOVES)) * bandwidth
    down = -_dot(p, tuple(min(m, 0.0) for m in MOVES)) * bandwidth
    return {
        "expected_move": _dot(p, MOVES) * bandwidth,
        "upside": up,
        "downside": down,
        "risk_reward": F.least(F.coalesce(div(up, down), F.lit(10.0)), F.lit(10.0)),
        "breakout": F.get(p, F.lit(0)) + F.get(p, F.lit(4)),
    }


def label(p: Column, names: tuple[str, ...] = LABELS) -> Column:
    """Name of the most probable class, the first of equals."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position(p, F.array_max(p)).cast("int"))


def gini(p: Column) -> Column:
    """1 less the sum of squares, over its largest value for five classes."""
    return (1 - F.aggregate(p, F.lit(0.0), lambda a, x: a + x * x)) / 0.8


def temperature_nll(rows: DataFrame, logits: str, actual: str, temperatures: tuple[float, ...]) -> DataFrame:
    """Mean negative log likelihood of the actual class (from 0) for each temperature; all candidates in one pass."""
    grid = rows.select(logits, actual, F.explode(F.array(*[F.lit(float(t)) for t in temperatures])).alias("temperature"))
    z = F.transform(logits, lambda x: x / F.col("temperature"))
    m = F.array_max(z)
    total = F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - m))
    return grid.groupBy("temperature").agg(F.avg(m + F.log(total) - F.get(z, F.col(actual))).alias("nll"))


def smoothed_label(actual: Column, eps: float = 0.1, classes: int = 5) -> Column:
    """One-hot with ``eps`` spread over all classes."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.when(k == actual, 1.0 - eps).otherwise(0.0) + eps / classes)


def bias_corrected(rows: DataFrame, p: str, actual: str) -> DataFrame:
    """Probabilities times the ratio of actual to mean predicted share of each class, scaled to 1; one row of ratios is joined."""
    n = 5
    shares = rows.agg(*[F.avg(F.get(p, F.lit(k))).alias(f"_p{k}") for k in range(n)], *[F.avg((F.col(actual) == k).cast("double")).alias(f"_a{k}") for k in range(n)])
    ratio = F.array(*[F.coalesce(div(f"_a{k}", f"_p{k}"), F.lit(1.0)) for k in range(n)])
    both = rows.join(F.broadcast(shares.select(ratio.alias("_ratio"))))
    raw = F.zip_with(p, F.col("_ratio"), lambda x, r: x * r)
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return both.withColumn("corrected", F.when(total > 0, F.transform(raw, lambda x: x / total)).otherwise(F.col(p))).drop("_ratio")


def ordinal_error(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Mean distance of classes, share within one class, and mean squared distance."""
    d = F.abs(F.col(predicted) - F.col(actual))
    return rows.agg(F.avg(d.cast("double")).alias("mean_distance"), F.avg((d <= 1).cast("double")).alias("within_one"), F.avg((d * d).cast("double")).alias("mean_square"))


def series_statistics(b: DataFrame) -> DataFrame:
    """By symbol, over ``with_base`` bars: return statistics, worst fall and best rise, autocorrelation and Kelly share."""
    back = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    r = b.withColumns({"_peak": F.max("close").over(back), "_floor": F.min("close").over(back), "_r1": F.lag("ret").over(by_symbol())})
    win, loss = F.avg(F.when(F.col("ret") > 0, F.col("ret"))), -F.avg(F.when(F.col("ret") < 0, F.col("ret")))
    share = F.avg(F.when(F.col("ret").isNotNull(), (F.col("ret") > 0).cast("double")))
    both = F.when(F.col("_r1").isNotNull(), F.col("ret"))
    return r.groupBy("symbol").agg(
        F.avg("ret").alias("mean_return"),
        F.stddev_samp("ret").alias("volatility"),
        F.max(div(F.col("_peak") - F.col("close"), "_peak")).alias("drawdown"),
        F.max(div(F.col("close") - F.col("_floor"), "_floor")).alias("run_up"),
        F.try_divide(F.covar_pop(both, F.col("_r1")), F.stddev_pop(both) * F.stddev_pop(F.when(F.col("ret").isNotNull(), F.col("_r1")))).alias("autocorrelation"),
        (share - F.try_divide(1 - share, F.try_divide(win, loss))).alias("kelly"),
    )


def market_regime(n: int = 20) -> Column:
    """volatile, trending or normal, by the deviation of the last n returns and the move over them."""
    spread, move = F.stddev_pop("ret").over(inc(n)), F.sum("ret").over(inc(n))
    held = F.count("ret").over(inc(n)) == n
    return F.when(held, F.when(spread > 0.5, "volatile").when(F.abs(move) > spread * 4, "trending").otherwise("normal"))


def adjusted_confidence(confidence: Column, regime: Column) -> Column:
    """Confidence times 0.85 in volatile and 1.1 in trending markets, at most 1."""
    return F.least(confidence * F.when(regime == "volatile", 0.85).when(regime == "trending", 1.1).otherwise(1.0), F.lit(1.0))


def regime_flags(b: DataFrame, n: int = 20) -> DataFrame:
    """Adds ``regime``, 0 to 3: volatility and trend of the n bars before above the symbol's 75th percentile of each, and volume over 1.5 medians.

    The percentiles are over the whole series (nearest rank), so this looks ahead.
    """
    own = Window.partitionBy("symbol")
    seen = b.withColumns({"_v": F.when(F.count("close").over(exc(n)) == n, F.stddev_pop("close").over(exc(n))), "_t": F.abs(F.lag("close", 1).over(by_symbol()) - F.lag("close", n).over(by_symbol()))})

    def rank(c: str, share: float, rule: str) -> Column:
        r = F.row_number().over(own.orderBy(F.col(c).asc_nulls_last())) - 1
        m = F.count(c).over(own)
        at = F.floor((m - 1) * share + 0.5) if rule == "round" else F.floor(m / 2)
        return F.when(r == at, F.col(c))

    seen = seen.withColumns({"_pv": rank("_v", 0.75, "round"), "_pt": rank("_t", 0.75, "round"), "_m": rank("volume", 0.5, "half")})
    seen = seen.withColumns({c: F.max(c).over(own) for c in ("_pv", "_pt", "_m")})
    flags = [F.col("_v") > F.col("_pv"), F.col("_t") > F.col("_pt"), F.lag("volume").over(by_symbol()) > 1.5 * F.col("_m")]
    total = sum((F.coalesce(f, F.lit(False)).cast("int") for f in flags), F.lit(0))
    return seen.withColumn("regime", F.when(F.col("_v").isNotNull(), total)).drop("_v", "_t", "_pv", "_pt", "_m")


def position_size(confidence: Column, volatility: Column, base: float = 0.1, most: float = 0.25) -> Column:
    """Share of capital: the base times confidence over its middle, less in volatile series, never above ``most``."""
    return F.least(base * (confidence / 0.5) / (1 + F.coalesce(volatility, F.lit(0.0))), F.lit(most))


# diversity of sequences


def cosine_distance(a: Column, b: Column) -> Column:
    """1 less the cosine of two array columns; null if one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return 1 - div(dot, norm(a) * norm(b))


def assembled(rows: DataFrame, raw: str, targets: tuple[str, ...], names: tuple[str, ...] = LABELS) -> DataFrame:
    """Adds ``prediction``: of each target its probabilities (softmax of its five logits in ``raw``), label and combined confidence."""
    from .metrics import combined_confidence, softmax

    parts = rows.withColumns({f"_p{k}": softmax(F.slice(raw, 5 * k + 1, 5)) for k in range(len(targets))})
    made = [F.struct(F.col(f"_p{k}").alias("p"), label(F.col(f"_p{k}"), names).alias("label"), combined_confidence(F.col(f"_p{k}")).alias("confidence")).alias(t) for k, t in enumerate(targets)]
    return parts.withColumn("prediction", F.struct(*made)).drop(*[f"_p{k}" for k in range(len(targets))])


def post_processed(rows: DataFrame, value: str, confidence: str, least: float) -> DataFrame:
    """The steps in order: confidence outliers out, confidence by market regime, too little confidence out. ``value`` passes through."""
    from .metrics import iqr_filter

    adjusted = rows.withColumn("_adj", adjusted_confidence(F.col(confidence), market_regime(20)))
    kept = iqr_filter(adjusted, confidence).withColumn(confidence, F.col("_adj")).drop("_adj")
    return kept.filter(F.col(confidence) >= least)


def write_json(predictions: DataFrame, path: str) -> None:
    predictions.write.mode("overwrite").json(path)


def write_csv(predictions: DataFrame, path: str) -> None:
    """Flat columns only; see ``metrics.unpivoted`` for a long form."""
    predictions.write.mode("overwrite").option("header", True).csv(path)


def as_json(predictions: DataFrame) -> DataFrame:
    """One column ``json`` with a document for each row."""
    return predictions.select(F.to_json(F.struct(*predictions.columns)).alias("json"))
