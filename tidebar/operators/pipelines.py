"""Preparation of bars for models: statistics that are saved and applied to new rows, and the steps in their orders.

Training: outliers, features, trimming, normalisation. Features only: features,
trimming, outliers. Prediction: features, trimming, the saved statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.safe import finite
from ..functions.windows import with_base
from . import preprocess as P
from .validate import trim_leading

STATISTICS = ("mean", "std", "min", "max", "median", "q25", "q75")
# Name parts of columns whose outliers go to the centre, and of those that are interpolated.
CENTRED = ("rsi", "macd", "sma", "ema", "bb", "stoch")
INTERPOLATED = ("return", "change", "momentum", "mom", "velocity", "acceleration")


def fit(rows: DataFrame, features: list[str]) -> DataFrame:
    """(symbol, feature, mean .. q75) of the finite values of every feature, in one pass over the ranks of each."""
    long = rows.select("symbol", *[F.col(f).cast("double") for f in features]).unpivot("symbol", features, "feature", "x").filter(finite("x"))
    own = Window.partitionBy("symbol", "feature")
    ranked = long.withColumns({"_r": F.row_number().over(own.orderBy("x")) - 1, "_n": F.count(F.lit(1)).over(own)})
    at = lambda p: F.max(F.when(F.col("_r") == F.floor((F.col("_n") - 1) * p + 0.5), F.col("x")))
    found = (F.avg("x"), F.stddev_pop("x"), F.min("x"), F.max("x"), at(0.5), at(0.25), at(0.75))
    return ranked.groupBy("symbol", "feature").agg(*[c.alias(n) for c, n in zip(found, STATISTICS)])


def save(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def apply(rows: DataFrame, stats: DataFrame, features: list[str], how: str = "robust") -> DataFrame:
    """``rows`` with each feature normalised by saved statistics; ``quantile`` needs ranks that new rows lack and falls back to robust.

    Features without statistics or spread stay as they are.
    """
    shift, scale = {"minmax": ("min", F.col("max") - F.col("min")), "standard": ("mean", F.col("std"))}.get(how, ("median", F.col("q75") - F.col("q25")))
    of = lambda f, c: F.max(F.when(F.col("feature") == f, c))
    wide = stats.groupBy("symbol").agg(*[x for k, f in enumerate(features) for x in (of(f, F.col(shift)).alias(f"_s{k}"), of(f, scale).alias(f"_w{k}"))])
    joined = rows.join(wide, "symbol", "left")
    made = {f: F.when(F.col(f"_w{k}") > 0, (F.col(f) - F.col(f"_s{k}")) / F.col(f"_w{k}")).otherwise(F.col(f)) for k, f in enumerate(features)}
    return joined.withColumns(made).drop(*[f"_{c}{k}" for k in range(len(features)) for c in "sw"])


def replacement(name: str) -> str:
    """How outliers of a column are replaced: cap, centre or interpolate, by its name."""
    if "volume" in name:
        return "cap"
    if any(part in name for part in CENTRED):
        return "centre"
    return "interpolate" if any(part in name for part in INTERPOLATED) else "cap"


def cleaned(rows: DataFrame, features: list[str], k: float = 1.5) -> DataFrame:
    """``rows`` (with ``i``) with values beyond k quartile ranges replaced by each column's rule; statistics of all columns come from one pass."""
    of = lambda f, c: F.max(F.when(F.col("feature") == f, F.col(c)))
    wide = fit(rows, features).groupBy("symbol").agg(*[of(f, c).alias(f"_{c}_{n}") for n, f in enumerate(features) for c in ("q25", "q75", "median")])
    made: dict[str, Column] = {}
    out: dict[str, Column] = {}
    for n, f in enumerate(features):
        low, high = F.col(f"_q25_{n}"), F.col(f"_q75_{n}")
        spread = high - low
        bounds = F.when(spread > 0, low - k * spread), F.when(spread > 0, high + k * spread)
        out[f"_out_{n}"] = P.is_outlier(f, bounds)
        rule = replacement(f)
        if rule == "cap":
            made[f] = P.capped(f, bounds)
        elif rule == "centre":
            made[f] = F.when(F.col(f"_out_{n}"), F.col(f"_median_{n}")).otherwise(F.col(f))
        else:
            made[f] = P.interpolated(f, f"_out_{n}")
    return rows.join(wide, "symbol", "left").withColumns(out).withColumns(made).drop(*wide.columns[1:], *out)


def training(bars: DataFrame, features: dict[str, Column], how: str = "robust") -> tuple[DataFrame, DataFrame]:
    """Normalised rows and the statistics that prediction needs."""
    names = list(features)
    made = with_base(cleaned(with_base(bars), ["volume"]).select(*bars.columns)).withColumns(features)
    kept = trim_leading(made, names)
    stats = fit(kept, names)
    return apply(kept, stats, names, how), stats


def features_only(bars: DataFrame, features: dict[str, Column]) -> DataFrame:
    """Features of raw bars, trimmed and cleaned, not normalised."""
    return cleaned(trim_leading(with_base(bars).withColumns(features), list(features)), list(features))


def prediction(bars: DataFrame, features: dict[str, Column], stats: DataFrame, how: str = "robust") -> DataFrame:
    """Features of new bars, normalised as in training."""
    return apply(trim_leading(with_base(bars).withColumns(features), list(features)), stats, list(features), how)


def cross_asset(bars: DataFrame, features: dict[str, Column], market: DataFrame, how: str = "robust") -> tuple[DataFrame, DataFrame]:
    """``training`` with columns of the market, aligned by time, missing values 0."""
    names = [c for c in market.columns if c != "ts"]
    rows, stats = training(bars, features, how)
    return rows.join(market, "ts", "left").fillna(0.0, names), stats
