"""An optional model stage: a random forest for a target, and a backtest over a chronological split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ("ret_1", "ret_5", "range", "volume_ratio", "position")


def sequence_features(s: DataFrame) -> DataFrame:
    """(symbol, seq, features...) from sequence summaries: nothing of the horizon is used."""
    n = F.size("s_path")
    last, before, five = F.get("s_path", n - 1), F.get("s_path", n - 2), F.get("s_path", n - 6)
    low, high = F.get("s_lows", F.lit(0)), F.get("s_highs", F.size("s_highs") - 1)
    made = {
        "ret_1": F.try_divide(last - before, before),
        "ret_5": F.try_divide(last - five, five),
        "range": F.try_divide(high - low, F.col("s_mean")),
        "volume_ratio": F.try_divide(F.col("s_smooth"), F.col("s_volume")),
        "position": F.try_divide(F.col("s_wclose") - low, high - low),
    }
    return s.select("symbol", "seq", *[F.coalesce(c, F.lit(0.0)).alias(k) for k, c in made.items()])


def train_forest(rows: DataFrame, target: str = "class", trees: int = 20, seed: int = 7):
    """A fitted pipeline: assembled features, then the forest."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    forest = RandomForestClassifier(labelCol=target, featuresCol="vector", numTrees=trees, maxDepth=6, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="vector"), forest]).fit(rows)


def backtest(features: DataFrame, labelled: DataFrame, train_share: float = 0.7, trees: int = 20) -> DataFrame:
    """(symbol, seq, class, predicted): the later part of each symbol's sequences, predicted by a forest of the earlier part."""
    from pyspark.sql import Window

    rows = features.join(labelled.select("symbol", "seq", "class"), ["symbol", "seq"]).filter("class is not null")
    own = Window.partitionBy("symbol")
    rows = rows.withColumn("_r", F.percent_rank().over(own.orderBy("seq")))
    model = train_forest(rows.filter(F.col("_r") < train_share), trees=trees)
    scored = model.transform(rows.filter(F.col("_r") >= train_share))
    return scored.select("symbol", "seq", "class", F.col("prediction").cast("int").alias("predicted"))
