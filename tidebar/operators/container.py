"""Models of several targets and horizons that are fitted, stored, loaded and applied as one.

Each (target, horizon) has a forest on the shared features and, where enough rows are
left, a second stage: a logistic regression on the features and the forest's probabilities,
fitted on rows that the forest did not see. A target with fewer than ``least`` rows or one
class only falls back to its commonest class, a second stage that is missing to the forest.

All models are applied in one pass over the rows: the features are assembled once, and each
model adds its columns to the same plan.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ordinal import backtest_report

LEAST = 40
CLASSES = 5
_ABOUT = "about"


@dataclass
class Container:
    features: list[str]
    common: dict[str, int | None] = field(default_factory=dict)  # name to its commonest class
    first: dict[str, PipelineModel] = field(default_factory=dict)
    second: dict[str, PipelineModel] = field(default_factory=dict)

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds ``predicted_{name}``, ``p_{name}`` (an array of class probabilities) and ``stage_{name}`` (0: commonest class, 1 or 2) for every name."""
        out = VectorAssembler(inputCols=self.features, outputCol="_features", handleInvalid="keep").transform(rows)
        for name, most in self.common.items():
            p = F.array(*[F.lit(1.0 if k == most else 0.0) for k in range(CLASSES)])
            stage = 0
            if name in self.first:
                out, stage, p = self.first[name].transform(out), 1, vector_to_array(f"_p1_{name}")
            if name in self.first and name in self.second:
                out, stage, p = self.second[name].transform(out), 2, vector_to_array(f"_p2_{name}")
            # models know the classes up to the largest that they saw
            p = F.array(*[F.coalesce(F.get(p, F.lit(k)), F.lit(0.0)) for k in range(CLASSES)])
            best = (F.array_position(F.col(f"p_{name}"), F.array_max(f"p_{name}")) - 1).cast("int")
            out = out.withColumn(f"p_{name}", p).withColumns({f"predicted_{name}": best if most is not None else F.lit(None).cast("int"), f"stage_{name}": F.lit(stage)})
        return out.select(*[c for c in out.columns if not c.startswith(("_features", "_p1_", "_p2_", "_r1_", "_r2_", "_y1_", "_y2_", "_both_"))])

    def save(self, spark: SparkSession, folder: str) -> None:
        for stage, models in (("first", self.first), ("second", self.second)):
            for name, model in models.items():
                model.write().overwrite().save(f"{folder}/{stage}/{name}")
        about = json.dumps({"features": self.features, "common": self.common, "first": sorted(self.first), "second": sorted(self.second)})
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{_ABOUT}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Container:
        about = json.loads(spark.read.text(f"{folder}/{_ABOUT}").first()[0])
        stages = ({n: PipelineModel.load(f"{folder}/{stage}/{n}") for n in about[stage]} for stage in ("first", "second"))
        return cls(about["features"], about["common"], *stages)


def fit(rows: DataFrame, features: list[str], names: list[str], trees: int = 20, depth: int = 6, seed: int = 7, second_share: float = 0.3, least: int = LEAST) -> Container:
    """Models of the class columns ``names`` of ``rows`` (symbol, seq, features, classes); null classes are left out, each target on its own."""
    made = Container(list(features))
    rows = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep").transform(rows)
    # by digest, so that reruns part them alike
    share = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "symbol", F.col("seq").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = rows.withColumn("_later", share < second_share).persist()
    try:
        counted = rows.select(*names).unpivot([], names, "name", "class").filter("class is not null").groupBy("name", "class").count().collect()
        for name in names:
            counts = {r["class"]: r["count"] for r in counted if r["name"] == name}
            made.common[name] = min(counts, key=lambda k: (-counts[k], k)) if counts else None
            if len(counts) < 2 or sum(counts.values()) < least:
                continue
            own = rows.filter(F.col(name).isNotNull())
            early, later = own.filter("not _later"), own.filter("_later")
            forest = RandomForestClassifier(labelCol=name, featuresCol="_features", numTrees=trees, maxDepth=depth, seed=seed, probabilityCol=f"_p1_{name}", rawPredictionCol=f"_r1_{name}", predictionCol=f"_y1_{name}")
            if early.select(name).distinct().count() < 2:
                continue
            made.first[name] = PipelineModel(stages=[forest.fit(early)])
            if later.count() < least or later.select(name).distinct().count() < 2:
                continue
            both = VectorAssembler(inputCols=["_features", f"_p1_{name}"], outputCol=f"_both_{name}")
            logistic = LogisticRegression(labelCol=name, featuresCol=f"_both_{name}", regParam=0.05, maxIter=12, probabilityCol=f"_p2_{name}", rawPredictionCol=f"_r2_{name}", predictionCol=f"_y2_{name}")
            made.second[name] = PipelineModel(stages=[both, logistic.fit(both.transform(made.first[name].transform(later)))])
    finally:
        rows.unpersist()
    return made


def early_and_later(rows: DataFrame, share: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """The first part of each symbol's sequences, and the rest."""
    placed = rows.withColumn("_at", F.percent_rank().over(Window.partitionBy("symbol").orderBy("seq")))
    return placed.filter(F.col("_at") < share).drop("_at"), placed.filter(F.col("_at") >= share).drop("_at")


def scored(container: Container, rows: DataFrame) -> DataFrame:
    """(name, stage, n, accuracy, ...): the backtest report of every model over rows with their classes."""
    names = list(container.common)
    made = container.transform(rows)
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"stage_{n}").alias("stage"), F.col(f"predicted_{n}").alias("predicted"), F.col(n).cast("int").alias("actual")) for n in names])
    return backtest_report(made.select(F.inline(each)), "predicted", "actual", "name", "stage")
