"""Settings files, stored parameters and stored models."""

from __future__ import annotations

import json
import tomllib
from dataclasses import asdict, fields, is_dataclass

from pyspark.sql import SparkSession

from ..operators.targets import Parameters


def merged(base: dict, over: dict) -> dict:
    """``base`` with the values of ``over``, tables merged key by key."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def _text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one settings file


def read_settings(spark: SparkSession, *paths: str) -> dict:
    """TOML files from any store that Spark reads; later ones override earlier ones."""
    out: dict = {}
    for path in paths:
        out = merged(out, tomllib.loads(_text(spark, path)))
    return out


def target_parameters(settings: dict) -> Parameters:
    """Parameters of the targets from the table ``targets``; unknown names are an error."""

    def made(kind, values: dict):
        known = {f.name: f for f in fields(kind)}
        if unknown := set(values) - set(known):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        current = kind()
        return kind(**{n: made(type(getattr(current, n)), values[n]) if is_dataclass(getattr(current, n)) else values[n] for n in values})

    return made(Parameters, settings.get("targets", {}))


def save_parameters(spark: SparkSession, p: Parameters, path: str) -> None:
    spark.createDataFrame([(json.dumps(asdict(p)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_parameters(spark: SparkSession, path: str) -> Parameters:
    return target_parameters({"targets": json.loads(_text(spark, path))})


def save_model(model, folder: str, name: str) -> None:
    """A fitted pipeline, under its name in a folder of models."""
    model.write().overwrite().save(f"{folder.rstrip('/')}/{name}")


def load_model(folder: str, name: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(f"{folder.rstrip('/')}/{name}")


def list_models(spark: SparkSession, folder: str) -> list[str]:
    """Names of the models in a folder, in any store that Spark reaches."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(conf)
    return sorted(s.getPath().getName() for s in store.listStatus(path) if s.isDirectory()) if store.exists(path) else []


def check_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that don't exist."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if not path.getFileSystem(conf).globStatus(path):
            out.append(p)
    return out
