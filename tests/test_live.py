"""Settings, stored models and parameters, appended lines, sinks and stream health; errors of splits and checks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidebar.operators import balance, measures, ordinal, pipelines, targets, validate
from tidebar.sources import settings
from tidebar.streaming import live


def test_settings_files(spark, tmp_path):
    (tmp_path / "a.toml").write_text("[model]\nname = 'x'\n[targets.volume]\nbandwidth = 0.3\nextreme = 3.0\n")
    (tmp_path / "b.toml").write_text("[targets.volume]\nbandwidth = 0.5\n")
    found = settings.read_settings(spark, str(tmp_path / "a.toml"), str(tmp_path / "b.toml"))
    p = settings.target_parameters(found)
    assert found["model"] == {"name": "x"} and (p.volume.bandwidth, p.volume.extreme, p.volume.low) == (0.5, 3.0, 0.1)
    settings.save_parameters(spark, p, str(tmp_path / "p"))
    assert settings.load_parameters(spark, str(tmp_path / "p")) == p
    with pytest.raises(ValueError, match="unknown settings"):
        settings.target_parameters({"targets": {"volume": {"width": 1}}})
    assert settings.check_paths(spark, [str(tmp_path / "a.toml"), str(tmp_path / "none.csv")]) == [str(tmp_path / "none.csv")]


def test_stored_models(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    rows = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert settings.list_models(spark, str(tmp_path / "m")) == []
    settings.save_model(Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="v")]).fit(rows), str(tmp_path / "m"), "first")
    assert settings.list_models(spark, str(tmp_path / "m")) == ["first"]
    assert settings.load_model(str(tmp_path / "m"), "first").transform(rows).first().v.toArray().tolist() == [1.0, 2.0]


def test_sink_and_health(spark, tmp_path):
    spark.range(20).write.parquet(str(tmp_path / "in"))
    health = live.Health(most=0)
    spark.streams.addListener(health)
    try:
        stream = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
        live.prediction_sink(stream, str(tmp_path / "out"), str(tmp_path / "check"), lambda b: b.withColumn("p", F.col("id") * 2)).awaitTermination()
    finally:
        spark.streams.removeListener(health)
    assert spark.read.json(str(tmp_path / "out")).agg(F.sum("p")).first()[0] == 380
    assert health.summary()["failures"] == 0 and not health.unhealthy
    assert live.with_defaults(spark.createDataFrame([(None,)], "p double"), p=0.2).first().p == 0.2


def test_exact_split_counts(spark):
    rows = [("s", 10 * k, k % 5, 0.5) for k in range(100)]
    labelled = spark.createDataFrame(rows, "symbol string, seq bigint, class int, strength double")
    got = balance.exact_split(labelled, 4, 3, 8)
    assert {(r["class"], r["split"]): r["count"] for r in got.groupBy("class", "split").count().collect()} == {(k, s): n for k in range(5) for s, n in (("val", 4), ("test", 3), ("train", 8))}
    assert got.select("seq").distinct().count() == got.count()
    with pytest.raises(Exception, match="too few rows of class"):
        balance.exact_split(labelled, 10, 8, 5).collect()
    assert balance.even_sample(labelled, 7).count() == 7 and balance.diverse(labelled, 12).groupBy("class").count().filter("count <> 12").count() == 0
    assert balance.window_plan(8000) in range(2, 7) and balance.window_plan(10) == 2


def test_saved_statistics_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", float(k), 5.0) for k in range(11)], "symbol string, x double, flat double")
    stats = pipelines.fit(rows, ["x", "flat"])
    pipelines.save(stats, str(tmp_path / "stats"))
    new = spark.createDataFrame([("a", 5.0, 7.0), ("b", 1.0, 1.0)], "symbol string, x double, flat double")
    got = pipelines.apply(new, pipelines.load(spark, str(tmp_path / "stats")), ["x", "flat"]).collect()
    assert sorted((r.symbol, r.x, r.flat) for r in got) == [("a", 0.0, 7.0), ("b", 1.0, 1.0)]
    assert [pipelines.replacement(n) for n in ("volume_sma", "rsi_14", "price_change", "other")] == ["cap", "centre", "interpolate", "cap"]


def test_checks(spark):
    validate.check_periods(fast=3, slow=5)
    for bad in ({"fast": 5, "slow": 5}, {"length": 0}):
        with pytest.raises(ValueError):
            validate.check_periods(**bad)
    assert validate.check_schema(spark.range(1), {"id": "bigint", "x": "double"}) == ["x: missing"]
    assert validate.required_rows(24, 6, 20) == 50
    assert ordinal.PENALTY[0][4] == 2.0 and targets.VARIED["direction"] == "sensitivity" and measures.REGIME_FACTOR["bull"] == 1.05


def test_best_overlap():
    from tidebar.operators.audits import best_overlap
    from tidebar.operators.sequences import expected_count, step_size

    for wanted in (1, 5, 20, 60):
        o = best_overlap(200, 24, 6, wanted)
        assert expected_count(200, 24, step_size(o, 24), 6) >= wanted
        assert o == 0 or expected_count(200, 24, step_size(o, 24) + 1, 6) < wanted
    assert best_overlap(200, 24, 6, 10_000) == pytest.approx(1 - 1 / 24)
