"""Nested predictions, their steps, calibration, and summaries of several horizons, on small hand-made rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_DIR
from tidebar.operators import calibrators as K
from tidebar.operators import forecasts as X
from tidebar.operators import targets as T
from tidebar.operators.recurrences import smoothed
from tidebar.operators.sequences import summaries, summaries_by_horizon
from tidebar.plans.indicators import bars

EVEN = [0.2] * 5


def logits_and_classes(seed: int, n: int, sharpness: float):
    """Probabilities that are too sharp by a factor, with classes drawn from the true ones."""
    rng = np.random.default_rng(seed)
    z = rng.normal(0, 1, (n, 5))
    true = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    actual = [int(rng.choice(5, p=t)) for t in true]
    shown = np.exp(z * sharpness) / np.exp(z * sharpness).sum(1, keepdims=True)
    return shown, actual


def plain_nll(p, actual, temperature):
    z = np.log(np.clip(p, 1e-10, 1 - 1e-10)) / temperature
    z -= z.max(1, keepdims=True)
    return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(actual)), actual]))


def table(spark, p, actual):
    return spark.createDataFrame([(x.tolist(), a) for x, a in zip(p, actual)], "p array<double>, actual int")


def test_summaries_of_several_horizons_are_those_of_each(spark):
    b = bars(spark, SF_DIR)
    made = summaries_by_horizon(b, 24, 12, (2, 6, 3))
    for h in (2, 3, 6):
        one = summaries(b, 24, 12, h, reach=6)
        names = sorted(one.columns)
        both = one.select(*names).exceptAll(made.filter(F.col("horizon") == h).select(*names))
        assert both.count() == 0 and one.count() == made.filter(F.col("horizon") == h).count() > 0
    with pytest.raises(ValueError):
        summaries_by_horizon(b, 24, 12, ())


def test_each_horizon_has_its_own_parameters(spark):
    b = bars(spark, SF_DIR)
    params = {3: T.Parameters(), 6: T.Parameters(price_level=T.Bands(bandwidth=0.9, low=0.2), volume=T.Volume(bandwidth=1.0))}
    mixed = T.by_horizon(b, 24, 12, (3, 6), params).cache()
    for h, p in params.items():
        own = T.by_horizon(b, 24, 12, (3, 6), p).filter(F.col("horizon") == h)
        assert own.exceptAll(mixed.filter(F.col("horizon") == h)).count() == 0
    assert T.of_horizon({3: T.Parameters(), 6: T.Parameters()}) == T.Parameters()


def test_temperature_of_probabilities_that_are_too_sharp(spark):
    p, actual = logits_and_classes(3, 1500, 2.0)
    found = K.fit(table(spark, p, actual), "p", "actual")
    best = min((plain_nll(p, actual, t), t) for t in np.linspace(0.5, 5, 901))
    assert abs(found.temperature - best[1]) < 0.02 and abs(found.nll - best[0]) < 1e-5
    assert found.nll < found.plain_nll and found.rows == 1500
    assert abs(found.plain_nll - plain_nll(p, actual, 1.0)) < 1e-9


def test_pathological_temperature_is_not_taken(spark):
    p = np.array([[0.9, 0.025, 0.025, 0.025, 0.025]] * 40)
    found = K.fit(table(spark, p, [1] * 40), "p", "actual")  # always wrong: the flatter, the better
    assert found.temperature == 1.0 and found.nll == found.plain_nll
    found = K.fit(table(spark, p, [0] * 40), "p", "actual")  # always right: the sharper, the better
    assert found.temperature == 1.0


def test_smoothing_and_mixing_by_hand(spark):
    p = np.array([[0.6, 0.1, 0.1, 0.1, 0.1], [0.6, 0.1, 0.1, 0.1, 0.1]])
    amounts = {r["class"]: r for r in K.smoothing_of(table(spark, p, [0, 1]), "p", "actual").collect()}
    assert amounts[0]["confidence"] == pytest.approx(0.6) and amounts[0]["accuracy"] == 1.0 and amounts[0]["smoothing"] == 0.0
    assert amounts[1]["accuracy"] == 0.0 and amounts[1]["smoothing"] == pytest.approx(0.1 * 1.1)  # its only row is missed
    assert amounts[2]["smoothing"] == pytest.approx(0.11)  # no rows
    c = K.Calibration(1.0, 0.0, 0.0, 0.1, (0.0,) * 5, (0.0, 0.1, 0.3, 0.0, 0.0), 0.24, 2)
    rows = spark.createDataFrame([(0,), (1,), (None,), (7,)], "a int").select("a", c.label(F.col("a")).alias("l")).collect()
    assert rows[0]["l"] == [1.0, 0.0, 0.0, 0.0, 0.0]
    assert rows[1]["l"] == pytest.approx([0.02, 0.92, 0.02, 0.02, 0.02]) and rows[2]["l"] is None and rows[3]["l"] is None


def test_fit_passes_over_rows_that_are_no_predictions(spark):
    rows = spark.createDataFrame([(None, 1), ([0.2] * 4, 1), ([0.2, 0.2, 0.2, 0.2, None], 1), ([0.2, 0.2, 0.2, 0.2, math.nan], 1), (EVEN, None), (EVEN, 9)], "p array<double>, actual int")
    found = K.fit(rows, "p", "actual")
    assert found.rows == 0 and found.temperature == 1.0 and found.smoothing == (0.0,) * 5 and math.isnan(found.ece) and found.mixing == 0.2


def test_adaptive_temperature_of_certain_and_uncertain_batches(spark):
    z = [("even", [0.0] * 5), ("sure", [60.0, 0.0, 0.0, 0.0, 0.0]), ("sure", None), (None, [0.0] * 5), ("none", None)]
    rows = spark.createDataFrame(z, "k string, z array<double>")
    made = {(r["k"], r["z"] is None): r for r in K.entropy_adaptive(rows, "z", 2.0, 1.0, "k").collect()}
    assert made["even", False]["temperature"] == pytest.approx(1.5) and made["even", False]["adapted"] == pytest.approx(EVEN)
    assert made["sure", False]["temperature"] == pytest.approx(2.5) and made["sure", True]["adapted"] is None
    assert made[None, False]["temperature"] == pytest.approx(1.5) and made["none", True]["temperature"] is None
    half = K.entropy_adaptive(rows.filter("k = 'even'"), "z", 2.0, 0.5).first()
    assert half["temperature"] == pytest.approx(1.25)


def _predictions(spark, values):
    rows = [("a", k, v, [v, 1 - v, 0.0, 0.0, 0.0] if v is not None else None, "kept") for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, k int, confidence double, p array<double>, open string").withColumn("ts", F.timestamp_seconds(F.col("k") * 3600)).withColumn("ret", F.lit(0.0))


def test_smoothing_of_confidence_and_probabilities(spark):
    made = X.processed(_predictions(spark, [0.5, 0.9, None, 0.1]), ("smoothing",), "confidence", "p").orderBy("ts").collect()
    a, b = 0.5, 0.3 * 0.9 + 0.7 * 0.5
    want = [a, b, None, 0.3 * 0.1 + 0.7 * b]
    assert [r["confidence"] for r in made] == [pytest.approx(w) if w is not None else None for w in want]
    assert [r["p"] and r["p"][0] for r in made] == [pytest.approx(w) if w is not None else None for w in want]
    assert all(r["open"] == "kept" for r in made)  # a column of another meaning with the name of a bar's field


def test_order_of_steps_counts(spark):
    values = [0.6] * 20 + [0.61, 0.1]
    rows = _predictions(spark, values)
    assert X.processed(rows, ("outliers", "smoothing")).count() == 20
    late = X.processed(rows, ("smoothing", "confidence"), least=0.5)
    assert late.count() == 21  # 0.1 becomes 0.4503
    assert X.processed(rows, ()).count() == 22
    with pytest.raises(ValueError):
        X.processed(rows, ("volatility",))


def test_smoothed_takes_more_columns_than_bars_have_fields(spark):
    names = [f"c{k}" for k in range(7)]
    rows = spark.createDataFrame([("a", t, *[float(t + k) for k in range(7)]) for t in range(3)], "symbol string, k int, " + ", ".join(f"{n} double" for n in names)).withColumn("ts", F.timestamp_seconds("k"))
    made = smoothed(rows, names, 0.5).orderBy("ts").collect()
    for k in range(7):
        assert [r[f"c{k}"] for r in made] == pytest.approx([k, k + 0.5, k + 1.25])


def test_structs_of_missing_targets_and_names_of_horizons(spark):
    s = summaries_by_horizon(bars(spark, SF_DIR), 24, 12, (3, 24)).filter("seq = 0")
    p = {t: F.array(*[F.lit(v) for v in (0.1, 0.1, 0.1, 0.2, 0.5)]) for t in T.VARIED}
    p["volume"] = F.lit(None).cast("array<double>")
    made = X.structs(s, 24, p, T.Parameters(), "horizon")
    r = made.first()["prediction"]
    assert r["volume"] is None and r["price_level"]["likely"] == "strong_up" and r["stop_level"]["likely"] == "minimal_adverse" and r["direction"]["label"] == "pump"
    ranges = [r["price_level"]["ranges"][n] for n in X.PRICE_LABELS]
    assert all(a["high"] == b["low"] for a, b in zip(ranges, ranges[1:])) and sum(x["probability"] for x in ranges) == pytest.approx(1.0)
    assert r["direction"]["skew"] == pytest.approx(0.5) and r["direction"]["margin"] == pytest.approx(0.3)
    packed = X.by_horizon(made, 60).first()["predictions"]
    assert list(packed) == ["3h", "1d"]
    with pytest.raises(ValueError):
        X.structs(s, 24, {"direction": p["direction"]})
