"""Importance and choice of features, balanced truncation, alignment, cleaning in one pass."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.operators import balance as B
from tidebar.operators import pipelines, preprocess
from tidebar.operators import selection as S
from tidebar.operators import sequences as Q
from tidebar.operators.measures import adjusted_atr


def plain_importance(x, y, bins=10):
    x, y = np.array(x, float), np.array(y)
    held = x[np.isfinite(x)]
    low, high = held.min(), held.max()
    place = [-1 if math.isnan(v) else (min(int((v - low) * bins / (high - low)), bins - 1) if high > low else 0) for v in x]
    n = len(y)
    told = 0.0
    for b in set(place):
        for c in set(y):
            p = sum(q == b and d == c for q, d in zip(place, y)) / n
            if p:
                told += p * math.log(p / (place.count(b) / n * (list(y).count(c) / n)))
    all_ = -sum(list(y).count(c) / n * math.log(list(y).count(c) / n) for c in set(y))
    ok = np.isfinite(x)
    m = x[ok].mean()
    between = sum((ok & (y == c)).sum() * (x[ok & (y == c)].mean() - m) ** 2 for c in set(y[ok]))
    total = ((x[ok] - m) ** 2).sum()
    return told / all_, between / total if total else 0.0


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 5, 400)
    good = y + rng.normal(0, 0.3, 400)
    noise = rng.normal(0, 1, 400)
    noise[::17] = math.nan
    data = [(int(c), float(g), float(2 * g + 1), float(n), 3.0, None) for c, g, n in zip(y, good, noise)]
    return spark.createDataFrame(data, "class int, good double, good_again double, noise double, flat double, none double").cache()


def test_importance_is_that_of_a_plain_count(rows):
    made = {r["feature"]: r for r in S.importance(rows, ["good", "noise", "flat", "none"], "class").collect()}
    data = rows.collect()
    for f in ("good", "noise"):
        information, ratio = plain_importance([r[f] for r in data], [r["class"] for r in data])
        assert made[f]["information"] == pytest.approx(information) and made[f]["ratio"] == pytest.approx(ratio)
        assert made[f]["importance"] == pytest.approx((information + ratio) / 2)
    assert made["flat"]["importance"] == 0.0 and made["none"]["importance"] == 0.0
    assert made["good"]["importance"] > 5 * made["noise"]["importance"]


def test_importance_of_odd_rows(spark):
    one = spark.createDataFrame([(1, 2.0), (1, math.inf), (None, 5.0), (1, -math.inf)], "class int, x double")
    assert S.importance(one, ["x"], "class").first()["importance"] == 0.0  # a single class
    assert S.importance(one.limit(0), ["x"], "class").count() == 0


def test_choice(rows):
    held = rows.fillna(0.0).withColumn("noise", F.nanvl("noise", F.lit(0.0)))
    names = ["good", "good_again", "noise", "flat"]
    assert [f for f, _ in S.chosen(held, names, "class")] == ["good", "noise", "flat"]
    assert [f for f, _ in S.chosen(held, names, "class", preferred=lambda f: f == "good_again", most=1)] == ["good_again"]
    assert [f for f, _ in S.chosen(held, names, "class", wanted=lambda f: f == "noise")] == ["noise"]
    assert sorted(f for f, _ in S.chosen(held, names, "class", wanted=lambda f: f == "noise", least=2)) == ["good", "noise"]
    assert [f for f, _ in S.chosen(held, names, "class", threshold=0.5)] == ["good"]
    assert len(S.chosen(held, names, "class", threshold=0.99, least=2)) == 2
    assert "good" in S.eliminated(held, ["good", "noise", "flat"], "class", 1)
    with pytest.raises(ValueError):
        S.chosen(held, names, "class", least=3, most=2)


@pytest.mark.parametrize("n, k", [(10, 10), (10, 3), (10, 4), (7, 5), (9, 1), (1, 1)])
def test_truncation_takes_even_strides(spark, n, k):
    rows = spark.createDataFrame([("a", s * 5 + c, c) for s in range(n) for c in range(5)], "symbol string, seq bigint, class int")
    made = B.truncated(rows, 5 * k).collect()
    places = sorted(min(math.floor(i * n / k + 0.5), n - 1) for i in range(k))
    for c in range(5):
        assert sorted(r["seq"] // 5 for r in made if r["class"] == c) == places


def test_truncation_refuses_what_is_not_balanced(spark):
    rows = spark.createDataFrame([("a", s, s % 5) for s in range(10)], "symbol string, seq bigint, class int")
    for bad, count in ((rows, 7), (rows, 15), (rows.filter("seq > 0"), 5), (rows.filter("class < 4"), 5)):
        with pytest.raises(ValueError):
            B.truncated(bad, count)


def test_alignment(spark):
    starts = spark.createDataFrame([("a", 0), ("a", 2), ("a", 2), ("a", 9), ("b", 0)], "symbol string, seq bigint")
    targets = spark.createDataFrame([("a", 0), ("a", 0), ("a", 4), ("b", 0)], "symbol string, seq bigint")
    bars = spark.createDataFrame([("a",)] * 5 + [("b",)] * 3 + [("c",)], "symbol string")
    report = Q.alignment(starts, targets, bars)
    made = {r["symbol"]: r.asDict() for r in report.collect()}
    assert made["a"] == {"symbol": "a", "n_sequences": 4, "n_targets": 2, "unlabelled": 2, "unmatched": 1, "repeated": 1, "outside": 1, "n_bars": 5}
    assert made["c"]["n_bars"] == 1 and made["c"]["n_sequences"] == 0
    with pytest.raises(ValueError, match="a: 2 unlabelled, 1 unmatched, 1 repeated, 1 outside$"):
        Q.check_alignment(report)
    Q.check_alignment(report.filter("symbol <> 'a'"))


def test_cleaning_is_that_of_each_column_alone(spark):
    values = [1.0, 2.0, 3.0, 2.0, 90.0, 2.0, 1.0, None, 3.0, -70.0]
    data = [(s, i, v, v, v) for s in ("a", "b") for i, v in enumerate(values)]
    rows = spark.createDataFrame(data, "symbol string, i bigint, volume double, sma double, mom double").withColumn("ts", F.timestamp_seconds("i"))
    made = pipelines.cleaned(rows, ["volume", "sma", "mom"]).orderBy("symbol", "ts").collect()
    stats = preprocess.column_stats(rows, "volume").first()
    width = 1.5 * (stats["q75"] - stats["q25"])
    assert made[4]["volume"] == stats["q75"] + width and made[9]["volume"] == stats["q25"] - width
    assert made[4]["sma"] == stats["median"] and made[4]["mom"] == 2.0 and made[9]["mom"] == 3.0
    assert made[7]["volume"] is None and made[7]["sma"] is None and made[7]["mom"] is None
    assert set(rows.columns) == set(made[0].asDict())


def test_range_by_volatility(spark):
    rows = spark.createDataFrame([("VERY_LOW",), ("LOW",), ("MEDIUM",), ("HIGH",), ("VERY_HIGH",), ("other",), (None,)], "l string")
    assert [r[0] for r in rows.select(adjusted_atr(F.lit(10.0), F.col("l"))).collect()] == pytest.approx([7.0, 8.5, 10.0, 13.0, 16.0, 10.0, 10.0])
