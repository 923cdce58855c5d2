"""Small operators by hand-computed cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidebar.operators import crossasset, inverse, volatility
from tidebar.sources import bars as sources

BARS = "symbol string, ts int, close double, tr double"


def test_expected_range_and_stop(spark):
    rows = spark.createDataFrame([([0.0, 0.0, 1.0, 0.0, 0.0],), ([0.0, 0.0, 0.0, 0.0, 1.0],), ([1.0, 0.0, 0.0, 0.0, 0.0],)], "p array<double>")
    got = rows.select(inverse.volatility_expectation(F.col("p"), F.lit(0.02)).alias("v"), inverse.stop_price(F.lit(100.0), F.col("p")).alias("s")).collect()
    # centres of the outer classes lie at 0.2 x 2 x 1.5; the stop is 5 % away for class 0 and not at all for class 4
    assert [r.v for r in got] == pytest.approx([0.02, 0.02 * 1.6, 0.02 * 0.4])
    assert [r.s for r in got] == pytest.approx([97.5, 100.0, 95.0])


def test_share_of_the_true_range(spark):
    rows = spark.createDataFrame([("a", 1, 50.0, 2.0), ("a", 2, 0.0, 2.0), ("a", 3, 50.0, None)], BARS)
    assert [r[0] for r in rows.orderBy("ts").select(volatility.true_range_share()).collect()] == [0.04, None, None]


def test_required_symbols(spark):
    rows = spark.createDataFrame([("a", 1, 1.0, 1.0), ("b", 1, 1.0, 1.0), ("b", 2, 1.0, 1.0)], BARS)
    assert crossasset.require(rows, ["b", "x", "a"]) == ["b", "a"]
    with pytest.raises(ValueError, match="2 symbols"):
        crossasset.require(rows, ["a", "x"])


def test_a_first_row_with_holes_goes(spark):
    rows = spark.createDataFrame([("a", 1, None, 1.0), ("a", 2, None, 1.0), ("b", 1, 1.0, 1.0), ("b", 2, 1.0, None)], BARS)
    assert sorted((r.symbol, r.ts) for r in sources.drop_null_first_row(rows).collect()) == [("a", 2), ("b", 1), ("b", 2)]


def test_sweep_strength_is_signed_and_scaled(spark):
    rows = [("a", k, 10.0, 11.0, 9.0, 10.0, 2.0) for k in range(3)] + [("a", 3, 10.0, 12.0, 9.5, 10.5, 2.0), ("a", 4, 10.0, 11.0, 8.0, 9.5, 4.0), ("a", 5, 10.0, 13.0, 9.0, 10.0, None)]
    bars = spark.createDataFrame(rows, "symbol string, ts int, open double, high double, low double, close double, atr double")
    got = [r[0] for r in bars.withColumn("s", volatility.sweep_strength("atr", 3)).orderBy("ts").select("s").collect()]
    assert got == [0.0, 0.0, 0.0, 0.5, -0.25, 0.0]
