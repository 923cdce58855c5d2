"""Results that have to be those of the SQL to the last bit, on tables where rounding or a zero decides."""

from __future__ import annotations

import math
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_DIR
from tidebar.operators import adaptive, volatility
from tidebar.operators.recurrences import smoothed
from tidebar.plans import registry


def plain_means(values, rate):
    out, mean = [], None
    for v in values:
        if v is not None:
            mean = v if mean is None else rate * v + (1 - rate) * mean
        out.append(None if v is None else mean)
    return out


def test_smoothing_keeps_the_bits_of_the_plain_recurrence(spark):
    values = {"a": [0.5, 0.9] + [1.0] * 300, "b": [None] + [1.0 - 0.01 * (k % 7) for k in range(400)] + [None, 1.0], None: [0.25, None, 1.0]}
    rows = spark.createDataFrame([(s, k, v, "kept") for s, x in values.items() for k, v in enumerate(x)], "symbol string, k int, c double, close string").withColumn("ts", F.timestamp_seconds("k"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("10000", "17"):  # the mean goes on over batches
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = sorted(smoothed(rows, ["c"], 0.3).collect(), key=lambda r: r["k"])
            for s, x in values.items():
                assert [r["c"] for r in got if r["symbol"] == s] == plain_means(x, 0.3)
            assert all(r["close"] == "kept" for r in got)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_processed_predictions_of_sure_bars(spark, tmp_path):
    """Busy hours make probabilities of 1, so that the quartiles leave no room for an ulp."""
    con = duckdb.connect()
    con.execute(
        f"""copy (select h * 1000 + k as event_id, timestamp '2024-01-01' + interval 1 hour * h + interval 1 second * k as ts, ['click', 'view'][h % 2 + 1] as event_type, (k * 7 + h) % 100 / 10 as value
        from (select unnest(range(300)) as h), (select unnest(range(900)) as k)) to '{tmp_path}/events.parquet' (format parquet)"""
    )
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet')")
    got = registry.queries()["processed_predictions"](spark, str(tmp_path)).select("symbol", "t", "confidence").collect()
    want = con.execute(f"select symbol, t, confidence from ({registry.oracle()['processed_predictions']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_range_volatility_of_zeros_and_signs(spark):
    inf, nan = math.inf, math.nan
    pairs = [(5.0, 0.0), (0.0, 0.0), (0.0, -1.0), (1.0, -1.0), (-1.0, -2.0), (-1.0, 0.0), (math.e, 1.0), (inf, 1.0), (inf, inf), (nan, 0.0), (1.0, None), (None, 0.0)]
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, high double, low double")
    got = [r[0] for r in rows.withColumn("v", volatility.range_vol()).orderBy("k").select("v").collect()]
    want = [inf, nan, inf, nan, math.log(2) / 4, nan, 1 / (4 * math.log(2)), inf, nan, nan, None, None]
    assert [g if g is None else pytest.approx(g, nan_ok=True) for g in got] == want


def test_volatility_features_of_a_bar_that_falls_to_zero(spark, tmp_path):
    con = duckdb.connect()
    con.execute(
        f"""copy (select k as event_id, timestamp '2024-01-01' + interval 20 minute * k as ts, 'click' as event_type, case when k in (100, 123, 124, 125) then 0 else 5 + k * 37 % 100 end::double as value
        from (select unnest(range(300)) as k)) to '{tmp_path}/events.parquet' (format parquet)"""
    )
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet')")
    got = registry.queries()["volatility_features"](spark, str(tmp_path)).select("t", "range_vol").orderBy("t").collect()
    want = con.execute(f"select t, range_vol from ({registry.oracle()['volatility_features']}) order by t").fetchall()
    assert sum(v == math.inf for _, v in want) == 1 and sum(math.isnan(v) for _, v in want) == 1
    assert [tuple(r) for r in got] == [(t, pytest.approx(v, abs=1e-6, nan_ok=True)) for t, v in want]


def test_array_normalizers_work_out_an_array_once(spark):
    """Statistics made anew for each element take minutes on arrays of this length."""
    v = np.random.default_rng(1).normal(3, 2, 3000)
    rows = spark.createDataFrame([(v.tolist(),)], "v array<double>")
    made = rows.select(adaptive.array_zscore(F.col("v")).alias("z"), adaptive.array_minmax(F.col("v")).alias("m"), adaptive.array_robust(F.col("v")).alias("r"))
    begun = time.monotonic()
    got = made.first()
    assert time.monotonic() - begun < 60
    o = np.sort(v)
    assert got["z"] == pytest.approx((v - v.mean()) / v.std()) and got["m"] == pytest.approx((v - o[0]) / (o[-1] - o[0]))
    assert got["r"] == pytest.approx((v - o[1500]) / (o[2249] - o[750]))


def test_array_normalizers_of_odd_arrays(spark):
    nan = math.nan
    rows = spark.createDataFrame([(0, None), (1, []), (2, [7.0]), (3, [2.0, None, 4.0, 3.0]), (4, [1.0, nan, 3.0])], "k int, v array<double>")
    made = rows.select("k", adaptive.array_zscore(F.col("v")).alias("z"), adaptive.array_minmax(F.col("v")).alias("m"), adaptive.array_robust(F.col("v")).alias("r"))
    got = [str(tuple(r[1:])) for r in made.orderBy("k").collect()]
    assert got == [
        "(None, None, None)",
        "([], [], [])",
        "([0.0], [0.0], [0.0])",
        "([None, None, None, None], [0.0, None, 1.0, 0.5], [-2.0, None, 0.0, -1.0])",
        "([nan, nan, nan], [nan, nan, nan], [nan, nan, nan])",
    ]
