"""Recurrences over blocks of time against one bar at a time."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests import plain_folds as P
from tidebar.operators import recurrences as R

SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"
BEGIN = dt.datetime(2024, 1, 1)
PARTS = {
    "ema": (lambda: R.Ema(5), lambda: P.EmaFold(5)),
    "dema": (lambda: R.Dema(4), lambda: P.DemaFold(4)),
    "tema": (lambda: R.Tema(4), lambda: P.TemaFold(4)),
    "zlema": (lambda: R.Zlema(9), lambda: P.ZlemaFold(9)),
    "kama": (lambda: R.Kama(6), lambda: P.KamaFold(6)),
    "macd": (lambda: R.Macd(3, 6, 4), lambda: P.MacdFold(3, 6, 4)),
    "rsi": (lambda: R.Rsi(5), lambda: P.RsiFold(5)),
    "wilder": (lambda: R.Rsi(6, True), lambda: P.RsiFold(6, True)),
    "atr": (lambda: R.Atr(5), lambda: P.AtrFold(5)),
    "keltner": (lambda: R.Keltner(4), lambda: P.KeltnerFold(4)),
    "garch": (lambda: R.Garch(), lambda: P.GarchFold()),
}


def bars_of(symbol, n, seed, gaps=0.0, step=1):
    rng, price, rows, at = random.Random(seed), 100.0, [], 0
    for _ in range(n):
        price *= 1 + rng.gauss(0, 0.02)
        high, low = price * (1 + rng.random() / 50), price * (1 - rng.random() / 50)
        bar = [price * (1 + rng.gauss(0, 0.005)), high, low, price, 10.0 * rng.random()]
        bar = [None if rng.random() < gaps else v for v in bar]
        rows.append((symbol, BEGIN + dt.timedelta(minutes=at), *bar))
        at += step if rng.random() > 0.02 else 500 * step
    return rows


def plain(rows, folds):
    out, by_symbol = {}, {}
    for r in rows:
        by_symbol.setdefault(r[0], []).append(r)
    for symbol, own in by_symbol.items():
        own.sort(key=lambda r: r[1])
        for r, values in zip(own, P.fold([r[2:] for r in own], *[f() for f in folds])):
            out[symbol, r[1]] = values
    return out


def check(spark, rows, span, *names, whole=3):
    parts = [PARTS[n][0]() for n in names]
    made = R.apply(spark.createDataFrame(rows, SCHEMA).repartition(3), *parts, span=span, whole=whole)
    want = plain(rows, [PARTS[n][1] for n in names])
    columns = [c for p in parts for c in p.names]
    found = made.collect()
    assert len(found) == len(want)
    for r in found:
        for c, v in zip(columns, want[r["symbol"], r["ts"]]):
            assert (r[c] is None) == (v is None) and (v is None or r[c] == pytest.approx(v, rel=1e-9, abs=1e-9)), (c, r, v)


ROWS = bars_of("a", 700, 1) + bars_of("b", 40, 2) + bars_of(None, 90, 3) + bars_of("one", 1, 4) + bars_of("two", 2, 5)


@pytest.mark.parametrize("span", [30 * 60, 97 * 60, 10**9])
def test_block_size_changes_nothing(spark, span):
    check(spark, ROWS, span, *PARTS)


def test_only_large_symbols_are_cut(spark):
    check(spark, ROWS, 30 * 60, *PARTS, whole=80)
    check(spark, ROWS, 30 * 60, *PARTS, whole=10**6)


@pytest.mark.parametrize("span, gaps", [(20 * 60, 0.3), (60, 0.1), (400 * 60, 0.9), (10**9, 0.5)])
def test_nulls_anywhere(spark, span, gaps):
    rows = bars_of("a", 250, 6, gaps) + bars_of("b", 60, 7, gaps) + bars_of("c", 25, 8, 1.0)
    check(spark, rows, span, *PARTS)


def test_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        check(spark, bars_of("a", 200, 9, 0.05) + bars_of("b", 3, 1), 45 * 60, *PARTS)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_movement_and_wide_prices(spark):
    rows = [("flat", BEGIN + dt.timedelta(minutes=k), 5.0, 5.0, 5.0, 5.0, 1.0) for k in range(60)]
    rows += [("wide", BEGIN + dt.timedelta(minutes=k), *[10.0 ** ((k * 7) % 19 - 9)] * 4, 1.0) for k in range(60)]
    check(spark, rows, 600, "ema", "rsi", "atr", "kama", "garch", "macd")


def test_one_symbol_is_cut_over_several_tasks(spark):
    rows = bars_of("a", 600, 11)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = R.apply(spark.createDataFrame(rows, SCHEMA), R.Ema(5), span=3600, whole=10)
        assert made.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_other_columns_and_odd_tables(spark):
    rows = bars_of("a", 50, 12)
    bars = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as block", "1 as of", "2 as since", "3 as start", "4 as carried", "5 as low_")
    made = R.apply(bars, R.Ema(5), span=600, whole=10)
    assert made.columns == [*bars.columns, "ema_5"] and {(r["block"], r["of"], r["carried"]) for r in made.collect()} == {("x", 1, 4)}
    assert R.apply(bars.filter("false"), R.Garch()).count() == 0
    assert R.apply(bars.withColumn("ts", F.expr("if(close > 100, ts, null)")), R.Ema(5)).count() == sum(r[5] > 100 for r in rows)
    with pytest.raises(ValueError):
        R.Macd(9, 3)
