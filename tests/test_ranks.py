"""Ranks within groups, and the selections that rest on them, for groups of any size."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidebar.operators import balance, preprocess
from tidebar.operators.ranks import ranked

LABELLED = "symbol string, seq bigint, class int, strength double"


def labelled(spark, n, classes, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice("abc"), k, rng.choice(classes), rng.choice([0.0, 0.5, rng.random(), None])) for k in range(n)]
    return rows, spark.createDataFrame(rows, LABELLED).repartition(5)


def strongest(rows):
    return sorted(rows, key=lambda r: (r[3] is None, -(r[3] or 0.0), r[0], r[1]))


@pytest.mark.parametrize("classes", [[3], [0, 1, 2, 3, 4], [1, 1, 1, 1, None]])
def test_ranks(spark, classes):
    rows, df = labelled(spark, 500, classes)
    got = ranked(df, ["class"], [F.desc("strength"), "symbol", "seq"]).collect()
    for c in set(classes):
        own = strongest([r for r in rows if r[2] == c])
        assert [(r["symbol"], r["seq"]) for r in sorted((r for r in got if r["class"] == c), key=lambda r: r["rank"])] == [(r[0], r[1]) for r in own]
        assert {r["total"] for r in got if r["class"] == c} == {len(own)}
    assert sorted(r["rank"] for r in ranked(df, [], ["seq"]).collect()) == list(range(500))


def test_one_class_is_spread(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _, df = labelled(spark, 2000, [1])
        sizes = [r["count"] for r in ranked(df.withColumn("at", F.lit(1)), ["class"], ["symbol", "seq"]).groupBy("at").count().collect()]
        parts = df.orderBy("class", "symbol", "seq").groupBy(F.spark_partition_id()).count().collect()
        assert sizes == [2000] and len(parts) > 2 and max(r["count"] for r in parts) < 1200
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def windows(df):
    """The windows of a plan that run over a whole group before a filter on the place takes effect."""
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in text.splitlines() if "Window [" in line and "class" in line.split("], [")[1]]


def test_no_window_over_a_class(spark):
    _, df = labelled(spark, 100, [0, 1, 2])
    for made in (balance.balance_to_min(df), balance.stratified_split(df, 0.2, 0.1), balance.exact_split(df, 2, 2, 3), balance.global_balance(df.withColumn("target", F.lit("t")))):
        # what is left are sums over a row a partition and class
        assert all("sum(n" in w for w in windows(made))


@pytest.mark.parametrize("classes", [[2], [0, 2, 4]])
def test_selections_against_plain_ones(spark, classes):
    rows, df = labelled(spark, 400, classes, 7)
    of = {c: [r for r in rows if r[2] == c] for c in classes}
    least = min(map(len, of.values()))
    want = {(r[0], r[1]) for own in of.values() for r in strongest(own)[:least]}
    assert {(r["symbol"], r["seq"]) for r in balance.balance_to_min(df).collect()} == want
    assert {(r["symbol"], r["seq"]) for r in balance.global_balance(df.withColumn("target", F.lit("x"))).collect()} == want
    split = {(r["symbol"], r["seq"]): r["split"] for r in balance.exact_split(df, 11, 7, 30).collect()}
    for own in of.values():
        own = sorted(own, key=lambda r: r[:2])
        n, val, test, left = len(own), [], [], []
        for r, row in enumerate(own):
            (val if -(-(r + 1) * 11 // n) > -(-r * 11 // n) else left).append(row)
        for r, row in enumerate(left):
            if -(-(r + 1) * 7 // (n - 11)) > -(-r * 7 // (n - 11)):
                test.append(row)
        train = [r for r in left if r not in test][:30]
        assert {split[r[:2]] for r in val} == {"val"} and len(val) == 11
        assert {split[r[:2]] for r in test} == {"test"} and len(test) == 7
        assert {split[r[:2]] for r in train} == {"train"}
        assert sum(1 for r in own if r[:2] in split) == 48


def test_required_classes_and_none(spark):
    _, df = labelled(spark, 50, [0, 1])
    with pytest.raises(ValueError, match="5 classes"):
        balance.balance_to_min(df, required=5)
    assert balance.balance_to_min(df.filter("false")).count() == 0
    assert balance.stratified_split(df.filter("class is null"), 0.2, 0.1).count() == 0


def test_global_rank_narrows(spark, monkeypatch):
    rng = random.Random(4)
    values = [rng.gauss(0, 1) for _ in range(3000)] + [0.25] * 700 + [None, float("nan"), float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    own = sorted(v for v in values if v is not None and v == v and abs(v) != float("inf"))
    shares = [0.0, 0.01, 0.25, 0.5, 0.61, 0.99, 1.0]
    want = [own[int((len(own) - 1) * p + 0.5)] for p in shares]
    assert preprocess.global_rank(df, "x", shares) == want
    monkeypatch.setattr(preprocess, "FEW", 4)
    assert preprocess.global_rank(df, "x", shares, accuracy=50) == want
