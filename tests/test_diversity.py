"""Weighted diversity against all pairs, and farthest-first picks against a plain selection."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tidebar.operators import diversity as D

TENSORS = "symbol string, seq bigint, features array<array<double>>"


def sequences(n, seed=3):
    rng, rows = random.Random(seed), []
    for k in range(n):
        p, bars = 10 + 5 * rng.random(), []
        for _ in range(4):
            p *= 1 + rng.gauss(0, 0.05)
            bars.append([p, p * 1.02, p * 0.97, p * (1 + rng.gauss(0, 0.005)), 100 * rng.random()])
        rows.append((rng.choice("ab"), 7 * k, bars, rng.choice([0, 1, 1, 2]), round(rng.random(), 1)))
    rows.append(("zero", 0, [[0.0] * 5] * 4, 1, 0.5))
    return rows


def cosine(a, b):
    x, y = math.sqrt(sum(v * v for v in a)), math.sqrt(sum(v * v for v in b))
    return 1.0 if not x or not y else 1 - sum(v * w for v, w in zip(a, b)) / x / y


def market(bars):
    n, close = len(bars), [b[3] for b in bars]
    mean = sum(close) / n
    if not mean:
        return None
    tr = [max(b[1] - b[2], abs(b[1] - a[3]), abs(b[2] - a[3])) for a, b in zip(bars, bars[1:])]
    mid = (n - 1) / 2
    slope = sum((k - mid) * (c - mean) for k, c in enumerate(close)) / sum((k - mid) ** 2 for k in range(n))
    return [sum(tr) / (n - 1), slope, sum(b[4] for b in bars) / n / mean, (max(b[1] for b in bars) - min(b[2] for b in bars)) / mean]


def described(spark, rows):
    tensors = spark.createDataFrame([r[:3] for r in rows], TENSORS)
    classes = spark.createDataFrame([(r[0], r[1], r[3], r[4]) for r in rows], "symbol string, seq bigint, class int, strength double")
    return D.described(tensors).join(classes, ["symbol", "seq"])


def flat(bars):
    return [v for b in bars for v in b]


def test_weighted_scores(spark):
    rows = sequences(40)[:-1] + [("one", 5, sequences(1)[0][2], 2, 0.1)]
    got = {(r.symbol, r.seq): r for r in D.weighted(described(spark, rows), 20, "symbol").collect()}
    assert len(got) == len(rows)
    for x in rows:
        own = [y for y in rows if y[0] == x[0]]
        others = [y for y in own if y is not x]
        starts = [y[1] for y in own]
        half, mid = (max(starts) - min(starts)) // 2, (max(starts) + min(starts)) // 2
        want = (
            sum(cosine(flat(x[2]), flat(y[2])) for y in others) / len(others) if others else 1.0,
            min(abs(x[1] - mid) / half, 1.0) if half else 1.0,
            min(max(sum(cosine(market(x[2]), market(y[2])) for y in others) / len(others), 0.0), 1.0) if others else 0.5,
            0.2 + 0.6 * (1 - sum(y[3] == x[3] for y in own) / len(own)),
        )
        r = got[x[0], x[1]]
        assert (r.feature, r.temporal, r.market_part, r.target) == pytest.approx(want, abs=1e-9)
        assert r.composite == pytest.approx(0.3 * want[0] + 0.25 * want[1] + 0.25 * want[2] + 0.2 * want[3])


def test_farthest_first_picks(spark):
    rows = sequences(50, 8)
    got = {}
    for r in D.farthest_first(described(spark, rows).repartition(3), 6, "symbol").collect():
        got.setdefault(r.symbol, []).append((r.place, r.seq))
    for s in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == s]
        span = max(r[1] for r in own) - min(r[1] for r in own)

        def off(x, y):
            m = cosine(market(x[2]), market(y[2])) if market(x[2]) and market(y[2]) else 1.0
            return 0.3 * cosine(flat(x[2]), flat(y[2])) + 0.25 * (abs(x[1] - y[1]) / span if span else 0) + 0.25 * m + 0.2 * (x[3] != y[3])

        taken = [min(own, key=lambda r: (-r[4], r[1]))]
        while len(taken) < min(6, len(own)):
            taken.append(min((r for r in own if r not in taken), key=lambda r: (-round(min(off(r, t) for t in taken), 12), r[1])))
        assert [q for _, q in sorted(got[s])] == [t[1] for t in taken]


def test_picks_have_each_column_once_and_null_groups(spark, sf_dir, tmp_path):
    from tidebar.plans import path_queries

    got = path_queries.QUERIES["diverse_picks"](spark, sf_dir)
    got.write.parquet(f"{tmp_path}/picks")
    assert got.columns == ["symbol", "seq", "place"] and spark.read.parquet(f"{tmp_path}/picks").count() == got.distinct().count() > 0
    rows = described(spark, sequences(12)).withColumn("lot", F.when(F.col("seq") > 20, F.lit(7)))
    picks = D.farthest_first(rows, 3, "lot")
    assert picks.columns == ["lot", "symbol", "seq", "place"]
    assert sorted((r.lot or 0, r.place) for r in picks.collect()) == [(g, k) for g in (0, 7) for k in range(3)]
    assert D.farthest_first(rows.filter("false"), 3, "lot").count() == 0
