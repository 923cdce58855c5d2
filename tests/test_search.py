"""Searches, overlaps, paths, the parabolic stop and models of several targets."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.operators import container, intervals, parabolic, paths, search
from tidebar.operators import sequences as Q
from tidebar.operators import targets as T
from tidebar.plans.indicators import bars
from tidebar.plans.target_queries import GRID, HORIZONS, LENGTH, STEP


def test_search_is_seeded_and_never_worse_than_the_grid(spark, sf_dir, monkeypatch):
    b = bars(spark, sf_dir)
    given = {target: [{T.VARIED[target]: v} for v in values] for target, values in GRID.items()}
    passes = []
    counted = search.counted
    monkeypatch.setattr(search, "counted", lambda *a: passes.append(1) or counted(*a))
    found = search.searched(b, LENGTH, STEP, HORIZONS, given, start=4, batch=3, rounds=3)
    assert len(passes) == 3 and set(found) == {(t, h) for t in search.SPACE for h in HORIZONS}
    assert search.searched(b, LENGTH, STEP, HORIZONS, given, start=4, batch=3, rounds=3) == found
    for h in HORIZONS:
        summary = Q.summaries(b, LENGTH, STEP, h, reach=max(HORIZONS))
        for r in T.calibrated(T.candidates(summary, LENGTH, GRID)).collect():
            assert found[r.target, h][0] <= r.score + 1e-6
    # the counts behind a score are those of the parameters
    p = search.parameters(found, 3)
    made = T.all_targets(Q.summaries(b, LENGTH, STEP, 3, reach=max(HORIZONS)), LENGTH, p).filter("class is not null").groupBy("target", "class").count().collect()
    for t in search.SPACE:
        counts = [sum(r["count"] for r in made if r["target"] == t and r["class"] == k) for k in range(5)]
        assert search.score(counts) == pytest.approx(found[t, 3][0])
    rows = search.as_rows(b, found).collect()
    assert len(rows) == sum(len(box) for box in search.SPACE.values()) * 2


def test_spread_points_are_far_apart():
    pool = np.random.default_rng(0).random((200, 2))
    chosen = search.spread(pool, np.array([[0.5, 0.5]]), 8)
    gaps = [np.hypot(*(a - b)) for k, a in enumerate(chosen) for b in chosen[:k]]
    assert min(gaps) > 0.25 and len({tuple(c) for c in chosen}) == 8
    assert search.score([0, 1, 1, 1, 1]) > 1000 > search.score([1, 20, 20, 20, 20]) > search.score([5, 5, 5, 5, 5]) == 0 and search.score([0] * 5) == math.inf


def test_overlaps_against_all_pairs(spark):
    rng, length = random.Random(2), 10
    rows = [(rng.choice("ab"), rng.randrange(0, 120), rng.choice(["val", "test", "train"])) for _ in range(70)]
    rows += [("a", 5, "val"), ("a", 5, "train"), ("a", 5, "train"), ("c", 1, "val")]
    df = spark.createDataFrame(rows, "symbol string, seq bigint, split string")
    pairs = {}
    own = sorted(set(rows))
    for k, x in enumerate(own):
        for y in own[:k]:
            if x[0] == y[0]:
                a, b = sorted([(y[1], y[2]), (x[1], x[2])])
                pairs[x[0], *a, *b] = max(0, length - (b[0] - a[0])) / length
    got = {(r.symbol, r.first, r.by_first, r.second, r.by_second): r.ratio for r in intervals.overlapping(df, length, "split").collect()}
    assert got == {k: v for k, v in pairs.items() if v > 0}
    report = {(r.low, r.high): r for r in intervals.overlap_report(df, length, "split").collect()}
    for low, high in report:
        mine = [v for (_, _, p, _, q), v in pairs.items() if sorted((p, q)) == [low, high]]
        r = report[low, high]
        assert (r.pairs, r.overlapping, r.most) == (len(mine), sum(v > 0 for v in mine), max(mine)) and r.mean_overlap == pytest.approx(sum(mine) / len(mine))
    left = {tuple(r) for r in intervals.without_overlaps(df, length, "val").select("symbol", "seq", "split").collect()}
    assert left == {x for x in own if x[2] == "val" or not any(v[2] == "val" and v[0] == x[0] and abs(v[1] - x[1]) < length for v in own)}
    assert intervals.overlap_report(df.filter("false"), length, "split").count() == 0


def plain_stop(rows):
    """From the rule, with whole histories."""
    out, rising, value, best, rate = [], None, None, None, None
    for k, (h, lo, c) in enumerate(rows):
        if k == 0:
            out.append(None)
            continue
        if k == 1:
            rising = c >= rows[0][2]
            value, best, rate = (rows[0][1], max(rows[0][0], h), 0.02) if rising else (rows[0][0], min(rows[0][1], lo), 0.02)
        else:
            before = rows[max(0, k - 2) : k]
            value += rate * (best - value)
            value = min([value, *[b[1] for b in before]]) if rising else max([value, *[b[0] for b in before]])
            if rising and lo < value:
                rising, value, best, rate = False, best, lo, 0.02
            elif not rising and h > value:
                rising, value, best, rate = True, best, h, 0.02
            elif rising and h > best:
                best, rate = h, min(0.2, rate + 0.02)
            elif not rising and lo < best:
                best, rate = lo, min(0.2, rate + 0.02)
        out.append((value, rising))
    return out


def test_parabolic_stop(spark):
    rng, rows = random.Random(6), []
    for s in "ab":
        p = 50.0
        for k in range(150):
            p *= 1 + rng.gauss(0.002 if k < 60 else -0.003, 0.01)
            rows.append((s, k, p * 1.004, p * 0.996, p))
    rows.append(("a", 40_000, None, 1.0, 1.0))
    df = spark.createDataFrame(rows, "symbol string, k int, high double, low double, close double").withColumn("ts", F.timestamp_seconds("k"))
    got = {(r.symbol, r.k): (r.sar, r.sar_rising) for r in parabolic.parabolic(df.repartition(3)).collect()}
    for s in "ab":
        own = [r for r in rows if r[0] == s and r[2] is not None]
        for r, want in zip(own, plain_stop([r[2:] for r in own])):
            assert got[s, r[1]] == (None, None) if want is None else got[s, r[1]] == (pytest.approx(want[0]), want[1])
    assert got["a", 40_000] == (None, None) and {v[1] for v in got.values()} == {None, True, False}
    assert parabolic.parabolic(df.filter("false")).count() == 0


def test_path_statistics(spark):
    rng = random.Random(1)
    rows = [("s", k, [10 + rng.random() for _ in range(n)]) for k, n in enumerate((2, 3, 8, 25))] + [("flat", 0, [2.0] * 9), ("one", 0, [1.0]), ("none", 0, [])]
    got = {(r.symbol, r.seq): r for r in paths.path_statistics(spark.createDataFrame(rows, "symbol string, seq bigint, path array<double>")).collect()}
    assert set(got) == {("s", 0), ("s", 1), ("s", 2), ("s", 3), ("flat", 0)}
    for s, k, p in rows[:5]:
        r = got[s, k]
        assert r.rise == pytest.approx(max(p) / p[0] - 1) and r.fall == pytest.approx(min(p) / p[0] - 1)
        assert r.mean_rise == pytest.approx(sum(max(p[j + 1 :]) / p[j] - 1 for j in range(len(p) - 1)) / (len(p) - 1))
        assert r.mean_fall == pytest.approx(sum(min(p[j + 1 :]) / p[j] - 1 for j in range(len(p) - 1)) / (len(p) - 1))
        m = [math.log(b / a) for a, b in zip(p, p[1:])]
        if max(m) > min(m):
            bins = [min(int((x - min(m)) / (max(m) - min(m)) * 10), 9) for x in m]
            assert r.entropy == pytest.approx(-sum(bins.count(b) / len(m) * math.log(bins.count(b) / len(m)) for b in set(bins)) / math.log(10), abs=1e-9)
        def rescaled(x):
            mean = sum(x) / len(x)
            at, low, high = 0.0, 0.0, 0.0
            for v in x:
                at += v - mean
                low, high = min(low, at), max(high, at)
            return (high - low) / math.sqrt(sum((v - mean) ** 2 for v in x) / len(x))
        if len(m) > 3 and max(m) > min(m):
            half = len(m) // 2
            assert r.hurst == pytest.approx(math.log2(rescaled(m[: 2 * half]) * 2 / (rescaled(m[:half]) + rescaled(m[half : 2 * half]))))
        else:
            assert r.hurst == 0.5 and r.entropy >= 0


def test_models_of_several_targets(spark, tmp_path):
    rng, rows = random.Random(9), []
    for k in range(400):
        a, b = rng.random(), rng.random()
        rows.append((rng.choice("xy"), k, a, b, int(a * 5), 4 if b > 0.6 else 1, 2 if k % 97 else None, k % 5 if k < 20 else None, None))
    df = spark.createDataFrame(rows, "symbol string, seq bigint, a double, b double, up int, side int, same int, few int, none int")
    early, later = container.early_and_later(df)
    made = container.fit(early, ["a", "b"], ["up", "side", "same", "few", "none"], trees=8)
    assert set(made.first) == {"up", "side"} and set(made.second) <= set(made.first) and made.common["same"] == 2 and made.common["none"] is None
    made.save(spark, str(tmp_path / "m"))
    back = container.Container.load(spark, str(tmp_path / "m"))
    key = lambda c: sorted((r.symbol, r.seq, r.predicted_up, r.predicted_side, r.predicted_same, r.predicted_few, r.predicted_none, tuple(np.round(r.p_up, 9))) for r in c.transform(later).collect())
    assert key(made) == key(back)
    report = {r.name: r for r in container.scored(back, later).collect()}
    assert report["side"].accuracy > 0.95 and report["up"].within_one > 0.9 and report["same"].accuracy == 1 and report["same"].stage == 0 and "none" not in report
    row = back.transform(later).first()
    assert len(row.p_up) == 5 and sum(row.p_up) == pytest.approx(1) and not [c for c in row.asDict() if c.startswith("_")]
    # without its second stage a target falls back to the first
    back.second.clear()
    assert {r.stage for r in container.scored(back, later).collect() if r.name in ("up", "side")} == {1}
