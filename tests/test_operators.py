"""Hand-computed cases of single operators, and what holds of any bars."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.functions.windows import staged, with_base
from tidebar.operators import balance, fractal, metrics, preprocess, recurrences, sequences, targets, trend, validate, volatility
from tidebar.sources import bars as source
from tidebar.streaming import bars as stream


def make(spark, rows, symbol="s"):
    """(open, high, low, close, volume) rows to hourly bars."""
    made = [(symbol, 3600 * k, *map(float, r)) for k, r in enumerate(rows)]
    df = spark.createDataFrame(made, "symbol string, t bigint, open double, high double, low double, close double, volume double")
    return df.select("symbol", F.timestamp_seconds("t").alias("ts"), "open", "high", "low", "close", "volume")


def closes(spark, values, volumes=None):
    volumes = volumes or [1.0] * len(values)
    return make(spark, [(c, c + 5, c - 5, c, v) for c, v in zip(values, volumes)])


def column(df, name):
    return [r[name] for r in df.orderBy("ts").select("ts", name).collect()]


def walk(n, seed=1):
    rng, price, out = random.Random(seed), 100.0, []
    for _ in range(n):
        o = price
        price = max(5.0, price * (1 + rng.gauss(0, 0.02)))
        out.append((o, max(o, price) * (1 + rng.random() / 50), min(o, price) * (1 - rng.random() / 50), price, rng.randrange(0, 2000)))
    return out


def test_on_balance_volume(spark):
    b = staged(with_base(closes(spark, [100, 105, 103, 108, 108], [1000, 1500, 1200, 1800, 1000])), {"signed": volatility.signed_volume()}, {"obv": volatility.obv()})
    assert column(b, "obv") == [1000, 2500, 1300, 3100, 3100]


def test_cumulative_vwap(spark):
    b = with_base(closes(spark, [100, 110, 105, 115], [1000, 2000, 1500, 2500])).withColumn("vwap", volatility.cumulative_vwap())
    assert column(b, "vwap")[:2] == [100.0, pytest.approx(106.666666, abs=1e-5)]


def test_constant_prices(spark):
    b = with_base(make(spark, [(50, 50, 50, 50, 10)] * 60))
    b = b.withColumns({"w": trend.williams_r(14), "ch": volatility.choppiness(14), "c": trend.cci(20), "k": trend.stochastic_k(14), "pv": volatility.price_volume_corr(20)})
    assert set(column(b, "w")) == {None, -50.0} and set(column(b, "ch")) == {None, 100.0}
    assert set(column(b, "c")) == {None, 0.0} and set(column(b, "k")) == {None, 50.0} and set(column(b, "pv")) == {None, 0.0}


def test_liquidity_sweeps(spark):
    up = [(100, 110, 95, 108), (108, 110, 100, 109), (109, 110, 105, 108), (108, 110, 106, 109), (109, 110, 105, 109), (109, 115, 108, 108), (108, 110, 104, 105)]
    b = with_base(make(spark, [(*r, 1) for r in up])).withColumns(volatility.sweeps(5))
    assert column(b, "sweep_up")[:6] == [0, 0, 0, 0, 0, 1] and column(b, "sweep_down")[5] == 0
    down = [(110, 115, 100, 108), (108, 112, 100, 105), (105, 108, 100, 104), (104, 107, 100, 103), (103, 106, 100, 102), (102, 105, 90, 102)]
    b = with_base(make(spark, [(*r, 1) for r in down])).withColumns(volatility.sweeps(5))
    assert column(b, "sweep_down")[5] == 1


def test_wick_ratios(spark):
    rows = [(100, 110, 90, 105, 1), (105, 106, 95, 96, 1), (99, 99, 99, 99, 1), (105, 105, 99, 99, 1)]
    b = with_base(make(spark, rows)).withColumns(trend.wick_ratios())
    parts = list(zip(*(column(b, c) for c in ("upper_wick", "lower_wick", "body"))))
    assert all(0 <= x <= 1 for p in parts for x in p)
    assert [round(sum(p), 9) for p in parts] == [1, 1, 0, 1] and parts[-1][2] > 0.99


def test_no_feature_looks_ahead(spark):
    rows = walk(90)
    made = {"rsi_14", "sma", "cvd", "pos", "chop", "vol", "slope"}

    def features(r):
        b = with_base(recurrences.apply(make(spark, r), recurrences.Rsi(14)))
        b = b.withColumns({"sma": trend.sma("close", 9), "cvd": volatility.volume_delta(), "pos": volatility.position_in_range(9), "chop": volatility.choppiness(9), "vol": volatility.realized_vol(9), "slope": trend.slope("close", 9)})
        return {c: column(b, c) for c in made}

    whole, part = features(rows), features(rows[:60])
    for c in made:
        assert whole[c][:60] == pytest.approx(part[c], abs=1e-9, nan_ok=True) if None not in part[c] else [x for x in whole[c][:60]] == pytest.approx(part[c])


def test_fractal_measures(spark):
    flat = fractal.measures(make(spark, [(50, 50, 50, 50, 1)] * 130))
    assert {r.hurst for r in flat.collect()} == {None, 0.4} and {r.fractal_dimension for r in flat.collect()} == {None, 1.5}
    got = fractal.measures(make(spark, walk(160, 3)))
    hurst, dimension = column(got, "hurst"), column(got, "fractal_dimension")
    assert hurst[:100] == [None] * 100 and all(0.1 <= h <= 0.9 for h in hurst[100:])
    assert dimension[:50] == [None] * 50 and all(0.5 <= d <= 2.5 for d in dimension[50:])


@pytest.mark.parametrize(("overlap", "step"), [(0, 60), (0.5, 30), (0.8, 12), (0.9, 6), (0.99, 1), (1, 1)])
def test_step_size(overlap, step):
    assert sequences.step_size(overlap, 60) == step


@pytest.mark.parametrize(("text", "minutes", "bars"), [("1h", 60, 1), ("4h", 5, 48), ("1d", 60, 24), ("2d", 60, 48), ("1d", 5, 288), ("15m", 5, 3)])
def test_horizons(text, minutes, bars):
    assert sequences.parse_horizon(text, minutes) == bars


@pytest.mark.parametrize(("text", "minutes"), [("invalid", 5), ("16", 5), ("h16", 5), ("", 5), ("5m", 60)])
def test_horizon_errors(text, minutes):
    with pytest.raises(ValueError):
        sequences.parse_horizon(text, minutes)


def test_sequences_and_tensors(spark):
    b = make(spark, walk(100))
    starts = sorted(r.seq for r in sequences.starts(b, 20, 5, 6).collect())
    assert starts == list(range(0, 75, 5)) and len(starts) == sequences.expected_count(100, 20, 5, 6)
    for r in sequences.tensors(b, ["close", "volume"], 20, 5, 6).collect():
        x = np.array(r.features)
        assert x.shape == (20, 2) and np.allclose(x.mean(0), 0, atol=1e-9) and np.allclose(x.std(0), 1, atol=1e-6)
    parts = {(r.seq, r.part): r["count"] for r in sequences.members(b, 20, 5, 6).groupBy("seq", "part").count().collect()}
    assert set(parts.values()) == {20, 6} and len(parts) == 2 * len(starts)
    assert len(sequences.last_sequence(b, 20).collect()) == 20


def test_targets_do_not_depend_on_scale(spark):
    rows = walk(120)
    one = targets.all_targets(sequences.summaries(make(spark, rows), 20, 5, 6), 20)
    ten = targets.all_targets(sequences.summaries(make(spark, [tuple(x * 10 for x in r[:4]) + (r[4],) for r in rows]), 20, 5, 6), 20)
    key = lambda d: sorted((r.seq, r.target, r["class"]) for r in d.collect())
    a, b = key(one), key(ten)
    assert len(a) == 6 * sequences.expected_count(120, 20, 5, 6)
    assert sum(x != y for x, y in zip(a, b)) <= 1 and {x[2] for x in a} <= {0, 1, 2, 3, 4}


def test_balance_and_splits(spark):
    rng = random.Random(8)
    rows = [("s", k, rng.choice([0, 0, 0, 1, 2, 3, 4]), rng.random()) for k in range(300)] + [("s", 900, None, 0.1)]
    labelled = spark.createDataFrame(rows, "symbol string, seq bigint, class int, strength double")
    counts = {r["class"]: r["count"] for r in balance.balance_to_min(labelled).groupBy("class").count().collect()}
    assert len(counts) == 5 and len(set(counts.values())) == 1
    split = balance.stratified_split(labelled, 0.2, 0.1).collect()
    assert len(split) == 300 and len({(r.seq, r.split) for r in split}) == 300
    val = sum(r.split == "val" for r in split)
    assert 50 <= val <= 60
    windows = balance.progressive_windows(make(spark, walk(40)), 4).groupBy("window").count().collect()
    assert {r.window: r["count"] for r in windows} == {0: 10, 1: 20, 2: 30, 3: 40}


def test_classification_metrics(spark):
    rows = spark.createDataFrame([(1, 1), (0, 0), (1, 0), (1, 1)], "p int, a int")
    assert metrics.classification(rows, "p", "a").first().accuracy == 0.75
    assert metrics.expected_calibration_error(spark.createDataFrame([], "c double, ok boolean"), "c", "ok").first().ece == 0.0
    sure = spark.createDataFrame([(1.0, True)] * 5, "c double, ok boolean")
    assert metrics.expected_calibration_error(sure, "c", "ok").first().ece < 0.01


def test_feature_selection():
    assert metrics.select_features([("rsi", "rsi_14", 0.99), ("a", "b", 0.2)], ["rsi", "rsi_14", "a", "b"]) == ["rsi", "a", "b"]


def test_exact_percentiles(spark):
    rng = random.Random(9)
    values = [float(rng.randrange(500)) for _ in range(4000)] + [float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    ordered = sorted(values[:-1])
    for p, got in zip((0.0, 0.25, 0.5, 0.9, 1.0), preprocess.global_rank(df, "x", [0.0, 0.25, 0.5, 0.9, 1.0], 100)):
        assert got == ordered[int(p * 3999 + 0.5)]
    assert preprocess.global_rank(df.filter("false"), "x", [0.5]) == [None]


def test_csv(spark, tmp_path):
    path = tmp_path / "ABC.csv"
    path.write_text("Time,O,High,low,C,vol,mood\n2024-01-01T00:00:00Z,1,2,0.5,1.5,10,0.3\n1704070800,1,2,0.5,bad,11,\n,1,1,1,1,1,1\n1704074400000,2,3,1,2,5,1\n")
    b = source.read_csv(spark, str(path))
    rows = b.orderBy("ts").collect()
    assert [r.symbol for r in rows] == ["ABC"] * 3 and [r.close for r in rows] == [1.5, None, 2.0] and rows[0].mood == 0.3
    assert [int(r.ts.timestamp()) for r in b.orderBy("ts").collect()] == [1704067200, 1704070800, 1704074400]
    with pytest.raises(ValueError):
        source.read_csv(spark, "x.parquet")
    with pytest.raises(ValueError):
        source.normalize_header(spark.createDataFrame([(1,)], "open int"))
    assert source.symbol_paths("/d", ["A", "B"]) == ["/d/A.csv", "/d/B.csv"]
    with pytest.raises(ValueError):
        source.symbol_paths("/d/a.csv", ["A", "B"])


def test_timeframe_and_reports(spark):
    b = make(spark, walk(30))
    assert validate.timeframe(b).first().minutes == 60
    report = validate.ohlc_report(b.unionByName(make(spark, [(1, 0, 2, -1, -5)], "t"))).collect()
    assert {r.symbol: r.n_broken for r in report} == {"s": 0, "t": 1}


def test_csv_tail_and_ring_buffer(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [f"{1704067200 + 3600 * k},10,12,9,{10 + k % 3},5" for k in range(12)]
    (tmp_path / "in" / "XY.csv").write_text("timestamp,open,high,low,close,volume\n" + "\n".join(lines) + "\n1,2,3\n1704067200,1,0,2,1,1\n# note\n")
    good, rejected = stream.csv_tail(spark, str(tmp_path / "in"))
    made = stream._replay(spark, stream.ring_buffer(good, 50, 5), "append").collect()
    assert [(r.symbol, r.n) for r in made] == [("XY", 12)] and made[0].last_close == 12.0
    assert stream._replay(spark, rejected, "append").count() == 2


def test_sliding_bars(spark, sf_dir):
    events = stream.event_stream(spark, sf_dir)
    assert stream._replay(spark, stream.bar_stream(events, "2 hours", "1 hour"), "complete").agg(F.sum("volume")).first()[0] == 2000.0


def test_predictions_and_augmentation(spark, tmp_path):
    from tidebar.operators import augment, predictions

    rows = spark.createDataFrame([([0.1, 0.2, 0.4, 0.2, 0.1], 2), ([0.0, 0.0, 0.0, 0.0, 1.0], 4)], "p array<double>, a int")
    made = rows.withColumns(predictions.direction_metrics(F.col("p"), F.lit(0.02))).withColumn("label", predictions.label(F.col("p"))).collect()
    assert [r.label for r in made] == ["sideways", "pump"] and made[0].expected_move == pytest.approx(0) and made[1].risk_reward == 10
    assert [sum(r.c) for r in predictions.bias_corrected(rows, "p", "a").select(F.col("corrected").alias("c")).collect()] == pytest.approx([1, 1])
    assert rows.select(predictions.smoothed_label(F.lit(1)).alias("s")).first().s == pytest.approx([0.02, 0.92, 0.02, 0.02, 0.02])
    predictions.write_json(rows, str(tmp_path / "j"))
    predictions.write_csv(rows.select("a"), str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2 and spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    b = sequences.tensors(make(spark, walk(80)), ["open", "close"], 20, 10, 5)
    for kind in augment.KINDS:
        one = {r.seq: r.features for r in augment.augment(b, kind, 3, exempt=1).collect()}
        assert one == {r.seq: r.features for r in augment.augment(b.repartition(3), kind, 3, exempt=1).collect()}
        for r in b.collect():
            x, y = np.array(r.features), np.array(one[r.seq])
            assert x.shape == y.shape and np.allclose(x[:, 0], y[:, 0]) and not np.allclose(x[:, 1], y[:, 1])
    with pytest.raises(ValueError):
        augment.augment(b, "none")
