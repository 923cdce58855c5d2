"""The tail of a growing file, keyed state, and joins of streams: late rows and restarts."""

from __future__ import annotations

import datetime as dt
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidebar.sources import tail as T
from tidebar.streaming import bars as B
from tidebar.streaming import state as S

DAY = dt.datetime(2024, 1, 1)


def run(stream, folder, mode="append"):
    """One run over what is there; goes on from the checkpoint in ``folder``."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def test_ranges_take_every_line_once(tmp_path):
    rng = random.Random(2)
    for kind in range(6):
        texts = ["x" * rng.choice([0, 1, 5, 300]) + rng.choice(["", "é"]) for _ in range(60)]
        raw = ("\r\n" if kind == 5 else "\n").join(texts).encode() + b"\n"
        path = tmp_path / f"{kind}.txt"
        path.write_bytes(raw + b"unfinished")
        for step in (1, 7, 64, 1000, 10**6):
            with pa.OSFile(str(path)) as file:
                end = T.last_line_end(file)
                assert end == len(raw)
                found = [line for at in range(0, end, step) for line in T.lines(file, at, min(at + step, end))]
            assert [v.decode() for _, v in found] == texts
            assert all(raw[at : at + len(v)] == v for at, v in found)
    empty = tmp_path / "none"
    empty.write_bytes(b"no end yet")
    with pa.OSFile(str(empty)) as file:
        assert T.last_line_end(file) == 0 and list(T.lines(file, 0, 0)) == []


def test_appended_lines_come_once_over_restarts(spark, tmp_path):
    path = tmp_path / "bars.csv"
    path.write_text("Timestamp,open,high,low,close,volume\n0,1,2,1,2,5\n# a comment\n\n60,1,2,1,1.5,1\n120,1,")
    stream = lambda: T.bar_lines(T.tail(spark, str(path), 20), "s")
    read = lambda: sorted((int(r.ts.timestamp()) if r.ts else None, r.ok) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    run(stream(), tmp_path)
    assert read() == [(0, True), (60, True)]
    run(stream(), tmp_path)  # a restart without news
    assert len(read()) == 2
    with path.open("a") as f:
        f.write("2,1,2,9\n180,5,4,6,5,1\n240,1,2,1,2,x\n300,1,1,1,1,1\n")
    run(stream(), tmp_path)
    assert read() == [(0, True), (60, True), (120, True), (180, False), (240, False), (300, True)]
    with path.open("a") as f:
        f.writelines(f"{360 + k},1,2,1,2,1\n" for k in range(500))
    run(stream(), tmp_path)
    assert len(read()) == 506 and len(set(read())) == 506
    path.write_text("7,1,2,1,2,1\n")  # replaced by a shorter one
    run(stream(), tmp_path)
    assert len(read()) == 507 and (7, True) in read()


def bars_at(spark, folder, rows):
    spark.createDataFrame(rows, B.BAR_COLUMNS).coalesce(1).write.mode("append").parquet(folder)


def bar(symbol, minute, close):
    return (symbol, DAY + dt.timedelta(minutes=minute), close, close + 1, close - 0.5, close, 1.0)


@pytest.fixture
def rocks(spark):
    for k, v in S.ROCKS.items():
        spark.conf.set(k, v)
    yield
    for k in S.ROCKS:
        spark.conf.unset(k)


def test_state_keeps_the_last_bars_over_restarts(spark, tmp_path, rocks):
    rng, seen = random.Random(3), {"a": [], "b": []}
    shown = set()
    for batch in range(4):
        rows = [bar(s, 100 * batch + m, 5.0 + rng.random()) for s, n in (("a", 9), ("b", 2)) for m in rng.sample(range(100), n)]
        bars_at(spark, f"{tmp_path}/in", [*rows, ("a", DAY, -1.0, 2.0, 1.0, 1.0, 1.0)])  # a bad bar
        run(S.ring_buffer(spark.readStream.schema(B.BAR_COLUMNS).parquet(f"{tmp_path}/in"), size=20, ready=6), tmp_path)
        for s in seen:
            seen[s] = sorted([*seen[s], *[(r[1], r[5]) for r in rows if r[0] == s]])[-20:]
            if len(seen[s]) >= 6:
                last = seen[s][-6:]
                shown.add((s, len(seen[s]), last[0][0], last[-1][0], last[-1][1], round(sum(c for _, c in last) / 6, 9)))
    got = {(r.symbol, r.n, r.first_ts, r.last_ts, r.last_close, round(r.mean_close, 9)) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == shown and {s for s, *_ in shown} == {"a", "b"} and max(r[1] for r in shown) == 20


def test_idle_symbols_give_up_their_state(spark, tmp_path, rocks):
    bars_at(spark, f"{tmp_path}/in", [bar("a", m, 5.0) for m in range(3)])
    stream = S.ring_buffer(spark.readStream.schema(B.BAR_COLUMNS).parquet(f"{tmp_path}/in"), size=5, ready=3, idle_ms=1)
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="0 seconds").start()
    read = lambda: sorted((r.symbol, r.n, r.gone) for r in spark.read.schema(S.OUT).parquet(f"{tmp_path}/out").collect()) if (tmp_path / "out").exists() else []
    try:
        until = time.time() + 60
        while len(read()) < 2 and time.time() < until:
            time.sleep(1)
    finally:
        query.stop()
    assert read() == [("a", 3, False), ("a", 3, True)]


def events(spark, folder, rows):
    made = [(u, DAY + dt.timedelta(minutes=m), i, 1.0) for u, m, i in rows]
    spark.createDataFrame(made, "user_id bigint, ts timestamp, event_id bigint, value double").coalesce(1).write.mode("append").parquet(folder)


def test_joined_streams_drop_late_rows_and_go_on(spark, tmp_path):
    schema = "user_id bigint, ts timestamp, event_id bigint, value double"
    users = spark.createDataFrame([(1, "gold"), (2, "iron")], "of_user bigint, kind string")

    def step():
        a, b = (spark.readStream.schema(schema).parquet(f"{tmp_path}/{side}") for side in ("later", "earlier"))
        run(B.enriched(B.preceded(a, b, "1 hour", "30 minutes"), users, "user_id", "of_user"), tmp_path)

    pairs = lambda: sorted((r.event_id, r.earlier_id, r.kind) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    events(spark, f"{tmp_path}/earlier", [(1, 0, 10), (1, 50, 11), (2, 55, 12), (3, 55, 13)])
    events(spark, f"{tmp_path}/later", [(1, 59, 20), (1, 50, 21), (2, 120, 22), (3, 58, 23)])
    step()
    first = [(20, 10, "gold"), (20, 11, "gold"), (21, 10, "gold")]  # not at the same time, not after 65 minutes, and no user 3
    assert pairs() == first
    events(spark, f"{tmp_path}/earlier", [(1, 600, 14)])
    events(spark, f"{tmp_path}/later", [(1, 610, 24)])
    step()  # goes on from the checkpoint: nothing twice, and the state of before is still met
    assert pairs() == [*first, (24, 14, "gold")]
    events(spark, f"{tmp_path}/earlier", [(2, 100, 15)])  # long before the watermark, which is now past 9 hours
    events(spark, f"{tmp_path}/later", [(2, 110, 25), (1, 620, 26)])
    step()
    assert pairs() == [*first, (24, 14, "gold"), (26, 14, "gold")]


def test_replay_sets_nothing_for_good(spark, sf_dir):
    key = next(iter(S.ROCKS))
    before = spark.conf.get(key)
    assert B.replayed_ring(spark, sf_dir).filter(F.col("n") < 50).count() == 0
    assert spark.conf.get(key) == before
