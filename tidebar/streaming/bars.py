"""Bars, sessions and predictions from event streams.

``bar_stream``, ``session_stream`` and ``unique_stream`` are event-time operators
with a watermark for late rows; ``preceded`` joins two streams within a range of time.
``csv_tail`` reads the rows appended to a CSV folder and parts rows that fail the
checks from good ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_folder
from ..operators.validate import valid_bar
from ..sources.bars import resample
from ..sources.tail import bar_lines, tail
from .state import ROCKS, ring_buffer

LATE = "1 hour"
BAR_COLUMNS = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def hourly(events: DataFrame) -> DataFrame:
    return resample(events).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "open", "high", "low", "close", "volume")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, times as timestamps."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(sf_dir)
    return raw.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "value", "event_id", "user_id")


def bar_stream(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = LATE) -> DataFrame:
    """Bars over tumbling (or sliding) event-time windows."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    at = F.struct("ts", "event_id")
    grouped = events.withWatermark("ts", late).groupBy(window.alias("w"), "symbol")
    out = grouped.agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def session_stream(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """(symbol, ts, n): runs of events that are less than the gap apart."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "symbol")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("symbol", F.col("w.start").alias("ts"), "n")


def unique_stream(events: DataFrame, late: str = LATE) -> DataFrame:
    """The first event of each symbol and minute."""
    minute = events.select("symbol", F.date_trunc("minute", "ts").alias("ts"))
    return minute.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "ts"])


def csv_tail(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) bars from CSV files that are added to a folder; lines that don't parse are rejected."""
    text = spark.readStream.text(folder, wholetext=False).filter((F.trim("value") != "") & ~F.col("value").startswith("#") & ~F.lower("value").startswith("timestamp"))
    part = F.split("value", ",")
    number = lambda k: F.get(part, F.lit(k)).try_cast("double")
    seconds = F.get(part, F.lit(0)).try_cast("bigint")
    symbol = F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)
    rows = text.select(symbol.alias("symbol"), F.timestamp_seconds(seconds).alias("ts"), *[number(k + 1).alias(c) for k, c in enumerate(("open", "high", "low", "close", "volume"))], "value")
    good = F.coalesce(F.col("ts").isNotNull() & valid_bar(), F.lit(False))
    return rows.filter(good).drop("value"), rows.filter(~good).select("symbol", "value")


def preceded(later: DataFrame, earlier: DataFrame, within: str = "1 hour", late: str = LATE) -> DataFrame:
    """Each event of one stream with each earlier event of its user in another that is at most ``within`` before it.

    Both are (user_id, ts, event_id, value). Both sides have watermarks and the range is bounded, so
    the state of either is let go once nothing can meet it any more; rows that come later than that are dropped.
    """
    a = later.withWatermark("ts", late).select(F.col("user_id").alias("user_id"), F.col("ts").alias("ts"), F.col("event_id").alias("event_id"), F.col("value").alias("value"))
    b = earlier.withWatermark("ts", late).select(F.col("user_id").alias("of"), F.col("ts").alias("since"), F.col("event_id").alias("earlier_id"), F.col("value").alias("earlier_value"))
    met = F.expr(f"user_id = of and since < ts and since >= ts - interval {within}")
    return a.join(b, met).drop("of")


def enriched(stream: DataFrame, static: DataFrame, stream_key: str, static_key: str) -> DataFrame:
    """Rows of a stream with those of a table; Spark reads the table anew with every batch and broadcasts it only if it is small."""
    return stream.join(static, stream[stream_key] == static[static_key])


def _replay(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Everything a stream gives when run over what is there, as a table in the shared folder; the driver holds none of it.

    State is kept by RocksDB, on disk rather than on the executors' heap; the session's own setting comes back afterwards.
    """
    folder = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        # a folder a batch, so that a repeated one replaces itself; a complete result replaces all
        batch.write.mode("overwrite").parquet(f"{folder}/rows" if mode == "complete" else f"{folder}/rows/batch={number}")

    before = {k: spark.conf.get(k, None) for k in ROCKS}
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    try:
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/rows")


def replayed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _replay(spark, bar_stream(event_stream(spark, sf_dir)), "complete")
    return done.select("symbol", F.unix_timestamp("ts").alias("t"), *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("open", "high", "low", "close", "volume")])


def replayed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replay(spark, session_stream(event_stream(spark, sf_dir)), "complete").select("symbol", F.unix_timestamp("ts").alias("t"), "n")


def replayed_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replay(spark, unique_stream(event_stream(spark, sf_dir), "40 days"), "append").select("symbol", F.unix_timestamp("ts").alias("t"))


def replayed_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars, one micro-batch: the state of every symbol after all of them."""
    folder = f"{shared_folder(spark)}/bars-{uuid.uuid4().hex}"
    hourly(spark.read.parquet(f"{sf_dir}/events.parquet")).write.parquet(folder)
    bars = spark.readStream.schema(BAR_COLUMNS).parquet(folder)
    rows = _replay(spark, ring_buffer(bars, 300, 50), "append")
    rounded = [F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("last_close", "mean_close", "high", "low")]
    return rows.select("symbol", "n", F.unix_timestamp("first_ts").alias("first_t"), F.unix_timestamp("last_ts").alias("last_t"), *rounded)


def replayed_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with earlier clicks of the user within an hour, and the user's market segment from a static table."""
    events = event_stream(spark, sf_dir)
    side = lambda kind: events.filter(F.col("symbol") == kind).select("user_id", "ts", "event_id", "value")
    users = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    met = enriched(preceded(side("purchase"), side("click"), "6 hours", "40 days"), users, "user_id", "c_custkey")
    rows = _replay(spark, met, "append")
    return rows.select("user_id", "event_id", "earlier_id", (F.unix_micros("ts") - F.unix_micros("since")).alias("gap_us"), F.col("c_mktsegment").alias("segment"))


def replayed_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of one symbol written as one text file and read back as a stream of its bytes; bad lines are counted by kind."""
    folder = f"{shared_folder(spark)}/tail-{uuid.uuid4().hex}"
    bars = hourly(spark.read.parquet(f"{sf_dir}/events.parquet"))
    # a file is what the source reads; every ninth line breaks a rule
    line = F.concat_ws(",", F.unix_timestamp("ts").cast("string"), *[F.round(c, 6).cast("string") for c in ("open", "high", "low", "close", "volume")])
    broken = F.when(F.unix_timestamp("ts") / 3600 % 9 == 0, F.concat(line, F.lit("x"))).otherwise(line)
    bars.orderBy("ts", "symbol").select(F.concat_ws(",", broken, "symbol").alias("value")).coalesce(1).write.text(folder)
    at = spark.read.text(folder).select(F.input_file_name()).first()[0]
    rows = _replay(spark, bar_lines(tail(spark, at.replace("file:///", "/"), 1 << 16), "all"), "append")
    named = rows.withColumn("symbol", F.element_at(F.split("value", ","), -1))
    return named.groupBy("symbol", "ok").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("close") + 1e-9, 5).alias("sum_close"), F.max(F.unix_timestamp("ts")).alias("last_t"))
