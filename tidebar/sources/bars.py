"""Bars: a table (symbol, ts, open, high, low, close, volume, ...) read from CSV or resampled from events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.windows import by_symbol

CORE = ("timestamp", "open", "high", "low", "close", "volume")

# Accepted spellings of header names.
ALIASES = {
    "time": "timestamp", "datetime": "timestamp", "date": "timestamp", "ts": "timestamp",
    "o": "open", "open_price": "open", "h": "high", "high_price": "high", "l": "low", "low_price": "low",
    "c": "close", "close_price": "close", "v": "volume", "vol": "volume", "volume_base": "volume",
    "quote_volume": "volume_quote", "count": "trades_count", "trade_count": "trades_count", "trades": "trades_count",
    "taker_buy_volume": "buy_volume", "buy_volume_base": "buy_volume", "taker_buy_quote_volume": "buy_volume_quote",
}


def resample(events: DataFrame, unit: str = "hour", symbol: str = "event_type", value: str = "value", order: str = "event_id") -> DataFrame:
    """OHLC bars of ``value`` per symbol and time unit; volume is the number of events. Ties in time follow ``order``."""
    at = F.struct(F.col("ts"), F.col(order))
    bars = events.groupBy(F.col(symbol).alias("symbol"), F.date_trunc(unit, "ts").alias("bar")).agg(
        F.min_by(value, at).alias("open"),
        F.max(value).alias("high"),
        F.min(value).alias("low"),
        F.max_by(value, at).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )
    return bars.withColumnRenamed("bar", "ts").select("symbol", "ts", "open", "high", "low", "close", "volume")


def normal_name(header: str) -> str:
    """A header's name in the schema: the alias's meaning, else lower case."""
    lowered = header.strip().lower()
    return ALIASES.get(lowered, lowered)


def normalize_header(df: DataFrame) -> DataFrame:
    """Renames columns by alias, then checks that the core columns are there."""
    renamed = df.withColumnsRenamed({c: normal_name(c) for c in df.columns})
    missing = [c for c in CORE if c not in renamed.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return renamed


def parse_time(c: str = "timestamp", unit: str = "auto") -> Column:
    """A timestamp from an RFC 3339 string or an epoch number in s, ms, us or ns (auto: told by its size)."""
    number = F.col(c).try_cast("bigint")
    size = F.abs(number)
    micros = {"s": number * 10**6, "ms": number * 10**3, "us": number, "ns": F.floor(number / 1000)}
    if unit != "auto":
        return F.timestamp_micros(micros[unit].cast("bigint"))
    told = F.when(size < 10**11, micros["s"]).when(size < 10**14, micros["ms"]).when(size < 10**17, micros["us"]).otherwise(micros["ns"])
    return F.coalesce(F.timestamp_micros(told.cast("bigint")), F.try_to_timestamp(F.col(c).cast("string")))


def as_bars(raw: DataFrame, symbol: Column | str, unit: str = "auto") -> DataFrame:
    """Raw rows with a header to bars: aliases, try_cast to double, times parsed, null times dropped.

    Every column besides the core passes through as a double feature.
    """
    named = normalize_header(raw)
    others = [c for c in named.columns if c not in ("timestamp", "symbol")]
    time = F.col("timestamp") if isinstance(named.schema["timestamp"].dataType, (T.TimestampType, T.TimestampNTZType)) else parse_time("timestamp", unit)
    tag = F.lit(symbol) if isinstance(symbol, str) else symbol
    return named.select(tag.alias("symbol"), time.cast("timestamp").alias("ts"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in others]).filter("ts is not null")


def read_csv(spark: SparkSession, path: str | list[str], symbol: str | None = None, unit: str = "auto") -> DataFrame:
    """Bars from CSV files with a header, all columns read as strings; the symbol is the file's name unless given."""
    paths = [path] if isinstance(path, str) else list(path)
    bad = [p for p in paths if not p.lower().rstrip("/").endswith((".csv", "*"))]
    if bad:
        raise ValueError(f"not CSV: {bad}")
    raw = spark.read.csv(paths, header=True)
    tag: Column | str = symbol if symbol is not None else F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)
    return as_bars(raw, tag, unit)


def symbol_paths(root: str, symbols: list[str]) -> list[str]:
    """Where the files of several symbols lie below a folder; one symbol may name a file itself."""
    if root.lower().endswith(".csv"):
        if len(symbols) > 1:
            raise ValueError("several symbols need a folder, not one file")
        return [root]
    return [f"{root.rstrip('/')}/{s}.csv" for s in symbols]


def drop_null_first_row(bars: DataFrame) -> DataFrame:
    """Drops a symbol's first row if any of its values is null."""
    holes = F.greatest(*[F.col(f"`{c}`").isNull().cast("int") for c in bars.columns]) == 1
    first = F.row_number().over(by_symbol()) == 1
    return bars.withColumn("_first", first).filter(~(F.col("_first") & holes)).drop("_first")


def data_info(bars: DataFrame) -> DataFrame:
    """One row a symbol: rows, distinct times, first and last time, number of feature columns."""
    core = {"symbol", "ts", *CORE}
    extra = len([c for c in bars.columns if c not in core])
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("ts").alias("n_times"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.lit(extra).alias("n_features"),
    )
