"""Appended lines of one growing text file as a stream.

Offsets are bytes of the file, up to its last line end; a line that is still being
written waits. A batch reads only its own range of bytes, in parts of ``rangeBytes`` that
different tasks read: a part takes the lines that begin in it. After a restart
the stream goes on from the offsets in its checkpoint, so no line comes twice or is
missed. A file that has become shorter than what was read has been replaced and is
read anew from its start; one that is replaced by a longer one can't be told from one that grew.

The path is opened with Arrow's file systems (local, hdfs, s3, gs), on the driver for its
length and on the executors for their ranges; it must be reachable from all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.validate import valid_bar

NAME = "tidebar_tail"
RANGE_BYTES = 64 << 20
_STEP = 1 << 16
_ROWS = 4096


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int


def _opened(path: str) -> pa.NativeFile:
    found, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return found.open_input_file(inside)


def last_line_end(file: pa.NativeFile) -> int:
    """Bytes up to the file's last line end, read backwards from there."""
    at = file.size()
    while at > 0:
        begin = max(0, at - _STEP)
        cut = file.read_at(at - begin, begin).rfind(b"\n")
        if cut >= 0:
            return begin + cut + 1
        at = begin
    return 0


def lines(file: pa.NativeFile, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(first byte, line without its end) of the lines that begin from ``begin`` on and before ``end``; ``end`` is within whole lines."""
    at, rest = begin, b""
    if begin:  # the line that goes on here belongs to the range before, unless one ends exactly here
        at, skipping = begin - 1, True
    else:
        skipping = False
    read = at
    size = file.size()
    while at < end and (read < size or rest):
        raw = file.read_at(min(_STEP, size - read), read)
        read += len(raw)
        rest += raw
        *whole, rest = rest.split(b"\n")
        for line in whole:
            if skipping:
                skipping = False
            elif at < end:
                yield at, line.removesuffix(b"\r")
            else:
                return
            at += len(line) + 1
        if not raw:
            return


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def initialOffset(self) -> dict:
        return {"bytes": 0}

    def latestOffset(self) -> dict:
        with _opened(self.path) as file:
            return {"bytes": last_line_end(file)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        begin, until = int(start["bytes"]), int(end["bytes"])
        begin = begin if begin <= until else 0
        return [Range(self.path, at, min(at + self.range_bytes, until)) for at in range(begin, until, self.range_bytes)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        places: list[int] = []
        values: list[str] = []

        def batch() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(places, pa.int64()), pa.array(values, pa.string())], names=["place", "value"])
            places.clear()
            values.clear()
            return made

        with _opened(partition.path) as file:
            for place, line in lines(file, partition.begin, partition.end):
                places.append(place)
                values.append(line.decode("utf-8", "replace"))
                if len(places) >= _ROWS:
                    yield batch()
        if places:
            yield batch()


class TailSource(DataSource):
    """``spark.readStream.format("tidebar_tail").option("path", ...)``: (place, value), a line and its first byte."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "place bigint, value string"

    def streamReader(self, schema) -> TailReader:
        if "path" not in self.options:
            raise ValueError("the option path must name a file")
        return TailReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))


def tail(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(place, value): the lines of a file, and then those that are appended to it."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format(NAME).option("path", path).option("rangeBytes", range_bytes).load()


def bar_lines(rows: DataFrame, symbol: str) -> DataFrame:
    """Lines ``seconds,open,high,low,close,volume`` as bars, with ``ok``: whether they pass the checks, and the line.

    Blank lines, comments and a first line that names a timestamp are not rows.
    """
    kept = rows.filter((F.trim("value") != "") & ~F.ltrim("value").startswith("#") & ~((F.col("place") == 0) & F.lower("value").contains("timestamp")))
    part = F.split("value", ",")
    number = lambda k: F.get(part, F.lit(k)).try_cast("double")
    fields = [number(k + 1).alias(c) for k, c in enumerate(("open", "high", "low", "close", "volume"))]
    bars = kept.select(F.lit(symbol).alias("symbol"), F.timestamp_seconds(F.get(part, F.lit(0)).try_cast("bigint")).alias("ts"), *fields, "place", "value")
    return bars.withColumn("ok", F.coalesce(F.col("ts").isNotNull() & valid_bar(), F.lit(False)))
