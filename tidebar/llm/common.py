"""Helpers shared by the text operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


try:
    _LIBC = ctypes.CDLL(None)
except (OSError, TypeError):
    _LIBC = None


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Only on a single machine a temporary one is made where none is named.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="tidebar-checkpoint-")
            atexit.register(shutil.rmtree, named, True)
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return it read back: losing executors afterwards costs nothing.

    For small tables of iterations; larger ones are ``written``.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder, and reread. The files go when the driver ends, or by ``discard``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _path(spark, path, lambda fs, p: fs.deleteOnExit(p))
    again = spark.read.schema(df.schema).parquet(path)
    again._written_to = path
    return again


def discard(*tables: DataFrame) -> None:
    """Deletes the files of ``written`` tables that nothing reads any more."""
    for table in tables:
        path = table.__dict__.get("_written_to")
        if path is not None:
            _path(table.sparkSession, path, lambda fs, p: fs.delete(p, True))


def _path(spark: SparkSession, path: str, act) -> None:
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    act(at.getFileSystem(sc._jsc.hadoopConfiguration()), at)


def shuffle_width(spark: SparkSession) -> int:
    """Number of partitions the session shuffles into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(docs: DataFrame, lead: str = "c") -> DataFrame:
    """``docs`` with its columns named by their place, so that no name can clash with an operator's own."""
    return docs.select(*[F.col(f"`{name}`").alias(f"{lead}{k}") for k, name in enumerate(docs.columns)])


def renamed(table: DataFrame, names: Iterable[str], lead: str = "c") -> list[Column]:
    """The columns that ``numbered`` made, under their names."""
    return [F.col(f"{lead}{k}").alias(name) for k, name in enumerate(names)]


_SIMPLE = (T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.NumericType)


def salt(docs: DataFrame, *but: str) -> Column:
    """A number from 0 to 65,535 that follows from a row's columns other than ``but``; it spreads rows of one text."""
    names = [f.name for f in docs.schema.fields if f.name not in but and isinstance(f.dataType, _SIMPLE)]
    return F.pmod(F.xxhash64(*[F.col(f"`{n}`") for n in names]), F.lit(1 << 16)).cast("int") if names else F.lit(0)


def byte_values(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8 bytes, null as empty."""
    binary = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [v if v is not None else b"" for v in column.cast(binary).to_pylist()]


_FRAME = b"\x28\xb5\x2f\xfd"


def packed(texts: Iterable[bytes | None]) -> pa.Array:
    """Texts compressed one by one, for exchanges; null stays null."""
    press = zstandard.ZstdCompressor(level=3)
    return pa.array([None if t is None else press.compress(t) for t in texts], pa.binary())


def unpacked(column: pa.Array) -> list[bytes | None]:
    """The texts that ``packed`` compressed; others are as they are: no UTF-8 text begins like a compressed one."""
    undo = zstandard.ZstdDecompressor()
    return [undo.decompress(raw) if raw is not None and raw.startswith(_FRAME) else raw for raw in column.to_pylist()]


def pieces(batch: pa.RecordBatch, text_bytes: int = 16 << 20, column: str = "text"):
    """Split a batch so that no part holds much more than ``text_bytes`` of text.

    A part has at least one row, so a single very long text stays whole.
    """
    n = batch.num_rows
    if n == 0:
        return
    total = batch.column(batch.schema.get_field_index(column)).nbytes
    step = max(1, int(n * text_bytes / max(total, 1)))
    for at in range(0, n, step):
        yield batch.slice(at, min(step, n - at))
    give_back()


def give_back() -> None:
    """Freed memory goes back to the system: a worker process serves many tasks, one after the other."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_LIBC, "malloc_trim", None)
    if trim is not None:
        trim(0)
