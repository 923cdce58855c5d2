"""Frames over a symbol's bars in time order.

``inc(n)`` is the current bar and the n - 1 before it; ``exc(n)`` is the n bars
before the current one. ``full`` gives null until a frame holds n values, so that
warm-up rows never show partial results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .safe import col, div, ln


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("ts")


def ever() -> WindowSpec:
    """From the symbol's start to the current bar."""
    return by_symbol().rowsBetween(Window.unboundedPreceding, 0)


def inc(n: int) -> WindowSpec:
    return by_symbol().rowsBetween(-(n - 1), 0)


def exc(n: int) -> WindowSpec:
    return by_symbol().rowsBetween(-n, -1)


def full(aggregate: Column, of: Column | str, n: int, frame: WindowSpec) -> Column:
    """The aggregate over the frame where it holds n non-null values of ``of``."""
    return F.when(F.count(col(of)).over(frame) == n, aggregate.over(frame))


def lag(c: Column | str, k: int = 1) -> Column:
    return F.lag(col(c), k).over(by_symbol())


def from_index(value: Column, first: int) -> Column:
    """``value`` from the bar of that index on, null before; needs the column ``i``."""
    return F.when(F.col("i") >= first, value)


def with_base(bars: DataFrame) -> DataFrame:
    """Bars with what most indicators start from.

    i: index in the symbol; tp: typical price; c1: close before; chg, ret, lret:
    its difference, ratio and log ratio to the close; tr: true range.
    """
    first = bars.withColumns(
        {"i": F.row_number().over(by_symbol()).cast("bigint") - 1, "tp": (F.col("high") + F.col("low") + F.col("close")) / 3, "c1": lag("close")}
    )
    return first.withColumns(
        {
            "chg": F.col("close") - F.col("c1"),
            "ret": div(F.col("close") - F.col("c1"), "c1"),
            "lret": ln(div("close", "c1")),
            "tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("c1")), F.abs(F.col("low") - F.col("c1"))),
        }
    )


def staged(df: DataFrame, *stages: dict[str, Column]) -> DataFrame:
    """Adds the columns of each stage in turn; one projection a stage keeps the plan flat and its windows fused."""
    for stage in stages:
        df = df.withColumns(stage)
    return df
