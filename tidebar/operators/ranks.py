"""Ranks within groups of any size.

The rows are sorted as a whole by group and order, which cuts them at sampled
bounds: a group that holds all rows is spread like any other. Each partition then counts
the rows of its groups, sums over the partitions before give where a group goes on, and
a row's rank is that number plus its place among its group's rows in the partition. The
counts are a row a partition and group; no task orders a group, and the rows are exchanged
once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import checkpointed

_PLACE_BITS = 33  # of monotonically_increasing_id: the place in its partition


def ranked(rows: DataFrame, keys: list[str], order: list[Column | str], rank: str = "rank", total: str = "total") -> DataFrame:
    """Adds ``rank`` (from 0) in ``order`` within ``keys``, and ``total``, the group's number of rows.

    The sorted rows are written to the shared folder. Null keys are a group of their own.
    Rows that tie in ``order`` are ranked in no fixed order, so it should end in something unique.
    """
    shown = rows.columns
    at, part, first, n, before = (_free(name, [*shown, rank, total]) for name in ("at", "part", "first", "n", "before"))
    laid = checkpointed(rows.orderBy(*keys, *order).withColumn(at, F.monotonically_increasing_id()))
    laid = laid.withColumn(part, F.shiftright(at, _PLACE_BITS))
    counts = laid.groupBy(part, *keys).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(n))
    group = Window.partitionBy(*keys)
    earlier = F.coalesce(F.sum(n).over(group.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumns({before: earlier, total: F.sum(n).over(group)})
    renamed = [_free(f"key{k}", [*shown, rank, total]) for k in range(len(keys))]
    counts = counts.select(F.col(part).alias(n + part), *[F.col(k).alias(r) for k, r in zip(keys, renamed)], first, before, total)
    same = F.col(part) == F.col(n + part)
    for k, r in zip(keys, renamed):
        same = same & F.col(k).eqNullSafe(F.col(r))
    return laid.join(counts, same).select(*shown, (F.col(at) - F.col(first) + F.col(before)).alias(rank), total)


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name
