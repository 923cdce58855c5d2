"""Minimax contiguous sharding of atomic groups of equal texts.

The groups, in the order of their text's MD5, are cut into ``shards`` runs so
that the largest run has as few bytes as any such cut allows. The smallest
feasible capacity is found by binary search; each candidate is checked greedily
on prefix sums. The order by digest keeps the runs independent of source and age
of a text, and sizes near equal: no shard exceeds the mean by more than the
largest group.

The search needs no list of groups. Bytes are summed over ``BLOCKS`` ranges of
the digest, which go to the driver (their number is fixed). Only blocks in which
a cut can fall, or that alone exceed the mean share, are opened into finer
ranges and at last into groups, never more than ``OPEN_LIMIT`` entries at a
time; all others enter whole. Cuts are then digests, and a row's shard follows
from comparing its own with them. Slots are counted per cell (part of a block in
a shard); blocks with many rows, such as a text with a third of all copies, are
split into several cells, so that no task orders a whole shard.

Defined results: a null text counts as the empty one, has size 1 and checksum 0,
and shares its group. Null ids and repeated rows are rows like others (each gets
its own slot; ties go to any). Very long texts are whole. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARDS = 8
DIGITS = 3
OPEN_LIMIT = 200_000


def _cuts(sizes: list[int], capacity: int, shards: int) -> list[int] | None:
    """Ends of the greedy runs over ``sizes``; None if ``shards`` runs don't hold all."""
    sums = [0, *accumulate(sizes)]
    ends, at = [], 0
    for _ in range(shards):
        at = bisect_right(sums, sums[at] + capacity) - 1
        ends.append(at)
        if at == len(sizes):
            return ends
    return None


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """Least capacity with which greedy runs over ``sizes`` need at most ``shards`` shards."""
    low, high = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        if _cuts(sizes, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def _touched(starts: list[int], sizes: list[int], closed: list[bool], low: int, high: int, shards: int) -> set[int]:
    """Open entries in which a greedy cut may fall for some capacity from ``low`` to ``high``.

    The earliest place of each cut follows from the earliest of the one before and
    the capacity ``low``, rounded down to the entry it falls in; the latest from
    ``high``, rounded down only where the entry is a single group.
    """
    total = starts[-1] + sizes[-1]
    found: set[int] = set()
    least = most = 0
    for _ in range(shards - 1):
        first = bisect_right(starts, least + low) - 1
        last = bisect_right(starts, min(total, most + high)) - 1
        found.update(i for i in range(first, last + 1) if not closed[i])
        least = starts[first]
        most = starts[last] if closed[last] and most + high < total else min(total, most + high)
    return found


def plan_cuts(rows: DataFrame, shards: int = SHARDS, digits: int = DIGITS, open_limit: int = OPEN_LIMIT) -> list[str]:
    """Digests (or their beginnings) at which a new shard begins, ascending. ``rows``: digest (32 hex digits), size."""
    first = rows.groupBy(F.substring("digest", 1, digits)).agg(F.sum("size"))
    known = sorted((r[0], r[1]) for r in first.collect())
    while known:
        sizes = [s for _, s in known]
        starts = [0, *accumulate(sizes)][:-1]
        closed = [len(p) == 32 for p, _ in known]
        low = max(-(-sum(sizes) // shards), max((s for s, c in zip(sizes, closed) if c), default=0))
        # entries that are a good part of a shard would make the bounds loose, so they are opened first
        want = {i for i, s in enumerate(sizes) if not closed[i] and s > max(low // 64, 4 * low * shards // len(sizes))}
        if not want:
            want = _touched(starts, sizes, closed, low, max(low, smallest_capacity(sizes, shards)), shards)
        if not want:
            break
        by_length: dict[int, list[str]] = {}
        for i in sorted(want):
            by_length.setdefault(len(known[i][0]), []).append(known[i][0])
        inside = F.lit(False)
        for length, some in by_length.items():
            inside = inside | F.substring("digest", 1, length).isin(some)
        part = rows.filter(inside)
        opened = part.groupBy("digest").agg(F.sum("size")).limit(open_limit + 1).collect()
        if len(opened) > open_limit:
            deeper = min(32, max(by_length) + digits)
            opened = part.groupBy(F.substring("digest", 1, deeper)).agg(F.sum("size")).collect()
        known = sorted([k for i, k in enumerate(known) if i not in want] + [(r[0], r[1]) for r in opened])
    if not known:
        return []
    sizes = [s for _, s in known]
    ends = _cuts(sizes, smallest_capacity(sizes, shards), shards)
    return [known[e][0] for e in ends if e < len(known)]


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, digest) of every row."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("digest"),
    )


def _shard_of(digest: Column, cuts: list[str]) -> Column:
    return sum(((digest >= F.lit(c)).cast("int") for c in cuts), F.lit(0))


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", digits: int = DIGITS, open_limit: int = OPEN_LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot."""
    # null ids would all fall into one cell of a crowded block
    spread = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("doc_id"))
    rows = written(sized(docs, id_col, text_col).withColumn("spread", spread))
    cuts = plan_cuts(rows, shards, digits, open_limit)
    block = F.substring("digest", 1, digits)
    placed = rows.withColumn("shard", _shard_of(F.col("digest"), cuts).cast("int")).withColumn("block", block)

    # at most 16^digits blocks: those with over four times the mean count of rows are split into cells
    counts = {r[0]: r[1] for r in placed.groupBy("block").count().collect()}
    mean = max(1, sum(counts.values()) // max(1, len(counts)))
    split = {b: -(-n // (2 * mean)) for b, n in counts.items() if n > 4 * mean}
    parts = F.lit(1)
    if split:
        table = F.create_map(*[F.lit(x) for pair in sorted(split.items()) for x in pair])
        parts = F.coalesce(F.try_element_at(table, F.col("block")), F.lit(1))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("spread"), parts).cast("int"))

    cells = placed.groupBy("shard", "block", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("shard", "block", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "block", "part").orderBy("digest", "doc_id")
    numbered = placed.withColumn("at", F.row_number().over(within))
    # the cells are at most 3 * 16^digits + shards in number
    return numbered.join(F.broadcast(offsets), ["shard", "block", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("at") - 1).alias("slot")
    )
