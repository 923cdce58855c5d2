"""Connected components of a link table by alternating large-star and small-star steps.

Every round is a pre-aggregated minimum and an equi-join; no link or component
reaches the driver, only a count and a checksum that tell when to stop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest of the node's neighbourhood."""
    near = _both_ways(links)
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return near.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them (links run from large to small)."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
    return row[0], row[1]


def connected(links: DataFrame) -> DataFrame:
    """``links`` (a, b: bigint) to rows (node, root): root is the smallest node reachable.

    Nodes that are their own root are left out, as are loops and nulls.
    """
    links = (
        links.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    links = cut_lineage(links)
    mark = _mark(links)
    while mark[0]:  # every round but the last lowers some node's parent, in about log2 of the longest chain rounds
        links = cut_lineage(_small_star(_large_star(links).filter("a <> b").distinct()))
        after = _mark(links)
        if after == mark:
            break
        mark = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
