"""Overlaps of sequences with uneven starts, as a binned range join.

A sequence of ``length`` bars lies in at most two bins of that width, so pairs that share a
bar share a (symbol, bin), and a pair is taken in the bin of its later start. Starts are
whole numbers, so a sequence meets fewer than 2 ``length`` others, however many there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlapping(rows: DataFrame, length: int, by: str | None = None) -> DataFrame:
    """(symbol, first, second, ratio) of sequences that share bars, the earlier start first; with ``by`` its values for both as ``by_first``, ``by_second``.

    Repeated rows count once. Sequences of one start with different values of ``by`` are a pair.
    """
    label = F.col(by).cast("string") if by else F.lit(None).cast("string")
    own = rows.select("symbol", F.col("seq").cast("bigint").alias("seq"), label.alias("label")).distinct()
    width = F.lit(length)
    late = own.withColumn("bin", F.floor(F.col("seq") / width))
    early = own.select("symbol", F.col("seq").alias("before"), F.col("label").alias("other"), F.explode(F.array(F.floor(F.col("seq") / width), F.floor(F.col("seq") / width) + 1)).alias("bin"))
    order = (F.col("before") < F.col("seq")) | ((F.col("before") == F.col("seq")) & (F.coalesce("other", F.lit("")) < F.coalesce("label", F.lit(""))))
    met = late.join(early, ["symbol", "bin"]).filter(order & (F.col("seq") - F.col("before") < width))
    ratio = (width - (F.col("seq") - F.col("before"))) / width.cast("double")
    shown = met.select("symbol", F.col("before").alias("first"), F.col("seq").alias("second"), ratio.alias("ratio"), F.col("other").alias("by_first"), F.col("label").alias("by_second"))
    return shown if by else shown.drop("by_first", "by_second")


def overlap_report(rows: DataFrame, length: int, by: str) -> DataFrame:
    """(low, high, pairs, overlapping, mean_overlap, most): all pairs of a symbol's sequences by their values of ``by``; those that share no bar count as 0."""
    label = F.col(by).cast("string")
    counts = rows.select("symbol", F.col("seq").cast("bigint"), label.alias("label")).distinct().groupBy("symbol", "label").agg(F.count(F.lit(1)).alias("n"))
    other = counts.select("symbol", F.col("label").alias("high"), F.col("n").alias("m"))  # a row a symbol and value
    both = counts.select("symbol", F.col("label").alias("low"), "n").join(other, "symbol").filter("low <= high")
    number = F.when(F.col("low") == F.col("high"), F.col("n") * (F.col("n") - 1) / 2).otherwise(F.col("n") * F.col("m")).cast("bigint")
    total = both.groupBy("low", "high").agg(F.sum(number).alias("pairs"))
    met = overlapping(rows, length, by)
    low, high = F.least("by_first", "by_second"), F.greatest("by_first", "by_second")
    shared = met.groupBy(low.alias("low"), high.alias("high")).agg(F.count(F.lit(1)).alias("overlapping"), F.sum("ratio").alias("_sum"), F.max("ratio").alias("most"))
    out = total.filter("pairs > 0").join(shared, ["low", "high"], "left")
    return out.select("low", "high", "pairs", F.coalesce("overlapping", F.lit(0)).alias("overlapping"), (F.coalesce("_sum", F.lit(0.0)) / F.col("pairs")).alias("mean_overlap"), F.coalesce("most", F.lit(0.0)).alias("most"))


def without_overlaps(rows: DataFrame, length: int, kept: str, by: str = "split") -> DataFrame:
    """``rows`` less those of other values of ``by`` that share a bar with one of value ``kept``, so that nothing of it leaks."""
    met = overlapping(rows, length, by).filter((F.col("by_first") == kept) != (F.col("by_second") == kept))
    leaking = met.select("symbol", F.when(F.col("by_first") == kept, F.col("second")).otherwise(F.col("first")).alias("seq")).distinct().withColumn("_leaks", F.lit(True))
    return rows.join(leaking, ["symbol", "seq"], "left").filter(F.col("_leaks").isNull() | (F.col(by) == kept)).drop("_leaks")
