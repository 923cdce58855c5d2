"""A bounded sample of labelled rows for models that are trained on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled ids of each class that a model is fitted on.
PER_CLASS = 3000
#: Most bytes of their texts that a model is fitted on, whole texts in the order of their ids' hashes.
MOST_BYTES = 128 << 20


def sample(
    docs: DataFrame, labels: DataFrame, label_col: str, usable: Column | None = None, per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES
) -> tuple[DataFrame, dict[int, int]]:
    """Rows (doc_id, text, y) of at most ``per_class`` labelled ids a class and ``most_bytes`` in all, and the number of labelled ids of each class.

    Which rows are taken depends on hashes alone: ids in the order of theirs, and of
    several texts with one id the one with the least. A text that does not fit in what is
    left of the bytes is passed over and the next one tried, classes in turn; if none of a
    class fits that is an error. Labels other than 0 and 1 and null ids are passed over; an
    id with several labels counts as 1 if its mean is at least a half. The driver
    holds an id, a hash and a length of each taken row, whose number is bounded, and
    only those texts are fetched.
    """
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1))
    rows = rows if usable is None else rows.filter(usable)
    rows = rows.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    counts = {int(r["y"]): int(r["count"]) for r in rows.groupBy("y").count().collect()}
    by_hash = [rows.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    taken = F.broadcast(by_hash[0].unionAll(by_hash[1]))
    text = F.coalesce("text", F.lit(""))
    mark = F.struct(F.xxhash64(text).alias("digest"), F.octet_length(text).alias("bytes"))
    held = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("mark", mark)
    sizes = held.select("doc_id", "mark").join(taken, "doc_id").groupBy("doc_id", "y").agg(F.min("mark").alias("mark"), F.xxhash64("doc_id").alias("at"))
    found = sizes.select("at", "doc_id", "y", "mark.digest", "mark.bytes").collect()
    chosen = _fitting(found, most_bytes)
    for y in {r["y"] for r in found} - {r[3] for r in chosen}:
        raise ValueError(f"every text of the {sum(r['y'] == y for r in found)} sampled rows of label {y} is longer than the {most_bytes} bytes that a model is fitted on")
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame(chosen, "doc_id bigint, digest bigint, bytes int, y int"))
    fetched = held.select("doc_id", "text", "mark.digest", "mark.bytes").join(wanted, ["doc_id", "digest", "bytes"])
    return fetched.dropDuplicates(["doc_id"]).select("doc_id", "text", "y"), counts


def _fitting(found: list, most_bytes: int) -> list[tuple]:
    """(doc_id, digest, bytes, y) of the rows that fit one after the other, classes in turn."""
    classes = [sorted((r["at"], r["doc_id"], r) for r in found if r["y"] == y) for y in (0, 1)]
    turns = sorted((k, y, r) for y, rows in enumerate(classes) for k, (_, _, r) in enumerate(rows))
    chosen, room = [], most_bytes
    for _, _, r in turns:
        if r["bytes"] <= room:
            room -= r["bytes"]
            chosen.append((r["doc_id"], r["digest"], r["bytes"], r["y"]))
    return chosen


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
