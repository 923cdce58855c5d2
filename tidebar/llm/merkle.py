"""A Merkle manifest of a table: per-source trees of digests under one root, with a proof for every row.

A row's leaf is the SHA-256 of its fields, each ``-`` if null, else its UTF-8 byte
count, a colon and the value. In a source the leaves ascend by id; every ``FAN``
consecutive nodes become the SHA-256 of their joined hex digests until one is left,
the source's subroot (a lone leaf is its own). The subroots, by source, likewise
give the root.

The trees are built by supersteps over an RDD of parents. Children message their
parents upward, a parent that has all its children (those of the superstep before)
hashes them and forwards its own digest. Reverse supersteps send every parent the
sibling digests of the path above it, and the last one expands them to its leaves,
so a path travels once for ``FAN`` leaves. Leaves are hashed by Spark's own
functions where the text is; only ids and digests move.

Digests are written once and range-sorted once. Each partition reports its first and last source and
how many rows they have, so that places in a source follow without a count in one
task; the driver holds one such line a partition, and the root. Parents of every
level are written to the shared folder: lost executors cost the running superstep.

Defined results: a null source is a source of its own, before all others. Null ids
come first in their source. Rows with one id come in the order of their leaves;
repeated rows are leaves like others. Empty and very long texts are whole. An empty
table gives an empty manifest. Other columns, whatever their names, are not covered.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _path, shared_folder, shuffle_width, written

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A parent's key: the number of the row at which its source starts, and the parent's place among those of its level.
Key = tuple[int, int]
#: A child: its place under its parent, its digest, and what it takes along.
Child = tuple[int, bytes, object]


def leaf(**replaced: Column) -> Column:
    """The digest (binary) of a row's fields; ``replaced`` gives other values for some."""
    values = [replaced.get(name, F.col(name)).cast("string") for name in FIELDS]
    fields = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return F.unhex(F.sha2(F.concat(*fields), 256))


def digest(parts: Iterable[bytes]) -> bytes:
    """SHA-256 over the hex forms of digests."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def _stored(spark: SparkSession, rdd: RDD) -> RDD:
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    rdd.saveAsPickleFile(path, 256)
    _path(spark, path, lambda fs, p: fs.deleteOnExit(p))
    return spark.sparkContext.pickleFile(path)


def _ends(part: int, rows: Iterator) -> Iterator[tuple]:
    """(partition, rows, [(source, rows) of its first and, if there is another, its last source])."""
    total, first, last, count = 0, None, None, 0
    for source, run in groupby(rows, key=lambda r: r[0]):
        count = sum(1 for _ in run)
        total += count
        last = (source, count)
        first = first or last
    if total:
        yield part, total, [first] if first is last else [first, last]


def _spans(ends: list[tuple]) -> dict[int, tuple[int, list[tuple[object, int, int, int]]]]:
    """Each partition's first row number, and of its outer sources: the source, its start, its rows in all, and those in partitions before."""
    groups: list[list[int]] = []  # start, rows
    found, offset, before = {}, 0, None
    for part, total, outer in sorted(ends):
        places = []
        for k, (source, count) in enumerate(outer):
            start = offset if k == 0 else offset + total - count
            if not (k == 0 and before is not None and before == (source,)):
                groups.append([start, 0])
            places.append((source, groups[-1], groups[-1][1]))
            groups[-1][1] += count
        before = (outer[-1][0],)
        found[part] = (offset, places)
        offset += total
    return {part: (at, [(s, g[0], g[1], seen) for s, g, seen in places]) for part, (at, places) in found.items()}


def _placed(spans: dict) -> Callable[[int, Iterator], Iterator[tuple[Key, tuple[int, list[Child]]]]]:
    """Leaves as messages to their parents; consecutive ones go together."""

    def run(part: int, rows: Iterator) -> Iterator[tuple[Key, tuple[int, list[Child]]]]:
        if part not in spans:
            return
        at, outer = spans[part]
        known = {(source,): rest for source, *rest in outer}
        for source, found in groupby(rows, key=lambda r: r[0]):
            if (source,) in known:
                start, n, place = known[(source,)]
            else:  # whole in this partition
                found = list(found)
                start, n, place = at, len(found), 0
            for up, few in groupby(enumerate(found, place), key=lambda r: r[0] // FAN):
                children = [(k % FAN, bytes(r[2]), (r[1], bytes(r[3]))) for k, r in few]
                at += len(children)
                yield (start, up), (n, children)

    return run


def _gathered(messages: RDD, width: int) -> RDD:
    """Parents with all the children that wrote to them, in order. A level that fits one partition is not exchanged."""
    if width > 1:
        joined = messages.reduceByKey(lambda a, b: (a[0], a[1] + b[1]), width)
    else:
        joined = messages.coalesce(1).mapPartitions(_merged)
    return joined.mapValues(lambda v: (v[0], sorted(v[1], key=lambda c: c[0]))).coalesce(width)


def _merged(messages: Iterator) -> Iterator:
    found: dict[Key, tuple[int, list[Child]]] = {}
    for key, (n, children) in messages:
        found.setdefault(key, (n, []))[1].extend(children)
    return iter(found.items())


def _met(level: RDD, arrived: RDD, width: int) -> RDD:
    """(key, (parent, what arrived for it)); as with ``_gathered``, one partition is not exchanged."""
    if width > 1:
        return level.join(arrived, width).coalesce(width)

    def both(rows: Iterator) -> Iterator:
        parents: dict[Key, object] = {}
        sent: dict[Key, object] = {}
        for is_parent, (key, value) in rows:
            (parents if is_parent else sent)[key] = value
        return iter([(key, (parents[key], value)) for key, value in sent.items() if key in parents])

    return level.map(lambda kv: (True, kv)).union(arrived.map(lambda kv: (False, kv))).coalesce(1).mapPartitions(both)


def _forward(parent: tuple[Key, tuple[int, list[Child]]]) -> tuple[Key, tuple[int, list[Child]]]:
    (start, up), (n, children) = parent
    return (start, up // FAN), (-(-n // FAN), [(up % FAN, digest(c[1] for c in children), None)])


def rise(spark: SparkSession, messages: RDD, width: int) -> list[RDD]:
    """Supersteps upward: the parents of each level. One whose tree has a single node there holds that tree's top."""
    levels = [_stored(spark, _gathered(messages, width))]
    while True:
        width = max(1, -(-width // FAN))
        level = _stored(spark, _gathered(levels[-1].filter(lambda p: p[1][0] > 1).map(_forward), width))
        if level.isEmpty():
            return levels
        levels.append(level)


def tops(spark: SparkSession, levels: list[RDD], width: int) -> RDD:
    """(start, (digest, depth)) of every tree, from one pass over the levels."""
    ready = [level.filter(lambda p: p[1][0] == 1).map(lambda p, depth=depth: (p[0][0], (p[1][1][0][1], depth))) for depth, level in enumerate(levels)]
    return _stored(spark, spark.sparkContext.union(ready).coalesce(max(1, width // FAN)))


def _paths(parent: tuple) -> Iterator[tuple[int, Child, tuple[bytes, list]]]:
    """Each child with its tree's top and its path: (place, siblings) level by level, its own run first."""
    (_, (n, children)), (top, above) = parent
    for k, child in enumerate(children):
        own = [] if n == 1 else [(k, [c[1] for c in children if c is not child])]
        yield k, child, (top, own + above)


def sink(levels: list[RDD], found: RDD, width: int) -> RDD:
    """Reverse supersteps: ``found`` (start, depth, (top, path above it)) goes down to (child, (top, path)) of the lowest level."""
    sent = None
    for depth in reversed(range(len(levels))):
        wide = max(1, -(-width // FAN**depth))
        ready = found.filter(lambda f, depth=depth: f[1] == depth).map(lambda f: ((f[0], 0), f[2]))
        arrived = ready if sent is None else ready.union(sent)
        met = _met(levels[depth], arrived, wide).map(lambda kv: ((kv[0], kv[1][0]), kv[1][1]))
        if depth == 0:
            return met.flatMap(lambda m: [(child, path) for _, child, path in _paths(m)])
        sent = met.flatMap(lambda m: [((m[0][0][0], m[0][0][1] * FAN + k), path) for k, _, path in _paths(m)])
    raise ValueError("a tree has at least one level")


def fold(value: bytes, path: list[tuple[int, list[bytes]]]) -> bytes:
    """The root that a leaf and its path give."""
    for place, siblings in path:
        value = digest([*siblings[:place], value, *siblings[place:]])
    return value


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``tampered``: the text that is checked against the manifest; by default the one it was built from.
    """
    spark = docs.sparkSession
    width = shuffle_width(spark)
    shown = leaf() if tampered is None else leaf(text=tampered)
    rows = docs.select("source", F.col("doc_id").cast("bigint").alias("doc_id"), leaf().alias("leaf"), shown.alias("shown"))
    # the last key parts rows that are equal in all, which may be many
    rows = written(rows).withColumn("tie", F.monotonically_increasing_id())
    in_order = rows.orderBy(F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "leaf", "tie").select("source", "doc_id", "leaf", "shown").rdd
    spans = _spans(in_order.mapPartitionsWithIndex(_ends).collect())
    if not spans:
        return spark.createDataFrame([], SCHEMA)
    levels = rise(spark, in_order.mapPartitionsWithIndex(_placed(spans)), width)

    few = max(1, width // FAN)
    ready = tops(spark, levels, width)
    subroots = ready.mapValues(lambda v: v[0]).sortByKey(numPartitions=few).zipWithIndex()
    n_sources = ready.count()
    crown = rise(spark, subroots.map(lambda s: ((0, s[1] // FAN), (n_sources, [(s[1] % FAN, s[0][1], s[0][0])]))), few)
    _, (root, depth) = tops(spark, crown, 1).first()
    above = sink(crown, spark.sparkContext.parallelize([(0, depth, (root, []))], 1), few)
    given = above.map(lambda found: (found[0][2], (found[0][1], found[1][1])))
    placed = _stored(spark, ready.join(given, few).map(lambda f: (f[0], f[1][0][1], f[1][1])).coalesce(few))

    def row(found: tuple[Child, tuple[bytes, list]]) -> tuple:
        (_, value, (doc_id, checked)), (top, path) = found
        folded = fold(checked, path)
        return doc_id, value.hex(), top.hex(), root.hex(), digest(s for _, siblings in path for s in siblings).hex(), folded.hex(), folded == root

    return spark.createDataFrame(sink(levels, placed, width).map(row), SCHEMA, verifySchema=False)


def lowered_fifth(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text with A-Z lower-cased where 5 divides the CRC-32 of the decimal id, else as it is."""
    return F.when(F.crc32(F.col(doc_id).cast("bigint").cast("string").cast("binary")) % 5 == 0, F.translate(text, _UPPER, _UPPER.lower())).otherwise(F.col(text))
