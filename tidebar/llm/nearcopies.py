"""Near copies: SimHash links of five-word shingles, completed and verified by Jaccard similarity.

Texts with the same words (A-Z lower-cased) are one class. Candidates come from two
sides. ``simhash.near_links`` joins the classes' SimHash fingerprints on the
segment-popcount grid. Two texts of similarity 0.8 can differ by more bits than a grid
reaches, so each class also has ``BANDS`` keys of ``ROWS`` minima of its shingles'
hashes; two classes of similarity s share a key with probability
1 - (1 - s**ROWS)**BANDS: 0.99997 at 0.8, more above. All candidates are compared on
their whole sets of 64-bit hashes, so every link is a true one.

Where at most ``SMALL`` classes share a key all pairs are compared. The classes of
larger buckets are compared with a few heads: those whose keys are shared by most, as
what many copies come from shares more keys than the copies among themselves. One head
in the first round, then up to ``HEADS``. Heads come first in a bucket's sorted stream,
which is cut into chunks of about ``CHUNK`` classes with the heads in each; a class is
linked to the first head that it is near to, so no pairs are made. Linked classes leave
all buckets, heads leave theirs, and the rest goes on until none is left.

A class that left is stood for by its head. One minus the similarity is a metric, so
two classes can be near only if their heads are at 0.4 or more (0.6 if one of them is a
head itself, or stood for by none). In every crowded bucket whose classes are not one group
by then, heads of followers are compared with all others of other groups, and where two
are that alike, their followers with each other. So two near copies that share a key are
always in one group.

Texts are not exchanged but for those that have a candidate, and for the result.

Defined results: null and empty texts and those without words are one class. Of a
group one row stays, the first by id (null last), then by a hash of the text. Very
long texts are whole; memory follows the longest. Other columns pass through, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import byte_values, discard, numbered, packed, pieces, renamed, unpacked, written
from .components import connected
from .simhash import shingle_hashes

WIDTH = 5
SIMILARITY = 0.8
ROWS = 4
BANDS = 20
SMALL = 16
HEADS = 512
CHUNK = 512
_LAST = (1 << 63) - 1

_SALT = np.random.default_rng(7).integers(1, 1 << 63, (ROWS * BANDS, 1), dtype=np.uint64)
_ODD = np.random.default_rng(8).integers(1, 1 << 63, (ROWS * BANDS, 1), dtype=np.uint64) | np.uint64(1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of the text's shingles, sorted."""
    return np.unique(shingle_hashes(text, width))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct values."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit key a band (of no shingles: none)."""
    if not len(shingles):
        return np.empty(0, np.int64)
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        x = (shingles[None, at : at + 4096] ^ _SALT) * _ODD
        np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=1), out=least)
    grid = least.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64) * _M1
    for k in range(ROWS):
        key = ((key ^ grid[:, k]) * _M1) ^ (key >> np.uint64(29))
        key = (key ^ (key >> np.uint64(32))) * _M2
    return key.view(np.int64)


def _class(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(text.lower().split())) - (1 << 63)


_MARKS = pa.schema([("node", pa.int64()), ("none", pa.bool_()), ("id", pa.int64()), ("digest", pa.int64()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64()))])
_MARKS_DDL = "node bigint, none boolean, id bigint, digest bigint, fp bigint, keys array<bigint>"
_ROW = ["node", "none", "id", "digest"]


def _placed(ids: pa.Array, texts: list[bytes]) -> list[pa.Array]:
    """A row's class, whether it has no id, its id and the hash of its text: where it stands in a group."""
    numbers = ids.to_pylist()
    return [
        pa.array([_class(t) for t in texts], pa.int64()),
        pa.array([n is None for n in numbers], pa.bool_()),
        pa.array([_LAST if n is None else n for n in numbers], pa.int64()),
        pa.array([xxhash.xxh64_intdigest(t, 3) - (1 << 63) for t in texts], pa.int64()),
    ]


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to rows of marks."""
    for whole in batches:
        for batch in pieces(whole, 2 << 20):
            texts = byte_values(batch.column(1))
            fps, keys = [], []
            for t in texts:
                hashes = shingle_hashes(t, WIDTH)
                fps.append(simhash.majority(hashes))
                keys.append(band_keys(np.unique(hashes)).tolist())
            yield pa.record_batch([*_placed(batch.column(0), texts), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], schema=_MARKS)


def _pack(fields: list[str]):
    """(..., id, text) to (..., node, none, id, digest, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 4 << 20):
                column = batch.column(batch.num_columns - 1)
                texts = byte_values(column)
                raw = packed(None if n else t for n, t in zip(column.is_null().to_pylist(), texts))
                yield pa.record_batch([*batch.columns[:-2], *_placed(batch.column(batch.num_columns - 2), texts), raw], names=fields)

    return run


def _packed_rows(rows: DataFrame) -> DataFrame:
    """Rows that end in (id, text), with their place in a group in its stead and the text packed."""
    added = [T.StructField("node", T.LongType()), T.StructField("none", T.BooleanType()), T.StructField("id", T.LongType()), T.StructField("digest", T.LongType()), T.StructField("packed", T.BinaryType())]
    schema = T.StructType([*rows.schema.fields[:-2], *added])
    return rows.mapInArrow(_pack([f.name for f in schema]), schema)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, packed text) to (node, hashes)."""
    for whole in batches:
        for batch in pieces(whole, 1 << 20, "packed"):
            sets = [shingle_set(t or b"").tobytes() for t in unpacked(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], names=["node", "hashes"])


def _compared(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ([np.frombuffer(x, np.uint64) for x in batch.column(k).to_pylist()] for k in (2, 3))
            near = [similarity(x, y) >= least for x, y in zip(*sets)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def _linked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as asked; written."""
    pairs = written(pairs.filter("a <> b").distinct())
    one = pairs.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    both = one.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    good = written(both.select("a", "b", "x", "y").mapInArrow(_compared(least), "a bigint, b bigint"))
    discard(pairs)
    return good


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


class _Heads:
    """Sets that others are compared with."""

    def __init__(self):
        self.nodes: list[int] = []
        self.hashes: list[np.ndarray] = []
        self.index: tuple | None = None

    def add(self, node: int, hashes: np.ndarray) -> None:
        self.nodes.append(node)
        self.hashes.append(hashes)
        self.index = None

    def near(self, own: np.ndarray, least: float) -> np.ndarray:
        """Places of the heads of that similarity or more, in order."""
        if self.index is None:
            sizes = np.array([len(h) for h in self.hashes])
            hashes = np.concatenate(self.hashes)
            order = np.argsort(hashes, kind="stable")
            self.index = hashes[order], np.repeat(np.arange(len(sizes)), sizes)[order], sizes
        hashes, owner, sizes = self.index
        low, high = np.searchsorted(hashes, own), np.searchsorted(hashes, own, side="right")
        n = high - low
        found = owner[np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        both = np.bincount(found, minlength=len(sizes))
        return np.flatnonzero(both >= least * (len(own) + sizes - both))


def _against_heads(least: float, alike: bool = False):
    """Rows (key, chunk, place, node, hashes) sorted by key, chunk and place, heads with places from 1, others with none after them, to links (head, class).

    A class has one link, to the first head that is near. With ``alike`` rows also have their
    (root, leads), and (a, b) are all pairs of different roots that are alike enough
    for their followers to be near: twice the distance of a near copy, three times if both lead.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, heads, roots = None, _Heads(), []
        far = 1 - least
        for batch in batches:
            links: list[tuple[int, int]] = []
            for key, chunk, place, node, raw, *group in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
                own = np.frombuffer(raw, np.uint64)
                if (key, chunk) != at:
                    at, heads, roots = (key, chunk), _Heads(), []
                if place:
                    heads.add(node, own)
                    roots.append(group[0] if group else None)
                elif heads.nodes and not alike:
                    links += [(heads.nodes[f], node) for f in heads.near(own, least)[:1].tolist()]
                elif heads.nodes:
                    # a hair less, as rounding must lose none
                    found = heads.near(own, 1 - (3 if group[1] else 2) * far - 1e-9).tolist()
                    links += [(heads.nodes[f], node) for f in found if roots[f] != group[0]]
            if links:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*links)], schema=_LINK)

    return run


def _streamed(heads: DataFrame, others: DataFrame, sets: DataFrame, run, more: tuple[str, ...] = ()) -> DataFrame:
    """``run`` over every bucket: its ``heads`` (key, slice, place, node, n: how many others, ...) before its ``others`` (key, node, slices: of heads, ...).

    Each slice of heads meets the others in chunks, of which each has a copy of the slice.
    """
    of = lambda n: F.greatest(F.ceil(n / CHUNK).cast("int"), F.lit(1))
    chunks = of(F.col("n"))
    first = heads.select("key", "slice", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), "place", "node", *more)
    own = F.pmod(F.xxhash64("node", "key"), of(F.col("n"))).cast("int")
    after = others.select("key", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), own.alias("chunk"), F.lit(0).alias("place"), "node", *more)
    held = first.unionAll(after).join(sets, "node").select("key", (F.col("slice").cast("bigint") * (1 << 32) + F.col("chunk")).alias("chunk"), "place", "node", "hashes", *more)
    laid = held.repartition("key", "chunk").sortWithinPartitions("key", "chunk", F.col("place") == 0, "place")
    return laid.mapInArrow(run, "a bigint, b bigint")


def _sliced(rows: DataFrame) -> DataFrame:
    """Rows of each ``key`` with a slice of about ``HEADS`` of them, by hash, and a place in it that is not 0."""
    sizes = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / HEADS).cast("int").alias("slices"))
    return rows.join(sizes, "key").withColumns({"slice": F.pmod(F.xxhash64("node", "key"), F.col("slices")).cast("int"), "place": F.lit(1)})


def _completed(crowded: DataFrame, followers: DataFrame, links: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) of classes that share a key of ``crowded`` (key, node) and are in different groups of ``links``, because one left for its head.

    ``followers``: (head, class), each class once.
    """
    stood = followers.select(F.col("b").alias("node"), F.col("a").alias("head"))
    leading = stood.select(F.col("head").alias("node")).distinct().withColumn("leads", F.lit(True))
    roots = connected(links)
    root = roots.select("node", "root")
    shown = crowded.join(stood, "node", "left").select("key", F.coalesce("head", "node").alias("node")).distinct()
    shown = shown.join(leading, "node", "left").join(root, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"), F.coalesce("leads", F.lit(False)).alias("leads"))
    shown = written(shown)
    mixed = shown.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"), F.count_if("leads").alias("led"))
    mixed = written(mixed.filter("low <> high and led > 0").select("key", "n", F.ceil(F.col("led") / HEADS).cast("int").alias("slices")))
    if mixed.isEmpty():
        discard(shown, mixed)
        return links.limit(0)
    open_ = shown.join(mixed, "key")
    place = F.pmod(F.xxhash64("node", "key"), F.col("slices")).cast("int")
    leads = open_.filter("leads").select("key", place.alias("slice"), F.lit(1).alias("place"), "node", "n", "root", "leads")
    pairs = _streamed(leads, open_.select("key", "node", "n", "slices", "root", "leads"), sets, _against_heads(least, True), ("root", "leads"))
    led = stood.groupBy("head").agg(F.count(F.lit(1)).alias("led"))
    size = lambda side: led.select(F.col("head").alias(side), F.struct("led", F.col("head").alias("of")).alias(f"n_{side}"))
    pairs = pairs.distinct().join(size("a"), "a", "left").join(size("b"), "b", "left")
    # the one with more followers is the key, so that they come once for all that they are compared with
    swap = F.coalesce(F.col("n_b") > F.col("n_a"), F.col("n_b").isNotNull())
    pairs = written(pairs.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("key"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("other")).distinct())
    both = stood.select("head", "node").unionAll(stood.select("head", F.col("head").alias("node")).distinct())
    first = written(_sliced(pairs.select("key").distinct().join(both, F.col("key") == F.col("head")).select("key", "node")))
    others = written(pairs.join(both, pairs["other"] == both["head"], "left").select("key", F.coalesce("node", "other").alias("node")).distinct())
    n = others.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    slices = first.groupBy("key").agg(F.first("slices").alias("slices"))
    found = _streamed(first.join(n, "key"), others.join(n, "key").join(slices, "key"), sets, _against_heads(least))
    found = written(found.filter("a <> b").distinct())
    discard(shown, mixed, pairs, first, others)
    return found


def _simhash_pairs(heads: DataFrame) -> DataFrame:
    """(a, b): classes of one fingerprint with the first of them, and the first ones of linked fingerprints."""
    firsts = written(heads.groupBy("fp").agg(F.min("node").alias("first")))
    alike = heads.join(firsts, "fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    links = simhash.near_links(firsts.select("fp"))
    near = links.join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    return alike.unionAll(near.select(F.col("x").alias("a"), F.col("y").alias("b")))


def near_links(heads: DataFrame, rows: DataFrame, least: float = SIMILARITY, small: int = SMALL) -> DataFrame:
    """Links (a, b) of near copies.

    ``heads``: one row a class, (node, none, id, digest, fp, keys), of its first row;
    ``rows``: (id, text) of all rows.
    """
    exploded = heads.select(F.explode("keys").alias("key"), "node")
    shared = exploded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    entries = written(exploded.join(shared, "key"))
    similar = written(_simhash_pairs(heads.select("node", "fp")))
    wanted = entries.select("node").unionAll(similar.select("a")).unionAll(similar.select("b")).distinct()
    asked = written(heads.select(*_ROW).join(wanted, "node", "left_semi"))
    fetched = _packed_rows(rows).join(asked, _ROW, "left_semi").dropDuplicates(_ROW)
    sets = written(fetched.select("node", "packed").mapInArrow(_sets, "node bigint, hashes binary"))
    # how many classes share a class's keys, all keys together
    popular = entries.join(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key").groupBy("node").agg(F.sum("n").alias("popular"))
    at = F.struct((-F.col("popular")).alias("rank"), *_ROW[1:], "node")
    left = written(entries.join(asked.join(popular, "node"), "node").select("key", "node", at.alias("at")))
    discard(entries)

    links, heads_a_round, crowded, followers = _linked(similar, sets, least), 1, None, None
    while True:
        sizes = written(left.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        if sizes.isEmpty():
            break
        few = left.join(sizes.filter(F.col("n") <= small).select("key"), "key").groupBy("key").agg(F.collect_list("node").alias("all"))
        pairs = few.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).filter("a < b")
        links = links.unionAll(_linked(pairs, sets, least))
        many = written(left.join(sizes.filter(F.col("n") > small), "key"))
        if many.isEmpty():
            break
        crowded = written(many.select("key", "node")) if crowded is None else crowded
        if heads_a_round == 1:
            heads = many.groupBy("key", "n").agg(F.min("at").alias("at")).select("key", "n", F.col("at.node").alias("node"), F.lit(1).alias("place"))
        else:
            place = F.row_number().over(Window.partitionBy("key").orderBy("at"))
            heads = many.withColumn("place", place).filter(F.col("place") <= heads_a_round).select("key", "n", "node", "place")
        heads = written(heads)
        one = F.lit(0).alias("slice")
        found = _streamed(heads.withColumn("slice", one), many.select("key", "node", "n", F.lit(1).alias("slices")), sets, _against_heads(least))
        good = written(found.filter("a <> b").distinct())
        links = links.unionAll(good)
        followers = good if followers is None else followers.unionAll(good)
        # heads are rows of their chunks too, so they are compared among themselves
        gone = good.select(F.col("b").alias("node")).distinct()
        rest = written(many.drop("n").join(heads.select("key", "node"), ["key", "node"], "left_anti").join(gone, "node", "left_anti"))
        discard(left, sizes, many, heads)
        left, heads_a_round = rest, HEADS if heads_a_round > 1 else 32
    links = written(links)
    if followers is not None:
        one_each = followers.groupBy("b").agg(F.min("a").alias("a"))
        links = written(links.unionAll(_completed(crowded, one_each, links, sets, least)))
    discard(sets, similar, asked)
    return links


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, small: int = SMALL) -> DataFrame:
    """``docs`` with one row of each group of near copies."""
    names = docs.columns
    text = f"c{names.index(text_col)}"
    held = numbered(docs)
    number = F.col(f"c{names.index(id_col)}").cast("bigint").alias("id")
    narrow = held.select(number, F.col(text).alias("text"))
    marks = written(narrow.mapInArrow(_mark, _MARKS_DDL))
    # equal words give equal fingerprints and keys, so a class is one group
    heads = written(marks.groupBy("node", "fp", "keys").agg(F.min(F.struct(*_ROW[1:])).alias("place")).select("node", "place.*", "fp", "keys"))
    discard(marks)
    roots = connected(near_links(heads, narrow, least, small))
    placed = heads.select(F.col("node").alias("own"), F.struct(*_ROW[1:], "node").alias("at"))
    placed = placed.join(roots, placed["own"] == roots["node"], "left").select(F.coalesce("root", "own").alias("group"), "at")
    stay = written(placed.groupBy("group").agg(F.min("at").alias("one")).select("one.*"))
    others = [c for c in held.columns if c != text]
    # rows of one id and text are alike, so any of them stands for all
    rows = _packed_rows(held.select(*others, number, F.col(text).alias("text")))
    kept = rows.join(stay, _ROW, "left_semi").dropDuplicates(_ROW).select(*others, F.col("packed"))
    return kept.mapInArrow(_unpack([*others, text]), T.StructType([*(held.schema[c] for c in others), T.StructField(text, T.StringType())])).select(*renamed(held, names))


def _unpack(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1 << 20, "packed"):
                texts = [None if t is None else t.decode("utf-8", "surrogatepass") for t in unpacked(batch.column(batch.num_columns - 1))]
                yield pa.record_batch([*batch.columns[:-1], pa.array(texts, pa.string())], names=names)

    return run
