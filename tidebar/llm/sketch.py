"""Bottom-k sketches of shingle hashes as document fingerprints.

A text's shingles (five words, the whole sequence if shorter) are hashed to 48
bits; the fingerprint holds the ``k`` smallest distinct hashes, sorted. The
union of two sketches cut to ``k`` is the sketch of the union, so parts of a text
or of a corpus can be sketched apart and merged. Two sketches give estimates of
resemblance and containment, one gives the number of distinct shingles; all are
exact while a side has fewer than ``k`` shingles.

A fingerprint is written as a string: each hash takes eight base64 characters.

``edit_check`` compares each document with an edited text whose tail comes from
the document that follows by id. Documents are cut into buckets at sampled ids, and
within an id that many share at hashes of the text; the
document that opens a bucket is also sent to the bucket before it, so a single
exchange of compressed texts serves every neighbour. Nothing but the bucket
bounds reaches the driver.

Defined results: a null or empty text, or one without words, has the empty
fingerprint; two empty fingerprints have likeness 1, an empty and another one 0.
Documents with equal ids are ordered by a hash of the text; null ids come last. Repeated
rows are documents of their own. Very long texts are whole; two are held at a time. An
empty table gives an empty result. Other columns are ignored, or kept by ``sketches``.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_values, packed, pieces, shuffle_width

K = 128
SHINGLE = 5
BYTES = 6
_TOP = float(1 << 8 * BYTES)
_WORD_CACHE = 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Hasher:
    """Hashes the shingles of texts; keeps the hashes of words it has met."""

    def __init__(self, width: int = SHINGLE):
        self.width, self.known = width, {}

    def words(self, words: list[bytes]) -> np.ndarray:
        known, digest = self.known, xxhash.xxh3_64_intdigest
        if len(known) > _WORD_CACHE:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in set(words).difference(known):
                known[w] = digest(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def shingles(self, text: bytes) -> np.ndarray:
        """A 48-bit hash for each run of ``width`` words, repeats included."""
        words = text.lower().split()
        if not words:
            return np.empty(0, np.uint64)
        each = self.words(words)
        width = min(self.width, len(each))
        total = np.zeros(len(each) - width + 1, np.uint64)
        for k in range(width):
            total = (total ^ each[k : len(each) - width + 1 + k]) * _STEP
            total ^= total >> np.uint64(29)
        total = (total + np.uint64(width)) * np.uint64(0xBF58476D1CE4E5B9)
        return (total ^ (total >> np.uint64(31))) >> np.uint64(64 - 8 * BYTES)


def smallest(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The ``k`` smallest distinct values, sorted."""
    if len(hashes) > 8 * k:
        cut = int(len(hashes) * min(1.0, 3 * k / len(hashes)))
        low = np.unique(np.partition(hashes, cut)[:cut])
        if len(low) >= k:
            return low[:k]
    return np.unique(hashes)[:k]


def to_text(sketch: np.ndarray) -> str:
    raw = sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BYTES :]
    return base64.b64encode(raw.tobytes()).decode("ascii")


def from_text(fingerprint: str | None) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint or ""), np.uint8).reshape(-1, BYTES)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, 8 - BYTES :] = raw
    return full.view(">u8").ravel().astype(np.uint64)


def merged(sketches: Iterable[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of the union of what the sketches were made of."""
    parts = list(sketches)
    return smallest(np.concatenate(parts), k) if parts else np.empty(0, np.uint64)


def distinct_count(sketch: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles (exact below ``k``)."""
    if len(sketch) < k:
        return float(len(sketch))
    return (k - 1) * _TOP / (float(sketch[k - 1]) + 1.0)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness of the shingle sets."""
    if not len(a) and not len(b):
        return 1.0
    both = merged((a, b), k)
    shared = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(both, shared, assume_unique=True).sum()) / len(both)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the shingles of ``a`` that ``b`` has too."""
    if not len(a):
        return 1.0
    share = resemblance(a, b, k) * distinct_count(merged((a, b), k), k) / distinct_count(a, k)
    return min(1.0, share)


def sketches(docs: DataFrame, text_col: str = "text", k: int = K, width: int = SHINGLE) -> DataFrame:
    """``docs`` with its text replaced by column ``fingerprint`` (one of that name goes)."""
    others = [c for c in docs.columns if c not in (text_col, "fingerprint")]
    held = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)]
    kept = docs.select(*held, F.col(f"`{text_col}`").alias("text"))
    schema = docs.select(*held).schema.add("fingerprint", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(width)
        for whole in batches:
            for batch in pieces(whole):
                marks = [to_text(smallest(hasher.shingles(t), k)) for t in byte_values(batch.column(batch.num_columns - 1))]
                yield pa.record_batch([*batch.columns[:-1], pa.array(marks, pa.string())], names=[f.name for f in schema])

    return kept.mapInArrow(run, schema).toDF(*others, "fingerprint")


def merge_by(marks: DataFrame, *keys: str, k: int = K) -> DataFrame:
    """One merged fingerprint for each value of ``keys``.

    The hashes are ranked within (key, hash range) first, so a key with a third
    of all rows is spread, and only the k smallest of each range go on.
    """
    parts = 64

    def split(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in it:
            for _, group in rows.groupby(list(keys), dropna=False, sort=False):
                sketch = merged((from_text(f) for f in group["fingerprint"]), k)
                yield group.iloc[: 1][list(keys)].assign(fingerprint=to_text(sketch))

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.iloc[:1][list(keys)].assign(fingerprint=to_text(merged((from_text(f) for f in rows["fingerprint"]), k)))

    narrow = marks.select(*keys, "fingerprint")
    first = narrow.mapInPandas(split, narrow.schema)
    salted = first.withColumn("_part", F.pmod(F.xxhash64("fingerprint"), F.lit(parts)))
    second = salted.groupBy(*keys, "_part").applyInPandas(join, narrow.schema)
    return second.groupBy(*keys).applyInPandas(join, narrow.schema)


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Resemblance of two fingerprint columns."""
    return pd.Series([resemblance(from_text(x), from_text(y)) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def contained(a: pd.Series, b: pd.Series) -> pd.Series:
    """Containment of the first fingerprint column in the second."""
    return pd.Series([containment(from_text(x), from_text(y)) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def shingle_count(a: pd.Series) -> pd.Series:
    """Estimated number of distinct shingles of a fingerprint column."""
    return pd.Series([distinct_count(from_text(x)) for x in a], dtype="float64")


_OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
        ("n_shingles", pa.float64()),
        ("contained_in_edited", pa.float64()),
    ]
)
_PACKED = "bucket int, doc_id bigint, own boolean, tie bigint, packed binary"
_ROWS_OUT = 512
_Place = tuple[bool, int, int]  # no id, id, hash of the text: the order of documents
_ANY = -(1 << 63)


def _bounds(rows: DataFrame, buckets: int) -> list[_Place]:
    """Places that cut the rows (doc_id, tie, text) into about ``buckets`` even parts, the least place first.

    An id that fills several parts, null among them, is cut within, by its texts' hashes.
    """
    shares = [i / buckets for i in range(1, buckets)]
    cuts = F.percentile_approx("doc_id", F.lit(shares), F.lit(50 * buckets)) if shares else F.lit(None)
    row = rows.agg(F.min("doc_id").alias("least"), cuts.alias("cuts"), F.count("doc_id").alias("n"), F.count(F.lit(1)).alias("all")).first()
    cut_at = [row["least"], *(row["cuts"] or [])] if row["n"] else []
    if any(abs(i) > 1 << 52 for i in cut_at):
        cut_at = _next_ids(rows, sorted(set(cut_at)))  # quantiles are of doubles: not all of these exist
    found = Counter(cut_at)
    parts: dict[int | None, int] = {i: n for i, n in found.items() if n > 1}
    if (row["all"] - row["n"]) * buckets > 2 * row["all"]:
        parts[None] = max(2, round((row["all"] - row["n"]) * buckets / row["all"]))
    places = {(False, i, _ANY) for i in found if i not in parts}
    if parts:  # a few ids, each of several parts
        inside = F.col("doc_id").isin([i for i in parts if i is not None]) | (F.col("doc_id").isNull() if None in parts else F.lit(False))
        most = max(parts.values())
        ties = F.percentile_approx("tie", F.lit([k / most for k in range(1, most)]), F.lit(50 * most))
        for r in rows.filter(inside).groupBy("doc_id").agg(F.min("tie").alias("least"), ties.alias("ties")).collect():
            places |= {(r["doc_id"] is None, r["doc_id"] or 0, t) for t in (r["least"], *r["ties"])}
    return sorted(places)


def _next_ids(rows: DataFrame, cuts: list[int]) -> list[int]:
    """The least id from each of the cuts to the next, where there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least: dict[int, int] = {}
            for i in batch.column(0).drop_null().to_pylist():
                at = max(0, bisect_right(cuts, i) - 1)
                least[at] = min(i, least.get(at, i))
            yield pa.record_batch([pa.array(list(least), pa.int32()), pa.array(list(least.values()), pa.int64())], names=["at", "id"])

    found = rows.select("doc_id").mapInArrow(run, "at int, id bigint").groupBy("at").agg(F.min("id").alias("id")).collect()  # a row a part
    return sorted(r["id"] for r in found)


def _deal(bounds: list[_Place]):
    """(doc_id, tie, text) to packed rows with their bucket; those that a bucket can open with also go to the bucket before it, not as its own."""
    last = max(0, len(bounds) - 1)
    schema = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("own", pa.bool_()), ("tie", pa.int64()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 4 << 20):
                ids, ties = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                raw = packed(byte_values(batch.column(2))).to_pylist()
                places = [(i is None, i or 0, t) for i, t in zip(ids, ties)]
                at = [max(0, bisect_right(bounds, p) - 1) for p in places]
                extra = [k for k, p in enumerate(places) if not bounds or bounds[at[k]] in (p, (*p[:2], _ANY)) or not last and p[0]]
                rows = [*range(len(ids)), *extra]
                columns = [
                    [*at, *((at[k] - 1) % (last + 1) for k in extra)],
                    [ids[k] for k in rows],
                    [True] * len(ids) + [False] * len(extra),
                    [ties[k] for k in rows],
                    [raw[k] for k in rows],
                ]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _compare(k: int, width: int):
    """Packed rows, sorted within their bucket, to result rows; holds two texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, undo = Hasher(width), zstandard.ZstdDecompressor()
        out: list[tuple] = []
        held = None  # (bucket, id, text, sketch) that waits for its successor

        def emit(item: tuple, following: tuple) -> None:
            _, doc_id, text, sketch = item
            chars = text.decode("utf-8", "surrogatepass")
            half = len(chars) // 2
            edited = (chars[: len(chars) - half] + following[2].decode("utf-8", "surrogatepass")[:half]).encode("utf-8", "surrogatepass")
            other = smallest(hasher.shingles(edited), k)
            out.append(
                (
                    doc_id,
                    len(chars),
                    hashlib.sha256(edited).hexdigest(),
                    to_text(sketch),
                    to_text(other),
                    resemblance(sketch, other, k),
                    resemblance(sketch, following[3], k),
                    distinct_count(sketch, k),
                    containment(sketch, other, k),
                )
            )

        def table() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), _OUT)], schema=_OUT)
            out.clear()
            return made

        for batch in batches:
            for bucket, doc_id, own, packed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "own", "packed"))):
                if not own and (held is None or held[0] != bucket):
                    continue  # the opening document of the next bucket has been met
                text = undo.decompress(packed)
                item = (bucket, doc_id, text, smallest(hasher.shingles(text), k))
                if held is not None and held[0] == bucket:
                    emit(held, item)
                held = item if own else None
                if len(out) >= _ROWS_OUT:
                    yield table()
        if out:
            yield table()

    return run


def edit_check(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = SHINGLE) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likenesses (see the module's notes)."""
    wide = shuffle_width(docs.sparkSession)
    kept = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.shiftright(F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), 11).alias("tie"), F.col(f"`{text_col}`").alias("text"))
    dealt = kept.mapInArrow(_deal(_bounds(kept, wide)), _PACKED)
    laid = dealt.repartitionById(wide, F.col("bucket")).sortWithinPartitions("bucket", F.desc("own"), F.col("doc_id").asc_nulls_last(), "tie")
    return laid.mapInArrow(
        _compare(k, width),
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, contained_in_edited double",
    )


def hash_column(fingerprint: Column) -> Column:
    """The fingerprint's hashes as eight-character strings, for joins on shared hashes."""
    return F.regexp_extract_all(fingerprint, F.lit("(.{8})"))
