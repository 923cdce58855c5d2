"""SimHash near-duplicate groups by a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its sixteen 4-bit segments.
The Manhattan distance of two such vectors never exceeds the Hamming distance
of the fingerprints, so vectors within distance 2 form a superset of the links.
The range join is done on the integer grid: each fingerprint enters the cells
of all vectors within distance 1 of its own, and two vectors within distance 2
always share such a cell (their midpoint). Cell members are then verified on
the fingerprints themselves.

Equal fingerprints are collapsed before the join, so groups of copies cost one
entry. Cells with more than ``CELL_LIMIT`` members are not paired: their members
enter the 65 exact cells "fingerprint with at most one bit flipped"; all members
of such a cell are within 2 bits of each other and so hang on its smallest
member, and every pair within 2 bits shares one. That is exact and linear.

Memory is bounded by an Arrow batch and ``CELL_LIMIT`` rows. All intermediate
tables are written to the checkpoint folder, so lost executors are survived.

Defined results: a null or empty text, or one without words, has fingerprint
zero, which links like any other. Null doc_ids are kept as rows and never name a
component unless all ids of the component are null. Repeated rows come back as
often as they came in. Very long texts are whole; memory follows the longest. Ties
(equal fingerprints, equal ids) need no order. An empty table gives an empty result.
Other columns are ignored by ``near_groups``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_values, numbered, pieces, renamed, shuffle_width, written
from .components import connected

SEED = 42
SHINGLE = 3
SEGMENTS = 16
CELL_LIMIT = 32

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_OFFSET = (np.arange(8, dtype=np.uint16) * 256)[None, :]
_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def shingle_hashes(text: bytes, width: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of ``width`` words, repeats included (fewer words: of the whole run)."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())]
    return np.array(hashes, np.uint64)


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of one text as an unsigned 64-bit number."""
    return majority(shingle_hashes(text, width, seed))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    table = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _BYTE_OFFSET).ravel(), minlength=2048)
    ones = (table.reshape(8, 256) @ _BITS).ravel()
    return int(_POWERS[2 * ones > len(hashes)].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp bigint) for every row of ``docs``."""
    kept = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    out = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                fps = np.array([fingerprint(t) for t in byte_values(batch.column(1))], np.uint64).view(np.int64)
                yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(fps)], schema=out)

    return kept.mapInArrow(run, "id bigint, fp bigint")


def _segment(fp: Column, k: int) -> Column:
    return F.bit_count(F.shiftrightunsigned(fp, 4 * k).bitwiseAND(F.lit(15)))


def grid_cells(fp: Column) -> Column:
    """The grid vectors within Manhattan distance 1 of the embedding of ``fp``.

    A vector is one number whose base-5 digits are the sixteen bit counts. A
    step down from 0 or up from 4 leaves the grid and is left out.
    """
    at = sum((_segment(fp, k) * F.lit(5**k).cast("bigint") for k in range(1, SEGMENTS)), _segment(fp, 0).cast("bigint"))
    steps = [at]
    for k in range(SEGMENTS):
        unit = F.lit(5**k).cast("bigint")
        steps.append(F.when(_segment(fp, k) < 4, at + unit))
        steps.append(F.when(_segment(fp, k) > 0, at - unit))
    return F.array_compact(F.array(*steps))


def _verified(limit: int):
    """Rows (cell, fp) sorted by cell to links (a, b); b is null for members of overfull cells."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(cells: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = [], []
        bits = fps.view(np.uint64)
        for step in range(1, limit):
            same = cells[step:] == cells[:-step]
            if not same.any():
                break
            near = same & (np.bitwise_count(bits[step:] ^ bits[:-step]) <= 2)
            a.append(fps[step:][near])
            b.append(fps[:-step][near])
        if not a:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
        return pairs[0], pairs[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_c, rest_f = np.empty(0, np.int64), np.empty(0, np.int64)
        heavy = None  # the overfull cell that the last batch ended in

        def flush(cells: np.ndarray, fps: np.ndarray, open_end: bool):
            nonlocal rest_c, rest_f, heavy
            if not len(cells):
                return
            cuts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1], [True]]))
            sizes = np.diff(cuts)
            full = sizes > limit
            if heavy is not None and cells[0] == heavy:
                full[0] = True
            member = np.repeat(full, sizes)
            done = len(cells)
            heavy = None
            if open_end:
                if full[-1]:
                    heavy = cells[-1]
                else:
                    done = cuts[-2]
            rest_c, rest_f = cells[done:], fps[done:]
            crowd = np.unique(fps[:done][member[:done]])
            if len(crowd):
                yield pa.record_batch([pa.array(crowd), pa.nulls(len(crowd), pa.int64())], schema=schema)
            light = ~member[:done]
            a, b = links(cells[:done][light], fps[:done][light])
            if len(a):
                yield pa.record_batch([pa.array(a), pa.array(b)], schema=schema)

        for batch in batches:
            cells, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield from flush(np.concatenate([rest_c, cells]), np.concatenate([rest_f, fps]), True)
        yield from flush(rest_c, rest_f, False)

    return run


def near_links(fps: DataFrame, limit: int = CELL_LIMIT) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b) that connect all pairs within 2 bits.

    Every link is a true one. Pairs that meet only in overfull cells may be
    connected through a third fingerprint instead of directly.
    """
    # fingerprints are few bytes, so that they would be coalesced into few tasks before they are multiplied
    dealt = fps.repartition(shuffle_width(fps.sparkSession), F.xxhash64("fp"))
    cells = dealt.select(F.explode(grid_cells(F.col("fp"))).alias("cell"), "fp")
    found = cells.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(_verified(limit), "a bigint, b bigint")
    found = written(found.distinct())
    crowd = found.filter("b is null").select(F.col("a").alias("fp"))
    one_off = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << k) - (1 << 64) if k == 63 else 1 << k)) for k in range(64)])
    balls = crowd.select(F.explode(one_off).alias("ball"), "fp")
    least = balls.groupBy("ball").agg(F.min("fp").alias("m"), F.max("fp").alias("top")).filter("m <> top")
    stars = balls.join(least, "ball").filter("fp <> m").select(F.col("fp").alias("a"), F.col("m").alias("b"))
    return found.filter("b is not null").unionAll(stars.distinct())


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = CELL_LIMIT) -> DataFrame:
    """One row per document: id, fp (bigint), component_id, the smallest id reachable over links of at most 2 bits."""
    rows = written(fingerprints(docs, id_col, text_col))
    classes = rows.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected(near_links(classes.select("fp"), limit))
    classes = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = written(classes)
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = classes.join(named, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    """Sixteen lowercase hexadecimal digits of a bigint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = CELL_LIMIT) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest id.

    Rows that share an id and a group count as copies. Rows with a null id can't be
    named, so they stay. Other columns pass through, whatever their names.
    """
    names = docs.columns
    held = numbered(docs)
    number, text = F.col(f"c{names.index(id_col)}").cast("bigint"), F.col(f"c{names.index(text_col)}")
    named = held.filter(number.isNotNull())
    groups = near_groups(named.select(number.alias("doc_id"), text.alias("text")), limit=limit)
    stay = groups.filter("id = component_id").select("id").distinct()
    kept = named.withColumn("id", number).join(stay, "id", "left_semi").dropDuplicates(["id"]).drop("id")
    return kept.unionAll(held.filter(number.isNull())).select(*renamed(held, names))
