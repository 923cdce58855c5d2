"""Cross-entropy difference scores from two matched bigram models.

Every word and every pair of words has a count of its own, held as a
distributed table: blocks of texts send the distinct keys that they hold, with
their counts, to the part of each key; parts sum over all blocks and answer each
block that asks. A frequent key comes once a block, so none is crowded. Keys are
48-bit hashes, sent as compressed differences. A block's rows come in the order of id
and text hash, so counting and scoring see the same blocks whenever a task is run again.

Both models share the vocabulary (all words of the background), order and smoothing.
Background counts are scaled to the target's number of tokens.

p(w | v) = (c(v, w) + MU p(w)) / (c(v) + MU), p(w) = (c(w) + 1) / (N + V).

A document's score is the mean over its tokens of target loss less background
loss, in nats: below 0 it resembles the target more than the corpus at large.
Each text is one sequence that begins with a boundary token.

Defined results: a null or empty text, or one without words, has 0 tokens and
losses and score 0. Without a target all scores are those of an empty target
model. Null ids and repeated rows are rows like others. Very long texts are whole; memory
follows the longest. No result depends on an order, so ties play no part. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, packed, pieces, shuffle_width, written

MU = 200.0
_KEPT_WORDS = 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BOUNDARY = np.uint64(0x5851F42D4C957F2D)
BLOCK_BYTES = 16 << 20


class Hashes(dict):
    """Hash of each word; fills itself as words come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = made = xxhash.xxh3_64_intdigest(word)
        return made

    def of(self, text: bytes) -> np.ndarray:
        """A boundary, then the hash of each word."""
        if len(self) > _KEPT_WORDS // 4:
            self.clear()
        words = text.lower().split()
        out = np.full(len(words) + 1, _BOUNDARY, np.uint64)
        out[1:] = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        return out


def word_keys(hashes: np.ndarray) -> np.ndarray:
    """Odd keys of 49 bits."""
    return (hashes >> np.uint64(16)) << np.uint64(1) | np.uint64(1)


def pair_keys(hashes: np.ndarray) -> np.ndarray:
    """Even keys of a text's neighbours."""
    key = (hashes[:-1] ^ (hashes[:-1] >> np.uint64(29))) * _MIX + hashes[1:]
    key = (key ^ (key >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((key ^ (key >> np.uint64(30))) >> np.uint64(16)) << np.uint64(1)


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(17)) * np.uint64(parts)) >> np.uint64(32)


def _summed(keys: np.ndarray, counts_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts_ = keys[order], counts_[order]
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[cuts], np.add.reduceat(counts_, cuts, axis=0) if len(cuts) else counts_


def _zipped(table: np.ndarray) -> bytes:
    """Numbers by planes of bytes, compressed: high planes are mostly zero."""
    planes = np.ascontiguousarray(table).view(np.uint8).reshape(-1, table.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unzipped(raw: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _steps(keys: np.ndarray) -> bytes:
    """Sorted keys as compressed differences."""
    return _zipped(np.diff(keys, prepend=np.uint64(0)))


def _keys_of(raw: bytes) -> np.ndarray:
    return np.cumsum(_unzipped(raw, np.uint64), dtype=np.uint64)


class Tables:
    """Tables of texts whose counts are gathered when texts are scored.

    The target is a table of texts, or a label table (doc_id, ...) whose labelled
    rows of the background are the target.
    """

    def __init__(self, target: DataFrame | None, background: DataFrame, mu: float = MU, labelled: DataFrame | None = None):
        self.target, self.background, self.mu, self.labelled = target, background, mu, labelled


_COUNTED, _ASKS, _TARGET, _LABEL = 1, 2, 4, 8
_DEALT_DDL = "block int, kind int, doc_id bigint, tie bigint, packed binary"
_ROW = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("background", pa.int64()), ("target", pa.int64()), ("asks", pa.bool_()), ("keys", pa.binary()), ("n", pa.binary())])
_ROW_DDL = "block bigint, part int, background bigint, target bigint, asks boolean, keys binary, n binary"
_ANSWER = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("background", pa.int64()), ("target", pa.int64()), ("words", pa.int64()), ("n", pa.binary())])
_ANSWER_DDL = "block bigint, part int, background bigint, target bigint, words bigint, n binary"
_SEQUENCE = 1 << 24


def _deal(docs: DataFrame, kind: int, width: int, by_id: bool) -> DataFrame:
    """(doc_id, text) to rows with their block, the text packed. Labels are matched within a block, so ``by_id`` deals by id (null: by text)."""
    ids = F.coalesce(F.xxhash64("doc_id"), F.lit(0)) if by_id else F.xxhash64("doc_id", "text")
    hashed = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(ids)
    rows = docs.select(F.pmod(hashed, F.lit(width)).cast("int").alias("block"), "doc_id", "text")
    names = [x.split()[0] for x in _DEALT_DDL.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 4 << 20):
                texts = byte_values(batch.column(2))
                ties = pa.array([xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in texts], pa.int64())
                yield pa.record_batch([batch.column(0), pa.array([kind] * len(texts), pa.int32()), batch.column(1), ties, packed(texts)], names=names)

    return rows.mapInArrow(run, _DEALT_DDL)


class _Block:
    """Texts that are counted and ask together."""

    def __init__(self):
        self.held: list[np.ndarray] = []
        self.target: list[bool] = []
        self.size = 0

    def add(self, hashes: np.ndarray, size: int, target: bool = False) -> None:
        self.held.append(hashes)
        self.target.append(target)
        self.size += size

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all texts, and how many of them each has."""
        each = [np.concatenate([word_keys(h), pair_keys(h)]) for h in self.held]
        return np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))


def _count(parts: int):
    """Rows sorted by block and id, labels first, to rows of blocks: for each part the distinct keys and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        block, done, labelled = None, 0, None
        asking, other = {}, {}  # by what the texts count for

        def flush(at: _Block, kind: int, name: int) -> pa.RecordBatch:
            keys, sizes = at.keys()
            own, which = np.unique(keys, return_inverse=True)
            of_target = np.array(at.target) | bool(kind & _TARGET)
            n = [np.bincount(which, minlength=len(own)) if kind & _COUNTED else np.zeros(len(own), np.int64)]
            n.append(np.bincount(which, weights=np.repeat(of_target, sizes), minlength=len(own)).astype(np.int64) if of_target.any() else np.zeros(len(own), np.int64))
            tokens = np.array([len(h) - 1 for h in at.held])
            totals = int(tokens.sum()) if kind & _COUNTED else 0, int(tokens[of_target].sum())
            cuts = np.searchsorted(_part_of(own, parts), np.arange(parts + 1, dtype=np.uint64)).tolist()
            asks = bool(kind & _ASKS)
            rows = [(name, k, *(totals if k == 0 else (0, 0)), asks, _steps(own[a:b]), _zipped(np.concatenate([n[0][a:b], n[1][a:b]]).astype(np.uint32))) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a or k == 0]
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROW)], schema=_ROW)

        for batch in batches:
            for own, kind, doc_id, raw in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4))):
                if own != block:
                    for group in (asking, other):
                        for k, at in group.items():
                            yield flush(at, k, block * _SEQUENCE + done)
                        group.clear()
                    block, done, labelled = own, 0, None
                if kind & _LABEL:
                    labelled = doc_id
                    continue
                text = zstandard.ZstdDecompressor().decompress(raw)
                group = asking if kind & _ASKS else other
                at = group.setdefault(kind, _Block())
                at.add(hashes.of(text), len(text), bool(kind & _COUNTED) and doc_id is not None and doc_id == labelled)
                if at.size > BLOCK_BYTES:
                    yield flush(group.pop(kind), kind, block * _SEQUENCE + done)
                    done += bool(kind & _ASKS)
        for group in (asking, other):
            for k, at in group.items():
                yield flush(at, k, block * _SEQUENCE + done)

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part to the target's and the background's counts of each key that a block asks for.

    Block -1 tells the tokens that came with the part, and how many words of the part the background has.
    """
    part, asks, keys, n, totals = None, [], [], [], [0, 0]

    def gather() -> None:
        if len(keys) > 1:
            k, c = _summed(np.concatenate(keys), np.concatenate(n))
            keys[:], n[:] = [k], [c]

    def emit() -> Iterator[pa.RecordBatch]:
        gather()
        words = int(((keys[0] & np.uint64(1) == 1) & (n[0][:, 0] > 0) & (keys[0] != word_keys(np.array([_BOUNDARY]))[0])).sum())
        rows = [(-1, part, *totals, words, b"")]
        for block, raw in asks:
            found = n[0][np.searchsorted(keys[0], _keys_of(raw))]
            rows.append((block, part, 0, 0, 0, _zipped(np.ascontiguousarray(found.T).ravel())))
        for at in range(0, len(rows), 64):
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 64]), _ANSWER)], schema=_ANSWER)

    for batch in batches:
        for block, at, background, target, asking, raw, counted in zip(*(batch.column(k).to_pylist() for k in range(7))):
            if at != part:
                if part is not None:
                    yield from emit()
                part, asks, keys, n, totals = at, [], [], [], [0, 0]
            totals[0] += background
            totals[1] += target
            own = _keys_of(raw)
            keys.append(own)
            n.append(_unzipped(counted, np.uint32).astype(np.int64).reshape(2, -1).T)
            if asking:
                asks.append((block, raw))
            if sum(map(len, keys[1:])) > max(1 << 19, len(keys[0])):
                gather()
    if part is not None:
        yield from emit()


def _score_tables(docs: DataFrame, tables: Tables, id_col: str, text_col: str) -> DataFrame:
    width = shuffle_width(docs.sparkSession)
    parts = 4 * width
    of = lambda df, i, t: df.select(i.cast("bigint").alias("doc_id"), F.col(t).alias("text"))
    none, by_id = F.lit(None), tables.labelled is not None
    own = docs is tables.background and (text_col == "text" or not by_id) and (not by_id or id_col == "doc_id")
    asking = _deal(of(docs, F.col(id_col), text_col), _ASKS | (_COUNTED if own else 0), width, by_id and own)
    rows = asking
    if not own:
        rows = rows.unionAll(_deal(of(tables.background, F.col("doc_id") if by_id else none, "text"), _COUNTED, width, by_id))
    if tables.target is not None:
        rows = rows.unionAll(_deal(of(tables.target, none, "text"), _TARGET, width, False))
    if by_id:
        block = F.pmod(F.xxhash64("doc_id"), F.lit(width)).cast("int")
        rows = rows.unionAll(tables.labelled.select(block.alias("block"), F.lit(_LABEL).alias("kind"), "doc_id", F.lit(0).cast("bigint").alias("tie"), F.lit(None).cast("binary").alias("packed")))
    in_order = ["block", F.col("doc_id").asc_nulls_first(), F.col("kind").desc(), "tie"]
    laid = rows.repartitionById(width, F.col("block")).sortWithinPartitions(*in_order)
    counted = laid.mapInArrow(_count(parts), _ROW_DDL).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "block")
    answers = written(counted.mapInArrow(_answers, _ANSWER_DDL))
    row = answers.filter("block = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("background", "target", "words")]).first()
    n_background, n_target, words = row
    factors = np.array([1.0, n_target / n_background if n_target and n_background else 1.0])
    totals, mu = np.array([n_target, n_background * factors[1]]) + words + 1, tables.mu
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *((n, pa.float64()) for n in ("loss_target", "loss_background", "score"))])

    def scored(ids: list, held: _Block, counted: list[bytes]) -> pa.RecordBatch:
        keys, which = np.unique(held.keys()[0], return_inverse=True)
        each = [_unzipped(raw, np.int64).reshape(2, -1)[::-1].T for raw in counted]
        table = np.concatenate(each) if each else np.zeros((0, 2), np.int64)
        assert len(table) == len(keys), "a block has been answered in part"
        out, at = [], 0
        for i, h in zip(ids, held.held):
            own = which[at : at + 2 * len(h) - 1]
            at += len(own)
            if len(h) == 1:
                out.append((i, 0, 0.0, 0.0, 0.0))
                continue
            single = table[own[: len(h)]] * factors
            pairs = np.minimum(table[own[len(h) :]] * factors, single[:-1])
            share = (single[1:] + 1) / totals
            a, b = (np.log(single[:-1] + mu) - np.log(pairs + mu * share)).mean(axis=0).tolist()
            out.append((i, len(h) - 1, a, b, a - b))
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, done, ids, held, hashes = None, 0, [], _Block(), Hashes()
        told: dict[int, list[bytes]] = {}
        for batch in batches:
            for own, sequence, doc_id, raw in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4))):
                if own != block:
                    if ids:
                        yield scored(ids, held, told.pop(done, []))
                    block, done, ids, held, told = own, 0, [], _Block(), {}
                if sequence >= 0:
                    told.setdefault(sequence, []).append(raw)
                    continue
                text = zstandard.ZstdDecompressor().decompress(raw)
                ids.append(doc_id)
                held.add(hashes.of(text), len(text))
                if held.size > BLOCK_BYTES:  # as they were counted: same rows in the same order
                    yield scored(ids, held, told.pop(done, []))
                    done, ids, held = done + 1, [], _Block()
        if ids:
            yield scored(ids, held, told.pop(done, []))

    # answers come before the texts of their block, by sequence and part
    found = answers.filter("block <> -1").select(
        F.shiftright("block", 24).cast("int").alias("block"), F.col("block").bitwiseAND(F.lit(_SEQUENCE - 1)).cast("int").alias("sequence"), F.lit(None).cast("bigint").alias("doc_id"), F.col("part").cast("bigint").alias("tie"), F.col("n").alias("packed")
    )
    back = found.unionAll(asking.select("block", F.lit(-1).alias("sequence"), "doc_id", "tie", "packed"))
    back = back.repartitionById(width, F.col("block")).sortWithinPartitions("block", F.col("sequence") < 0, "sequence", F.col("doc_id").asc_nulls_first(), "tie")
    return back.mapInArrow(run, "doc_id bigint, n_tokens bigint, loss_target double, loss_background double, score double")


def fit_labelled(docs: DataFrame, labels: DataFrame, label_col: str = "quality", mu: float = MU) -> Tables:
    """Models of ``docs`` and of those of them that are labelled 1."""
    good = labels.filter(F.col(label_col) == 1).select(F.col("doc_id").cast("bigint").alias("doc_id")).filter("doc_id is not null").distinct()
    return Tables(None, docs, mu, good)


def fit(target: DataFrame, background: DataFrame, mu: float = MU) -> Tables:
    """Models of the texts of two tables."""
    return Tables(target, background, mu)


def score(docs: DataFrame, models: Tables, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, loss_target, loss_background and score, their difference."""
    return _score_tables(docs, models, id_col, text_col)
