"""Removal of repeated strings by difference-cover suffix sorting.

A text is a sequence of symbols: its bytes, or its words (32-bit hashes; blanks are
not compared). Every symbol that is covered by a run of a ``Measure``'s length which
also starts elsewhere is marked, wherever the other one is; matches stay within
documents. Several measures are taken in one pass.

A suffix array of the whole corpus would move each symbol several times through a
sort, so the suffixes that can matter are dealt out first:

1. Each window of ``length`` symbols has an anchor: the least hash among the strings
   of ``gram`` symbols that start in its first ``length - gram + 1`` places, leftmost if equal. It
   depends on the window's content only, so equal windows have equal anchors. The
   windows of one anchor place are neighbours; with the symbols they cover they form
   a tile. A tile is named by its anchor's hash and its content's.
2. Anchors are counted. One that occurs once has nothing to match; its tile goes no
   further. Of the others, a tile that occurs twice repeats as a whole, and where
   tiles of one anchor differ, one occurrence of each fetches its symbols.
3. Those tiles, ordered by anchor, form runs of bounded size whose suffixes are
   sorted by the difference-cover method: triples at places not divisible by 3 are
   sorted and named, the names are sorted recursively until all differ, the other
   suffixes follow from them, and both are merged. Windows
   that repeat are neighbours then, and adjacent prefixes of ``length`` symbols are
   compared symbol by symbol.
   Anchors with over ``CROWD`` different tiles are not put in one task. Their tiles
   are cut into parts of at most ``PART`` window starts, at fixed distances from the anchor.
   The windows of a part share a core of ``length - PART + 1`` symbols: parts with a
   core of their own have nothing to match, equal parts repeat, and only of
   different parts with one core the windows are compared, by 128 bits of hashes.
4. Repeated window starts go back to the tile's texts and their documents.

Copies of a text are one text from step 2 on; rows of one text differ by a salt of
their other columns, so that only some fetch and none crowd one task.

Defined results: a null text counts as empty. Texts shorter than a measure's length
never lose any by it. Repeated rows repeat each other's strings like any copies. Null
ids are rows like others. An empty table gives an empty result. Very long texts
are whole; memory follows the longest. Other columns, whatever their names, pass
through ``remove`` and ``remove_passages`` and are ignored by ``report``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_values, discard, numbered, packed, pieces, renamed, salt, unpacked, written

LENGTH = 400
GRAM = 100
WORDS = 51
WORDS_GRAM = 12
CROWD = 64
PART = 16
RUN_BYTES = 1 << 20
_PLACE_BITS = 31
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Measure:
    """What repeats: runs of ``length`` bytes or words, dealt by the least string of ``gram`` of them."""

    unit: str = "bytes"
    length: int = LENGTH
    gram: int = GRAM

    @property
    def least_bytes(self) -> int:
        """No text of fewer bytes holds a run."""
        return self.length if self.unit == "bytes" else 2 * self.length - 1

    def symbols(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, np.uint8) if self.unit == "bytes" else word_hashes(raw)

    def loads(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, np.uint8 if self.unit == "bytes" else np.uint32)

    @property
    def part(self) -> int:
        """Window starts in a part of a crowded tile."""
        return min(PART, max(1, self.length // 2))

    @property
    def lead(self) -> int:
        """Keeps the anchors of measures apart."""
        return xxhash.xxh3_64_intdigest(f"{self.unit} {self.length} {self.gram}".encode())


BYTES = Measure()
PASSAGES = Measure("words", WORDS, WORDS_GRAM)

_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\r\x0b\x0c")] = True
#: Characters of scripts that are written without blanks are words one by one: first and last code points.
_ALONE_RANGES = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF))
_ALONE = np.zeros(1 << 16, bool)  # by the first two of a character's three bytes
for _low, _high in _ALONE_RANGES:
    for _c in range(_low, _high + 1, 64):
        _raw = chr(_c).encode()
        _ALONE[_raw[0] << 8 | _raw[1]] = True
_OCTET = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x5851F42D4C957F2D
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after its last."""
    octets = np.frombuffer(raw, np.uint8)
    solid = ~_BLANK[octets]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    if len(octets) > 2 and octets.max() >= 0xE0:
        at = np.flatnonzero(_ALONE[octets[:-2].astype(np.int32) << 8 | octets[1:-1]])
        if len(at):
            first[at] = last[at + 2] = True
            before, after = at[at > 0] - 1, at[at + 3 < len(octets)] + 3
            last[before] = solid[before]
            first[after] = solid[after]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _powers(n: int) -> list[np.ndarray]:
    """Powers of ``_BASE`` and of its inverse, as many as asked."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 15), base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS


def word_hashes(raw: bytes) -> np.ndarray:
    """A 32-bit hash of each word, from differences of one sum over the text."""
    starts, ends = word_bounds(raw)
    if not len(starts):
        return np.empty(0, np.uint32)
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_OCTET[np.frombuffer(raw, np.uint8)] * up[: len(raw)], out=total[1:])
    x = (total[ends] - total[starts]) * down[starts]
    x = (x ^ (x >> np.uint64(32))) * _B
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(32)).astype(np.uint32)


def _spans_hash(symbols: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` symbols from each place, by doubling."""
    n = len(symbols) - width + 1
    step, table = 1, (symbols.astype(np.uint64) + np.uint64(1)) * _A
    done, out = 0, None
    while True:
        if width & step:
            part = table[done : done + n]
            out = part.copy() if out is None else ((out ^ (out >> np.uint64(31))) * _B + part)
            done += step
        if done == width:
            return (out ^ (out >> np.uint64(29))) * _A
        table = (table[:-step] ^ (table[:-step] >> np.uint64(32))) * _B + table[step:]
        step *= 2


def _gram_hashes(symbols: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` symbols from each place, from differences of one sum. It chooses anchors only; ``_spans_hash`` stands for windows."""
    n = len(symbols)
    up, down = _powers(n + 1)
    values = _OCTET[symbols] if symbols.dtype == np.uint8 else (symbols.astype(np.uint64) + np.uint64(1)) * _A
    values *= up[:n]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    x = total[width:] - total[: n - width + 1]
    x *= down[: n - width + 1]
    x ^= x >> np.uint64(32)
    x *= _B
    x ^= x >> np.uint64(29)
    x *= _A
    return x


def _least_place(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least value among the ``width`` from each place, leftmost if equal.

    Values are compared in their upper 33 bits, so that a place fits below them.
    """
    low = np.uint64((1 << _PLACE_BITS) - 1)
    block = -(-len(values) // width) * width
    marked = np.full(block, np.iinfo(np.uint64).max, np.uint64)
    marked[: len(values)] = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    grid = marked.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & low).astype(np.int64)


def tiles(symbols: np.ndarray, measure: Measure = BYTES) -> list[tuple[int, int, int, int]]:
    """(anchor hash, content hash, first window start, number of starts) of each tile of a text."""
    if len(symbols) < measure.length:
        return []
    hashes = _gram_hashes(symbols, measure.gram)
    places = _least_place(hashes, measure.length - measure.gram + 1)
    cuts = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
    sizes = np.diff(np.append(cuts, len(places)))
    names = (hashes[places[cuts]] ^ np.uint64(measure.lead)).view(np.int64).tolist()
    digest, more = xxhash.xxh3_64_intdigest, measure.length - 1
    return [(name, digest(symbols[at : at + n + more]) - (1 << 63), at, n) for name, at, n in zip(names, cuts.tolist(), sizes.tolist())]


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Order of the keys, the rank of each among distinct ones from 1, and how many are distinct."""
    order = np.argsort(keys)  # the order of equal keys is of no use
    ordered = keys[order]
    fresh = np.concatenate([[1], (ordered[1:] != ordered[:-1]).astype(np.int64)])
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(fresh)
    return order, rank, int(fresh.sum())


def difference_cover_order(symbols: np.ndarray) -> np.ndarray:
    """Places of a sequence of positive numbers (below 2**21, at most 2 million of them) ordered by their suffixes."""
    n = len(symbols)
    if n == 0:
        return np.empty(0, np.int64)
    s = np.concatenate([symbols.astype(np.int64), np.zeros(3, np.int64)])
    place = np.arange(n + 1)  # the empty suffix at n keeps the halves apart
    sampled = place[place % 3 != 0]
    sampled = np.concatenate([sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]])
    triple = (s[sampled] << 42) | (s[np.minimum(sampled + 1, n)] << 21) | s[np.minimum(sampled + 2, n)]
    order, names, distinct = _ranked(triple)
    if distinct < len(sampled):
        # names of places 1 mod 3, then of places 2 mod 3: three symbols each
        order = difference_cover_order(names)
    rank = np.zeros(n + 4, np.int64)
    rank[sampled[order]] = np.arange(1, len(sampled) + 1)
    rank[n + 1 :] = 0
    first = sampled[order]
    first = first[first < n]
    # suffixes at places divisible by 3: their first symbol, then the rank of the next place
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort((s[rest] << 32) | rank[rest + 1])]
    # merge by comparing with each kind of sampled suffix
    kind = first % 3 == 1
    one, two = first[kind], first[~kind]
    # against 1 mod 3: (symbol, rank of next); against 2 mod 3: (two symbols, rank of the place after)
    below_one = np.searchsorted((s[one] << 32) | rank[one + 1], (s[rest] << 32) | rank[rest + 1])
    base = int(s.max()) + 1
    wide = lambda at: (s[at] * base + s[at + 1]) * (n + 4) + rank[at + 2]
    below_two = np.searchsorted(wide(two), wide(rest))
    at = np.arange(len(rest)) + below_one + below_two
    out = np.empty(n, np.int64)
    free = np.ones(n, bool)
    free[at] = False
    out[at] = rest
    out[free] = first
    return out


def repeated_starts(texts: list[np.ndarray], length: int = LENGTH) -> list[np.ndarray]:
    """For each sequence of symbols, which of its windows of ``length`` start again elsewhere in any of them."""
    buffer = np.concatenate(texts)
    ranks = buffer.astype(np.int64) if buffer.dtype == np.uint8 else np.unique(buffer, return_inverse=True)[1].astype(np.int64)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    order = difference_cover_order(ranks + 1)
    room = np.repeat(ends, sizes) - np.arange(len(buffer))
    order = order[room[order] >= length]
    again = np.zeros(len(buffer), bool)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        near = np.flatnonzero((buffer[a] == buffer[b]) & (buffer[a + length - 1] == buffer[b + length - 1]) & (buffer[a + length // 2] == buffer[b + length // 2]))
        windows = np.lib.stride_tricks.sliding_window_view(buffer, length)
        for at in range(0, len(near), 20_000):
            some = near[at : at + 20_000]
            same = some[(windows[a[some]] == windows[b[some]]).all(axis=1)]
            again[a[same]] = True
            again[b[same]] = True
    return np.split(again, ends[:-1])


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(start, number) of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - edges[::2]).tolist()))


def _rows(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*columns), schema)], schema=schema)


def _ddl(schema: pa.Schema) -> str:
    kinds = {"int64": "bigint", "int32": "int", "binary": "binary", "bool": "boolean", "list<item: int32>": "array<int>"}
    return ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in schema)


def _keyed(raw: bytes) -> tuple[int, int]:
    return xxhash.xxh3_64_intdigest(raw) - (1 << 63), xxhash.xxh64_intdigest(raw, 7) - (1 << 63)


_KEY = [("k1", pa.int64()), ("k2", pa.int64())]
_TILE = pa.schema([*_KEY, ("salt", pa.int32()), ("kind", pa.int32()), ("anchor", pa.int64()), ("content", pa.int64()), ("at", pa.list_(pa.int32())), ("n", pa.int32())])


def _find_tiles(measures: tuple[Measure, ...]):
    """(text, salt) to the tiles of each measure; ``kind`` is its place among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 2 << 20):
                rows = []
                for raw, own in zip(byte_values(batch.column(0)), batch.column(1).to_pylist()):
                    key = _keyed(raw)
                    for kind, measure in enumerate(measures):
                        same: dict[tuple[int, int, int], list[int]] = {}  # a text's equal tiles make one row
                        for anchor, content, at, n in tiles(measure.symbols(raw), measure):
                            same.setdefault((anchor, content, n), []).append(at)
                        rows += [(*key, own, kind, anchor, content, ats, n) for (anchor, content, n), ats in same.items()]
                if rows:
                    yield _rows(rows, _TILE)

    return run


_PACKED = pa.schema([*_KEY, ("salt", pa.int32()), ("packed", pa.binary())])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, salt) to the text's key, the salt and the packed text."""
    for whole in batches:
        for batch in pieces(whole, 4 << 20):
            texts = byte_values(batch.column(0))
            keys = [pa.array(k, pa.int64()) for k in zip(*map(_keyed, texts))]
            yield pa.record_batch([*keys, batch.column(1), packed(texts)], schema=_PACKED)


_CUT = pa.schema([("kind", pa.int32()), ("anchor", pa.int64()), ("content", pa.int64()), ("crowded", pa.bool_()), ("tile", pa.binary())])


def _cut_out(measures: tuple[Measure, ...]):
    """Packed texts and wanted tiles to one row a tile with its symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1 << 20, "packed"):
                rows = []
                for raw, wanted in zip(unpacked(batch.column(0)), batch.column(1).to_pylist()):
                    symbols: dict[int, np.ndarray] = {}
                    for w in wanted:
                        measure = measures[w["kind"]]
                        if w["kind"] not in symbols:
                            symbols[w["kind"]] = measure.symbols(raw)
                        tile = symbols[w["kind"]][w["at"] : w["at"] + w["n"] + measure.length - 1]
                        rows.append((w["kind"], w["anchor"], w["content"], w["crowded"], tile.tobytes()))
                if rows:
                    yield _rows(rows, _CUT)

    return run


_FOUND = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("start", pa.int32()), ("number", pa.int32())])


def _sort_runs(measures: tuple[Measure, ...], run_bytes: int):
    """Tiles ordered by kind and anchor to (anchor, content, start, number): runs of repeated windows of the tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size, kind = 0, 0

        def emit() -> Iterator[pa.RecordBatch]:
            measure, rows = measures[kind], []
            for (anchor, content, _), flags in zip(held, repeated_starts([measure.loads(t) for _, _, t in held], measure.length)):
                rows += [(anchor, content, *r) for r in _runs(flags)]
            if rows:
                yield _rows(rows, _FOUND)

        for batch in batches:
            for own, anchor, content, tile in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if held and (own != kind or size >= run_bytes and held[-1][0] != anchor):
                    yield from emit()
                    held, size = [], 0
                kind = own
                held.append((anchor, content, tile))
                size += len(tile)
        if held:
            yield from emit()

    return run


def _wide(symbols: np.ndarray, seed: int) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(symbols, seed)
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


_PART_ROW = pa.schema([*((n, pa.int64()) for n in ("h1", "h2", "part")), ("kind", pa.int32()), ("anchor", pa.int64()), ("content", pa.int64()), ("start", pa.int32()), ("number", pa.int32()), ("raw", pa.binary())])


def _cut_parts(measures: tuple[Measure, ...]):
    """Crowded tiles to one row a part: the hashes of its core and of all of it, its tile, first start, number of starts and symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for kind, anchor, content, raw in zip(*(batch.column(k).to_pylist() for k in range(4))):
                measure = measures[kind]
                tile, length = measure.loads(raw), measure.length
                n, step = len(tile) - length + 1, measure.part
                place = int(_least_place(_gram_hashes(tile, measure.gram), length - measure.gram + 1)[0])
                # distance of a start to the anchor, cut at multiples of the parts' size
                for q in range(max(0, place - n + 1) // step, place // step + 1):
                    last = min(n - 1, place - q * step)
                    first = max(0, place - q * step - step + 1)
                    if last < first:
                        continue
                    core = tile[place - q * step : place - q * step - step + 1 + length]
                    own = tile[first : last + length]
                    rows.append((*_wide(core, q * len(measures) + kind), _wide(own, q * len(measures) + kind)[0], kind, anchor, content, first, last - first + 1, own.tobytes()))
            if rows:
                yield _rows(rows, _PART_ROW)

    return run


_WINDOW = pa.schema([*((n, pa.int64()) for n in ("w1", "w2", "h1", "h2", "part")), ("within", pa.int32())])


def _spread(measures: tuple[Measure, ...]):
    """Parts (h1, h2, part, kind, raw) to one row a window: its two hashes, its part, and where it starts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in _WINDOW]
            for h1, h2, part, kind, raw in zip(*(batch.column(k).to_pylist() for k in range(5))):
                measure = measures[kind]
                symbols = measure.loads(raw)
                one = _spans_hash(symbols, measure.length).view(np.int64) ^ np.int64(kind)
                two = _spans_hash(symbols[::-1] ^ symbols.dtype.type(0x5A), measure.length)[::-1].view(np.int64)
                n = len(one)
                for held, made in zip(columns, (one, two, np.full(n, h1), np.full(n, h2), np.full(n, part), np.arange(n, dtype=np.int32))):
                    held.append(made)
            if columns[0]:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in columns], schema=_WINDOW)

    return run


def _crowded_runs(crowded: DataFrame, measures: tuple[Measure, ...]) -> DataFrame:
    """(anchor, content, runs) of the repeated windows of crowded tiles (kind, anchor, content, tile): a row a part, with its runs as (start, number)."""
    parts = written(crowded.mapInArrow(_cut_parts(measures), _ddl(_PART_ROW)))
    key = ["h1", "h2", "part"]
    kinds = written(parts.groupBy(*key, "kind", "number", "raw").agg(F.count(F.lit(1)).alias("times")))
    cores = kinds.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("h1", "h2")
    windows = written(kinds.join(cores, ["h1", "h2"]).select(*key, "kind", "raw").mapInArrow(_spread(measures), _ddl(_WINDOW)))
    twice = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("w1", "w2")
    # a part's repeated windows are bits of one number, and its row stays one row
    bit = lambda k: F.call_function("shiftleft", F.lit(1), k)
    some = windows.join(twice, ["w1", "w2"]).select(*key, bit(F.col("within")).alias("mask"))
    whole = kinds.filter("times > 1").select(*key, (bit(F.col("number")) - 1).alias("mask"))
    masks = written(some.unionAll(whole).groupBy(*key).agg(F.bit_or("mask").alias("mask")))
    discard(kinds, windows)
    hit = parts.select(*key, "anchor", "content", "start").join(masks, key)
    down = lambda k: F.call_function("shiftright", F.col("mask"), k)
    first = F.filter(F.sequence(F.lit(0), F.lit(max(m.part for m in measures) - 1)), lambda k: (down(k).bitwiseAND(1) == 1) & ((k == 0) | (down(k - 1).bitwiseAND(1) == 0)))
    ones = lambda x: F.bit_count(x.bitwiseXOR(x + 1)) - 1  # noqa: E731  # from the lowest bit
    return hit.select("anchor", "content", F.transform(first, lambda k: F.struct((F.col("start") + k).alias("start"), ones(down(k)).cast("int").alias("number"))).alias("runs"))


def repeated_spans(docs: DataFrame, measures: tuple[Measure, ...], text_col: str = "text", crowd: int = CROWD, run_bytes: int = RUN_BYTES) -> DataFrame:
    """(k1, k2, spans0, spans1, ...): a text's key and, for each measure, the (start, number) of its repeated windows."""
    least = min(m.least_bytes for m in measures)
    texts = docs.select(F.col(f"`{text_col}`").alias("text"), salt(docs, text_col).alias("salt")).filter(F.octet_length("text") >= least)
    places = written(texts.mapInArrow(_find_tiles(measures), _ddl(_TILE)))
    shared = written(places.groupBy("anchor").agg(F.sum(F.size("at")).alias("all")).filter("all > 1").select("anchor"))
    # both sides of this and the following joins are read from files, so that a frequent key can be split
    named = ["k1", "k2", "kind", "anchor", "content", "at", "n"]
    once = written(places.join(shared, "anchor").groupBy(*named).agg(F.count(F.lit(1)).alias("copies"), F.min("salt").alias("salt")))
    discard(places, shared)

    one = F.min(F.struct("k1", "k2", "salt", F.get("at", F.lit(0)).alias("at"), "n"))
    found = written(once.groupBy("kind", "anchor", "content").agg(F.sum(F.size("at") * F.col("copies")).alias("times"), one.alias("one")))
    per_anchor = written(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"))
    wanted = found.join(per_anchor, "anchor").select("one.*", "kind", "anchor", "content", (F.col("kinds") > crowd).alias("crowded"))
    asked = written(wanted.groupBy("k1", "k2", "salt").agg(F.collect_list(F.struct("kind", "anchor", "content", "crowded", "at", "n")).alias("wanted")))
    fetched = texts.mapInArrow(_pack, _ddl(_PACKED)).join(asked, ["k1", "k2", "salt"]).select("packed", "wanted").mapInArrow(_cut_out(measures), _ddl(_CUT))
    cut = written(fetched.dropDuplicates(["anchor", "content"]))
    discard(per_anchor, asked)

    light = cut.filter("not crowded").select("kind", "anchor", "content", "tile").repartition("anchor").sortWithinPartitions("kind", "anchor", "content")
    sorted_ = light.mapInArrow(_sort_runs(measures, run_bytes), _ddl(_FOUND))
    crowded = _crowded_runs(cut.filter("crowded").select("kind", "anchor", "content", "tile"), measures)
    whole = found.filter("times > 1").select("anchor", "content", F.lit(0).alias("start"), F.col("one.n").alias("number"))
    runs = sorted_.unionAll(whole).select("anchor", "content", F.array(F.struct("start", "number")).alias("runs")).unionAll(crowded)
    per_tile = written(runs.groupBy("anchor", "content").agg(F.array_distinct(F.flatten(F.collect_list("runs"))).alias("runs")))
    discard(cut, found)
    moved = F.flatten(F.transform("at", lambda a: F.transform("runs", lambda r: F.struct((r["start"] + a).alias("start"), r["number"].alias("number")))))
    back = once.join(per_tile, ["anchor", "content"]).select("k1", "k2", "kind", moved.alias("runs"))
    each = [F.flatten(F.collect_list(F.when(F.col("kind") == k, F.col("runs")))).alias(f"spans{k}") for k in range(len(measures))]
    spans = written(back.groupBy("k1", "k2").agg(*each))
    discard(once, per_tile)
    return spans


def _lists(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Starts and numbers of each row's spans."""
    flat = column.flatten()
    start, number = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return [(start[a:b], number[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def covered(size: int, spans: tuple[np.ndarray, np.ndarray], length: int) -> np.ndarray:
    """Which of a text's symbols are covered by its repeated windows."""
    start, number = spans
    edge = np.bincount(start, minlength=size + 1) - np.bincount(start + number - 1 + length, minlength=size + 1)
    return np.cumsum(edge[:size]) > 0


def _with_spans(docs: DataFrame, spans: DataFrame, text_at: int, measures: tuple[Measure, ...]) -> DataFrame:
    """``docs`` (columns c0, c1, ...) with its text packed and its spans; texts too short for any are not exchanged."""
    least = min(m.least_bytes for m in measures)
    text = f"c{text_at}"
    others = [c for c in docs.columns if c != text]
    kinds = {f.name: f for f in docs.schema.fields}
    schema = T.StructType([*(kinds[c] for c in others), T.StructField("packed", T.BinaryType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 4 << 20, text):
                column = batch.column(batch.num_columns - 1)
                null = column.is_null().to_pylist()
                texts = byte_values(column)
                keys = map(_keyed, texts)
                raw = packed(None if n else t for n, t in zip(null, texts))
                yield pa.record_batch([*batch.columns[:-1], raw, *(pa.array(k, pa.int64()) for k in zip(*keys))], names=[f.name for f in schema])

    longer = F.coalesce(F.octet_length(text) >= least, F.lit(False))
    rows = docs.filter(longer).select(*others, text).mapInArrow(run, schema)
    wide = [f.name for f in spans.schema.fields if f.name not in ("k1", "k2")]
    found = rows.join(spans, ["k1", "k2"], "left").select(*others, "packed", *wide)
    none = [F.lit(None).cast(spans.schema[w].dataType).alias(w) for w in wide]
    # short texts go to the next Python step as they are
    return found.unionAll(docs.filter(~longer).select(*others, F.col(text).cast("binary").alias("packed"), *none))


_REPORT = pa.schema(
    [("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_bytes", "n_removed", "n_spans")), ("kept_sha256", pa.string()), *((n, pa.int64()) for n in ("n_repeated_words", "n_passages"))]
)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", measure: Measure = BYTES, passages: Measure = PASSAGES, **options) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans and kept_sha256 by ``measure``; n_repeated_words and n_passages by ``passages``.

    The last two count the words in runs of words that start elsewhere too, and
    their maximal runs; a run of over 50 words is often shorter than 400 bytes.
    """
    measures = (measure, passages)
    narrow = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("c0"), F.col(f"`{text_col}`").alias("c1"))
    rows = _with_spans(narrow, repeated_spans(narrow, measures, "c1", **options), 1, measures)

    def row(raw: bytes, own: tuple, words: tuple) -> tuple:
        n = s = w = p = 0
        kept = raw
        if len(own[0]):
            gone = covered(len(raw), own, measure.length)
            n, s = int(gone.sum()), len(_runs(gone))
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        if len(words[0]):
            gone = covered(int((words[0] + words[1]).max()) - 1 + passages.length, words, passages.length)
            w, p = int(gone.sum()), len(_runs(gone))
        return len(raw), n, s, hashlib.sha256(kept).hexdigest(), w, p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 2 << 20, "packed"):
                texts = [t or b"" for t in unpacked(batch.column(1))]
                made = [row(*x) for x in zip(texts, _lists(batch.column(2)), _lists(batch.column(3)))]
                yield pa.record_batch([batch.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*made), list(_REPORT)[1:]))], schema=_REPORT)

    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_repeated_words bigint, n_passages bigint")


def _without_bytes(raw: bytes, spans: tuple, measure: Measure) -> bytes:
    return np.frombuffer(raw, np.uint8)[~covered(len(raw), spans, measure.length)].tobytes()


def _without_words(raw: bytes, spans: tuple, measure: Measure) -> bytes:
    """The text without the words that repeat and the blanks within each run; empty if only blanks are left."""
    starts, ends = word_bounds(raw)
    out, at = [], 0
    for first, number in _runs(covered(len(starts), spans, measure.length)):
        out.append(raw[at : starts[first]])
        at = int(ends[first + number - 1])
    left = b"".join([*out, raw[at:]])
    return left if left.strip(b" \t\n\r\x0b\x0c") else b""


def _taken_out(docs: DataFrame, measure: Measure, text_col: str, **options) -> DataFrame:
    names = docs.columns
    at = names.index(text_col)
    held = numbered(docs)
    rows = _with_spans(held, repeated_spans(held, (measure,), f"c{at}", **options), at, (measure,))
    without = _without_bytes if measure.unit == "bytes" else _without_words
    others = [c for c in held.columns if c != f"c{at}"]
    schema = T.StructType([*(held.schema[c] for c in others), T.StructField(f"c{at}", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 2 << 20, "packed"):
                texts = unpacked(batch.column(len(others)))
                cut = [without(t, s, measure) if t and len(s[0]) else t for t, s in zip(texts, _lists(batch.column(len(others) + 1)))]
                made = pa.array([None if t is None else t.decode("utf-8", "ignore") for t in cut], pa.string())
                yield pa.record_batch([*batch.columns[: len(others)], made], names=[f.name for f in schema])

    return rows.mapInArrow(run, schema).select(*renamed(held, names))


def remove(docs: DataFrame, length: int = LENGTH, gram: int | None = None, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with its repeated strings of ``length`` bytes taken out of its text; what is left of a character cut in two goes too.

    Rows whose whole text repeats are kept with an empty text.
    """
    return _taken_out(docs, Measure("bytes", length, gram or length // 4), text_col, **options)


def remove_passages(docs: DataFrame, words: int = WORDS, gram: int | None = None, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every run of ``words`` words that starts elsewhere too taken out of its text.

    Blanks between words are not compared. Rows of which nothing but blanks is left
    have an empty text.
    """
    return _taken_out(docs, Measure("words", words, gram or max(1, words // 4)), text_col, **options)
