"""Phrases of two to four words that hold together, mined by pivot partitioning.

Texts are cut into pieces at punctuation and line ends and those into words.
Words are ordered by how often their language has them, and a phrase belongs to
its rarest word, its pivot (of several places of that word, to the first). Around each
place of a frequent word the piece is rewritten to what phrases of that pivot can
hold: up to three words before it that are all more frequent, up to three after it that
are not rarer. Such fragments go to the pivot's part, where phrases are counted
locally and only those that the pivot owns and that reach ``LEAST`` leave it. A
context whose pair with the pivot is not frequent is cut off before.

Order of words: the ``HEAD`` most frequent of all languages by their count, all of
which are kept in every worker; any others come after them, by a 62-bit hash of language
and word. If all words that reach ``LEAST`` are among the first, the rest can be in no
frequent phrase and end a piece like punctuation.

A pivot with over ``SPLIT`` places is too much for one part: its fragments are cut into
the phrases that it owns where they are found, and these are dealt by their
hash. Equal fragments of a batch of texts go together with their number, so copies and
passages that many texts share don't crowd a part.

Phrases then meet their parts' counts in equi-joins. A cut after k words gives the score
floor(``SCALE`` * a / (l + r)); the least counts. Sums and products are decimals of 38 digits.

Defined results: a null text is empty; a null language is ``und``, like that word. Texts
of any length are whole. Repeated rows count as often as they come. A text without
phrases adds its words to n alone. An empty table gives an empty result. Ties are ranked
by the phrase's bytes, and of cuts that tie the first counts. Other columns are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_values, discard, pieces, shuffle_width, written

LEAST = 30
LONGEST = 4
SCALE = 2_000_000
HELD = 80  # a phrase goes if a longer one has as many per cent of its places
TOP = 2000
HEAD = 1 << 18
SPLIT = 1 << 17
NO_LANGUAGE = "und"

_SIDE = LONGEST - 1
_FLUSH = 1 << 18
_BATCH = 4 << 20
_OTHER = 1 << 62
_BREAK = b"\xff"  # in no UTF-8 text
_TABLE = bytes(0xFF if chr(b) in ".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FRAGMENTS = "pivot bigint, part int, fragment binary, n bigint"


def words_of(raw: bytes) -> list[bytes]:
    """Words in lower case, and a mark at every end of a piece."""
    return raw.translate(_TABLE).replace(_BREAK, b" \xff ").split()


def _languages(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit(NO_LANGUAGE)).alias("lang"), F.col(f"`{text_col}`").alias("text"))


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Words of some texts of one language, with marks at the ends."""
    for whole in batches:
        for batch in pieces(whole, _BATCH):
            found: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), byte_values(batch.column(1))):
                found.setdefault(lang, []).append(text)
            for lang, texts in found.items():
                yield lang, words_of(b"\n".join(texts))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, f); a row with a null word counts all words of its language."""
    seen: dict[str, Counter] = {}
    fields = ["lang", "word", "f"]

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, counts in seen.items():
            counts.pop(_BREAK, None)
            words = [None, *counts]
            yield pa.record_batch([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()), pa.array([counts.total(), *counts.values()], pa.int64())], names=fields)
        seen.clear()

    for lang, words in _by_language(batches):
        seen.setdefault(lang, Counter()).update(words)
        if sum(map(len, seen.values())) > _FLUSH:
            yield from rows()
    yield from rows()


class Order:
    """Numbers of words by rarity. A larger number is a rarer word."""

    def __init__(self, head: list[tuple[str, bytes, int]], complete: bool):
        self.head: dict[str, dict[bytes, int]] = {}
        self.f = np.array([f for _, _, f in head], np.int64)
        self.complete = complete
        for number, (lang, word, _) in enumerate(head):
            self.head.setdefault(lang, {})[word] = number

    def other(self, lang: str, word: bytes) -> int:
        return _OTHER | xxhash.xxh3_64_intdigest(lang.encode() + b"\0" + word) >> 2

    def number(self, lang: str, word: bytes) -> int:
        known = self.head.get(lang, {}).get(word)
        return self.other(lang, word) if known is None else known

    def numbers(self, lang: str, words: list[bytes]) -> np.ndarray:
        """-1 for words that no frequent phrase holds, and for ends of pieces; three of them at both ends."""
        out = np.full(len(words) + 2 * _SIDE, -1, np.int64)
        known = self.head.get(lang, {})
        found = out[_SIDE : len(words) + _SIDE]
        found[:] = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        if not self.complete:
            for at in np.flatnonzero(found < 0).tolist():
                if words[at] != _BREAK:
                    found[at] = self.other(lang, words[at])
        return out


def _order(counts: DataFrame, head: int) -> Order:
    """From (lang, word, f) of frequent words: all, or those of the highest counts that fit."""
    level = F.when(F.col("f") < 1024, F.col("f")).otherwise(F.floor(F.log2("f") * 64) - 640 + 1024)  # a few thousand at most
    levels = sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    least, taken, complete = None, 0, True
    for at, n in levels:
        if taken + n > head:
            complete = False
            break
        least, taken = at, taken + n
    rows = [] if least is None else counts.filter(level >= least).select("lang", "word", "f").collect()
    return Order(sorted(((r[0], bytes(r[1]), r[2]) for r in rows), key=lambda r: (-r[2], r[0], r[1])), complete)


def _hashes(rows: np.ndarray) -> np.ndarray:
    made = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        made = (made ^ (made >> np.uint64(29)) ^ rows[:, k].astype(np.uint64)) * _MIX
    return made ^ (made >> np.uint64(32))


def summed(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows with the sum of their numbers, and their hashes."""
    h = _hashes(rows)
    if not len(rows):
        return rows, n, h
    order = np.argsort(h, kind="stable")
    other = (rows[order[1:]] != rows[order[:-1]]).any(1)
    if (other & (h[order[1:]] == h[order[:-1]])).any():  # different rows with one hash may alternate
        order = np.lexsort(rows.T[::-1])
        other = (rows[order[1:]] != rows[order[:-1]]).any(1)
    starts = np.flatnonzero(np.concatenate([[True], other]))
    return rows[order[starts]], np.add.reduceat(n[order], starts), h[order[starts]]


def fragments(numbers: np.ndarray) -> np.ndarray:
    """One row for each place that owns a phrase: three numbers before the pivot, the pivot, three after it; -1 where none counts."""
    pivot = numbers[_SIDE : len(numbers) - _SIDE]
    out = np.full((len(pivot), 2 * _SIDE + 1), -1, np.int64)
    out[:, _SIDE] = pivot
    for step, most in ((-1, pivot - 1), (1, pivot)):
        going = pivot >= 0
        for k in range(1, _SIDE + 1):
            at = numbers[_SIDE + step * k : len(numbers) - _SIDE + step * k]
            going = going & (at >= 0) & (at <= most)
            out[going, _SIDE + step * k] = at[going]
    return out[(out[:, _SIDE - 1] >= 0) | (out[:, _SIDE + 1] >= 0)]


def owned(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each phrase of 2 to 4 words that contains the pivot, in rows of the same kind."""
    found, numbers = [], []
    for before in range(_SIDE + 1):
        for after in range(max(0, 1 - before), _SIDE + 1 - before):
            fits = np.ones(len(rows), bool)
            if before:
                fits &= rows[:, _SIDE - before] >= 0
            if after:
                fits &= rows[:, _SIDE + after] >= 0
            some = np.full((int(fits.sum()), rows.shape[1]), -1, np.int64)
            some[:, _SIDE - before : _SIDE + after + 1] = rows[fits, _SIDE - before : _SIDE + after + 1]
            found.append(some)
            numbers.append(n[fits])
    return np.concatenate(found), np.concatenate(numbers)


def _packed(rows: np.ndarray, n: np.ndarray, part: np.ndarray, single: bool) -> Iterator[pa.RecordBatch]:
    """Rows by their shape: a head byte, then the numbers beside the pivot in four bytes, or in eight where they need them."""
    sides = rows >= 0
    shape = sides[:, :_SIDE].sum(1) + (sides[:, _SIDE + 1 :].sum(1) << 2) + (16 if single else 0)
    shape += np.where((rows[:, :_SIDE] >= 1 << 31).any(1) | (rows[:, _SIDE + 1 :] >= 1 << 31).any(1), 32, 0)
    for head in np.unique(shape).tolist():
        some = np.flatnonzero(shape == head)
        before, after = head & 3, head >> 2 & 3
        cells = np.concatenate([rows[some, _SIDE - before : _SIDE], rows[some, _SIDE + 1 : _SIDE + 1 + after]], axis=1)
        raw = np.ascontiguousarray(cells.astype("<i8" if head & 32 else "<i4")).view(np.uint8).reshape(len(some), -1)
        raw = np.ascontiguousarray(np.concatenate([np.full((len(some), 1), head, np.uint8), raw], axis=1))
        offsets = np.arange(len(some) + 1, dtype=np.int32) * raw.shape[1]
        packed = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        yield pa.record_batch([pa.array(rows[some, _SIDE]), pa.array(part[some], pa.int32()), packed, pa.array(n[some])], names=["pivot", "part", "fragment", "n"])


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, whether each is a single phrase, their numbers and parts."""
    pivot, part, n = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1, 3))
    column = batch.column(2).cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    heads = data[offsets[:-1]]
    rows = np.full((len(pivot), 2 * _SIDE + 1), -1, np.int64)
    rows[:, _SIDE] = pivot
    for head in np.unique(heads).tolist():
        some = np.flatnonzero(heads == head)
        before, after, width = head & 3, head >> 2 & 3, 8 if head & 32 else 4
        raw = data[offsets[some][:, None] + 1 + np.arange((before + after) * width)]
        cells = np.ascontiguousarray(raw).view("<i8" if width == 8 else "<i4")
        rows[np.ix_(some, range(_SIDE - before, _SIDE))] = cells[:, :before]
        rows[np.ix_(some, range(_SIDE + 1, _SIDE + 1 + after))] = cells[:, before:]
    return rows, (heads & 16) > 0, n, part


def _cut(order, split: int):
    """Texts to fragments, dealt by pivot; pivots with many places by phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Order = order.value
        parts = np.maximum(1, -(-known.f // split))
        for lang, words in _by_language(batches):
            rows = fragments(known.numbers(lang, words))
            rows, n, _ = summed(rows, np.ones(len(rows), np.int64))
            head = rows[:, _SIDE] < len(parts)
            of = np.ones(len(rows), np.int64)
            of[head] = parts[rows[head, _SIDE]]
            yield from _packed(rows[of == 1], n[of == 1], np.zeros(int((of == 1).sum()), np.int64), False)
            single, n, h = summed(*owned(rows[of > 1], n[of > 1]))
            if len(single):
                yield from _packed(single, n, (h % parts[single[:, _SIDE]].astype(np.uint64)).astype(np.int64), True)

    return run


def _pruned(rows: np.ndarray, group: np.ndarray, n: np.ndarray, least: int) -> np.ndarray:
    """Rows without the sides whose pair with the pivot is not frequent."""
    rows = rows.copy()
    for step in (-1, 1):
        has = np.flatnonzero(rows[:, _SIDE + step] >= 0)
        if not len(has):
            continue
        order = has[np.lexsort((rows[has, _SIDE + step], group[has]))]
        fresh = np.concatenate([[True], (rows[order[1:], _SIDE + step] != rows[order[:-1], _SIDE + step]) | (group[order[1:]] != group[order[:-1]])])
        total = np.add.reduceat(n[order], np.flatnonzero(fresh))
        rare = order[(total < least)[np.cumsum(fresh) - 1]]
        if step < 0:
            rows[rare, :_SIDE] = -1
        else:
            rows[rare, _SIDE + 1 :] = -1
    return rows


def _mine(least: int):
    """Fragments, sorted by pivot and part, to the frequent phrases that the pivot owns."""
    fields = [f"w{k}" for k in range(LONGEST)] + ["a"]

    def closed(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows, single, n, part = (np.concatenate(x) for x in zip(*held))
        if not len(rows):
            return
        fresh = np.concatenate([[False], (rows[1:, _SIDE] != rows[:-1, _SIDE]) | (part[1:] != part[:-1])])
        group = np.cumsum(fresh)
        whole = ~single
        spread, numbers = owned(_pruned(rows[whole], group[whole], n[whole], least), n[whole])
        phrases, a, _ = summed(np.concatenate([spread, rows[single]]), np.concatenate([numbers, n[single]]))
        phrases, a = phrases[a >= least], a[a >= least]
        first = np.argmax(phrases >= 0, axis=1) if len(phrases) else np.empty(0, np.int64)
        columns = []
        wide = np.concatenate([phrases, np.full((len(phrases), LONGEST), -1, np.int64)], axis=1)
        for k in range(LONGEST):
            cells = wide[np.arange(len(phrases)), first + k]
            columns.append(pa.array(cells, pa.int64(), mask=cells < 0))
        if len(phrases):
            yield pa.record_batch([*columns, pa.array(a, pa.int64())], names=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, single, n, part = _unpacked(batch)
            last = (rows[:, _SIDE] == rows[-1, _SIDE]) & (part == part[-1])
            cut = len(rows) - int(np.argmin(last[::-1])) if not last.all() else 0  # where the last group begins
            if cut or (held and (held[-1][0][-1, _SIDE], held[-1][3][-1]) != (rows[0, _SIDE], part[0])):
                yield from closed([*held, (rows[:cut], single[:cut], n[:cut], part[:cut])])
                held = []
            held.append((rows[cut:], single[cut:], n[cut:], part[cut:]))
        if held:
            yield from closed(held)

    return run


def frequent(docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", head: int = HEAD, split: int = SPLIT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, lang, word, f) of frequent words, (words, a) of frequent phrases by those keys, and (lang, n)."""
    spark = docs.sparkSession
    texts = _languages(docs, text_col, lang_col)
    counts = texts.mapInArrow(_count_words, "lang string, word binary, f bigint").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    counts = written(counts.filter((F.col("f") >= least) | F.col("word").isNull()))
    common = counts.filter("word is not null")
    order = spark.sparkContext.broadcast(_order(common, head))  # at most ``head`` words

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [order.value.number(lang, word) for lang, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.record_batch([pa.array(keys, pa.int64()), *batch.columns], names=["key", "lang", "word", "f"])

    words = written(common.mapInArrow(keyed, "key bigint, lang string, word binary, f bigint").withColumn("word", F.col("word").cast("string")))
    dealt = texts.mapInArrow(_cut(order, split), _FRAGMENTS).repartition(shuffle_width(spark), "pivot", "part").sortWithinPartitions("pivot", "part")
    found = dealt.mapInArrow(_mine(least), ", ".join(f"w{k} bigint" for k in range(LONGEST)) + ", a bigint")
    phrases = written(found.select(F.array_compact(F.array(*[f"w{k}" for k in range(LONGEST)])).alias("words"), "a"))
    return words, phrases, counts.filter("word is null").select("lang", F.col("f").alias("n"))


def _whole(value: Column | int) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("decimal(38,0)")


def scored(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """(words, a, l, r, score): each phrase by its worst cut."""
    known = phrases.select(F.col("words").alias("part"), F.col("a").alias("f")).unionAll(words.select(F.array("key").alias("part"), "f"))
    cuts = phrases.select("words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.expr("slice(words, 1, k)"), "rest": F.expr("slice(words, k + 1, size(words) - k)")})
    cuts = cuts.join(known.select(F.col("part").alias("first"), F.col("f").alias("l")), "first").join(known.select(F.col("part").alias("rest"), F.col("f").alias("r")), "rest")
    # both at most 38 digits, and the quotient at most half of SCALE
    cuts = cuts.withColumn("score", F.expr(f"(cast({SCALE} as decimal(18,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    worst = F.min(F.struct("score", "k", "l", "r")).alias("worst")
    return cuts.groupBy("words", "a").agg(worst).select("words", "a", "worst.l", "worst.r", "worst.score")


def held_by_longer(phrases: DataFrame, per_cent: int = HELD) -> DataFrame:
    """(words) of phrases inside a longer one that has ``per_cent`` of their places or more."""
    spans = F.expr(
        f"flatten(transform(sequence(2, size(words) - 1), w -> transform(sequence(1, size(words) - w + 1), s -> slice(words, s, w))))"
    )
    inside = phrases.filter(F.size("words") > 2).select(F.explode(spans).alias("words"), F.col("a").alias("longer"))
    most = inside.groupBy("words").agg(F.max("longer").alias("longer"))
    both = phrases.join(most, "words")
    return both.filter(_whole(100) * F.col("longer").cast("decimal(20,0)") >= _whole(per_cent) * F.col("a").cast("decimal(20,0)")).select("words")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, **options) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    words, phrases, totals = frequent(docs, least, **options)
    kept = scored(words, phrases).join(held_by_longer(phrases), "words", "left_anti")
    named = kept.select("*", F.posexplode("words").alias("at", "key")).join(words.select("key", "lang", "word"), "key")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase")
    named = named.groupBy("words", "a", "l", "r", "score").agg(F.first("lang").alias("lang"), phrase)
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = named.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
