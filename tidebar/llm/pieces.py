"""Encoding to and decoding from a SentencePiece BPE vocabulary, with seeded merge-dropout.

A text is cut where no merge can cross (see ``Encoder.chunks``), and each chunk
is merged on an agenda: the candidate with the best score, leftmost first, joins
its two neighbours and may bring up new candidates. With dropout, each candidate
taken from the agenda is skipped when a hash keyed with the seed, the document, the
chunk's place in it and the candidate's place falls below the rate. The same seed always gives
the same pieces on any machine and in any order of rows; another seed gives
others. Without dropout the result is that of the vocabulary's own encoder.

Every occurrence of a chunk draws on its own. A task keeps the plain outcome of
chunks that it meets often, about ``CACHE`` of them, with the candidates that led to it: where
an occurrence skips none of these, its outcome is the plain one. Where it skips some, the outcome
without these takes the plain one's place, and is kept in the same way (about ``VARIANTS`` of them), until none of
the candidates that led to it is skipped. The others are
merged together, one agenda step of each at a time, in array operations; long ones
go one by one.

Decoding is lossless: characters that the vocabulary lacks, and the mark that
stands for a space where a text itself contains it, are written as byte pieces.

Defined results: a null text encodes to no pieces and decodes to the empty text,
as does an empty one. Very long texts are whole; memory follows the longest.
Null ids are a key of their own. Repeated rows give equal results. An empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back
from .common import pieces as parts_of

SPACE = "▁"
DROPOUT = 0.1
SEED = 20240
CACHE = 100_000
VARIANTS = 200_000
_MET_BITS = 22
_LONG = 40  # such a chunk has at most 40 merges, and places below 64
_TOGETHER = 10_000
_OWN = "own mark"
_M1, _M2, _M3 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_ALL = (1 << 64) - 1
_MERGES = (1 << 40) - 1


def _mixed(key: np.ndarray, left: np.ndarray, right: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Keyed 64-bit hash of candidates; arrays of uint64."""
    return _drawn(key ^ _draw_part(left, right, piece))


def _draw_part(left: np.ndarray, right: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """What ``_mixed`` combines with the key."""
    return (left.astype(np.uint64) * np.uint64(_M1)) ^ (right.astype(np.uint64) * np.uint64(_M2)) ^ (piece.astype(np.uint64) * np.uint64(_M3))


def _part_of(code: np.ndarray) -> np.ndarray:
    """The draw part of candidates (left place, right place, piece in 6, 6 and 20 bits)."""
    return _draw_part(code >> 26, code >> 20 & 63, code & 0xFFFFF)


def _drawn(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(_M2)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_M3)
    return x ^ (x >> np.uint64(32))


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


def _unpacked(raw: bytes) -> list[int]:
    return np.frombuffer(raw, np.int32).tolist()


class Encoder:
    """Agenda merges over one vocabulary; made once per worker from the model file's bytes."""

    def __init__(self, model: bytes, dropout: float = DROPOUT, seed: int = SEED):
        if not 0.0 <= dropout < 1.0:
            raise ValueError("dropout must be in [0, 1)")
        self.model, self.dropout, self.seed = model, dropout, seed
        self.below = int(dropout * 2**64)
        self.forget()

    def forget(self) -> None:
        """Kept outcomes by number: the pieces, the merges taken and their draw parts, the chunk, and the candidates it goes without."""
        self.kept: dict[str, int] = {}
        self.plain: list[bytes] = []
        self.chunk: list[str] = []
        # merges of all outcomes in one row each, as an array of its own would take more than what it holds; those of k end where k + 1 starts
        self.codes, self.taken, self.starts = array("I"), array("Q"), array("q", [0])
        # number << 40 | skipped ones of its merges as bits: the number of the outcome without these; of each outcome, from which it came
        self.variants: dict[int, int] = {}
        self.origin = array("q")
        self.met = np.zeros(1 << _MET_BITS, bool)  # by hash: who meets another's place is kept one meeting early

    @cached_property
    def _vocabulary(self) -> tuple[dict[str, int], list[float], list[int], list]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        ids, scores, octets, surfaces = {}, [], [0] * 256, []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            scores.append(sp.get_score(i))
            surfaces.append(piece)
            if sp.is_byte(i):
                octets[int(piece[3:5], 16)] = i
                surfaces[i] = int(piece[3:5], 16)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                ids[piece] = i
        return ids, scores, octets, surfaces

    @cached_property
    def crossing(self) -> bool:
        """Whether some piece holds a space mark after another character: then only line ends could cut."""
        return any(SPACE in p.lstrip(SPACE) for p in self._vocabulary[0])

    def chunks(self, text: str) -> list[str]:
        """The text's words, each with the spaces before it but for one; no piece crosses from one to the next.

        A vocabulary with a space inside other characters has no such places; its
        texts are one chunk.
        """
        if not text:
            return []
        if self.crossing:
            return [text]
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [m[1:] for m in re.findall(" +[^ ]*", " " + text)]

    def _symbols(self, chunk: str) -> list[str]:
        """Characters of a chunk with its leading space; a space mark of the text's own is a stand-in outside the vocabulary."""
        return [SPACE, *(_OWN if c == SPACE else SPACE if c == " " else c for c in chunk)]

    def _skips(self, key: int, left: int, right: int, piece: int) -> bool:
        x = key ^ (left * _M1 & _ALL) ^ (right * _M2 & _ALL) ^ (piece * _M3 & _ALL)
        x = (x ^ (x >> 31)) * _M2 & _ALL
        x = (x ^ (x >> 29)) * _M3 & _ALL
        return x ^ (x >> 32) < self.below

    def _key(self, chunk: str, stream: int) -> int:
        return xxhash.xxh3_64_intdigest(chunk.encode("utf-8", "surrogatepass"), (self.seed ^ stream << 48) & _ALL)

    @cached_property
    def _tables(self) -> tuple:
        """For arrays: piece of a code point, rank of a piece, and the joined piece of a pair by open addressing."""
        ids, scores, _, _ = self._vocabulary
        of_char = np.full(0x110000, -1, np.int32)
        pairs = {}
        for piece, i in ids.items():
            if len(piece) == 1:
                of_char[ord(piece)] = i
            for cut in range(1, len(piece)):
                if piece[:cut] in ids and piece[cut:] in ids:
                    pairs[ids[piece[:cut]] << 32 | ids[piece[cut:]]] = i
        order = np.argsort(np.array(scores), kind="stable")
        rank = np.empty(len(scores), np.int64)
        _, level = np.unique(np.array(scores)[order], return_inverse=True)
        rank[order] = level + 1
        bits = max(4, int(len(pairs) * 4).bit_length())
        slots, joined = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        mask = (1 << bits) - 1
        longest = 1
        for key, i in pairs.items():
            at, tries = (key * _M1 & _ALL) >> (64 - bits), 1
            while slots[at] != -1:
                at, tries = (at + 1) & mask, tries + 1
            slots[at], joined[at] = key, i
            longest = max(longest, tries)
        return of_char, rank, slots, joined, bits, longest

    def _join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The joined piece of each pair, -1: none."""
        _, _, slots, joined, bits, longest = self._tables
        key = left.astype(np.int64) << 32 | right
        at = ((key.view(np.uint64) * np.uint64(_M1)) >> np.uint64(64 - bits)).astype(np.int64)
        found = slots[at]
        hit = found == key
        out = np.full(len(key), -1, np.int64)
        out[hit] = joined[at[hit]]
        open_ = np.flatnonzero(~hit & (found != -1))
        at = at[open_]
        for _ in range(longest):
            if not len(open_):
                break
            at = (at + 1) & (len(slots) - 1)
            found = slots[at]
            hit = found == key[open_]
            out[open_[hit]] = joined[at[hit]]
            go = ~hit & (found != -1)
            open_, at = open_[go], at[go]
        return out

    def merge_many(self, chunks: list[str], stream: int | None = None, keys: np.ndarray | None = None, trace: list | None = None, without: np.ndarray | None = None) -> list[bytes]:
        """``merge`` of many short chunks at once, one agenda step of each at a time; ids as packed 32-bit numbers.

        ``keys``: the keys of the draws, in place of a stream. ``trace`` takes the
        merges of each step: number of the chunk and code of the candidate (see ``_part_of``).
        ``without``: candidates that are skipped, as chunk number << 32 | code, ordered.
        """
        of_char, rank, _, _, _, _ = self._tables
        n = len(chunks)
        size = np.fromiter(map(len, chunks), np.int64, n) + 1
        raw = np.frombuffer((" " + " ".join(chunks)).encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.where(raw == 32, np.uint32(ord(SPACE)), raw)
        sampled = keys is not None or stream is not None
        if sampled and keys is None:
            keys = np.fromiter((self._key(c, stream) for c in chunks), np.uint64, n)
        symbol = of_char[points].astype(np.int64)
        apart = (symbol < 0) | (raw == ord(SPACE))  # unknown characters and own space marks join nothing
        symbol[apart] = -2 - points[apart].astype(np.int64)
        total = len(symbol)
        origin = np.arange(total)
        word = np.repeat(np.arange(n), size)
        place = origin - np.repeat(np.cumsum(size) - size, size)
        final = np.full(total, -1, np.int64)

        def proposals(left: np.ndarray, right: np.ndarray, at: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Joined piece of each pair of symbols of one chunk, and its value; -1 and 0: none or skipped. ``at``, ``after``: their first characters."""
            piece = self._join(left, right)
            k = np.flatnonzero(piece >= 0)
            if sampled and len(k):
                draw = _mixed(keys[word[at[k]]], place[at[k]], place[after[k]], piece[k])
                skipped = draw < np.uint64(self.below)
                piece[k[skipped]] = -1
                k = k[~skipped]
            if without is not None and len(k):
                code = word[at[k]] << 32 | place[at[k]] << 26 | place[after[k]] << 20 | piece[k]
                skipped = without[np.minimum(np.searchsorted(without, code), len(without) - 1)] == code
                piece[k[skipped]] = -1
                k = k[~skipped]
            value = np.zeros(len(piece), np.int64)
            value[k] = rank[piece[k]] << 32 | (total - at[k])  # the best score, leftmost first
            return piece, value

        joins, value = np.full(total, -1, np.int64), np.zeros(total, np.int64)
        inner = np.flatnonzero(word[:-1] == word[1:])
        joins[inner], value[inner] = proposals(symbol[inner], symbol[inner + 1], inner, inner + 1)
        lengths = size
        while len(symbol):
            best = np.maximum.reduceat(value, np.cumsum(lengths) - lengths)
            alive = best > 0
            each = np.repeat(best, lengths)
            at = np.flatnonzero((value == each) & (each > 0))
            keep = each > 0
            if trace is not None:
                trace.append((word[origin[at]], place[origin[at]] << 26 | place[origin[at + 1]] << 20 | joins[at]))
            symbol[at] = joins[at]
            done = np.flatnonzero(~keep)
            final[origin[done]] = symbol[done]
            keep[at + 1] = False
            left = np.flatnonzero(keep)
            at = (np.cumsum(keep) - 1)[at]
            symbol, origin, joins, value = symbol[left], origin[left], joins[left], value[left]
            lengths = lengths[alive] - 1
            own = word[origin]
            joins[at], value[at] = -1, 0
            first = np.concatenate([at[at > 0] - 1, at[at + 1 < len(symbol)]])
            first = first[own[first] == own[first + 1]]
            joins[first], value[first] = proposals(symbol[first], symbol[first + 1], origin[first], origin[first + 1])
        here = final != -1
        count = np.bincount(np.repeat(np.arange(n), size)[here], minlength=n)
        ends = np.cumsum(count)
        flat = final[here].astype(np.int32).tobytes()
        out = [flat[a:b] for a, b in zip((4 * (ends - count)).tolist(), (4 * ends).tolist())]
        octets = self._vocabulary[2]
        for k in np.unique(np.repeat(np.arange(n), size)[apart]).tolist():
            out[k] = _packed([i for p in _unpacked(out[k]) for i in ([p] if p >= 0 else [octets[b] for b in chr(-2 - p).encode("utf-8", "surrogatepass")])])
        return out

    def _learn(self, chunks: list[str], stream: int | None) -> dict[str, bytes]:
        """Packed pieces of each chunk."""
        found = {}
        plain = [c for c in chunks if 0 < len(c) <= _LONG]
        for at in range(0, len(plain), _TOGETHER):
            some = plain[at : at + _TOGETHER]
            found.update(zip(some, self.merge_many(some, stream)))
        for c in chunks:
            if not 0 < len(c) <= _LONG:
                found[c] = _packed(self.merge(c, stream))
        return found

    def merge(self, chunk: str, stream: int | None, key: int | None = None) -> list[int]:
        """Piece ids of one chunk; ``stream`` None: no dropout. ``key``: that of the draws, in place of a stream."""
        ids, scores, octets, _ = self._vocabulary
        symbols = self._symbols(chunk)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        sampled = key is not None or stream is not None
        if sampled and key is None:
            key = self._key(chunk, stream)
        agenda: list[tuple[float, int, int, str]] = []

        def propose(left: int, right: int) -> None:
            if left >= 0 and right >= 0 and symbols[left] and symbols[right]:
                both = symbols[left] + symbols[right]
                if both in ids:
                    heapq.heappush(agenda, (-scores[ids[both]], left, right, both))

        for k in range(n - 1):
            propose(k, k + 1)
        while agenda:
            _, left, right, both = heapq.heappop(agenda)
            if after[left] != right or not symbols[left] or symbols[left] + symbols[right] != both:
                continue  # one side has been merged since
            if sampled and self._skips(key, left, right, ids[both]):
                continue
            symbols[left] = both
            symbols[right] = ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            after[right] = -2
            propose(before[left], left)
            propose(left, after[left])
        out: list[int] = []
        k = 0
        while 0 <= k < n:
            piece = symbols[k]
            if piece in ids:
                out.append(ids[piece])
            else:
                out += [octets[b] for b in (SPACE if piece == _OWN else piece).encode("utf-8", "surrogatepass")]
            k = after[k]
        return out

    def _keys(self, key: int, n: int) -> np.ndarray:
        """The key of each of a document's chunks."""
        base = np.uint64(xxhash.xxh3_64_intdigest(key.to_bytes(8, "little", signed=True), self.seed & _ALL))
        k = np.arange(n, dtype=np.uint64)
        return _mixed(base, k, k, k)

    def _without(self, origin: int) -> list[int]:
        """The candidates skipped on the way to an outcome that came from ``origin``; 0: a plain one."""
        codes = []
        while origin:
            number, bits = origin >> 40, origin & _MERGES
            first = self.starts[number]
            codes += [self.codes[first + k] for k in range(bits.bit_length()) if bits >> k & 1]
            origin = self.origin[number]
        return codes

    def _keep(self, chunks: list[str], origins: list[int]) -> None:
        """Keeps outcomes of short chunks, and the draws that must all fail to skip for them."""
        for at in range(0, len(chunks), _TOGETHER):
            some, came = chunks[at : at + _TOGETHER], origins[at : at + _TOGETHER]
            trace: list[tuple[np.ndarray, np.ndarray]] = []
            barred = [self._without(o) for o in came]
            all_barred = np.fromiter(chain.from_iterable(barred), np.int64)
            all_barred = np.sort(np.repeat(np.arange(len(some)) << 32, [len(w) for w in barred]) | all_barred)
            outcomes = self.merge_many(some, trace=trace, without=all_barred if len(all_barred) else None)
            word = np.concatenate([w for w, _ in trace]) if trace else np.empty(0, np.int64)
            code = np.concatenate([p for _, p in trace]) if trace else np.empty(0, np.int64)
            order = np.argsort(word, kind="stable")
            word, code = word[order], code[order]
            ends = self.starts[-1] + np.cumsum(np.bincount(word, minlength=len(some)))
            self.plain += outcomes
            self.codes.frombytes(code.astype(np.uint32).tobytes())
            self.taken.frombytes(_part_of(code).tobytes())
            self.starts.frombytes(ends.tobytes())
            self.chunk += some
            self.origin.extend(came)

    def _meet(self, chunks: list[str]) -> None:
        """Keeps the plain outcome of new short chunks."""
        self.kept.update(zip(chunks, range(len(self.plain), len(self.plain) + len(chunks))))
        self._keep(chunks, [0] * len(chunks))

    def _skipped(self, draws: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Which merges of its kept outcome each occurrence skips, as bits."""
        taken, starts = np.frombuffer(self.taken, np.uint64), np.frombuffer(self.starts, np.int64)  # gone before these grow
        bits = np.zeros(len(number), np.int64)
        for a in range(0, len(number), _TOGETHER):
            own = number[a : a + _TOGETHER]
            first = starts[own]
            n = starts[own + 1] - first
            owner = np.repeat(np.arange(len(own)), n)
            inner = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            skips = np.flatnonzero(_drawn(draws[a : a + _TOGETHER][owner] ^ taken[first[owner] + inner]) < np.uint64(self.below))
            # different powers of two below 2**53: sums of doubles are exact
            bits[a : a + _TOGETHER] = np.bincount(owner[skips], np.exp2(inner[skips]), len(own)).astype(np.int64)
        return bits

    def _variant(self, number: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """The number of the outcome without the skipped merges; -1 where it was not met before."""
        pairs, at, times = np.unique(number << 40 | bits, return_inverse=True, return_counts=True)
        found = np.fromiter(map(self.variants.get, pairs.tolist(), repeat(-1)), np.int64, len(pairs))
        places = (pairs.view(np.uint64) * np.uint64(_M1)) >> np.uint64(64 - _MET_BITS)
        new = np.flatnonzero((found < 0) & ((times > 1) | self.met[places]))
        self.met[places] = True
        first, wanted = len(self.plain), pairs[new].tolist()
        self._keep([self.chunk[p >> 40] for p in wanted], wanted)
        self.variants.update(zip(wanted, range(first, len(self.plain))))
        found[new] = np.arange(first, len(self.plain))
        return found[at]

    def encode_many(self, texts: list[str | None], keys: list[int], sampled: bool = True) -> list[bytes]:
        """Packed piece ids of each text. A text's key and a chunk's place key the chunk's draws."""
        sampled = sampled and self.dropout > 0
        cuts = [self.chunks(text) for text in texts]
        words = list(chain.from_iterable(cuts))
        if len(self.kept) > CACHE or len(self.variants) > VARIANTS:
            self.forget()
        number = np.fromiter(map(self.kept.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(number < 0).tolist()
        times = Counter([words[k] for k in new])
        self._meet([c for c, n in times.items() if (n > 1 or not sampled) and 0 < len(c) <= _LONG])
        number[new] = [self.kept.get(words[k], -1) for k in new]
        plain = self.plain
        out = [plain[k] if k >= 0 else b"" for k in number.tolist()]
        if not sampled:
            for k in np.flatnonzero(number < 0).tolist():
                out[k] = _packed(self.merge(words[k], None))
        elif words:
            draws = np.concatenate([self._keys(key, len(cut)) for key, cut in zip(keys, cuts)])
            alone = []  # merged by their own draws
            for k in np.flatnonzero(number < 0).tolist():
                if 0 < len(words[k]) <= _LONG:
                    alone.append(k)
                else:
                    out[k] = _packed(self.merge(words[k], None, int(draws[k])))
            here = np.flatnonzero(number >= 0)
            number = number[here]
            while len(here):
                bits = self._skipped(draws[here], number)
                other = bits > 0
                here = here[other]
                number = self._variant(number[other], bits[other])
                alone += here[number < 0].tolist()
                here, number = here[number >= 0], number[number >= 0]
                for k, v in zip(here.tolist(), number.tolist()):
                    out[k] = plain[v]
            for a in range(0, len(alone), _TOGETHER):
                some = alone[a : a + _TOGETHER]
                for k, o in zip(some, self.merge_many([words[k] for k in some], keys=draws[some])):
                    out[k] = o
        ends = np.cumsum([len(cut) for cut in cuts]).tolist()
        return [b"".join(out[e - len(cut) : e]) for e, cut in zip(ends, cuts)]

    def encode(self, text: str | None, key: int = 0, sampled: bool = True) -> list[int]:
        """Piece ids of one text."""
        return _unpacked(self.encode_many([text], [key], sampled)[0])

    @cached_property
    def _shown(self) -> list[bytes]:
        return [bytes((x,)) if isinstance(x, int) else x.replace(SPACE, " ").encode("utf-8") for x in self._vocabulary[3]]

    def decode(self, ids) -> str:
        """The text that was encoded."""
        text = b"".join(map(self._shown.__getitem__, ids)).decode("utf-8", "surrogatepass")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def _encoder(model: bytes, dropout: float, seed: int) -> Encoder:
    """A worker process keeps its encoder over its tasks, but not the outcomes."""
    return Encoder(model, dropout, seed)


def read_model(path: str) -> bytes:
    """The model file's bytes, read on the driver; they go to the workers with the task."""
    with open(path, "rb") as f:
        return f.read()


def encode_table(
    docs: DataFrame,
    model: bytes,
    dropout: float = DROPOUT,
    seed: int = SEED,
    key_col: str = "doc_id",
    text_col: str = "text",
    checked: bool = True,
) -> DataFrame:
    """``docs`` without its text, plus ``piece_ids``, ``n_pieces`` and ``lossless``.

    ``lossless`` tells whether decoding gave back the text (null: the empty text);
    null where not ``checked``. Other columns pass through; any that are named like the
    three are left out. Equal rows, and copies of a row, are segmented alike: the draws depend on the id.
    """
    added = [("piece_ids", T.ArrayType(T.IntegerType())), ("n_pieces", T.LongType()), ("lossless", T.BooleanType())]
    taken = {name for name, _ in added}
    others = [c for c in docs.columns if c != text_col and c not in taken]
    held = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)]
    kept = docs.select(*held, F.col(f"`{key_col}`").cast("bigint").alias("key"), F.col(f"`{text_col}`").alias("text"))
    schema = docs.select(*held).schema
    for name, kind in added:
        schema = schema.add(name, kind)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)  # one vocabulary file, its size fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(shared.value, dropout, seed)
        try:
            for whole in batches:
                for batch in parts_of(whole, 1 << 20):
                    keys, texts = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
                    coded = coder.encode_many(texts, [-1 if k is None else k for k in keys])
                    same = [coder.decode(_unpacked(c)) == (t or "") for c, t in zip(coded, texts)] if checked else [None] * len(texts)
                    flat = pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]), pa.int32()),
                        pa.array(np.frombuffer(b"".join(coded), np.int32)),
                    )
                    columns = [flat, pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array(same, pa.bool_())]
                    yield pa.record_batch([*batch.columns[:-2], *columns], names=[f.name for f in schema])
        finally:  # Spark takes more workers than run at once, in turn, and keeps them for the jobs after
            coder.forget()
            give_back()

    return kept.mapInArrow(run, schema).toDF(*others, *(n for n, _ in added))


def decode_table(coded: DataFrame, model: bytes, ids_col: str = "piece_ids") -> DataFrame:
    """``coded`` with ``piece_ids`` replaced by the decoded ``text`` (null ids: null); a column ``text`` that it has goes."""
    others = [c for c in coded.columns if c not in (ids_col, "text")]
    schema = coded.select(*[F.col(f"`{c}`") for c in others]).schema.add("text", "string")
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(shared.value, DROPOUT, SEED)
        for batch in batches:
            texts = [None if i is None else coder.decode(i) for i in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.record_batch([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*others, "text"])

    return coded.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{ids_col}`")).mapInArrow(run, schema)
