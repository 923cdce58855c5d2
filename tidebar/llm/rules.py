"""Quality rules: plain measures of a text, and a calibrated linear model of its n-grams.

The measures are exact counts. The model is a logistic regression on hashed word
one- and two-grams and character two- to four-grams (log counts, unit length),
trained on a bounded sample of labelled rows (``labelled.PER_CLASS`` a class) with
full-batch Adam. A fifth of the sample, by hash, is left out of the training and
fits a logistic calibration of the raw scores, weighed to the classes' shares
among all labelled ids. ``THRESHOLD`` on the calibrated probability is fixed.

Scoring reads each text once in Arrow batches and exchanges nothing; the weights
have a fixed size.

Defined results: a null text counts as empty: no words, which fails the rules.
Without labels of both classes the model keeps everything that passes the rules.
Null ids and repeated rows are rows like others. Very long texts are whole. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, give_back, pieces
from .labelled import PER_CLASS, sample
from .sketch import Hasher

BITS = 15
SIZE = 1 << BITS
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
THRESHOLD = 0.5
STEPS = 120
RATE = 0.05
RIDGE = 1e-5
_TEXTS = 400
_SYMBOLS = b"#*$%&|<>"
_BLANKS = b" \t\n\x0b\x0c\r"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def repeated_words(hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows that are found twice or more; ``hashes``: one 64-bit number a word."""
    n = len(hashes) - window + 1
    if n < 2:
        return 0
    total = np.zeros(n, np.uint64)
    for k in range(window):
        total = (total ^ hashes[k : k + n]) * _A
        total ^= total >> np.uint64(29)
    order = np.argsort(total, kind="stable")
    ranked = total[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(hashes) + 1, np.int64)
    cover[:n] += again
    cover[window:] -= again
    return int((np.cumsum(cover) > 0).sum())


def measures(text: bytes, words: list[bytes], hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = len(text.decode("utf-8", "surrogatepass"))
    blanks = len(text) - len(text.translate(None, _BLANKS))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip(_BLANKS)]
    return len(words), chars - blanks, symbols, len(lines) - len(set(lines)), repeated_words(hashes)


def features(text: bytes, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature numbers and values of unit length."""
    raw = np.frombuffer(text, np.uint8).astype(np.uint64)
    parts = []
    h = raw
    for k in range(1, 4):
        if len(raw) <= k:
            break
        h = h[:-1] * np.uint64(257) + raw[k:]
        parts.append(((h + np.uint64(k)) * _A) >> np.uint64(64 - BITS))
    grams = np.bincount(np.concatenate(parts).astype(np.int64), minlength=SIZE) if parts else np.zeros(SIZE, np.int64)
    parts = [(hashes * _B) >> np.uint64(64 - BITS)]
    if len(hashes) > 1:
        parts.append((((hashes[:-1] * _A) ^ hashes[1:]) * _B) >> np.uint64(64 - BITS))
    terms = np.bincount(np.concatenate(parts).astype(np.int64), minlength=SIZE)
    at = [np.flatnonzero(grams), np.flatnonzero(terms)]
    values = []
    for place, table in zip(at, (grams, terms)):
        v = np.log1p(table[place])
        values.append(v / np.sqrt(v @ v) if len(v) else v)
    return np.concatenate([at[0], at[1] + SIZE]).astype(np.int32), np.concatenate(values).astype(np.float32)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _adam(gradient, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    x, one, two = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for k in range(1, steps + 1):
        g = gradient(x)
        one, two = 0.9 * one + 0.1 * g, 0.999 * two + 0.001 * g * g
        x -= rate * (one / (1 - 0.9**k)) / (np.sqrt(two / (1 - 0.999**k)) + 1e-8)
    return x


def train(texts: list[bytes], y: np.ndarray, counts: dict[int, int], steps: int = STEPS) -> dict | None:
    """Weights, bias and calibration; None without both classes."""
    if len(set(y.tolist())) < 2:
        return None
    hasher = Hasher()
    each = [features(t, hasher.words(t.split())) for t in texts]
    aside = np.array([xxhash.xxh3_64_intdigest(t) % 5 == 0 for t in texts])
    if len(set(y[aside].tolist())) < 2 or len(set(y[~aside].tolist())) < 2:
        aside = np.zeros(len(y), bool)
    share = {k: counts[k] / sum(counts.values()) for k in (0, 1)}

    def part(which: np.ndarray) -> list[tuple]:
        """Feature numbers, values, rows, labels and weights of the chosen texts, in blocks."""
        chosen = np.flatnonzero(which)
        mean = float(y[chosen].mean())
        blocks = []
        for at in range(0, len(chosen), _TEXTS):
            some = chosen[at : at + _TEXTS]
            own = y[some]
            weight = np.where(own == 1, share[1] / max(1e-9, mean), share[0] / max(1e-9, 1 - mean)) / len(chosen)
            row = np.repeat(np.arange(len(some), dtype=np.int32), [len(each[i][0]) for i in some])
            blocks.append((np.concatenate([each[i][0] for i in some]), np.concatenate([each[i][1] for i in some]), row, own, weight))
        return blocks

    def logits(x: np.ndarray, at, value, row, own) -> np.ndarray:
        return np.bincount(row, weights=x[at] * value, minlength=len(own)) + x[-1]

    fitted, rest = part(~aside), part(aside if aside.any() else ~aside)
    each.clear()

    def gradient(x: np.ndarray) -> np.ndarray:
        g = np.zeros_like(x)
        for at, value, row, own, weight in fitted:
            off = weight * (_sigmoid(logits(x, at, value, row, own)) - own)
            g[:-1] += np.bincount(at, weights=value * off[row], minlength=2 * SIZE)
            g[-1] += off.sum()
        g[:-1] += RIDGE * x[:-1]
        return g

    x = _adam(gradient, np.zeros(2 * SIZE + 1), steps, RATE)
    raw = np.concatenate([logits(x, at, value, row, own) for at, value, row, own, _ in rest])
    own, weight = (np.concatenate([block[k] for block in rest]) for k in (3, 4))

    def slope(ab: np.ndarray) -> np.ndarray:
        off = weight * (_sigmoid(ab[0] * raw + ab[1]) - own)
        return np.array([off @ raw + 1e-3 * (ab[0] - 1), off.sum()])

    scale = _adam(slope, np.array([1.0, 0.0]), 400, 0.02)
    return {"weights": x[:-1].astype(np.float32), "bias": float(x[-1]), "slope": float(scale[0]), "offset": float(scale[1])}


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = PER_CLASS) -> dict | None:
    """The model of the labelled rows of ``docs``."""
    rows, counts = sample(docs, labels, label_col, None, per_class)
    found = sorted((r["doc_id"], (r["text"] or "").encode("utf-8", "surrogatepass"), r["y"]) for r in rows.toLocalIterator())
    model = train([t for _, t, _ in found], np.array([y for _, _, y in found], np.float64), counts)
    del found
    give_back()
    return model


def probability(model: dict | None, text: bytes, hashes: np.ndarray) -> float:
    """Calibrated probability of good quality (1 without a model)."""
    if model is None:
        return 1.0
    at, value = features(text, hashes)
    raw = float(model["weights"][at] @ value) + model["bias"]
    return float(_sigmoid(model["slope"] * raw + model["offset"]))


_SCHEMA = pa.schema(
    [("doc_id", pa.int64())]
    + [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("probability", pa.float64()), ("kept", pa.bool_())]
)


def judge(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, the measures, base_failed, probability and kept."""
    kept = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 * SIZE weights

    def row(text: bytes, hasher: Hasher, model: dict | None) -> tuple:
        words = text.split()
        hashes = hasher.words(words)
        found = measures(text, words, hashes)
        failed = found[0] < MIN_WORDS or 100 * found[4] > MAX_REPEAT_PERCENT * found[0]
        likely = probability(model, text, hashes)
        return *found, failed, likely, not failed and likely >= threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known = Hasher(), shared.value
        for whole in batches:
            for batch in pieces(whole):
                columns = zip(*(row(t, hasher, known) for t in byte_values(batch.column(1))))
                yield pa.record_batch([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(_SCHEMA)[1:]))], schema=_SCHEMA)

    return kept.mapInArrow(
        run, "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, probability double, kept boolean"
    )
