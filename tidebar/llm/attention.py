"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded:
character trigrams and word shapes hashed to ``BUCKETS`` counts, and a few
measures of its style. A layer embeds the encodings; gated attention, softmax of
w (tanh(V h) * sigmoid(U h)), weighs the passages; a logistic unit scores their
weighted mean. All of it is learned from document labels alone, by Adam on a
bounded sample of labelled documents (``labelled.PER_CLASS`` a class). Classes
are weighed so that scores follow the classes' shares among all labelled ids.

Training runs on the driver in fixed memory; scoring reads each text once, in
Arrow batches, and exchanges nothing.

Defined results: a null or empty text, or one without words, is a bag of one
empty passage and has a score like any other. Without labels of both classes
every score is the share of label 1 (0.5 without any). Null ids are never held
out or learned from. Repeated rows are scored alike; ids that tie in the
order of hashes are taken by number. Very long texts are whole; memory follows the longest. An empty table gives an
empty result. Other columns, labels among them, are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_values, give_back, pieces
from .labelled import PER_CLASS, held_out, sample

PASSAGE = 64
BUCKETS = 256
STYLE = 12
WIDTH = 32
GATES = 16
EPOCHS = 14
BATCH = 128
RATE = 0.004
DECAY = 1e-4
SEED = 11

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_KIND = np.zeros((256, 8), np.float32)
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = [
        _b < 128 and _c.isupper(),
        _b < 128 and _c.islower(),
        _b < 128 and _c.isdigit(),
        _b >= 128,
        _c in ".,;:",
        _c in "!?",
        _c in "#*$%&|<>=+~^_{}[]\\/@",
        _b == 10,
    ]


def encode(text: bytes) -> np.ndarray:
    """Passage encodings, one row each, float32."""
    raw = np.frombuffer(text, np.uint8)
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    word = np.cumsum(first) - 1
    n_words = int(word[-1]) + 1 if len(raw) else 0
    if n_words <= 0:
        return np.zeros((1, BUCKETS + STYLE), np.float32)
    count = -(-n_words // PASSAGE)
    passage = np.maximum(word, 0) // PASSAGE
    size = np.bincount(passage, minlength=count).astype(np.float32)
    words = np.bincount(passage[first], minlength=count).astype(np.float32)
    out = np.zeros((count, BUCKETS + STYLE), np.float32)
    codes = raw.astype(np.uint32)
    if len(raw) >= 3:
        h = (codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1] * np.uint32(0x85EBCA77) ^ codes[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
        cell = passage[:-2] * BUCKETS + (h >> np.uint32(24)).astype(np.int64)
        out[:, :BUCKETS] = np.bincount(cell, minlength=count * BUCKETS).reshape(count, BUCKETS)
        out[:, :BUCKETS] = np.sqrt(out[:, :BUCKETS] / np.maximum(size, 1)[:, None])
    style = np.zeros((count, 8), np.float32)
    for k in range(8):
        style[:, k] = np.bincount(passage, weights=_KIND[raw, k], minlength=count)
    out[:, BUCKETS : BUCKETS + 8] = np.sqrt(style / np.maximum(size, 1)[:, None])
    out[:, BUCKETS + 8] = np.log1p(words) / 5
    out[:, BUCKETS + 9] = (size / np.maximum(words, 1)) / 10
    # share of words of this passage that repeat one of it
    starts = np.flatnonzero(first)
    tail = np.minimum(starts + 1, len(raw) - 1), np.minimum(starts + 2, len(raw) - 1)
    mark = (codes[starts].astype(np.int64) << 16 | codes[tail[0]].astype(np.int64) << 8 | codes[tail[1]].astype(np.int64)) + (passage[starts] << 24)
    distinct = np.bincount(np.unique(mark) >> 24, minlength=count)
    out[:, BUCKETS + 10] = distinct / np.maximum(words, 1)
    out[:, BUCKETS + 11] = np.log1p(n_words) / 10
    return out


def bags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Encodings of all passages, and where each document's begin."""
    each = [encode(t) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(e) for e in each])])[:-1]
    return np.concatenate(each), starts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _forward(m: dict, x: np.ndarray, starts: np.ndarray) -> dict:
    sizes = np.diff(np.append(starts, len(x)))
    bag = np.repeat(np.arange(len(starts)), sizes)
    h = np.tanh((x - m["shift"]) / m["scale"] @ m["W"] + m["b"])
    t, g = np.tanh(h @ m["V"]), _sigmoid(h @ m["U"])
    e = (t * g) @ m["w"]
    a = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    a /= np.add.reduceat(a, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts)
    return {"bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ m["c"] + m["c0"])}


def attention(model: dict, texts: list[bytes]) -> list[np.ndarray]:
    """The weights of each text's passages; they sum to 1."""
    x, starts = bags(texts)
    return np.split(_forward(model, x, starts)["a"], starts[1:])


def train(texts: list[bytes], y: np.ndarray, counts: dict[int, int], epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """A model (plain arrays) from labelled texts; a constant one if a class is missing."""
    total = sum(counts.values())
    if not len(y) or len(set(y.tolist())) < 2:
        return {"constant": counts.get(1, 0) / total if total else 0.5}
    each = [encode(t) for t in texts]
    everything = np.concatenate(each)
    each = np.split(everything, np.cumsum([len(e) for e in each])[:-1])  # views
    rng = np.random.default_rng(seed)
    d = everything.shape[1]
    m = {
        "shift": everything.mean(0),
        "scale": everything.std(0) + 0.01,
        "W": rng.normal(0, 1 / np.sqrt(d), (d, WIDTH)).astype(np.float32),
        "b": np.zeros(WIDTH, np.float32),
        "V": rng.normal(0, 0.2, (WIDTH, GATES)).astype(np.float32),
        "U": rng.normal(0, 0.2, (WIDTH, GATES)).astype(np.float32),
        "w": rng.normal(0, 0.2, GATES).astype(np.float32),
        "c": rng.normal(0, 0.2, WIDTH).astype(np.float32),
        "c0": np.zeros(1, np.float32),
    }
    share = {k: counts[k] / total for k in (0, 1)}
    weight = np.where(y == 1, share[1] / max(1e-9, float((y == 1).mean())), share[0] / max(1e-9, float((y == 0).mean())))
    learned = ("W", "b", "V", "U", "w", "c", "c0")
    one, two, step = {k: np.zeros_like(m[k]) for k in learned}, {k: np.zeros_like(m[k]) for k in learned}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(each))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            x = np.concatenate([each[i] for i in some])
            starts = np.concatenate([[0], np.cumsum([len(each[i]) for i in some])])[:-1]
            f = _forward(m, x, starts)
            out = (weight[some] * (f["p"] - y[some]) / len(some)).astype(np.float32)
            grad = {"c": f["z"].T @ out, "c0": np.array([out.sum()], np.float32)}
            dz = (out[:, None] * m["c"])[f["bag"]]
            dh = f["a"][:, None] * dz
            da = (f["h"] * dz).sum(1)
            de = f["a"] * (da - np.add.reduceat(f["a"] * da, starts)[f["bag"]])
            grad["w"] = (f["t"] * f["g"]).T @ de
            gate = de[:, None] * m["w"]
            dt, dg = gate * f["g"] * (1 - f["t"] ** 2), gate * f["t"] * f["g"] * (1 - f["g"])
            grad["V"], grad["U"] = f["h"].T @ dt, f["h"].T @ dg
            dh = (dh + dt @ m["V"].T + dg @ m["U"].T) * (1 - f["h"] ** 2)
            grad["W"], grad["b"] = ((x - m["shift"]) / m["scale"]).T @ dh, dh.sum(0)
            step += 1
            rate = RATE * (1 - epoch / epochs)
            for k in learned:
                one[k] = 0.9 * one[k] + 0.1 * grad[k]
                two[k] = 0.999 * two[k] + 0.001 * grad[k] ** 2
                m[k] = (m[k] - rate * ((one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8) + DECAY * m[k])).astype(np.float32)
    return m


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", usable: Column | None = None, per_class: int = PER_CLASS) -> dict:
    """A model from the labelled rows of ``docs`` that are ``usable``."""
    rows, counts = sample(docs, labels, label_col, usable, per_class)
    found = sorted((r["doc_id"], (r["text"] or "").encode("utf-8", "surrogatepass"), r["y"]) for r in rows.toLocalIterator())
    model = train([t for _, t, _ in found], np.array([y for _, _, y in found], np.float64), counts)
    del found
    give_back()
    return model


def scores(model: dict, texts: list[bytes]) -> np.ndarray:
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    if not texts:
        return np.empty(0)
    return _forward(model, *bags(texts))["p"].astype(np.float64)


def score(docs: DataFrame, model: dict, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score in column ``name`` (one of that name is replaced)."""
    columns = [c for c in docs.columns if c != name]
    kept = docs.select(*[F.col(f"`{c}`") for c in columns])
    at = columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed shapes: some 50 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1 << 20, text_col):
                made = scores(shared.value, byte_values(batch.column(at)))
                yield pa.record_batch([*batch.columns, pa.array(made)], names=[*columns, name])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = PER_CLASS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Held-out rows are not learned from."""
    model = fit(docs, labels, label_col, ~held_out(F.col("doc_id")), per_class)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
