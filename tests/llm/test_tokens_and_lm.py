"""SentencePiece encoding and language-model scores."""

from __future__ import annotations

import gc
import math
import os
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidebar.llm import lm, pieces
from tests.llm.helpers import docs_of

PATH = "/opt/tokenizers/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary file")
TEXTS = ["Hello world", "  two  spaces ", "", " ", "   ", "tab\tline\nend", "é🙂 <s> </s> <0x41> ½", "▁own ▁mark▁", "\0\0pair", "12 345", "longwordwithoutanyspace" * 30, "a" * 41 + " b"]


@pytest.fixture(scope="module")
def model():
    return pieces.read_model(PATH)


def test_plain_equals_the_library(model):
    own, sp = pieces.Encoder(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for text in TEXTS:
        if "▁" not in text and "\0" not in text:
            assert own.encode(text, 0, False) == sp.encode(text)


def test_dropout_is_lossless_seeded_and_varied(model):
    a, b = pieces.Encoder(model, 0.3, 1), pieces.Encoder(model, 0.3, 2)
    text = "the quick brown fox jumps over lazy dogs and runs through international waters " * 20
    for t in [*TEXTS, text]:
        assert a.decode(a.encode(t, 5)) == t
    assert a.encode(text, 5) == pieces.Encoder(model, 0.3, 1).encode(text, 5)
    assert len({tuple(x) for x in (a.encode(text, 5), a.encode(text, 6), b.encode(text, 5), a.encode(text, 5, False))}) == 4


def test_together_equals_one_by_one(model):
    e = pieces.Encoder(model, 0.25, 3)
    chunks = sorted({c for t in TEXTS for c in e.chunks(t)})
    for stream in (None, 0, 3):
        assert {c: pieces._unpacked(p) for c, p in e._learn(chunks, stream).items()} == {c: e.merge(c, stream) for c in chunks}


def test_table(spark, model):
    docs = docs_of(spark, [*enumerate(TEXTS), (None, None), (3, TEXTS[3])]).withColumn("piece_ids", F.lit("clash"))
    coded = pieces.encode_table(docs, model)
    rows = coded.collect()
    assert len(rows) == len(TEXTS) + 2 and all(r.lossless for r in rows) and all(len(r.piece_ids) == r.n_pieces for r in rows)
    back = {r.doc_id: r.text for r in pieces.decode_table(coded, model).collect()}
    assert all(back[k] == t for k, t in enumerate(TEXTS)) and back[None] == ""
    assert pieces.encode_table(docs.filter("false"), model).count() == 0


def test_no_target(spark):
    background = docs_of(spark, [(1, "a b c")])
    models = lm.fit(background.filter("false"), background)
    assert lm.score(background, models).count() == 1


def test_every_occurrence_draws_on_its_own(model):
    e = pieces.Encoder(model, 0.3, 1)
    texts = ["international waters"] * 300
    assert len(set(e.encode_many(texts, list(range(300))))) > 16  # four streams: at most four
    within = e.encode_many(["international " * 64], [5])[0]
    plain = e.encode("international", 0, False)
    assert e.decode(pieces._unpacked(within)) == "international " * 64 and len(pieces._unpacked(within)) > 64 * len(plain)
    some = [*TEXTS, "the quick brown fox jumps over lazy dogs " * 9]
    for k, text in enumerate(some):
        cut = e.chunks(text)
        one_by_one = [i for c, key in zip(cut, e._keys(k, len(cut)).tolist()) for i in e.merge(c, None, key)]
        assert e.encode(text, k) == one_by_one
    assert e.encode_many(some, list(range(len(some)))) == [e.encode_many([t], [k])[0] for k, t in enumerate(some)]


def test_outcomes_with_skips_are_kept(model, monkeypatch):
    e = pieces.Encoder(model, 0.3, 1)
    texts = ["international waters run through crowded valleys " * 6] * 300
    merged = []
    plain = pieces.Encoder.merge_many
    monkeypatch.setattr(pieces.Encoder, "merge_many", lambda self, chunks, *a, **k: merged.append(len(chunks)) or plain(self, chunks, *a, **k))
    for at in range(0, 3000, 300):
        keys = list(range(at, at + 300))
        merged.clear()
        coded = e.encode_many(texts, keys)
    assert sum(merged) < 0.35 * 300 * 36  # over half of the occurrences skip something
    fresh = pieces.Encoder(model, 0.3, 1)
    cut = e.chunks(texts[0])
    for k, got in list(zip(keys, coded))[::60]:
        assert pieces._unpacked(got) == [i for c, key in zip(cut, e._keys(k, len(cut)).tolist()) for i in e.merge(c, None, key)]
        assert fresh.encode(texts[0], k) == pieces._unpacked(got)


def test_kept_outcomes_are_compact(model):
    e = pieces.Encoder(model, 0.3, 1)
    texts = [" ".join(f"water{k}side{k * k}" for k in range(at, at + 20)) for at in range(2000)] * 2
    e.encode_many(texts[:1], [0])  # the vocabulary's tables
    e.forget()
    tracemalloc.start()
    try:
        e.encode_many(texts, list(range(len(texts))))
        gc.collect()
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert len(e.plain) > 10_000 and held / len(e.plain) < 500  # an array for each list of merges: over 1000


def test_workers_keep_no_outcomes_for_the_jobs_after(spark, model):
    docs = docs_of(spark, [(k, f"international waters {k % 7} " * 9) for k in range(200)])
    assert pieces.encode_table(docs, model).filter("lossless").count() == 200

    def held(batches):
        found = sum(len(x.plain) for x in gc.get_objects() if isinstance(x, pieces.Encoder))
        for b in batches:
            yield pa.record_batch([pa.array([found] * b.num_rows, pa.int64())], names=["n"])

    assert {r.n for r in spark.range(0, 64, 1, 32).mapInArrow(held, "n bigint").collect()} == {0}


def test_every_word_and_pair_has_its_own_count(spark):
    rare = " ".join(f"w{k} v{k % 7}" for k in range(70_000))  # more words than fit in 65,536
    texts = ["a b a b c", "a a b", "", "c c c d", "x" * 70 + " d d " + "x" * 70, None, rare]
    good = ["a b a b c", "w5 v5 w5 v5"]
    background, target = docs_of(spark, enumerate(texts)), docs_of(spark, enumerate(good))
    made = {}
    for name, corpus in (("t", good), ("b", texts)):
        one, two = Counter(), Counter()
        for t in corpus:
            s = ["^", *(t or "").split()]
            one.update(s)
            two.update(zip(s, s[1:]))
        made[name] = one, two, sum(n for w, n in one.items() if w != "^")
    size = len(made["b"][0]) - 1
    scale = {"t": 1.0, "b": made["t"][2] / made["b"][2]}

    def loss(name, v, w):
        one, two, total = made[name]
        k = scale[name]
        share = (one[w] * k + 1) / (total * k + size + 1)
        return -math.log((min(two[v, w] * k, one[v] * k) + lm.MU * share) / (one[v] * k + lm.MU))

    models = lm.fit(target, background)
    for docs in (background, docs_of(spark, enumerate([*texts, "never seen a b"]))):
        for r in lm.score(docs, models).collect():
            s = ["^", *("never seen a b" if r.doc_id == len(texts) else texts[r.doc_id] or "").split()]
            each = [(loss("t", v, w), loss("b", v, w)) for v, w in zip(s, s[1:])]
            assert r.n_tokens == len(each)
            assert r.score == pytest.approx(sum(a - b for a, b in each) / max(1, len(each)), abs=1e-9)
    assert lm.score(background.filter("false"), models).count() == 0


def test_labelled_rows_are_the_target(spark):
    rows = [(k, f"a{k % 5} b c{k % 3} " * (k % 4)) for k in range(40)] + [(None, "a1 b"), (7, "a2 b again"), (7, "a2 b again"), (50, None)]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(k, k % 2) for k in range(45)] + [(7, 1), (None, 1)], "doc_id bigint, quality int")
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.score)
    one = sorted(lm.score(docs, lm.fit_labelled(docs, labels)).collect(), key=key)
    two = sorted(lm.score(docs, lm.fit(docs.join(labels.filter("quality = 1"), "doc_id", "left_semi"), docs)).collect(), key=key)
    assert len(one) == len(rows) and [r.n_tokens for r in one] == [r.n_tokens for r in two]
    assert [r.score for r in one] == pytest.approx([r.score for r in two]) and any(r.score for r in one)
    part = docs.filter("doc_id < 20")
    for a in lm.score(part, lm.fit_labelled(docs, labels)).collect():
        assert any(a.doc_id == b.doc_id and a.score == pytest.approx(b.score) for b in one)
