"""Phrase mining against a plain count of all phrases."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import lower
from tidebar.llm import phrases

SCHEMA = "text string, lang string"


def plain(rows, least, top=2000):
    f, n = {}, Counter()
    for text, lang in rows:
        counts = f.setdefault(lang or "und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(words)
            for m in range(1, 5):
                for s in range(len(words) - m + 1):
                    counts[tuple(words[s : s + m])] += 1
    out = []
    for lang, counts in f.items():
        common = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        dropped = set()
        for p, a in common.items():
            for m in range(2, len(p)):
                for s in range(len(p) - m + 1):
                    if 100 * a >= 80 * common[p[s : s + m]]:
                        dropped.add(p[s : s + m])
        made = []
        for p, a in common.items():
            if p not in dropped:
                score, _, l, r = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                made.append((-score, -a, " ".join(p).encode(), l, r))
        for k, (score, a, phrase, l, r) in enumerate(sorted(made)[:top]):
            out.append((lang, k + 1, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def got(spark, rows, least, **options):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, phrases.collocations(docs, least, **options).collect()))


def corpus(seed=3, texts=120):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["Übel", "ß", "日本", "A-b", "x\x0by", "\x1c"]
    weights = [1 / (k + 1) for k in range(len(words))]
    fixed = ["new york City", "of the of the of the", "in spite of", "w0 w0 w0 w0 w0"]
    rows = []
    for k in range(texts):
        parts = rng.choices(words, weights, k=rng.randrange(0, 60)) + [rng.choice(fixed) for _ in range(rng.randrange(3))]
        rng.shuffle(parts)
        text = "".join(p + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "!\n", "\r\n"]) for p in parts)
        rows.append((text, rng.choice(["en", "en", "en", "de", None, ""])))
    return rows


@pytest.mark.parametrize("options", [{}, {"split": 7}, {"head": 12}, {"head": 1, "split": 5}, {"head": 0}])
def test_all_phrases(spark, options):
    rows = corpus()
    assert got(spark, rows, 4, **options) == plain(rows, 4)


def test_top_and_ties(spark):
    rows = [(f"a{k} b{k}. " * 5, "en") for k in range(12)] + [("c d e f g. " * 9, "en")]
    assert got(spark, rows, 5, top=7) == plain(rows, 5, 7)


def test_odd_rows(spark):
    rows = [(None, "en"), ("", None), (" \t.,", "de"), ("one", "fr"), ("und so", "und"), ("Und SO", None)] * 3
    rows += [("long text here " * 50_000, "en")] + [("the same line", "es")] * 400
    assert got(spark, rows, 6) == plain(rows, 6)


def test_empty_and_clashing_columns(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = corpus(texts=30)
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as words", "2 as a", "3 as word", "4 as rank", "5 as phrase")
    assert sorted(map(tuple, phrases.collocations(docs, 4).collect())) == plain(rows, 4)


def test_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = corpus(seed=8)
        assert got(spark, rows, 3, split=11) == plain(rows, 3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_every_phrase_is_owned_once():
    rng = np.random.default_rng(1)
    numbers = np.concatenate([[-1] * 3, rng.integers(-1, 6, 300), [-1] * 3])
    rows, n = phrases.owned(phrases.fragments(numbers), np.ones(len(phrases.fragments(numbers)), np.int64))
    found = Counter(tuple(v for v in row if v >= 0) for row in rows.tolist())
    want = Counter()
    for m in (2, 3, 4):
        for s in range(len(numbers) - m + 1):
            if (numbers[s : s + m] >= 0).all():
                want[tuple(numbers[s : s + m].tolist())] += 1
    assert found == want and n.sum() == sum(want.values())


def test_sum_of_rows_with_one_hash(monkeypatch):
    monkeypatch.setattr(phrases, "_hashes", lambda rows: np.zeros(len(rows), np.uint64))
    rows = np.array([[1, 2], [3, 4], [1, 2], [3, 4], [0, 9]])
    keys, n, _ = phrases.summed(rows, np.array([1, 2, 3, 4, 5]))
    assert sorted(zip(map(tuple, keys.tolist()), n.tolist())) == [((0, 9), 5), ((1, 2), 4), ((3, 4), 6)]
