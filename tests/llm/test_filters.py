"""Quality classifier, quality rules and license scans."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidebar.llm import attention, licenses, queries, rules
from tests.llm.helpers import WORD, docs_of, lower


def toy(n=120):
    rng = random.Random(5)
    words = ["river", "stone", "walks", "under", "light", "green", "hills", "slowly"]
    out = []
    for k in range(n):
        good = k % 3 > 0
        out.append((k, " ".join(rng.choice(words) + ("" if good else "$$$") for _ in range(rng.randrange(30, 200))), int(good)))
    return out


def test_attention_learns_and_weighs(spark):
    rows = toy()
    docs = docs_of(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7000, 0)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in attention.classify(docs, labels).collect()}
    for i, _, y in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i].predicted == y == int(got[i].score >= 0.5)
    model = attention.fit(docs, labels)
    weights = attention.attention(model, [t.encode() for _, t, _ in rows[:9]] + [b""])
    assert all(w.sum() == pytest.approx(1, abs=1e-4) for w in weights) and len(weights[-1]) == 1


def test_attention_edges(spark):
    docs = docs_of(spark, [(1, ""), (None, None), (2, "x " * 30000), (2, "x " * 30000)]).withColumn("score", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert [r.score for r in attention.classify(docs, none).collect()] == [0.5] * 4
    one = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    assert {r.score for r in attention.score(docs, attention.fit(docs, one)).collect()} == {1.0}
    assert attention.classify(docs.filter("false"), none).count() == 0


def test_attention_held_out(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    scored = queries.op4_attention(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    assert scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.95


def plain_measures(text):
    words = WORD.findall(text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    again = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again)


def test_rules_measures(spark):
    texts = ["", None, "a", "a b\na b\n\n \na b", "x " * 60, "p q r s t u v w " * 2 + "end", "é#*$ %&|<> z", " ".join(f"w{k % 11}" for k in range(40))]
    docs = docs_of(spark, enumerate(texts)).withColumn("kept", F.lit(1))
    for r in rules.judge(docs, None).collect():
        want = plain_measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and r.kept == (not r.base_failed)
    assert rules.judge(docs.filter("false"), None).count() == 0


def test_rules_model(spark):
    rows = toy()
    docs = docs_of(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, quality int")
    model = rules.fit(docs, labels)
    got = {r.doc_id: r for r in rules.judge(docs, model).collect()}
    assert all(0 <= got[i].probability <= 1 and (got[i].probability >= 0.5) == bool(y) for i, _, y in rows)
    assert rules.fit(docs, labels.filter("quality = 1")) is None


def test_license_base(spark):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    texts = ["", None, "CC-BY and cc by", "All Rights, Reserved! all rights reserved", "general publicé license", "GNU General Public License general public license", "cc", "x " * 99 + "cc. by"]
    docs = docs_of(spark, enumerate(texts)).withColumn("labels", F.lit("clash"))
    for r in licenses.scan(docs).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(texts[r.doc_id] or ""))
        places = sorted((k, label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    assert licenses.scan(docs.filter("false")).count() == 0


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the Apache License, Version 2.0", {"apache-2.0"}),
        ("// SPDX-License-Identifier: MIT", {"mit"}),
        ("GNU Lesser General Public License v2.1", {"lgpl-2.1"}),
        ("under the BSD 3-Clause License.", {"bsd-3-clause"}),
        ("nothing of the kind, just a summit", set()),
        ("Attribution-NonCommercial-ShareAlike 4.0", {"cc-by-nc-sa"}),
    ],
)
def test_license_detections(text, labels):
    assert {d.label for d in licenses.detect(text)} == labels


def test_license_suppression():
    d = licenses.Detection
    kept = licenses.resolve({d("gpl", 5, 4, 20), d("lgpl", 6, 0, 20), d("mit", 3, 30, 33), d("gpl-3.0", 8, 4, 25)})
    assert [x.label for x in kept] == ["lgpl", "gpl-3.0", "mit"]
    assert len(licenses.rules()) > 200


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        (" * GNU Lesser\n * General Public License", {"lgpl"}),
        ("under the BSD 2 Clause License", {"bsd-2-clause"}),
        ("Permission is hereby granted, free of\n# charge, to any person\n# obtaining a copy", {"mit"}),
        ("provided WITHOUT\n// WARRANTY OF ANY KIND", {"disclaimer"}),
        ("released under GPLv3", {"gpl-3.0"}),
        ("gplv2", {"gpl-2.0"}),
        ("GPL-3", {"gpl-3.0"}),
        ("LGPLv3", {"lgpl-3.0"}),
        ("lgplv2.1", {"lgpl-2.1"}),
        ("AGPLv3", {"agpl-3.0"}),
        ("MPLv2.0", {"mpl-2.0"}),
        ("GNU General Public License v3", {"gpl-3.0"}),
        ("Apache-2.0", {"apache-2.0"}),
        ("Mozilla\n * Public License, v. 2.0", {"mpl-2.0"}),
    ],
)
def test_license_wrapped_and_compact(text, labels):
    assert {d.label for d in licenses.detect(text)} == labels


def test_license_keywords_are_no_stricter_than_rules():
    def spellings(items):
        """Two matches of an expression, with the first and the last choice everywhere."""
        parser = licenses.parser
        for last in (0, -1):
            def text(items):
                out = ""
                for op, value in items:
                    if op is parser.LITERAL:
                        out += chr(value)
                    elif op is parser.IN:
                        out += "\n" if value[0][0] is parser.CATEGORY else chr(value[0][1][0] if value[0][0] is parser.RANGE else value[0][1])
                    elif op is parser.SUBPATTERN:
                        out += text(value[-1])
                    elif op is parser.BRANCH:
                        out += text(value[1][last])
                    elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT):
                        out += text(value[2]) * (value[0] if last else max(1, value[0]))
                return out
            yield text(items)

    for rule in licenses.rules():
        if rule.keywords == ("spdx-license-identifier",):
            continue  # spelled without gaps
        for text in spellings(licenses.parser.parse(rule.pattern.pattern)):
            assert rule.pattern.search(text), (rule.label, text)
            assert any(k in text for k in rule.keywords), (rule.label, text)


def test_license_gaps_of_any_length():
    for gap in (" ", " " * 100, "\n" + " " * 300 + "# " * 50, " * " * 400):
        assert {d.label for d in licenses.detect(f"licensed under the apache{gap}license version 2.0")} == {"apache-2.0"}
    found = licenses.detect("x" * 50 + " GNU" + " " * 5000 + "Lesser -- General,\n\nPublic / License!")
    assert [(d.label, d.start) for d in found] == [("lgpl", 51)]
    assert {d.label for d in licenses.detect("# SPDX-License-Identifier:          (MIT OR Apache-2.0 AND\tBSD-3-Clause WITH x) and more, zlib")} == {"mit", "apache-2.0", "bsd-3-clause"}


def test_license_resolution_is_not_quadratic():
    import time

    rng = random.Random(1)
    raw = {licenses.Detection(rng.choice("abc"), rng.randrange(2, 9), s, s + rng.randrange(1, 30)) for s in range(0, 400)}
    kept = []
    for d in sorted(raw, key=lambda d: (-d.priority, d.start - d.end, d.start, d.label)):
        if not any(k.start <= d.start and d.end <= k.end for k in kept):
            kept.append(d)
    assert licenses.resolve(raw) == sorted(kept, key=lambda d: (d.start, d.end, d.label))
    began = time.time()
    assert len(licenses.resolve({licenses.Detection("a", 3, 5 * k, 5 * k + 4) for k in range(60_000)})) == 60_000
    assert time.time() - began < 10


def test_training_rows_do_not_follow_the_partitions(spark):
    from tidebar.llm.labelled import sample

    docs = docs_of(spark, [(k % 30, f"text {k} " * (k % 7)) for k in range(600)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id bigint, quality int")
    take = lambda n, **more: sorted(map(str, sample(docs.repartition(n), labels, "quality", **more)[0].collect()))
    assert take(3) == take(7) and len(take(3)) == 30
    assert take(3, per_class=4) == take(7, per_class=4) and len(take(3, per_class=4)) == 8
    some = take(3, most_bytes=300)
    assert some == take(5, most_bytes=300) and 0 < len(some) < 30


def test_a_long_text_does_not_empty_the_training_rows(spark, monkeypatch, tmp_path):
    import corpus_pipeline
    from tidebar.llm import attention, labelled, rules

    first = min(range(40), key=lambda k: spark.range(1).select(F.xxhash64(F.lit(k).cast("bigint"))).first()[0])
    rows = [(k, f"{'good plain prose of words' if k % 2 else '#$ %& spam *** $$'} {k} " * 2) for k in range(40)]
    rows[first] = (first, rows[first][1] * 60)
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id bigint, quality int")
    most = len(rows[first][1]) // 2
    assert sum(len(t) for k, t in rows if k != first) > most > 1000
    taken = labelled.sample(docs, labels, "quality", most_bytes=most)[0].collect()
    assert first not in {r.doc_id for r in taken} and {r.y for r in taken} == {0, 1}
    assert most * 0.9 < sum(len(r.text) for r in taken) <= most
    with pytest.raises(ValueError, match="label 1"):
        labelled.sample(docs.filter("doc_id < 1 or doc_id % 2 = 1"), labels, "quality", most_bytes=len(rows[0][1]))
    monkeypatch.setattr(labelled.sample, "__defaults__", (None, labelled.PER_CLASS, most))
    assert "constant" not in attention.fit(docs, labels)
    judged = {r.doc_id: r.kept for r in rules.judge(docs, rules.fit(docs, labels)).collect()}
    assert len(judged) == 40
    labels.withColumn("toxic", F.lit(0)).write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, str(tmp_path)).collect()}
    assert kept and kept <= {k for k in range(40) if k % 2}


def test_attention_scores_by_a_plain_forward_pass():
    import math

    import numpy as np

    from tidebar.llm import attention as A

    rows = toy(40)
    model = A.train([t.encode() for _, t, _ in rows], np.array([y for *_, y in rows], float), {0: 14, 1: 26}, epochs=2)
    texts = [rows[0][1].encode(), b"", b"one", ("many words here " * 90).encode()]
    for text, got in zip(texts, A.scores(model, texts)):
        passages = A.encode(text)
        assert len(passages) == max(1, -(-len(text.split()) // A.PASSAGE))
        hidden, energy = [], []
        for x in passages:
            z = [(float(v) - float(s)) / float(w) for v, s, w in zip(x, model["shift"], model["scale"])]
            h = [math.tanh(sum(z[i] * float(model["W"][i, j]) for i in range(len(z))) + float(model["b"][j])) for j in range(A.WIDTH)]
            gate = [math.tanh(sum(h[j] * float(model["V"][j, k]) for j in range(A.WIDTH))) / (1 + math.exp(-sum(h[j] * float(model["U"][j, k]) for j in range(A.WIDTH)))) for k in range(A.GATES)]
            hidden.append(h)
            energy.append(sum(g * float(w) for g, w in zip(gate, model["w"])))
        weight = [math.exp(e - max(energy)) for e in energy]
        mean = [sum(w * h[j] for w, h in zip(weight, hidden)) / sum(weight) for j in range(A.WIDTH)]
        want = 1 / (1 + math.exp(-(sum(m * float(c) for m, c in zip(mean, model["c"])) + float(model["c0"][0]))))
        assert got == pytest.approx(want, abs=1e-4)


def test_rules_probability_by_plain_counting():
    import math

    import numpy as np
    import xxhash

    from tidebar.llm.sketch import Hasher

    rows = toy(60)
    model = rules.train([t.encode() for _, t, _ in rows], np.array([y for *_, y in rows], float), {0: 20, 1: 40}, steps=20)
    mask = (1 << 64) - 1
    a, b = int(rules._A), int(rules._B)
    for text in (rows[3][1].encode(), b"two words", "é a".encode(), b""):
        grams, terms = Counter(), Counter()
        for k in range(1, 4):
            for at in range(len(text) - k):
                h = 0
                for c in text[at : at + k + 1]:
                    h = (h * 257 + c) & mask
                grams[((h + k) * a & mask) >> (64 - rules.BITS)] += 1
        words = [xxhash.xxh3_64_intdigest(w) for w in text.split()]
        for w in words:
            terms[(w * b & mask) >> (64 - rules.BITS)] += 1
        for v, w in zip(words, words[1:]):
            terms[(((v * a & mask) ^ w) * b & mask) >> (64 - rules.BITS)] += 1
        raw = model["bias"]
        for table, shift in ((grams, 0), (terms, rules.SIZE)):
            length = math.sqrt(sum(math.log1p(n) ** 2 for n in table.values())) or 1.0
            raw += sum(float(model["weights"][k + shift]) * math.log1p(n) / length for k, n in table.items())
        want = 1 / (1 + math.exp(-(model["slope"] * raw + model["offset"])))
        assert rules.probability(model, text, Hasher().words(text.split())) == pytest.approx(want, abs=1e-5)
