"""SimHash groups, components and bottom-k sketches."""

from __future__ import annotations

import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tidebar.llm import components, simhash, sketch
from tests.llm.helpers import WORD, components as plain_components, docs_of, lower


def plain_fingerprint(text):
    words = WORD.findall(lower(text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", None, "one", "one two", "A b C", "é x y\tz\n\nA a a a a a", "x " * 500, "Ω\x0bq\x0cr s"])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("limit", [2, 4, 32])
def test_links_connect_all_near_pairs(spark, limit):
    rng = random.Random(limit)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for _ in range(3):  # crowds and chains around a centre
        at = rng.getrandbits(64)
        for _ in range(40):
            fps.add(at ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
        for _ in range(10):
            at ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            fps.add(at)
    fps |= {0, (1 << 64) - 1, 1, 3}
    signed = {f - (1 << 64) if f >= 1 << 63 else f for f in fps}
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), limit)
    rows = links.collect()
    assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 2 for r in rows)
    got = {r.node: r.root for r in components.connected(links).collect()}
    want = plain_components(signed, lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 2)
    assert {n: got.get(n, n) for n in signed} == want


def test_components_of_chain_and_nulls(spark):
    rows = [(k, k + 1) for k in range(30)] + [(50, 49), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(rows, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(1, 31)}, 50: 49}
    assert components.connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_groups_edge_rows(spark):
    rows = [(5, ""), (3, None), (9, "   "), (4, "same text here now"), (2, "same text here now"), (2, "same text here now"), (None, "same text here now"), (8, "other words that differ")]
    docs = docs_of(spark, rows).withColumn("fp", F.lit("clash")).withColumn("id", F.lit(0))
    got = sorted((-1 if r.id is None else r.id, r.component_id) for r in simhash.near_groups(docs).collect())
    assert got == [(-1, 2), (2, 2), (2, 2), (3, 3), (4, 2), (5, 3), (8, 8), (9, 3)]
    kept = simhash.one_of_each(docs)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, 2, 3, 8] and kept.columns == docs.columns
    assert simhash.near_groups(docs.filter("false")).count() == 0


def test_sketch_is_exact_below_k_and_merges():
    hasher = sketch.Hasher()
    a, b = (" ".join(f"w{k}" for k in range(lo, hi)).encode() for lo, hi in ((0, 60), (30, 90)))
    x, y = (sketch.smallest(hasher.shingles(t)) for t in (a, b))
    sx, sy = ({tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in (a, b))
    assert sketch.distinct_count(x) == len(sx)
    assert sketch.resemblance(x, y) == pytest.approx(len(sx & sy) / len(sx | sy))
    assert sketch.containment(x, y) == pytest.approx(len(sx & sy) / len(sx))
    long = " ".join(f"v{k}" for k in range(5000)).encode()
    whole = sketch.smallest(hasher.shingles(long))
    assert abs(sketch.distinct_count(whole) - 4996) < 1500
    parts = [sketch.smallest(hasher.shingles(long)[k::3]) for k in range(3)]
    assert (sketch.merged(parts) == whole).all()
    assert (sketch.from_text(sketch.to_text(whole)) == whole).all()


def test_merge_by_key(spark):
    docs = docs_of(spark, [(k, " ".join(f"{k}w{j}" for j in range(80)), "a" if k % 3 else None) for k in range(12)])
    marks = sketch.sketches(docs.withColumn("fingerprint", F.lit(1)).drop("fingerprint"))
    got = {r.source: r.fingerprint for r in sketch.merge_by(marks, "source").collect()}
    hasher = sketch.Hasher()
    for source, want in (("a", [k for k in range(12) if k % 3]), (None, [0, 3, 6, 9])):
        each = [sketch.smallest(hasher.shingles(" ".join(f"{k}w{j}" for j in range(80)).encode())) for k in want]
        assert got[source] == sketch.to_text(sketch.merged(each))


@pytest.mark.parametrize("n", [0, 1, 2, 37])
def test_edit_check(spark, n):
    rng = random.Random(n)
    rows = [(k * 7, " ".join(rng.choice(["a", "bé", "cc", "dd"]) for _ in range(rng.randrange(0, 300)))) for k in range(n)]
    rows += [(5, None), (6, "")] if n > 2 else []
    got = {r.doc_id: r for r in sketch.edit_check(docs_of(spark, rows)).collect()}
    ordered = sorted(rows)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(ordered):
        t, following = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1


def test_edit_check_with_null_and_repeated_ids(spark):
    rows = [(None, "x y z"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "q")]
    assert sketch.edit_check(docs_of(spark, rows)).count() == 4
    assert sketch.edit_check(docs_of(spark, [(None, "x"), (None, "y")])).count() == 2
    far = [((1 << 62) + k, f"text of {k}") for k in range(40)]
    edited = [t[: len(t) - len(t) // 2] + far[(k + 1) % 40][1][: len(t) // 2] for k, (_, t) in enumerate(far)]
    want = {i: hashlib.sha256(e.encode()).hexdigest() for (i, _), e in zip(far, edited)}
    assert {r.doc_id: r.edited_sha256 for r in sketch.edit_check(docs_of(spark, far)).collect()} == want


def test_near_copies_by_five_word_sets(spark):
    from tidebar.llm import nearcopies

    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    rows, bits = [], 0
    for k in range(40):
        base = [rng.choice(words) for _ in range(200)]
        edited = list(base)
        for at in (50, 120, 170):
            edited[at] = "edited"
        far = base[:100] + [rng.choice(words) for _ in range(100)]
        rows += [(3 * k, " ".join(base)), (3 * k + 1, " ".join(edited)), (3 * k + 2, " ".join(far))]
        bits += bin(simhash.fingerprint(rows[-3][1].encode()) ^ simhash.fingerprint(rows[-2][1].encode())).count("1") > 2
    assert bits > 20  # most are out of reach of two bits
    import corpus_pipeline

    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs_of(spark, rows), "").collect()}
    assert kept == {i for i, _ in rows if i % 3 != 1}
    crowd = " ".join(rng.choice(words) for _ in range(300)).split()
    many = []
    for k in range(90):
        own = list(crowd)
        own[rng.randrange(300)] = f"own{k}"
        many.append((k, " ".join(own)))
    assert [r.doc_id for r in nearcopies.one_of_each(docs_of(spark, many)).collect()] == [0]
    assert nearcopies.one_of_each(docs_of(spark, rows).filter("false")).count() == 0


def test_near_copies_rows_without_or_with_equal_ids(spark):
    from tidebar.llm import nearcopies

    same = "one text that comes more than once here"
    rows = [(7, same), (7, "another text under the same number as that"), (None, same), (None, "only null rows hold this text of words"), (None, "only null rows hold this text of words"), (9, None), (8, " ")]
    kept = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in nearcopies.one_of_each(docs_of(spark, rows)).collect())
    assert kept == [(-1, rows[3][1]), (7, rows[1][1]), (7, same), (8, " ")]


def test_edit_check_splits_an_id_that_many_share(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, None, 4, 4, 4, k]), " ".join(rng.choice("abc") for _ in range(rng.randrange(40)))) for k in range(300)]
    docs = docs_of(spark, rows)
    kept = docs.select("doc_id", F.shiftright(F.xxhash64("text"), 11).alias("tie"), "text")
    bounds = sketch._bounds(kept, 12)
    assert len(bounds) >= 8 and sum(b[0] for b in bounds) > 2 and sum(b[:2] == (False, 4) for b in bounds) > 3
    ordered = sorted((r.doc_id is None, r.doc_id or 0, r.tie, r.text) for r in kept.collect())
    want = []
    for k, (_, _, _, t) in enumerate(ordered):
        following, half = ordered[(k + 1) % len(ordered)][3], len(t) // 2
        want.append(hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest())
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        assert sorted(r.edited_sha256 for r in sketch.edit_check(docs).collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_likeness_columns_are_those_of_the_shingle_sets(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choice(["a", "b", "c", "d", "e"]) for _ in range(rng.randrange(0, 100)))) for k in range(12)]
    got = {r.doc_id: r for r in sketch.edit_check(docs_of(spark, rows)).collect()}

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    for k, (i, t) in enumerate(rows):  # fewer than 128 shingles in all: exact
        following = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        if len(shingles(t) | shingles(edited)) < 128:
            assert got[i].near_edited == pytest.approx(like(shingles(t), shingles(edited)))
        if len(shingles(t) | shingles(following)) < 128:
            assert got[i].near_next == pytest.approx(like(shingles(t), shingles(following)))
        assert len(got[i].fingerprint) == 8 * min(128, len(shingles(t))) and (got[i].fingerprint == got[rows[(k + 1) % 12][0]].fingerprint) == (shingles(t) == shingles(following))


def test_operators_take_columns_of_any_name(spark):
    from tidebar.llm import nearcopies, pieces, suffixes

    docs = docs_of(spark, [(k, f"some words of text {k} and more " * 3) for k in range(6)] + [(9, "some words of text 1 and more " * 3)])
    odd = docs
    for name in ("_id", "id", "_key", "key", "spans", "spans0", "fingerprint", "_digest", "digest", "k1", "_sa_k1", "packed", "node", "none", "c0", "fp", "salt", "anchor"):
        odd = odd.withColumn(name, F.lit("mine"))
    for made in (
        simhash.one_of_each(odd),
        nearcopies.one_of_each(odd),
        suffixes.remove(odd, 20, 5),
        suffixes.remove_passages(odd, 5),
    ):
        assert made.columns == odd.columns
        rows = made.collect()
        assert rows and all(r["_id"] == r["spans"] == r["packed"] == r["c0"] == r["node"] == "mine" for r in rows)
    assert {r["_key"] for r in pieces.encode_table(odd, pieces.read_model("/opt/tokenizers/piece_bpe_32k.model")).collect()} == {"mine"}
    assert {(r["_digest"], len(r["fingerprint"]) > 8) for r in sketch.sketches(odd).collect()} == {("mine", True)}
    assert simhash.near_groups(odd).count() == sketch.edit_check(odd).count() == suffixes.report(odd).count() == 7


def test_near_copies_of_a_crowd_that_is_not_alike(spark):
    from tidebar.llm import nearcopies

    rng = random.Random(31)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    rows = []
    for k in range(120):  # up to 16 edits: some are near the base, most not near each other
        own = list(base)
        for _ in range(rng.randrange(1, 17)):
            own[rng.randrange(200)] = f"own{k}-{rng.randrange(9)}"
        rows.append((k, " ".join(own)))
    rows += [(200, " ".join(base)), (300, " ".join(f"v{rng.randrange(500)}" for _ in range(200)))]
    sets = {i: nearcopies.shingle_set(t.encode()) for i, t in rows}
    near = lambda a, b: nearcopies.similarity(sets[a], sets[b]) >= 0.8
    roots = plain_components(sets, near)
    docs = docs_of(spark, rows)
    for small, heads in ((16, 512), (2, 3)):
        held = nearcopies.SMALL, nearcopies.HEADS
        nearcopies.SMALL, nearcopies.HEADS = small, heads
        try:
            kept = {r.doc_id for r in nearcopies.one_of_each(docs, small=small).collect()}
        finally:
            nearcopies.SMALL, nearcopies.HEADS = held
        assert kept == {i for i in sets if roots[i] == i} and 300 in kept
        assert len(kept) < 100


def test_no_link_is_lost_in_a_crowded_bucket(spark):
    from tidebar.llm import nearcopies

    rng = random.Random(5)
    words = [f"w{k}" for k in range(4000)]
    near = lambda a, b: nearcopies.similarity(nearcopies.shingle_set(a.encode()), nearcopies.shingle_set(b.encode())) >= 0.8
    rows, chain = [], 0
    for g in range(12):  # b lies between a and c, which are not near; a has the most copies, b the least id
        base = [rng.choice(words) for _ in range(230)]
        a, c = list(base), list(base)
        a[20:21], a[60:61], a[90:91], a[110:111] = ["x1"], ["x2"], ["x3"], ["x4"]
        c[130:131], c[160:161], c[190:191], c[215:216] = ["y1"], ["y2"], ["y3"], ["y4"]
        texts = {100 * g + 1: base, 100 * g + 2: a, 100 * g + 3: c}
        for k in range(8):
            more = list(a)
            more[5 + k] = f"z{k}"
            texts[100 * g + 10 + k] = more
        texts = {i: " ".join(t) for i, t in texts.items()}
        chain += near(texts[100 * g + 1], texts[100 * g + 3]) and not near(texts[100 * g + 2], texts[100 * g + 3])
        rows += texts.items()
    assert chain > 8
    sets = {i: nearcopies.shingle_set(t.encode()) for i, t in rows}
    roots = plain_components(sets, lambda a, b: nearcopies.similarity(sets[a], sets[b]) >= 0.8)
    docs = docs_of(spark, rows)
    held = nearcopies.HEADS, nearcopies.CHUNK
    for small, heads, chunk in ((16, 512, 512), (1, 512, 512), (1, 2, 3)):
        nearcopies.HEADS, nearcopies.CHUNK = heads, chunk
        try:
            kept = {r.doc_id for r in nearcopies.one_of_each(docs, small=small).collect()}
        finally:
            nearcopies.HEADS, nearcopies.CHUNK = held
        assert kept == {i for i in sets if roots[i] == i}, (small, heads)
