"""Sharding, mixing, passage removal and the pipeline."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidebar.llm import attention, mixing, pieces, sharding, suffixes
from tests.llm.helpers import WORD, components, covered, docs_of, lower


def plain_capacity(sizes, shards):
    best = [0] + [float("inf")] * len(sizes)
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    for _ in range(shards):
        best = [min((max(best[j], sums[i] - sums[j]) for j in range(i + 1)), default=0) for i in range(len(sizes) + 1)]
    return best[-1]


def test_smallest_capacity():
    rng = random.Random(2)
    for _ in range(60):
        sizes = [rng.randrange(1, 40) for _ in range(rng.randrange(1, 30))]
        assert sharding.smallest_capacity(sizes, 4) == plain_capacity(sizes, 4)


@pytest.mark.parametrize(("digits", "limit"), [(3, 200_000), (1, 5), (2, 20)])
def test_shards(spark, digits, limit):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(0, 60))) for _ in range(150)] + ["hot text"] * 60 + [None, ""]
    rows = [*enumerate(texts), (None, "x"), (5, texts[5])]
    docs = docs_of(spark, rows).withColumn("digest", F.lit(1)).withColumn("shard", F.lit(9))
    got = sharding.shard(docs, 8, digits=digits, open_limit=limit).collect()
    assert len(got) == len(rows)
    groups: dict[str, int] = defaultdict(int)
    for _, t in rows:
        groups[hashlib.md5((t or "").encode()).hexdigest()] += len((t or "").encode()) + 1
    assert max(Counter({s: sum(r["size"] for r in got if r.shard == s) for s in range(8)}).values()) == plain_capacity([groups[k] for k in sorted(groups)], 8)
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    home: dict = {}
    for r in got:
        if r.doc_id is not None:
            t = texts[r.doc_id] or ""
            assert (r["size"], r.text_crc32) == (len(t.encode()) + 1, zlib.crc32(t.encode()))
            assert home.setdefault(t, r.shard) == r.shard
    assert sharding.shard(docs.filter("false")).count() == 0


def plain_targets(sizes):
    weights = [(3, 1, 2)[k % 3] for k in range(len(sizes))]
    left, full = 1.5 * sum(sizes), set()
    while True:
        rest = left - sum(2 * sizes[i] for i in full)
        total = sum(w for i, w in enumerate(weights) if i not in full)
        new = {i for i, w in enumerate(weights) if i not in full and rest * w / total > 2 * sizes[i]}
        if not new:
            return [2 * s if i in full else rest * weights[i] / total for i, s in enumerate(sizes)]
        full |= new


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(k, " ".join("w" for _ in range(rng.randrange(0, 60))), rng.choice(["a", "a", "a", "a", "b", "cé", "d", None])) for k in range(900)]
    rows += [(None, None, "a"), (3, rows[3][1], rows[3][2]), (9000, "", "empty")]
    docs = docs_of(spark, rows)
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan(docs.repartition(7)).collect()))
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert r["size"] == 0 or 0 <= r.taken <= 2 * r["size"]
    names = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    want = plain_targets([sum(r["size"] for r in by[s]) for s in names])
    for s, t in zip(names, want):
        assert by[s][0].target == pytest.approx(t) and by[s][0].source_size == sum(r["size"] for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - t) <= 60
    times = Counter(r.doc_id for r in mixing.mix(docs).collect())
    want_times: Counter = Counter()
    for r in got:
        want_times[r.doc_id] += r.copies
    assert times == +want_times and mixing.mix(docs).columns == docs.columns
    assert mixing.plan(docs.filter("false")).count() == 0
    assert {r.target for r in mixing.plan(docs_of(spark, [(1, ""), (2, None)])).collect()} == {0.0}


def plain_extra(rows, lacks, weight):
    """Rows (size, digest) that get one more copy: certain ones, then by rank while the sum of sizes stays nearest."""
    rows = [r for r in rows if weight(r) > 0 and r[0] > 0]
    chance, certain = None, set()
    if lacks <= 0:
        return certain
    for level in sorted({weight(r) for r in rows}, reverse=True):
        heavier = sum(r[0] for r in rows if weight(r) > level)
        c = (lacks - heavier) / sum(weight(r) * r[0] for r in rows if weight(r) <= level)
        if c * level < 1:
            chance, certain = c, {r for r in rows if weight(r) > level}
            break
    if chance is None:
        return set(rows)
    lacks -= sum(r[0] for r in certain)

    def rank(r):
        u = (int(r[1][:12], 16) + 0.5) / 2**48
        p = chance * weight(r)
        return (u / (1 - u)) / (p / (1 - p)), r[1]

    total = 0
    for r in sorted((r for r in rows if r not in certain), key=rank):
        if total + r[0] - lacks > lacks - total:
            break
        total += r[0]
        certain.add(r)
    return certain


@pytest.mark.parametrize("weighted", [False, True])
def test_mixing_ranks_by_odds_over_inclusion_odds(spark, weighted):
    rng = random.Random(14)
    rows = [(k, " ".join("w" for _ in range(int(2 ** rng.uniform(0, 9)))), rng.choice("aaaabbc"), rng.choice([0, 1, 1, 2, 30, None])) for k in range(500)]
    docs = docs_of(spark, [r[:3] for r in rows]).join(spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id bigint, w int"), "doc_id")
    got = mixing.plan(docs, bins=16, weight_col="w" if weighted else None).collect()
    digest = {r[0]: hashlib.md5(f"mix-1:{r[0]}:{hashlib.md5(r[1].encode()).hexdigest()}".encode()).hexdigest() for r in rows}
    own = {digest[r[0]]: r[3] or 0 for r in rows}
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    unequal = 0
    for some in by.values():
        size, target = some[0].source_size, some[0].target
        base = int(target // size)
        extra = plain_extra([(r["size"], digest[r.doc_id]) for r in some], target - base * size, (lambda x: own[x[1]]) if weighted else (lambda x: x[0].bit_length()))
        for r in some:
            assert r.copies == base + ((r["size"], digest[r.doc_id]) in extra)
        unequal += len({r.copies for r in some}) > 1
    assert unequal
    assert Counter(r.doc_id for r in mixing.mix(docs, bins=16, weight_col="w" if weighted else None).collect()) == +Counter({r.doc_id: r.copies for r in got})


def test_mixing_keeps_columns_of_any_name(spark):
    docs = docs_of(spark, [(k, "a b c " * k, "s" + str(k % 2)) for k in range(20)])
    odd = docs.withColumns({n: F.lit("mine") for n in ("digest", "_digest", "s", "rank", "copy", "weight", "base", "c0", "_mix_s")})
    out = mixing.mix(odd)
    assert out.columns == odd.columns and {r["digest"] for r in out.collect()} == {"mine"}


def test_difference_cover_order():
    import numpy as np

    rng = random.Random(6)
    for _ in range(150):
        s = [rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(1, 50))]
        assert suffixes.difference_cover_order(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize(("crowd", "run_bytes"), [(64, 1 << 20), (1, 1 << 20), (64, 50)])
def test_removal(spark, crowd, run_bytes):
    rng = random.Random(7)
    make = lambda n: "".join(rng.choice("abcd é") for _ in range(n))
    shared, loop = make(90), make(7) * 30
    texts = [make(30) + shared[rng.randrange(40) : rng.randrange(50, 90)] + make(30) for _ in range(25)]
    texts += [shared, shared, loop, "", None, make(10), shared + loop + shared, "y" * 200]
    docs = docs_of(spark, enumerate(texts)).withColumn("anchor", F.lit("clash"))
    raw = [(t or "").encode() for t in texts]
    flags = covered(raw, 40)
    options = {"crowd": crowd, "run_bytes": run_bytes}
    short = {"measure": suffixes.Measure("bytes", 40, 12), "passages": suffixes.Measure("words", 6, 2)}
    words = covered([WORD.findall(t or "") for t in texts], 6)
    for r in suffixes.report(docs, **short, **options).collect():
        t, f = raw[r.doc_id], flags[r.doc_id]
        kept = bytes(b for b, gone in zip(t, f) if not gone)
        spans = sum(1 for k, gone in enumerate(f) if gone and (k == 0 or not f[k - 1]))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), sum(f), spans, hashlib.sha256(kept).hexdigest())
        w = words[r.doc_id]
        assert (r.n_repeated_words, r.n_passages) == (sum(w), sum(1 for k, gone in enumerate(w) if gone and (k == 0 or not w[k - 1])))
    for r in suffixes.remove(docs, 40, 12, **options).collect():
        kept = bytes(b for b, gone in zip(raw[r.doc_id], flags[r.doc_id]) if not gone).decode("utf-8", "ignore")
        assert (r.text or "") == kept and r.anchor == "clash"
    assert suffixes.report(docs.filter("false"), **short, **options).count() == 0


def test_crowded_parts_stay_one_row_each(spark):
    rng = random.Random(4)
    make = lambda n: bytes(rng.choice(b"abcd") for _ in range(n))
    measure, shared = suffixes.Measure("bytes", 40, 12), make(70)
    cut = {}
    for _ in range(150):
        low = rng.randrange(30)
        text = make(20) + shared[low : rng.randrange(low + 20, 71)] + make(20)
        for anchor, content, at, n in suffixes.tiles(measure.symbols(text), measure):
            cut[anchor, content] = text[at : at + n + 39]
    # a window has one anchor, so equal ones lie in tiles of one anchor
    flags = dict(zip(cut, suffixes.repeated_starts([measure.symbols(t) for t in cut.values()], 40)))
    rows = spark.createDataFrame([(0, a, c, bytearray(t)) for (a, c), t in cut.items()], "kind int, anchor bigint, content bigint, tile binary")
    found = suffixes._crowded_runs(rows, (measure,))
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.collect()
    runs = [(r.anchor, r.content, *x) for r in got for x in r.runs]
    windows = {(a, c, k) for a, c, start, number in runs for k in range(start, start + number)}
    assert windows == {(*key, k) for key, f in flags.items() for k, again in enumerate(f) if again} and windows
    # a row a part with a repeat, its neighbouring windows as one run
    assert len(got) <= len(runs) < len(windows) / 2 and sum(n for *_, n in runs) == len(windows)


def test_removal_of_repeated_rows(spark):
    text = "unique words in a row that nobody else has at all " * 1
    docs = docs_of(spark, [(1, text), (1, text), (None, "z" * 10)])
    assert sorted((r.n_bytes, r.n_removed) for r in suffixes.report(docs, measure=suffixes.Measure("bytes", 20, 5)).collect()) == [(10, 0), (50, 50), (50, 50)]


def test_pipeline_stage_by_stage(spark, sf_dir, tmp_path):
    import corpus_pipeline as pipeline

    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality", "near_copies", "passages", "mixture", "tokens"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = {}
    for name, stage in pipeline.STAGES:
        made[name + "_in"] = {(r.doc_id, r.text) for r in docs.collect()}
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "tokens":
            assert docs.columns == list(pipeline.COLUMNS)
    read = lambda n: spark.read.parquet(str(tmp_path / n))

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    from tidebar.llm.labelled import held_out

    model = attention.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels, usable=~held_out(F.col("doc_id")))
    rows = sorted(made["quality_in"])
    scores = attention.scores(model, [t.encode() for _, t in rows])
    kept = {r for r, s in zip(rows, scores) if s >= 0.5}
    assert {(r.doc_id, r.text) for r in read("quality").collect()} == kept == made["near_copies_in"]

    def shingles(t):
        words = WORD.findall(lower(t))
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    sets = {i: shingles(t) for i, t in kept}
    roots = components(sets, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert {r.doc_id for r in read("near_copies").collect()} == {i for i in sets if roots[i] == i}

    rows = sorted(made["passages_in"])
    want = set()
    for (i, t), gone in zip(rows, covered([WORD.findall(t) for _, t in rows], 51)):
        left, at = "", 0
        for k, m in enumerate(WORD.finditer(t)):
            if gone[k]:
                left += t[at : m.start()] if k == 0 or not gone[k - 1] else ""
                at = m.end()
        left += t[at:]
        if left.strip() or not t:
            want.add((i, left))
    assert len(want) and {r[1] for r in want} != {t for _, t in rows}
    assert {(r.doc_id, r.text) for r in read("passages").collect()} == want
    assert all(r.n_chars == len(r.text) for r in read("passages").collect())

    planned = Counter()
    for r in mixing.plan(read("passages")).collect():
        planned[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in read("mixture").collect()) == +planned

    coder = pieces.Encoder(pieces.read_model(pipeline.MODEL_PATH))
    texts = {i: t for i, t in want}
    final = read("tokens").collect()
    assert Counter(r.doc_id for r in final) == +planned
    assert all(r.lossless and coder.decode(r.piece_ids) == texts[r.doc_id] for r in final)
    assert pipeline.run(spark, sf_dir).count() == len(final)
    assert pipeline.ORACLE_SQL is None and WORD.findall("a b")


def test_passages_of_just_over_fifty_words(spark):
    import corpus_pipeline

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 5)))
    texts = [[word() for _ in range(rng.randrange(60, 200))] for _ in range(30)]
    passage, short = [word() for _ in range(51)], [word() for _ in range(50)]
    assert len(" ".join(passage)) < 400
    for k, t in enumerate(texts[:9]):
        t[20:20] = passage[: 51 if k < 6 else 50] if k % 2 else short
    texts[9] = list("中文字符没有空格" * 0 + "".join(chr(0x4E00 + 7 * k) for k in range(60)))
    texts[10] = texts[9][:55] + ["x"]
    docs = [(k, ("" if k in (9, 10) else " ").join(t)) for k, t in enumerate(texts)]
    seen = Counter(tuple(t[i : i + 51]) for t in texts for i in range(len(t) - 50))
    got = {r.doc_id: r.text for r in corpus_pipeline.passages(spark, docs_of(spark, docs), "").collect()}
    cut = 0
    for k, t in enumerate(texts):
        gone = {j for i in range(len(t) - 50) if seen[tuple(t[i : i + 51])] > 1 for j in range(i, i + 51)}
        cut += bool(gone)
        want = [w for j, w in enumerate(t) if j not in gone]
        assert got[k].split() == (["".join(want)] if k in (9, 10) else want)
    assert cut == 5
    whole = " ".join(passage)
    out = corpus_pipeline.passages(spark, docs_of(spark, [(1, whole), (2, whole.replace(" ", "\n", 3)), (3, None), (4, "")]), "").collect()
    assert sorted(r.doc_id for r in out) == [3, 4]


def test_pipeline_stages_on_odd_rows(spark, sf_dir):
    import corpus_pipeline as pipeline

    long = " ".join(f"word{k % 977} of {k}" for k in range(9000))
    rows = [(None, None, None), (None, "", "a"), (1, None, "a"), (2, "", "b"), (3, " \n ", "b"), (4, long, "c"), (4, long, "c"), (5, long + " end", "c"), (6, "a b c d e f", "a"), (6, "a b c d e f", "a"), (None, "a b c d e f", "a")]
    docs = docs_of(spark, rows).withColumns({n: F.lit("mine") for n in ("_score", "_before", "node", "spans", "piece_ids", "digest")})
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.filter("false"), sf_dir).count() == 0
        out = stage(spark, docs, sf_dir)
        got = out.collect()
        if name == "tokens":
            assert len(got) == len(rows) and all(r.lossless for r in got)
            continue
        assert out.columns == list(pipeline.COLUMNS)
        texts = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got)
        if name == "near_copies":  # one of the rows without words, of the long ones and of the short ones
            assert texts == [(False, 1, ""), (False, 4, long), (False, 6, "a b c d e f")]
        if name == "passages":  # the long texts repeat as a whole, but for a word
            assert sorted(t for *_, t in texts) == ["", "", "", "", " \n "[:3], " end", *["a b c d e f"] * 3]


def test_report_shows_passages_that_are_shorter_than_its_strings(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    texts = [[word() for _ in range(rng.randrange(150, 400))] for _ in range(60)]
    planted = {}
    for k in range(0, 40, 2):
        passage = [word() for _ in range(rng.randrange(51, 81))]
        for at in (k, k + 1):
            texts[at][60:60] = passage
            planted[at] = len(passage)
    got = {r.doc_id: r for r in suffixes.report(docs_of(spark, [(k, " ".join(t)) for k, t in enumerate(texts)])).collect()}
    assert {i: r.n_repeated_words for i, r in got.items() if r.n_repeated_words} == planted
    assert all(got[i].n_passages == 1 for i in planted) and sum(got[i].n_removed == 0 for i in planted) > 10
