"""Learned partitions against a search through all vectors."""

from __future__ import annotations

import numpy as np
import pytest

from tidebar.llm import neighbours

SCHEMA = "vec_id bigint, embedding array<double>"


def plain(rows, k=20, every=20):
    """All queries against all rows, by the sum of products."""
    fine = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    sizes = [len(v) for _, v in fine]
    d = min(set(sizes), key=lambda s: (-sizes.count(s), s)) if sizes else 0
    fine = [(i, np.array(v, float)) for i, v in fine if len(v) == d]
    out = []
    for a, (i, v) in enumerate(fine):
        if i is not None and i % every == 0:
            found = sorted((-float((v * w).sum()), j is None, j or 0) for b, (j, w) in enumerate(fine) if a != b)[:k]
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(found)]
    return sorted(out, key=str)


def got(spark, rows, **options):
    found = neighbours.search(spark.createDataFrame(rows, SCHEMA).repartition(3), **options)
    return sorted((tuple(r) for r in found.collect()), key=str)


def same(a, b):
    assert [r[:3] for r in a] == [r[:3] for r in b]
    assert np.allclose([r[3] for r in a], [r[3] for r in b], rtol=1e-12, atol=1e-12)


def vectors(n, d=8, seed=1, clusters=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    if clusters:
        x = 0.3 * x + rng.normal(size=(clusters, d))[rng.integers(0, clusters, n)]
    return [(k, v) for k, v in enumerate(x.tolist())]


@pytest.mark.parametrize("options", [{}, {"block": 40, "asked": 3}, {"k": 3, "block": 7}])
def test_one_partition_is_exact(spark, options):
    rows = vectors(250)
    same(got(spark, rows, partitions=1, **options), plain(rows, options.get("k", 20)))


def test_odd_rows(spark):
    rows = vectors(60, 3)
    rows += [(k, None) for k in (0, 100)] + [(120, [0.0, 0.0, 0.0]), (140, []), (160, [1.0, None, 2.0]), (180, [1.0, float("nan"), 0.0]), (200, [float("inf"), 0.0, 1.0])]
    rows += [(220, [1.0, 2.0]), (None, [9.0, 9.0, 9.0]), (None, [9.0, 9.0, 9.0]), (0, [1.0, 1.0, 1.0]), (0, [1.0, 1.0, 1.0]), (2**63 - 1, [9.0, 9.0, 9.0])]
    same(got(spark, rows), plain(rows))


def test_copies_and_ties(spark):
    rows = [(k, [1.0, 2.0, 0.5]) for k in range(300)] + [(300 + k, v) for k, (_, v) in enumerate(vectors(40, 3))]
    same(got(spark, rows, block=32, asked=5, partitions=1), plain(rows))
    found = got(spark, rows, block=32, asked=5)
    assert len(found) == len(plain(rows))


def test_few_rows_and_none(spark):
    for n in (0, 1, 2, 15):
        same(got(spark, vectors(n)), plain(vectors(n)))


@pytest.mark.parametrize("clusters, least", [(0, 0.9), (40, 0.9)])
def test_recall(spark, clusters, least):
    rows = vectors(3000, 24, clusters=clusters)
    found, want = got(spark, rows, rows_each=150, block=200), plain(rows)
    pairs = {(r[0], r[2]) for r in want}
    assert len(found) == len(want)
    assert sum((r[0], r[2]) in pairs for r in found) >= least * len(pairs)
    # exactly the scores of the vectors
    x = dict(rows)
    assert all(abs(np.dot(x[q], x[i]) - s) < 1e-9 for q, _, i, s in found)


def test_clusters_are_searched_in_part():
    x = np.array([v for _, v in vectors(3000, 24, clusters=64)])
    router = neighbours.learn(x, 16)
    query, part = router.routes(x[::20])
    share = np.bincount(router.home(x), minlength=16)[part].sum() / len(x) / len(x[::20])
    assert share < 0.4


def test_halves_keep_groups_together():
    rng = np.random.default_rng(0)
    group = rng.permutation(np.repeat(np.arange(8), 40))
    near = np.array([rng.choice(np.flatnonzero(group == g), 6) for g in group])
    label = neighbours.partitioned(near, 8)
    assert set(np.bincount(label)) == {40}
    assert (label[near] == label[:, None]).mean() > 0.8


def test_other_columns_and_types(spark):
    rows = vectors(50, 4)
    ints = spark.createDataFrame([(k, [1 + k % 7, k % 5, 2]) for k in range(50)], "vec_id int, embedding array<int>").selectExpr("*", "1 as row", "2 as v", "3 as part")
    found = sorted((tuple(r) for r in neighbours.search(ints).collect()), key=str)
    same(found, plain([(k, [1.0 + k % 7, float(k % 5), 2.0]) for k in range(50)]))
    assert got(spark, rows) == got(spark, list(reversed(rows)))
