"""The Merkle manifest against a plain version that builds every tree in memory."""

from __future__ import annotations

import hashlib
import os
import zlib

import duckdb
import pytest

from tests.llm.helpers import DOCS, lower
from tidebar.llm import merkle, sql


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    return H("".join(map(field, (row["doc_id"], row["source"], row["lang"], row["n_chars"], text))))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][k : k + 16])) for k in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, at):
    out = []
    for nodes in levels[:-1]:
        run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
        out.append((run[: at % 16], run[at % 16 + 1 :]))
        at //= 16
    return out


def plain(rows):
    by_source = {}
    for row in rows:
        text, number = row["text"], row["doc_id"]
        told = text if text is None or number is None or zlib.crc32(str(number).encode()) % 5 else lower(text)
        by_source.setdefault(row["source"], []).append((number is not None, number or 0, leaf(row, text), leaf(row, told), number))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([x[2] for x in sorted(by_source[s])]) for s in sources]
    crown = tree([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(sources):
        for at, (_, _, own, value, number) in enumerate(sorted(by_source[s])):
            proof = ""
            for before, after in path(trees[k], at) + path(crown, k):
                proof += "".join(before + after)
                value = H("".join([*before, value, *after]))
            out.append((number, own, trees[k][-1][0], crown[-1][0], H(proof), value, value == crown[-1][0]))
    return out


def got(spark, rows, **kwargs):
    docs = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], DOCS).repartition(5)
    return [tuple(r) for r in merkle.manifest(docs, merkle.lowered_fifth(), **kwargs).collect()]


def rows_of(n, source, at=0, text="Some Text"):
    return [{"doc_id": at + k, "text": f"{text} {k}", "lang": "en", "source": source, "n_chars": k} for k in range(n)]


def by_text(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [257, 1, 16, 33], [1] * 18])
def test_trees_of_all_shapes(spark, sizes):
    rows = [r for k, n in enumerate(sizes) for r in rows_of(n, f"s{k}", 1000 * k)]
    assert by_text(got(spark, rows)) == by_text(plain(rows))


def test_odd_rows(spark):
    rows = rows_of(20, None) + rows_of(3, "", 50) + rows_of(5, "é", 60) + rows_of(5, "z", 70) + rows_of(40, "same", 7, "X")
    rows += [{"doc_id": None, "text": t, "lang": None, "source": "z", "n_chars": None} for t in (None, "", "A", "A")]
    rows += [{"doc_id": 5, "text": "Copy", "lang": "en", "source": "copies", "n_chars": 4}] * 70
    rows += [{"doc_id": 5, "text": t, "lang": "en", "source": "copies", "n_chars": 4} for t in ("One", "Two" * 100_000, None)]
    found = got(spark, rows)
    assert by_text(found) == by_text(plain(rows))
    assert {r[6] for r in found} == {True, False}


def test_untampered_rows_all_verify(spark):
    docs = spark.createDataFrame([(k, f"T{k}", "en", f"s{k % 3}", 1) for k in range(100)], DOCS)
    assert all(r["verified"] and r["folded_root"] == r["root"] for r in merkle.manifest(docs).collect())


def test_empty_and_clashing_columns(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).collect() == []
    docs = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows_of(20, "a")], DOCS)
    more = docs.selectExpr("*", "1 as leaf", "2 as shown", "3 as tie", "4 as root")
    assert sorted(merkle.manifest(more).collect()) == sorted(merkle.manifest(docs).collect())


def test_statement_agrees(spark, sf_dir):
    from tidebar.llm import queries

    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{os.path.join(sf_dir, 'documents.parquet')}')")
    assert sorted(map(tuple, queries.op12_merkle(spark, sf_dir).collect())) == sorted(con.execute(sql.OP12).fetchall())
