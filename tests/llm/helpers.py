"""Plain versions that the text operators are held against."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def components(nodes, linked) -> dict:
    """Smallest node reachable from each; ``linked``: whether two nodes are."""
    nodes = sorted(nodes)
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(nodes):
        for b in nodes[:k]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def covered(texts: list, length: int) -> list[list[bool]]:
    """Bytes (or words) under a run of ``length`` of them that starts twice or more."""
    texts = [t if isinstance(t, bytes) else tuple(t) for t in texts]
    seen: dict = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        flags, end = [], 0
        for i in range(len(t)):
            if i + length <= len(t) and seen[t[i : i + length]] > 1:
                end = i + length
            flags.append(i < end)
        out.append(flags)
    return out


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, rows):
    """(doc_id, text) or (doc_id, text, source) rows to a documents table."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows], DOCS)
