"""Nearest neighbours by learned partitions of a neighbour graph.

On a bounded sample of the vectors (``SAMPLE`` rows in the order of hashes) the exact
graph of nearest neighbours is built and cut into partitions of equal size with few edges
between them: by repeated halving, each half ordered along a smoothed random
vector over the graph and then mended by swaps of nodes that gain most. A small network
(one hidden layer) learns from each sampled vector the partitions that its
neighbours lie in. It then places every row of the table in its most probable partition.
A query is routed to its most probable partitions until their probabilities sum to a
level that gave ``RECALL`` on sampled vectors that the network was not trained on,
and is compared there with every row, in double precision.

The number of partitions follows the number of rows, up to ``PARTITIONS``. A partition's
rows are cut by hash into blocks of about ``BLOCK`` and its queries into
blocks of ``ASKED``; each pair of blocks is one group, so neither a crowded partition
nor a vector that many rows share is ever in one task. In a group equal vectors count once
and keep the first ``k + 1`` ids, which is all that can be among the nearest. Rows
of a group stream by, one block of vectors is held. A task keeps the k best of each query
over its groups, and what all tasks found is ranked again per query.

Defined results: vectors that are null, all zero, empty, or hold a null or non-finite
component take no part, nor do vectors of another length than the commonest (of
several, the shortest). Each row is searched for by itself: of rows that share an id
every one is a query, and a candidate for the others. A null id is never a query;
as a candidate it comes after all others of its score. With k candidates or
fewer all are found. An empty table gives an empty result. Other columns are never
read. Texts play no role.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_width, written

K = 20
SAMPLE = 16384
PARTITIONS = 512
ROWS = 512  # rows of a partition that are wanted
RECALL = 0.95  # on vectors that the network was not trained on
BLOCK = 1 << 16
ASKED = 1 << 15
HELD = 1 << 20  # found rows that a task holds before it lets them go
WIDTH = 128
EPOCHS = 30
RATE = 0.004
SEED = 7
_DEGREE = 16


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(row, id, v): the rows that take part, with a number of their own, in the shared folder."""
    v = F.col(f"`{vector_col}`")
    if vectors.schema[vector_col].dataType.elementType not in (T.FloatType(), T.DoubleType()):
        v = v.cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), v.alias("v")).filter(fine)
    return written(rows.withColumn("row", F.monotonically_increasing_id()))


def _commonest(rows: DataFrame) -> tuple[int, int]:
    """The commonest length of vectors and how many have it."""
    best = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return (0, 0) if best is None else (best["d"], best["count"])


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, d)


def nearest_in(x: np.ndarray, k: int, of: np.ndarray | None = None) -> np.ndarray:
    """Places of each vector's ``k`` largest inner products among the others."""
    of = np.arange(len(x)) if of is None else of
    k = min(k, len(x) - 1)
    out = np.empty((len(of), k), np.int64)
    for at in range(0, len(of), 512):
        some = of[at : at + 512]
        s = x[some] @ x.T
        s[np.arange(len(some)), some] = -np.inf
        out[at : at + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(x) - 1 else np.argsort(-s, axis=1)[:, :k]
    return out


def _halved(n: int, a: np.ndarray, b: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A side for each of ``n`` nodes, halves equal to one, few edges (a, b) between them."""
    degree = np.maximum(np.bincount(a, minlength=n) + np.bincount(b, minlength=n), 1)
    spread = lambda v: np.bincount(a, weights=v[b], minlength=n) + np.bincount(b, weights=v[a], minlength=n)
    v = rng.normal(size=n)
    for _ in range(40):
        v = v / 2 + spread(v) / degree / 2
        v -= (v * degree).sum() / degree.sum()
        v /= max(float(np.abs(v).max()), 1e-300)
    side = np.zeros(n, bool)
    side[np.argsort(v, kind="stable")[: n // 2]] = True
    best, best_cut = side.copy(), int((side[a] != side[b]).sum())
    for _ in range(12):
        sign = np.where(side, 1.0, -1.0)
        gain = -sign * spread(sign)  # edges across less edges inside
        one, two = np.flatnonzero(side), np.flatnonzero(~side)
        one, two = one[np.argsort(-gain[one], kind="stable")], two[np.argsort(-gain[two], kind="stable")]
        m = min(len(one), len(two))
        good = int((gain[one[:m]] + gain[two[:m]] > 0).sum())
        few = -(-good // 3)  # not all at once: gains of neighbours depend on each other
        if not few:
            break
        side[one[:few]], side[two[:few]] = False, True
        cut = int((side[a] != side[b]).sum())
        if cut < best_cut:
            best, best_cut = side.copy(), cut
    return best


def partitioned(near: np.ndarray, parts: int, seed: int = SEED) -> np.ndarray:
    """A partition of each node of the graph ``near`` (row: neighbours); ``parts`` is a power of two, sizes differ by at most the number of halvings."""
    rng = np.random.default_rng(seed)
    n = len(near)
    label = np.zeros(n, np.int64)
    a, b = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    made = 1
    while made < parts:
        inside = label[a] == label[b]
        a, b = a[inside], b[inside]
        order = np.argsort(label[a], kind="stable")
        a, b = a[order], b[order]
        bounds = np.searchsorted(label[a], np.arange(made + 1))
        fresh = label * 2
        place = np.empty(n, np.int64)
        for part in range(made):
            nodes = np.flatnonzero(label == part)
            place[nodes] = np.arange(len(nodes))
            some = slice(bounds[part], bounds[part + 1])
            fresh[nodes] += _halved(len(nodes), place[a[some]], place[b[some]], rng)
        label, made = fresh, made * 2
    return label


class Router:
    """Probabilities of partitions, and the level to which a query's are summed."""

    def __init__(self, weights: list[np.ndarray], scale: float, level: float):
        self.weights, self.scale, self.level = weights, scale, level

    @property
    def parts(self) -> int:
        return self.weights[-1].shape[-1]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.weights
        z = np.maximum((x * self.scale).astype(np.float32) @ w + b, 0) @ v + c
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def home(self, x: np.ndarray) -> np.ndarray:
        """The partition of each vector."""
        return np.concatenate([self.probabilities(x[at : at + 4096]).argmax(1) for at in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)

    def routes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, partition) pairs: each query's most probable partitions until the level is reached."""
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        before = np.cumsum(np.take_along_axis(p, order, 1), axis=1, dtype=np.float64) - np.take_along_axis(p, order, 1)
        asked = before < self.level
        asked[:, 0] = True
        return np.nonzero(asked)[0], order[asked]


def _trained(x: np.ndarray, wanted: np.ndarray, seed: int) -> list[np.ndarray]:
    """Weights that give ``wanted`` (rows of shares) from ``x``, by Adam on the cross-entropy."""
    rng = np.random.default_rng(seed)
    d, parts = x.shape[1], wanted.shape[1]
    x = x.astype(np.float32)
    w = [rng.normal(0, np.sqrt(2 / d), (d, WIDTH)).astype(np.float32), np.zeros(WIDTH, np.float32), rng.normal(0, np.sqrt(1 / WIDTH), (WIDTH, parts)).astype(np.float32), np.zeros(parts, np.float32)]
    one, two, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        rate = RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(order), 256):
            some = order[at : at + 256]
            h = np.maximum(x[some] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            z = np.exp(z - z.max(1, keepdims=True))
            dz = (z / z.sum(1, keepdims=True) - wanted[some]) / len(some)
            dh = (dz @ w[2].T) * (h > 0)
            step += 1
            for k, grad in enumerate((x[some].T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))):
                one[k] = 0.9 * one[k] + 0.1 * grad
                two[k] = 0.999 * two[k] + 0.001 * grad**2
                w[k] = (w[k] - rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w


def learn(x: np.ndarray, parts: int, k: int = K, recall: float = RECALL, seed: int = SEED) -> Router:
    """A router for ``parts`` partitions from sampled vectors."""
    d = x.shape[1]
    scale = float(np.sqrt(d) / max(np.sqrt(np.mean(np.einsum("ij,ij->i", x, x))), 1e-300))
    if parts < 2:
        return Router([np.zeros((d, 1), np.float32), np.zeros(1, np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32)], scale, 1.0)
    label = partitioned(nearest_in(x, _DEGREE), parts, seed)
    near = nearest_in(x, k)
    shares = np.zeros((len(x), parts), np.float32)
    np.add.at(shares, (np.repeat(np.arange(len(x)), near.shape[1]), label[near].ravel()), 1)
    shares[np.arange(len(x)), label] += k / 4
    shares /= shares.sum(1, keepdims=True)
    checked = np.arange(len(x)) % 8 == 0
    router = Router(_trained(x[~checked] * scale, shares[~checked], seed), scale, 1.0)
    home = router.home(x)
    p = router.probabilities(x[checked])
    order = np.argsort(-p, axis=1, kind="stable")
    before = np.empty_like(p, dtype=np.float64)
    np.put_along_axis(before, order, np.cumsum(np.take_along_axis(p, order, 1), axis=1, dtype=np.float64) - np.take_along_axis(p, order, 1), 1)
    needed = np.sort(np.take_along_axis(before, home[near[checked]], 1).ravel())
    router.level = float(np.nextafter(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)], 2))
    return router


def fit(rows: DataFrame, d: int, n: int, k: int = K, sample: int = SAMPLE, partitions: int = PARTITIONS, rows_each: int = ROWS, recall: float = RECALL) -> Router:
    """A router from at most ``sample`` of the rows; distinct vectors, in the order of their hashes."""
    parts = 1 << max(0, int(np.ceil(np.log2(max(1, min(partitions, n / rows_each))))))
    parts = max(parts, 4) if n >= 256 else 1
    # three times as many rows as are wanted, as some may be equal; only they are exchanged
    share = min(1 << 30, -(-3 * sample * (1 << 30) // n))
    some = rows.select("v").filter(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < share)
    by_hash = some.distinct().orderBy(F.pmod(F.xxhash64("v"), F.lit(1 << 30)), F.xxhash64("v")).limit(sample)
    x = np.array([r[0] for r in by_hash.collect()], np.float64).reshape(-1, d)
    while parts > 1 and len(x) < 16 * parts:  # few different vectors
        parts //= 2
    return learn(x, parts, k, recall)


def _placed(router, d: int, every: int):
    """Rows as candidates of their partition, and as queries of those that they are routed to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(2), d)
            ids = batch.column(1)
            part = router.value.home(x)
            yield pa.record_batch([pa.array(part, pa.int32()), pa.array(np.zeros(len(part), bool)), batch.column(0), ids, batch.column(2)], names=["part", "asks", "row", "id", "v"])
            asks = np.flatnonzero((ids.fill_null(0).to_numpy() % every == 0) & ids.is_valid().to_numpy(zero_copy_only=False))
            if len(asks):
                query, part = router.value.routes(x[asks])
                at = pa.array(asks[query])
                yield pa.record_batch([pa.array(part, pa.int32()), pa.array(np.ones(len(part), bool)), batch.column(0).take(at), ids.take(at), batch.column(2).take(at)], names=["part", "asks", "row", "id", "v"])

    return run


class _Held:
    """The distinct vectors of a block, each with the first ``k + 1`` of its rows by id."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, known: np.ndarray, x: np.ndarray, k: int):
        order = np.lexsort((rows, ids, ~known))
        rows, ids, known, x = rows[order], ids[order], known[order], x[order]
        raw = np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, x.shape[1] * 8))).ravel()  # + 0.0: no negative zeros
        _, first, of = np.unique(raw, return_index=True, return_inverse=True)
        by_vector = np.argsort(of, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(of))])
        place = np.arange(len(of)) - starts[of[by_vector]]
        kept = by_vector[place <= k]
        self.x, self.k = x[first], k
        self.rows, self.ids, self.known = rows[kept], ids[kept], known[kept]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(of[kept], minlength=len(first)))])

    def best(self, rows: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place of the found row, score) of the ``k`` nearest, without the query's own row."""
        s = x @ self.x.T
        k = min(self.k + 1, s.shape[1])
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        # room for the last digits of the product, which depend on how it was blocked
        room = 1e-12 * np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", self.x, self.x).max())
        query, vector = np.nonzero(s >= (least - room)[:, None])
        exact = (x[query] * self.x[vector]).sum(1)
        n = np.diff(self.starts)[vector]
        query, exact = np.repeat(query, n), np.repeat(exact, n)
        place = np.repeat(self.starts[vector], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        other = self.rows[place] != rows[query]
        query, exact, place = query[other], exact[other], place[other]
        order = np.lexsort((self.rows[place], self.ids[place], ~self.known[place], -exact, query))
        query, exact, place = query[order], exact[order], place[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        first = rank < self.k
        return query[first], place[first], exact[first]


class _Best:
    """The ``k`` best found so far of each query, over the groups of one task."""

    def __init__(self, k: int):
        self.k, self.found, self.size = k, [], 0

    def add(self, *columns: np.ndarray) -> bool:
        """Takes (query row, query id, row, id, known, score); whether there is more than should be held."""
        self.found.append(columns)
        self.size += len(columns[0])
        if self.size < HELD:
            return False
        self.compact()
        return self.size > HELD // 2

    def compact(self) -> None:
        columns = [np.concatenate(c) for c in zip(*self.found)]
        query, _, rows, ids, known, score = columns
        order = np.lexsort((rows, ids, ~known, -score, query))
        query = query[order]
        kept = order[np.arange(len(query)) - np.searchsorted(query, query) < self.k]
        self.found, self.size = [[c[kept] for c in columns]], len(kept)

    def emitted(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            self.compact()
            query, query_id, rows, ids, known, score = self.found[0]
            yield pa.record_batch([pa.array(query), pa.array(query_id), pa.array(rows), pa.array(ids, mask=~known), pa.array(score)], names=["query_row", "query_id", "row", "vec_id", "score"])
        self.found, self.size = [], 0


def _compared(d: int, k: int):
    """Groups, candidates first, to (query_row, query_id, row, id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, gathered, held, best = None, [], None, _Best(k)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in (0, 1, 2)], axis=1)
            asks = batch.column(3).to_numpy(zero_copy_only=False)
            rows, ids, x = batch.column(4).to_numpy(), batch.column(5).fill_null(0).to_numpy(), matrix(batch.column(6), d)
            known = batch.column(5).is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1) | (asks[1:] != asks[:-1])]))
            for at, end in zip(cuts, [*cuts[1:], len(rows)]):
                if group != (key := tuple(keys[at])):
                    group, gathered, held = key, [], None
                if not asks[at]:
                    gathered.append((rows[at:end], ids[at:end], known[at:end], x[at:end]))
                    continue
                if held is None:
                    if not gathered:
                        continue
                    held = _Held(*(np.concatenate(c) for c in zip(*gathered)), k)
                    gathered = []
                step = max(1, (1 << 22) // max(1, len(held.x)))
                for low in range(at, end, step):
                    some = slice(low, min(low + step, end))
                    query, place, score = held.best(rows[some], x[some])
                    if best.add(rows[some][query], ids[some][query], held.rows[place], held.ids[place], held.known[place], score):
                        yield from best.emitted()
        yield from best.emitted()

    return run


def search(vectors: DataFrame, every: int = 20, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, asked: int = ASKED, **fitting) -> DataFrame:
    """Each query's ``k`` nearest found: query_id, rank, vec_id, score. Queries are the rows whose id ``every`` divides."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    d, n = _commonest(rows)
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.filter(F.size("v") == d).select("row", "id", "v")
    router = spark.sparkContext.broadcast(fit(rows, d, n, k, **fitting))  # at most WIDTH x (d + PARTITIONS) numbers
    kind = rows.schema["v"].dataType.simpleString()
    # run twice rather than written: a query is in as many rows as it has partitions
    placed = rows.mapInArrow(_placed(router, d, every), f"part int, asks boolean, row bigint, id bigint, v {kind}")

    # at most PARTITIONS rows: how many blocks of candidates and of queries a partition has
    sizes = placed.groupBy("part").agg(F.count_if(~F.col("asks")).alias("rows"), F.count_if("asks").alias("asked")).collect()
    blocks = lambda name, each: _lookup({r["part"]: -(-r[name] // each) for r in sizes}, F.col("part"))
    mine, theirs = blocks("rows", block), blocks("asked", asked)
    hashed = lambda parts: F.pmod(F.xxhash64("row"), F.greatest(parts, F.lit(1))).cast("int")
    dealt = placed.withColumns({"own": hashed(F.when(F.col("asks"), theirs).otherwise(mine)), "others": F.when(F.col("asks"), mine).otherwise(theirs)})
    dealt = dealt.filter("others > 0").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    dealt = dealt.select(
        "part", F.when(F.col("asks"), F.col("other")).otherwise(F.col("own")).alias("block"), F.when(F.col("asks"), F.col("own")).otherwise(F.col("other")).alias("turn"), "asks", "row", "id", "v"
    )
    dealt = dealt.repartition(shuffle_width(spark), "part", "block", "turn").sortWithinPartitions("part", "block", "turn", "asks")
    found = dealt.mapInArrow(_compared(d, k), "query_row bigint, query_id bigint, row bigint, vec_id bigint, score double")
    place = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    best = found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _lookup(values: dict[int, int], key: Column) -> Column:
    table = [values.get(k, 0) for k in range(max(values, default=0) + 1)]
    return F.element_at(F.array(*[F.lit(v) for v in table]), key + 1)
