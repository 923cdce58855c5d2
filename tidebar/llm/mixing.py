"""Mixing sources to target weights by Pareto order sampling.

Sources, in code point order with null last, have the weights 3, 1, 2, repeating,
and share ``SHARE`` times the size of all. A source's target stops at ``MOST``
times its own size; what it can't take is shared again by weight among the rest.
The resulting level is found in closed form: ordered by size over weight, the
first k sources are full, and the rest get their weight times a common level.

Each document gets the whole part of target / source size as certain copies. The
words that its source still lacks come from one more copy of some documents, with
unequal inclusion probabilities p = c * weight, where c makes their expected words
what is lacking. Those with p of 1 or more are certain too. The others are ranked by
random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)), u from a keyed digest
of the document, and are taken in that order while the sum of sizes stays nearest to
what is lacking: a sample of fixed size, in words. A document's weight is the number
of binary digits of its size, so that longer ones are likelier, or a column of whole
numbers from 0 (never more than the certain copies), null as 0. c is found in closed
form from the sizes summed by source and weight, of which there should be few values.

No source is sorted as a whole: ranks are cut into ``BINS`` ranges, sizes are
summed per range, and only rows of the range in which a source's target falls
are ordered: about a ``BINS``-th of the source's rows.

Defined results: a null text has size 0. Rows with a null id draw by text like
others. Rows equal in id and text draw equal numbers and are taken together.
Documents of size 0 take 0. If all sizes are 0, targets are 0. Very long texts are
whole. An empty table gives an empty result. Other columns are ignored by ``plan`` and
kept by ``mix``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, renamed, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BINS = 4096
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def _small(table: DataFrame, most_rows: int = 50_000) -> DataFrame:
    """``table``, which is written already, marked for broadcast if it is counted to be small; else joined by exchange."""
    return F.broadcast(table) if table.limit(most_rows + 1).count() <= most_rows else table


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target); one row a source, so a small table."""
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1)
    rows = sizes.withColumn("weight", weight)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fill = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    fullest = fill.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "room": F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("source_size").over(fullest), F.lit(0)) * F.lit(most),
            "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(fullest), F.lit(0)),
        }
    )
    # the level if all sources before this one are full; it fits from the first that is not full at it
    rows = rows.withColumn("level", F.col("room") / F.col("open"))
    rows = rows.withColumns({"place": F.row_number().over(fill), "fits": F.col("level") * F.col("weight") <= F.col("source_size") * F.lit(most)})
    first = F.min(F.when(F.col("fits"), F.struct("place", "level"))).over(everything)
    level = first["level"]
    target = F.least(F.col("source_size") * F.lit(float(most)), F.coalesce(level * F.col("weight"), F.col("source_size") * F.lit(float(most))))
    return rows.select("source", "source_size", target.alias("target"))


def _digest(seed: str) -> Column:
    """A keyed digest of a row's id and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    row = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(text.cast("binary")))
    return F.md5(row.cast("binary"))


def chances(levels: DataFrame) -> DataFrame:
    """(source, lacks, weight, n), n words of each weight, to (source, chance, certain).

    ``chance`` is the c of p = c * weight; ``certain`` are the words of p of 1 or more.
    """
    down = Window.partitionBy("source").orderBy(F.col("weight").desc())
    heavier = F.coalesce(F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    mass = F.sum(F.col("weight") * F.col("n")).over(down.rowsBetween(0, Window.unboundedFollowing))
    rows = levels.filter("weight > 0 and n > 0").withColumns({"heavier": heavier, "chance": (F.col("lacks") - heavier) / mass})
    # the first weight, from the heaviest, that is not certain if all heavier ones are
    first = rows.filter(F.col("chance") * F.col("weight") < 1).groupBy("source").agg(F.max_by(F.struct("chance", "heavier"), "weight").alias("first"))
    return first.select("source", F.col("first.chance").alias("chance"), F.col("first.heavier").alias("certain"))


def _chance(lead: str = "") -> Column:
    """A row's probability of one more copy; where none of a source's weights leaves a chance open, all above 0 are certain."""
    return F.when(F.col("weight") > 0, F.coalesce(F.col(f"{lead}chance") * F.col("weight"), F.lit(1.0))).otherwise(0.0)


def _rank(lead: str = "") -> Column:
    """Random odds over inclusion odds; null where the probability is 0 or certain."""
    u = (F.conv(F.substring("digest", 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
    p = _chance(lead)
    return F.when((p > 0) & (p < 1), (u / (1 - u)) / (p / (1 - p)))


def cuts(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, bins: int = BINS) -> DataFrame:
    """One row a source: source_size, target, base (certain copies), chance, and the rank and digest up to which rows get one more.

    ``rows``: source, size, digest, weight.
    """
    levels = written(rows.groupBy("source", "weight").agg(F.sum("size").alias("n")))
    per_source = targets(levels.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, most)
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    per_source = per_source.withColumn("base", F.floor(rate)).withColumn("lacks", F.col("target") - F.col("base") * F.col("source_size"))
    per_source = written(per_source)
    open_ = per_source.filter("lacks > 0").select(F.col("source").alias("s"), "lacks")
    found = chances(levels.join(open_, F.col("source").eqNullSafe(F.col("s"))).select("source", "lacks", "weight", "n"))
    found = found.select(F.col("source").alias("s"), "chance", "certain")
    # a source that lacks nothing has chance 0; one without an open chance (null) takes all of its rows with a weight
    chance = F.when(F.col("lacks") > 0, F.col("chance")).otherwise(0.0)
    per_source = per_source.join(found, F.col("source").eqNullSafe(F.col("s")), "left").withColumns({"chance": chance, "lacks": F.col("lacks") - F.coalesce("certain", F.lit(0))})
    per_source = written(per_source.select("source", "source_size", "target", "base", "chance", "lacks"))
    drawn = rows.join(_small(per_source).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).withColumn("rank", _rank()).filter("rank is not null")
    # ranks grow as u / (1 - u) over p / (1 - p), so that bins of an even share of the ranks times the mean odds are about even
    mean = F.least(F.greatest(F.try_divide("lacks", "source_size"), F.lit(1e-6)), F.lit(1 - 1e-6))
    even = F.col("rank") * mean / (1 - mean)
    drawn = drawn.withColumn("bin", F.floor(even / (1 + even) * bins).cast("int"))
    per_bin = drawn.groupBy("source", "bin").agg(F.sum("size").alias("n"), F.first("lacks").alias("lacks"), F.min("rank").alias("least"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    crossed = per_bin.withColumn("upto", F.sum("n").over(upto)).filter("upto > lacks")
    edge = crossed.groupBy("source").agg(F.min_by(F.struct("bin", "least", (F.col("upto") - F.col("n")).alias("before")), "bin").alias("edge"))
    edge = edge.select(F.col("source").alias("e"), "edge.*").withColumnRenamed("bin", "edge_bin")
    edge = written(edge)
    near = drawn.join(_small(edge), F.col("source").eqNullSafe(F.col("e")) & (F.col("bin") == F.col("edge_bin")))
    peers = Window.partitionBy("source").orderBy("rank", "digest")
    with_it = F.col("before") + F.sum("size").over(peers.rangeBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("with_it", with_it).withColumn("without", F.col("with_it") - F.sum("size").over(Window.partitionBy("source", "rank", "digest")))
    # a row is taken while the sum with it is no farther from what lacks than the sum without it
    taken = near.filter(F.col("with_it") - F.col("lacks") <= F.col("lacks") - F.col("without"))
    last = taken.groupBy("source").agg(F.max(F.struct("rank", "digest")).alias("last")).select(F.col("source").alias("l"), F.col("last.rank").alias("last_rank"), F.col("last.digest").alias("last_digest"))
    return (
        per_source.join(edge, F.col("source").eqNullSafe(F.col("e")), "left")
        .join(last, F.col("source").eqNullSafe(F.col("l")), "left")
        .select(
            F.col("source").alias("s"),
            "source_size",
            "target",
            F.col("base").cast("int").alias("base"),
            "chance",
            # no row of the edge taken: those before its least rank; no edge: all
            F.when(F.col("edge_bin").isNull(), F.lit(float("inf"))).otherwise(F.coalesce("last_rank", "least")).alias("last_rank"),
            F.coalesce("last_digest", F.lit("")).alias("last_digest"),
        )
    )


def _copies() -> Column:
    rank, last = _rank(), F.col("last_rank")
    within = (rank < last) | ((rank == last) & (F.col("digest") <= F.col("last_digest")))
    return F.col("base") + ((_chance() >= 1) | F.coalesce(within, F.lit(False))).cast("int")


def _narrow(docs: DataFrame, seed: str, id_col: str, text_col: str, source_col: str, weight_col: str | None) -> DataFrame:
    named = {"doc_id": id_col, "text": text_col, "source": source_col, **({"weight": weight_col} if weight_col else {})}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in named.items()])
    rows = rows.withColumn("size", F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("bigint"))
    weight = F.coalesce(F.col("weight").cast("int"), F.lit(0)) if weight_col else F.length(F.bin("size"))
    return rows.select("doc_id", "source", "size", _digest(seed).alias("digest"), weight.alias("weight"))


def plan(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    bins: int = BINS,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_col: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken."""
    rows = written(_narrow(docs, seed, id_col, text_col, source_col, weight_col))
    found = _small(written(cuts(rows, weights, share, most, bins)))
    joined = rows.join(found, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", _copies())
    return joined.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    bins: int = BINS,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_col: str | None = None,
) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (zero to ``most`` times).

    Only the small table of cuts meets the texts; they are not exchanged where it
    can be broadcast.
    """
    rows = written(_narrow(docs, seed, id_col, text_col, source_col, weight_col))
    found = _small(written(cuts(rows, weights, share, most, bins)))
    held, at = numbered(docs), {c: f"c{k}" for k, c in enumerate(docs.columns)}
    text = F.coalesce(F.col(at[text_col]), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("bigint")
    weight = F.coalesce(F.col(at[weight_col]).cast("int"), F.lit(0)) if weight_col else F.length(F.bin(size))
    row = F.concat_ws(":", F.lit(seed), F.coalesce(F.col(at[id_col]).cast("string"), F.lit("null")), F.md5(text.cast("binary")))
    marked = held.withColumns({"digest": F.md5(row.cast("binary")), "weight": weight})
    joined = marked.join(found, F.col(at[source_col]).eqNullSafe(F.col("s"))).withColumn("copy", F.explode(F.array_repeat(F.lit(1), _copies())))
    return joined.select(*renamed(held, docs.columns))
