"""Balancing, splitting and calibrating labelled sequences (symbol, seq, class, strength).

Undefined classes are left out everywhere. Ranks within a class are counted over
sorted ranges (``ranks``), so a class may hold all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranked
from .targets import Direction, direction


def _strongest_first() -> list[Column]:
    return [F.desc("strength"), F.col("symbol").asc(), F.col("seq").asc()]


def balance_to_min(labelled: DataFrame, required: int = 0) -> DataFrame:
    """As many rows of each class as the rarest has, the strongest first; with ``required``, an error if there are fewer classes."""
    return _as_the_rarest(labelled.filter("class is not null"), ["class"], required)


def _as_the_rarest(rows: DataFrame, keys: list[str], required: int = 0) -> DataFrame:
    least = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("groups")).first()
    if least["groups"] < required:
        raise ValueError(f"{required} classes are required, {least['groups']} have rows")
    places = ranked(rows, keys, _strongest_first(), "_r", "_n")
    return places.filter(F.col("_r") < F.lit(least["least"])).drop("_r", "_n")


def _spans(rows: DataFrame, buckets: int, name: str) -> DataFrame:
    """Adds the number of the row's span, of ``buckets`` equal ones, in its class's range of starts."""
    ends = rows.groupBy(F.col("class").alias("_class")).agg(F.min("seq").alias("_low"), F.max("seq").alias("_high"))
    share = F.floor(F.try_divide((F.col("seq") - F.col("_low")) * float(buckets), F.col("_high") - F.col("_low") + 1))
    spread = rows.join(ends, F.col("class") == F.col("_class"))
    return spread.withColumn(name, F.least(share, F.lit(buckets - 1)).cast("int")).drop("_class", "_low", "_high")


def strongest_per_bucket(labelled: DataFrame, buckets: int = 5) -> DataFrame:
    """The strongest row of each class in each of so many equal spans of the class's range of starts."""
    rows = _spans(labelled.filter("class is not null"), buckets, "bucket")
    order = Window.partitionBy("class", "bucket").orderBy(*_strongest_first())
    return rows.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")  # each partition keeps one before the exchange


def stratified_split(labelled: DataFrame, val: float, test: float) -> DataFrame:
    """Adds ``split``: within a class, validation rows at an even stride, then test rows, the rest for training."""
    rows = ranked(labelled.filter("class is not null"), ["class"], ["symbol", "seq"], "_r", "_n")
    crossed = lambda share, shift: F.floor((F.col("_r") + 1) * F.lit(share) + shift) > F.floor(F.col("_r") * F.lit(share) + shift)
    return rows.withColumn("split", F.when(crossed(val, 0.0), "val").when(crossed(test, 0.5), "test").otherwise("train")).drop("_r", "_n")


def chronological_split(bars: DataFrame, train: float, val: float = 0.0) -> DataFrame:
    """Adds ``split``: the first part of each symbol's bars for training, the next for validation, the rest for test."""
    i = F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    rows = bars.withColumns({"_i": i, "_n": n})
    first = F.floor(F.col("_n") * F.lit(train))
    second = first + F.floor(F.col("_n") * F.lit(val))
    return rows.withColumn("split", F.when(F.col("_i") < first, "train").when(F.col("_i") < second, "val").otherwise("test")).drop("_i", "_n")


def progressive_windows(bars: DataFrame, windows: int) -> DataFrame:
    """(window, row): expanding training windows; window w holds the first w + 1 parts of each symbol's rows."""
    i = F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    part = F.least(F.floor(F.try_divide(i * windows, n)), F.lit(windows - 1)).cast("int")
    return bars.withColumn("_p", part).withColumn("window", F.explode(F.sequence(F.col("_p"), F.lit(windows - 1)))).drop("_p")


def balance_score(targets: DataFrame) -> DataFrame:
    """By target: mean distance of the class shares from 20 %, largest over smallest, and the score with its penalties."""
    rows = targets.filter("class is not null").groupBy("target")
    counts = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("class") == k, 1)).alias(f"n{k}") for k in range(5)])
    share = [F.col(f"n{k}") * 100.0 / F.col("n") for k in range(5)]
    off = sum((F.abs(p - 20) for p in share[1:]), F.abs(share[0] - 20)) / 5
    ratio = F.try_divide(F.greatest(*share), F.least(*share))
    penalty = F.when(F.least(*share) == 0, 1000.0).when(ratio > 10, (ratio - 10) * 10).otherwise(0.0)
    return counts.select("target", F.round(off, 6).alias("mean_off"), F.round(ratio, 6).alias("imbalance"), F.round(off / 20 + penalty, 6).alias("score"))


def direction_grid(summary: DataFrame, length: int, sensitivities: tuple[float, ...]) -> DataFrame:
    """Class counts of the direction target for each candidate sensitivity, in one pass over the sequences."""
    from .targets import consistency

    grid = F.explode(F.array(*[F.lit(float(s)) for s in sensitivities]))
    p = Direction()
    rise = lambda a, b: F.when(F.abs(a) < 1e-10, 0.0).otherwise(F.try_divide(b - a, a))
    first, last = F.get("s_path", F.lit(0)), F.get("s_path", F.lit(length - 1))
    cv = F.when(F.abs(F.col("s_mean")) > 1e-10, F.col("s_std") / F.col("s_mean")).otherwise(0.01)
    rows = summary.select(
        ((rise(F.col("h_first"), F.col("h_last")) - rise(first, last)) / (1 + cv)).alias("x"), consistency(F.col("s_path"), length).alias("c")
    ).withColumn("sensitivity", grid)
    base = F.greatest(F.col("c") * F.col("sensitivity"), F.lit(p.min_base))
    extreme = F.greatest(F.col("c") * F.col("sensitivity") * p.extreme, F.lit(p.min_extreme))
    x = F.col("x")
    cls = F.when(x <= -extreme, 0).when(x <= -base, 1).when(F.abs(x) <= base, 2).when(x <= extreme, 3).otherwise(4)
    return rows.groupBy("sensitivity").agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(cls == k, 1)).alias(f"n_{k}") for k in range(5)])


def mean_overlap(starts: DataFrame, length: int, step: int) -> DataFrame:
    """Number of sequence pairs of a symbol and their mean overlap.

    Starts are a fixed step apart, so the sum over pairs follows from how many
    starts lie each number of steps behind; no pairs are made.
    """
    reach = [k for k in range(1, length // step + 1) if k * step < length]
    w = Window.partitionBy("symbol").orderBy("seq")
    rows = starts.select("symbol", "seq", *[F.lag("seq", k).over(w).alias(f"_l{k}") for k in reach])
    total = sum((F.coalesce(F.greatest(F.lit(0), length - (F.col("seq") - F.col(f"_l{k}"))) / F.lit(float(length)), F.lit(0.0)) for k in reach), F.lit(0.0))
    sums = rows.groupBy("symbol").agg(F.sum(total).alias("_t"), F.count(F.lit(1)).alias("_n"))
    pairs = (F.col("_n") * (F.col("_n") - 1) / 2).cast("bigint")
    return sums.filter("_n > 1").select("symbol", pairs.alias("n_pairs"), F.round(F.col("_t") / pairs, 6).alias("mean_overlap"))


def shuffled(rows: DataFrame, seed: int) -> DataFrame:
    """Adds ``order``, a keyed digest: sorting by it is the same shuffle on every run."""
    return rows.withColumn("order", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("symbol"), F.col("seq").cast("string")).cast("binary")))


def global_balance(targets: DataFrame) -> DataFrame:
    """As many rows of every class of every target as the rarest of them all has, the strongest first."""
    return _as_the_rarest(targets.filter("class is not null"), ["target", "class"])


def exact_split(labelled: DataFrame, val: int, test: int, train: int) -> DataFrame:
    """Adds ``split``: of each class exactly so many rows, validation and then test at even strides, the first of the rest for training.

    Rows beyond are left out. A class with fewer rows than all three ask for is an error.
    Of n rows of which k are taken at an even stride, ceil(r k / n) are before the r-th, so
    one rank in the class gives the ranks among the rest.
    """
    rows = ranked(labelled.filter("class is not null"), ["class"], ["symbol", "seq"], "_r", "_n")
    short = F.raise_error(F.concat(F.lit("too few rows of class "), F.col("class").cast("string")))
    rows = rows.withColumn("_n", F.when(F.col("_n") >= val + test + train, F.col("_n")).otherwise(short.cast("bigint")))
    before = lambda r, n, k: F.ceil(r * k / n)
    stride = lambda r, n, k: before(r + 1, n, k) > before(r, n, k)
    r, n = F.col("_r"), F.col("_n")
    rows = rows.withColumns({"_v": stride(r, n, val), "_r": r - before(r, n, val)})
    rows = rows.withColumns({"_t": ~F.col("_v") & stride(r, n - val, test), "_r": r - before(r, n - val, test)})
    split = F.when(F.col("_v"), "val").when(F.col("_t"), "test").when(r < train, "train")
    return rows.withColumn("split", split).filter("split is not null").drop("_n", "_r", "_v", "_t")


def truncated(labelled: DataFrame, count: int, classes: int = 5) -> DataFrame:
    """``count`` rows of a balanced table, as many of each class, at even strides of its rows by symbol and start.

    Of a class's n rows those nearest to the strides of n over its share are taken, halves upwards. A count
    that the classes don't divide or that is beyond the rows, and a table that isn't balanced, are errors.
    """
    if count <= 0 or count % classes:
        raise ValueError(f"{count} rows can't be {classes} equal classes")
    held = labelled.filter("class is not null")
    sizes = {r["class"]: r["count"] for r in held.groupBy("class").count().limit(classes + 1).collect()}
    if len(sizes) != classes or len(set(sizes.values())) != 1:
        raise ValueError(f"the classes are not balanced: {sizes}")
    n, k = next(iter(sizes.values())), count // classes
    if k > n:
        raise ValueError(f"{count} rows are asked for, there are {n * classes}")
    rows = ranked(held, ["class"], ["symbol", "seq"], "_r", "_n")
    ends = lambda r: F.ceil(F.greatest((2 * r + 1) * k, F.lit(0)) / (2 * n))
    return rows.filter(ends(F.col("_r")) > ends(F.col("_r") - 1)).drop("_r", "_n")


def diverse(labelled: DataFrame, count: int, gap: int = 0) -> DataFrame:
    """At most ``count`` rows of each class: the strongest of equal spans of the class's starts first, then by strength.

    There are ``count`` / 10 spans, 3 to 10. A span's strongest row that starts less than
    ``gap`` bars after that of the span before it has no precedence.
    """
    buckets = min(max(count // 10, 3), 10)
    rows = _spans(labelled.filter("class is not null"), buckets, "_b")
    # a row a class and span, whose precedence depends on the span before
    best = rows.groupBy("class", "_b").agg(F.min(F.struct((-F.col("strength")).alias("s"), "symbol", "seq")).alias("_best"))
    before = F.lag("_best.seq").over(Window.partitionBy("class").orderBy("_b"))
    best = best.withColumn("_free", F.coalesce(F.col("_best.seq") - before >= gap, F.lit(True))).select("class", "_b", F.col("_best.symbol").alias("_symbol"), F.col("_best.seq").alias("_seq"), "_free")
    rows = rows.join(best, ["class", "_b"], "left")
    rows = rows.withColumn("_first", F.col("_free") & F.col("symbol").eqNullSafe(F.col("_symbol")) & (F.col("seq") == F.col("_seq")))
    order = Window.partitionBy("class").orderBy(F.desc("_first"), *_strongest_first())
    best = rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= count)  # each partition keeps ``count`` of a class before the exchange
    return best.select(*labelled.columns)


def even_sample(rows: DataFrame, count: int) -> DataFrame:
    """``count`` rows of each symbol at an even stride in time, all where there are fewer."""
    own = Window.partitionBy("symbol")
    r, n = F.row_number().over(own.orderBy("seq")) - 1, F.count(F.lit(1)).over(own)
    kept = rows.withColumns({"_r": r, "_n": n})
    taken = F.ceil((F.col("_r") + 1) * count / F.col("_n")) > F.ceil(F.col("_r") * count / F.col("_n"))
    return kept.filter((F.col("_n") <= count) | taken).drop("_r", "_n")


def selected(targets: DataFrame, chosen: DataFrame) -> DataFrame:
    """The targets of chosen sequences (symbol, seq)."""
    return targets.join(chosen.select("symbol", "seq").distinct(), ["symbol", "seq"], "left_semi")


def extracted(targets: DataFrame, names: list[tuple[str, int]]) -> DataFrame:
    """One row a sequence with a class column ``{target}_{horizon}`` for each named target; sequences that lack any are left out."""
    made = [F.max(F.when((F.col("target") == t) & (F.col("horizon") == h), F.col("class"))).alias(f"{t}_{h}") for t, h in names]
    return targets.groupBy("symbol", "seq").agg(*made).na.drop()


def with_targets(tensors: DataFrame, targets: DataFrame) -> DataFrame:
    """Sequences with all of their targets as a map from name to class."""
    own = targets.filter("class is not null").groupBy("symbol", "seq").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("target", "class")))).alias("targets"))
    return tensors.join(own, ["symbol", "seq"])


def window_plan(rows: int, least: int = 1000, most: int = 6) -> int:
    """How many expanding training windows suit so many rows: of 2 to ``most`` with at least ``least`` rows each, the best by size and number.

    Each candidate is scored by 0.6 of the share of the rows that its first window
    holds and 0.4 of its number over the most.
    """
    fitting = range(2, max(2, min(most, rows // least)) + 1)
    return max(fitting, key=lambda k: (0.6 / k + 0.4 * k / most, -k))


def overlaps(starts: DataFrame, length: int) -> DataFrame:
    """Adds ``ratio``: the share of a sequence that the one before it covers too; null for a symbol's first."""
    before = F.lag("seq").over(Window.partitionBy("symbol").orderBy("seq"))
    return starts.withColumn("ratio", F.greatest(length - (F.col("seq") - before), F.lit(0)) / F.lit(float(length)))
