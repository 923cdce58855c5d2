"""Overlapping sequences of bars and the horizon that follows each.

A sequence is named by its symbol and the index of its first bar. Bars are dealt
to the sequences that hold them as rows (``members``) and summarised by
aggregation, so the work is spread over (symbol, sequence), not over symbols
alone, and nothing materialises a tensor unless ``tensors`` is asked for it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import div
from ..functions.windows import with_base


def step_size(overlap: float, length: int) -> int:
    """Bars from one sequence's start to the next: the part of the length that doesn't overlap, rounded up."""
    if overlap <= 0.0:
        return length
    if overlap >= 1.0:
        return 1
    exact = (1.0 - overlap) * length
    near = round(exact)
    return max(1, near if abs(exact - near) < 1e-10 else math.ceil(exact))


def expected_count(rows: int, length: int, step: int, horizon: int) -> int:
    """How many sequences with their horizon fit into so many rows."""
    return 0 if rows < length + horizon else (rows - length - horizon) // step + 1


def parse_horizon(text: str, timeframe_minutes: int) -> int:
    """Bars in a span such as 15m, 4h or 1d; a span below one bar is an error."""
    unit = {"m": 1, "h": 60, "d": 1440}.get(text[-1:])
    if unit is None or not text[:-1].isdigit():
        raise ValueError(f"not a horizon: {text!r}")
    steps = int(text[:-1]) * unit // timeframe_minutes
    if steps < 1:
        raise ValueError(f"{text!r} is shorter than a bar of {timeframe_minutes} minutes")
    return steps


def indexed(bars: DataFrame) -> DataFrame:
    """``with_base`` columns and the symbol's number of bars."""
    return with_base(bars).withColumn("n_bars", F.count(F.lit(1)).over(Window.partitionBy("symbol")))


def starts(bars: DataFrame, length: int, step: int, horizon: int) -> DataFrame:
    """(symbol, seq): the index of each sequence's first bar; its horizon is inside the data."""
    b = indexed(bars)
    return b.filter((F.col("i") % step == 0) & (F.col("i") + length + horizon <= F.col("n_bars"))).select("symbol", F.col("i").alias("seq"))


def alignment(starts: DataFrame, targets: DataFrame, bars: DataFrame) -> DataFrame:
    """By symbol: numbers of sequences, targets and bars, and what doesn't fit.

    ``starts`` and ``targets``: (symbol, seq), a target once for each name and horizon is one. ``unlabelled``: sequences
    without a target; ``unmatched``: targets of no sequence; ``repeated``: sequences that are there
    more than once; ``outside``: starts of either beyond the symbol's bars, or before their first.
    Everything is counted by (symbol, seq) first, so no symbol meets in one task whole.
    """
    tagged = starts.select("symbol", F.col("seq").cast("bigint").alias("seq"), F.lit(1).alias("s"), F.lit(0).alias("t"))
    tagged = tagged.unionAll(targets.select("symbol", F.col("seq").cast("bigint").alias("seq"), F.lit(0).alias("s"), F.lit(1).alias("t")))
    each = tagged.groupBy("symbol", "seq").agg(F.sum("s").alias("s"), F.max("t").alias("t"))
    found = each.groupBy("symbol").agg(
        F.sum("s").alias("n_sequences"),
        F.sum("t").alias("n_targets"),
        F.count_if((F.col("s") > 0) & (F.col("t") == 0)).alias("unlabelled"),
        F.count_if((F.col("s") == 0) & (F.col("t") > 0)).alias("unmatched"),
        F.count_if(F.col("s") > 1).alias("repeated"),
    )
    sizes = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"))
    beyond = each.join(sizes, "symbol", "left").groupBy("symbol").agg(F.count_if((F.col("seq") < 0) | (F.col("seq") >= F.coalesce("n_bars", F.lit(0)))).alias("outside"))
    every = found.join(beyond, "symbol").join(sizes, "symbol", "full")
    return every.fillna(0, ["n_sequences", "n_targets", "unlabelled", "unmatched", "repeated", "outside", "n_bars"])


def check_alignment(report: DataFrame) -> None:
    """An error that names the symbols (ten at most) where sequences and targets don't fit."""
    bad = report.filter("unlabelled + unmatched + repeated + outside > 0").orderBy("symbol").limit(10).collect()
    if bad:
        raise ValueError("sequences and targets don't fit: " + "; ".join(f"{r['symbol']}: {r['unlabelled']} unlabelled, {r['unmatched']} unmatched, {r['repeated']} repeated, {r['outside']} outside" for r in bad))


def members(bars: DataFrame, length: int, step: int, horizon: int, reach: int | None = None) -> DataFrame:
    """A row for each bar of each sequence (``part`` s, place ``k`` from 0) and of its horizon (``part`` h).

    Sequences leave room for ``reach`` bars, the longest of several horizons.
    """
    b = indexed(bars)
    span = length + horizon
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - span + 1) / step)).cast("int")
    last = F.floor(F.least(F.col("i"), F.col("n_bars") - length - (reach or horizon)) / step).cast("int")
    held = b.filter(last >= first).withColumn("_s", F.explode(F.sequence(first, last)))
    held = held.withColumn("seq", F.col("_s").cast("bigint") * step).withColumn("_k", F.col("i") - F.col("seq"))
    inside = F.col("_k") < length
    return held.withColumns({"part": F.when(inside, "s").otherwise("h"), "k": F.when(inside, F.col("_k")).otherwise(F.col("_k") - length)}).drop("_s", "_k")


def tensors(bars: DataFrame, features: list[str], length: int, step: int, horizon: int, normalize: bool = True) -> DataFrame:
    """(symbol, seq, features array<array<double>>): bars in order, each feature z-scored in its sequence.

    Deviations are population ones of at least 1e-6.
    """
    m = members(bars, length, step, horizon).filter("part = 's'")
    own = Window.partitionBy("symbol", "seq")
    z = {c: (F.col(c) - F.avg(c).over(own)) / F.greatest(F.stddev_pop(c).over(own), F.lit(1e-6)) for c in features}
    row = F.array(*[(z[c] if normalize else F.col(c)).cast("double") for c in features])
    rows = m.select("symbol", "seq", "k", row.alias("row"))
    packed = rows.groupBy("symbol", "seq").agg(F.array_sort(F.collect_list(F.struct("k", "row"))).alias("rows"))
    return packed.select("symbol", "seq", F.transform("rows", lambda r: r["row"]).alias("features"))


def zscores(bars: DataFrame, c: str, length: int, step: int, horizon: int) -> DataFrame:
    """(symbol, seq, k, z): one feature z-scored in its sequence, a row a bar."""
    m = members(bars, length, step, horizon).filter("part = 's'")
    own = Window.partitionBy("symbol", "seq")
    z = (F.col(c) - F.avg(c).over(own)) / F.greatest(F.stddev_pop(c).over(own), F.lit(1e-6))
    return m.select("symbol", "seq", "k", z.alias("z"))


def last_sequence(bars: DataFrame, length: int) -> DataFrame:
    """The last ``length`` bars of every symbol that has as many."""
    b = indexed(bars)
    return b.filter((F.col("n_bars") >= length) & (F.col("i") >= F.col("n_bars") - length)).drop("n_bars")


def prediction_sequence(bars: DataFrame, features: list[str], length: int) -> DataFrame:
    """The last ``length`` bars of every symbol that has as many, place ``k`` from 0, each feature also z-scored as ``{feature}_z``."""
    rows = last_sequence(bars, length).withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")).cast("bigint") - 1)
    own = Window.partitionBy("symbol")
    return rows.withColumns({f"{c}_z": (F.col(c) - F.avg(c).over(own)) / F.greatest(F.stddev_pop(c).over(own), F.lit(1e-6)) for c in features})


def _dealt(bars: DataFrame, length: int, step: int, horizon: int, reach: int | None) -> DataFrame:
    """``members`` with ``_div``, a bar's own divergence: log volume ratio to the bar before, inside the sequence."""
    m = members(bars, length, step, horizon, reach)
    before = F.greatest(F.lag("volume").over(Window.partitionBy("symbol", "seq", "part").orderBy("k")), F.lit(1.0))
    return m.withColumn("_div", F.when(F.col("volume") > 0, F.log(F.col("volume") / before)))


def _ohlc4() -> Column:
    return (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4


def _share() -> Column:
    return F.when((F.col("tr") > 0) & (F.col("close") > 0) & (F.col("k") >= 1), F.col("tr") / F.col("close"))


def _place(n: int) -> Column:
    return F.pow((F.col("k") + 1) / F.lit(float(n)), F.lit(2.0))


def _of_sequence(length: int, smoothing: int) -> list[Column]:
    """What the targets need of a sequence's own bars, as aggregates over ``_dealt`` rows."""
    seq = F.col("part") == "s"
    of = lambda x: F.when(seq, x)
    sorted_of = lambda x: F.array_sort(F.collect_list(of(x)))
    positive = F.when(F.col("volume") > 0, F.col("volume"))
    return [
        div(F.sum(of(F.col("close") * _place(length))), F.sum(of(_place(length)))).alias("s_wclose"),
        sorted_of(F.col("close")).alias("s_closes"),
        sorted_of(F.col("low")).alias("s_lows"),
        sorted_of(F.col("high")).alias("s_highs"),
        sorted_of(F.col("volume")).alias("s_volumes"),
        sorted_of(F.col("_div")).alias("s_divs"),
        F.transform(F.array_sort(F.collect_list(of(F.struct("k", _ohlc4().alias("p"))))), lambda r: r["p"]).alias("s_path"),
        F.avg(of(_ohlc4())).alias("s_mean"),
        F.stddev_pop(of(_ohlc4())).alias("s_std"),
        F.avg(of(_share())).alias("s_atr"),
        F.avg(of(F.col("volume"))).alias("s_volume"),
        F.coalesce(F.avg(F.when(seq & (F.col("k") >= length - smoothing), positive)), F.lit(1.0)).alias("s_smooth"),
    ]


def _of_horizon(horizon: int, decay: float, smoothing: int) -> list[Column]:
    """What the targets need of the first ``horizon`` bars after a sequence."""
    hor = (F.col("part") == "h") & (F.col("k") < horizon)
    of = lambda x: F.when(hor, x)
    at = lambda k, x: F.max(F.when(hor & (F.col("k") == k), x))
    mid = (F.col("open") + F.col("close")) / 2
    aged = F.pow(F.lit(decay), F.lit(horizon) - F.col("k") - 1)
    positive = F.when(F.col("volume") > 0, F.col("volume"))
    return [
        div(F.sum(of(F.col("close") * _place(horizon))), F.sum(of(_place(horizon)))).alias("h_wclose"),
        F.array_sort(F.collect_list(of(F.struct("k", "low", "high")))).alias("h_bars"),
        at(0, _ohlc4()).alias("h_first"),
        at(horizon - 1, _ohlc4()).alias("h_last"),
        at(0, mid).alias("h_mid0"),
        at(horizon - 1, mid).alias("h_mid1"),
        div(F.sum(of(_share() * aged)), F.sum(F.when(hor & _share().isNotNull(), aged))).alias("h_atr"),
        F.avg(of(F.col("volume"))).alias("h_volume"),
        F.coalesce(F.avg(F.when(hor & (F.col("k") >= horizon - smoothing), positive)), F.lit(1.0)).alias("h_smooth"),
    ]


def summaries(bars: DataFrame, length: int, step: int, horizon: int, decay: float = 0.9, smoothing: int = 3, reach: int | None = None) -> DataFrame:
    """One row a sequence with what the targets need of it and of its horizon."""
    return _dealt(bars, length, step, horizon, reach).groupBy("symbol", "seq").agg(*_of_sequence(length, smoothing), *_of_horizon(horizon, decay, smoothing))


def summaries_by_horizon(bars: DataFrame, length: int, step: int, horizons: tuple[int, ...], decay: float = 0.9, smoothing: int = 3) -> DataFrame:
    """``summaries`` of several horizons, named by ``horizon``: a sequence's bars are dealt and summarised once for all of them.

    The sequences are those that leave room for the longest horizon.
    """
    if not horizons:
        raise ValueError("at least one horizon is needed")
    own = _of_sequence(length, smoothing)
    after = [F.struct(F.lit(h).alias("horizon"), *_of_horizon(h, decay, smoothing)).alias(f"_after_{h}") for h in dict.fromkeys(horizons)]
    held = _dealt(bars, length, step, max(horizons), None).groupBy("symbol", "seq").agg(*own, *after)
    names = [c for c in held.columns if not c.startswith("_after_")]
    return held.select(*names, F.inline(F.array(*[c for c in held.columns if c.startswith("_after_")])))


def ranked(values: Column, share: float, rule: str = "floor") -> Column:
    """A value by nearest rank in a sorted array; ``rule``: floor or ceil of n * share, or round of (n - 1) * share."""
    n = F.size(values)
    at = {"floor": F.floor(n * F.lit(share)), "ceil": F.ceil(n * F.lit(share)), "round": F.round((n - 1) * F.lit(share))}[rule]
    return F.try_element_at(values, F.least(at.cast("int"), n - 1) + 1)
