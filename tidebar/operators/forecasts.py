"""From the probabilities of all targets to one nested prediction a sequence and horizon, and the steps that follow it.

``structs`` names the classes of each target by the target's own labels and adds what
follows from them and from the sequence: ranges of price and stop of every class,
expected move and momentum, range and trend of volatility, divergence, volume ratio,
and a confidence each. It is a projection of the summaries, so all horizons and sequences
are made in one pass. ``by_horizon`` puts a sequence's horizons into one map.

``processed`` runs named steps in any order over predictions of many times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.safe import clamp, div
from .confidence import SENTIMENT_LABELS, VOLUME_LABELS, class_label, direction_confidence, regime_confidence
from .inverse import expected_values, likely
from .metrics import combined_confidence, entropy_confidence, iqr_filter
from .predictions import LABELS, adjusted_confidence, direction_metrics, market_regime
from .recurrences import smoothed
from .targets import Parameters

# Names of the classes of prices and of stops; bounds of an expected range; ratios beyond which volatility rises or falls.
PRICE_LABELS = ("strong_down", "moderate_down", "neutral", "moderate_up", "strong_up")
STOP_LABELS = ("extreme_adverse", "high_adverse", "moderate_adverse", "low_adverse", "minimal_adverse")
RANGE = (0.001, 1.0)
RISING, FALLING = 1.02, 0.98
RATE = 0.3
STEPS = ("smoothing", "outliers", "regime", "confidence")


def margin(p: Column) -> Column:
    """The largest probability less the second."""
    falling = F.sort_array(p, asc=False)
    return F.get(falling, F.lit(0)) - F.get(falling, F.lit(1))


def skew(p: Column) -> Column:
    """The two upper classes less the two lower ones."""
    return F.get(p, F.lit(3)) + F.get(p, F.lit(4)) - F.get(p, F.lit(0)) - F.get(p, F.lit(1))


def _ranges(p: Column, edges: Column, reference: Column, names: tuple[str, ...]) -> Column:
    """A struct of each class's range, in price and in percent of the reference, and its probability."""
    made = []
    for k, name in enumerate(names):
        a, b = F.get(edges, F.lit(k)), F.get(edges, F.lit(k + 1))
        low, high = F.least(a, b), F.greatest(a, b)
        percent = lambda x: div(x - reference, reference) * 100
        made.append(F.struct(low.alias("low"), high.alias("high"), percent(low).alias("low_pct"), percent(high).alias("high_pct"), F.get(p, F.lit(k)).alias("probability")).alias(name))
    return F.struct(*made)


def _levels(p: Column, edges: Column, expected: Column, reference: Column, names: tuple[str, ...]) -> Column:
    at = likely(p)
    ends = [F.get(edges, at), F.get(edges, at + 1)]
    percent = lambda x: div(x - reference, reference) * 100
    return F.when(
        p.isNotNull(),
        F.struct(
            _ranges(p, edges, reference, names).alias("ranges"),
            class_label(p, names).alias("likely"),
            percent(F.least(*ends)).alias("low_pct"),
            percent(F.greatest(*ends)).alias("high_pct"),
            expected.alias("expected"),
            combined_confidence(p).alias("confidence"),
        ),
    )


def structs(s: DataFrame, length: int, p: dict[str, Column], params: Parameters = Parameters(), *keys: str) -> DataFrame:
    """(keys, symbol, seq, prediction): a struct of all six targets for each row of the summaries.

    ``p``: five probabilities of each target, of columns of ``s``; a null array makes that target's
    struct null. Percentages are of the sequence's weighted close. A flat sequence has no
    bandwidth, so its price ranges, moves and expected range are null. The most probable class is the last of equals.
    """
    missing = {"price_level", "stop_level", "direction", "volatility", "sentiment", "volume"} - set(p)
    if missing:
        raise ValueError(f"no probabilities of {sorted(missing)}")
    rows = s.withColumns({f"_p_{t}": c for t, c in p.items()})
    q = {t: F.col(f"_p_{t}") for t in p}
    rows = expected_values(rows, length, q, params)
    ref = F.col("s_wclose")
    band = div(F.col("_e_width"), ref)
    span = clamp(band * F.col("_e_ratio"), *RANGE)
    d, v, n, w = q["direction"], q["volatility"], q["sentiment"], q["volume"]
    moves = direction_metrics(d, band)
    trend = F.when(F.col("_e_ratio") > RISING, "RISING").when(F.col("_e_ratio") < FALLING, "FALLING").when(F.col("_e_ratio").isNotNull(), "STABLE")
    of_direction = F.struct(
        d.alias("p"),
        class_label(d, LABELS).alias("label"),
        *[x.alias(name) for name, x in moves.items()],
        F.col("_e_momentum").alias("momentum"),
        margin(d).alias("margin"),
        skew(d).alias("skew"),
        (1 - entropy_confidence(d)).alias("entropy"),
        direction_confidence(d).alias("confidence"),
    )
    of_volatility = F.struct(
        v.alias("p"),
        class_label(v, VOLUME_LABELS).alias("label"),
        F.col("_e_ratio").alias("atr_ratio"),
        (-span).alias("range_low"),
        span.alias("range_high"),
        trend.alias("trend"),
        margin(v).alias("margin"),
        skew(v).alias("skew"),
        clamp(entropy_confidence(v), 0, 1).alias("persistence"),
        regime_confidence(v, "volatility").alias("confidence"),
    )
    of_sentiment = F.struct(n.alias("p"), class_label(n, SENTIMENT_LABELS).alias("label"), F.col("_e_sentiment").alias("divergence"), regime_confidence(n, "sentiment").alias("confidence"))
    of_volume = F.struct(w.alias("p"), class_label(w, VOLUME_LABELS).alias("label"), F.col("_e_change").alias("ratio"), regime_confidence(w, "volume").alias("confidence"))
    whole = F.struct(
        _levels(q["price_level"], F.col("_e_price_edges"), F.col("_e_price"), ref, PRICE_LABELS).alias("price_level"),
        _levels(q["stop_level"], F.col("_e_stop_edges"), F.col("_e_stop"), ref, STOP_LABELS).alias("stop_level"),
        F.when(d.isNotNull(), of_direction).alias("direction"),
        F.when(v.isNotNull(), of_volatility).alias("volatility"),
        F.when(n.isNotNull(), of_sentiment).alias("sentiment"),
        F.when(w.isNotNull(), of_volume).alias("volume"),
    )
    return rows.select(*keys, "symbol", "seq", whole.alias("prediction"))


def by_horizon(made: DataFrame, bar_minutes: int | None = None) -> DataFrame:
    """(symbol, seq, predictions): the structs of a sequence as a map from its horizon, in bars or, with the length of a bar, as text such as 4h."""
    name = F.col("horizon")
    if bar_minutes is not None:
        span = F.col("horizon") * bar_minutes
        name = F.when(span % 1440 == 0, F.concat((span / 1440).cast("bigint").cast("string"), F.lit("d"))).when(span % 60 == 0, F.concat((span / 60).cast("bigint").cast("string"), F.lit("h"))).otherwise(F.concat(span.cast("string"), F.lit("m")))
    packed = made.groupBy("symbol", "seq").agg(F.collect_list(F.struct("horizon", name.alias("name"), "prediction")).alias("_all"))
    ordered = F.array_sort("_all", lambda a, b: a["horizon"] - b["horizon"])
    return packed.select("symbol", "seq", F.map_from_entries(F.transform(ordered, lambda r: F.struct(r["name"], r["prediction"]))).alias("predictions"))


def processed(rows: DataFrame, steps: tuple[str, ...], confidence: str = "confidence", p: str | None = None, least: float = 0.0, rate: float = RATE) -> DataFrame:
    """Predictions by symbol and time (``with_base`` rows) after the steps, in the order given.

    ``smoothing``: confidence and the five probabilities in ``p`` become running means over time;
    ``outliers``: rows whose confidence lies beyond 1.5 quartile ranges of their symbol's go;
    ``regime``: confidence times the factor of the market over the last 20 bars, which is taken before any row goes;
    ``confidence``: rows below ``least`` go. A step may be named several times.
    """
    unknown = [x for x in steps if x not in STEPS]
    if unknown:
        raise ValueError(f"not steps: {unknown}")
    market = "_market"
    if "regime" in steps:
        rows = rows.withColumn(market, market_regime(20))
    for step in steps:
        if step == "smoothing":
            members = [f"_smooth_{k}" for k in range(5)] if p else []
            rows = rows.withColumns({m: F.get(p, F.lit(k)) for k, m in enumerate(members)}) if p else rows
            rows = smoothed(rows, [confidence, *members], rate)
            if p:
                rows = rows.withColumn(p, F.when(F.col(p).isNotNull(), F.array(*members))).drop(*members)
        elif step == "outliers":
            rows = iqr_filter(rows, confidence)
        elif step == "regime":
            rows = rows.withColumn(confidence, F.coalesce(adjusted_confidence(F.col(confidence), F.col(market)), F.col(confidence)))
        else:
            rows = rows.filter(F.col(confidence) >= least)
    return rows.drop(market)
