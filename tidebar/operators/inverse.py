"""From class probabilities back to prices and expected values, for each target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.safe import clamp, div
from .sequences import ranked
from .targets import Bands, Parameters, _plans


def expected(p: Column, centres: tuple[float, ...]) -> Column:
    """Mean of the class centres, weighed by probability."""
    return sum((F.get(p, F.lit(k)) * c for k, c in enumerate(centres) if c), F.lit(0.0))


def price_bins(s: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """A row a sequence and class: the price range the class stands for, also relative to the weighted close.

    The outer classes reach one band further than their boundary.
    """
    low, high = ranked(F.col("s_closes"), bands.low), ranked(F.col("s_closes"), bands.high)
    d = s.select("symbol", "seq", F.col("s_wclose").alias("ref"), low.alias("lo"), high.alias("hi"))
    width, middle, half = (F.col("hi") - F.col("lo")) * bands.bandwidth, (F.col("lo") + F.col("hi")) / 2, (F.col("hi") - F.col("lo")) * bands.neutral / 2
    edges = [F.col("lo") - 2 * width, F.col("lo") - width, middle - half, middle + half, F.col("hi") + width, F.col("hi") + 2 * width]
    rows = F.array(*[F.struct(F.lit(k).alias("class"), edges[k].alias("low"), edges[k + 1].alias("high")) for k in range(5)])
    made = d.select("symbol", "seq", "ref", F.inline(rows))
    return made.select("symbol", "seq", "class", "low", "high", (div((F.col("low") + F.col("high")) / 2 - F.col("ref"), "ref") * 100).alias("change_pct"))


def volatility_expectation(p: Column, base: Column, bandwidth: float = 0.2, extreme: float = 2.0) -> Column:
    """Expected true range share: the base times 1 plus the mean of the class centres."""
    outer, inner = bandwidth * extreme * 1.5, bandwidth * (1 + extreme) / 2
    return base * (1 + expected(p, (-outer, -inner, 0.0, inner, outer)))


def stop_price(reference: Column, p: Column, reach: float = 0.05) -> Column:
    """A stop below the reference by the expected adverse share: most for class 0, least for class 4."""
    return reference * (1 - expected(p, tuple(reach * (4 - k) / 4 for k in range(5))))


def midpoints(base: Column, extreme: Column) -> list[Column]:
    """What the five classes between -extreme, -base, base and extreme stand for; the outer ones reach half an inner one further."""
    half = (extreme - base) / 2
    return [-extreme - half, -(extreme + base) / 2, F.lit(0.0), (base + extreme) / 2, extreme + half]


def _mean(p: Column, centres: list[Column]) -> Column:
    return sum((F.get(p, F.lit(k)) * c for k, c in enumerate(centres)), F.lit(0.0))


def likely(p: Column) -> Column:
    """The most probable class, the last of equals."""
    return F.size(p) - F.array_position(F.reverse(p), F.array_max(p)).cast("int")


def expected_values(s: DataFrame, length: int, p: dict[str, Column], params: Parameters = Parameters()) -> DataFrame:
    """The summaries with what each target's probabilities expect (``_e_`` columns, see ``expectations``), and the edges of price and stop ranges.

    ``_e_price_edges`` and ``_e_stop_edges`` are six prices, class 0 first; ``_e_width`` is the price target's bandwidth, null on a flat sequence.
    """
    plans = _plans(length, params)
    price = plans["price_level"](s)
    b, w = price.bounds, price.width
    edges = [b[0] - w, b[0], b[1], b[2], b[3], b[3] + w]
    s = price.rows.withColumns({"_e_price_edges": F.array(*edges), "_e_width": w})
    s = s.withColumn("_e_price", _mean(p["price_level"], [(edges[k] + edges[k + 1]) / 2 for k in range(5)]))

    up = (F.get(p["direction"], F.lit(3)) + F.get(p["direction"], F.lit(4))) >= (F.get(p["direction"], F.lit(0)) + F.get(p["direction"], F.lit(1)))
    bands, side = params.stop_level, F.when(up, F.col("s_lows")).otherwise(F.col("s_highs"))
    s = s.withColumns({"_e_lo": ranked(side, bands.low), "_e_hi": ranked(side, bands.high)})
    lo, hi, ref = F.col("_e_lo"), F.col("_e_hi"), F.col("s_wclose")
    s = s.withColumn("_e_reach", F.when(F.abs(hi - lo) > 0, F.abs(hi - lo)).when(F.abs(ref - lo) > 0, F.abs(ref - lo)).otherwise(F.abs(lo) * 0.01))
    reach = F.col("_e_reach")
    width, middle, half = reach * bands.bandwidth, (lo + hi) / 2, reach * bands.neutral / 2
    edges = [lo - 2 * width, lo - width, middle - half, middle + half, hi + width, hi + 2 * width]
    s = s.withColumn("_e_stop_edges", F.when(up, F.array(*edges)).otherwise(F.array(*edges[::-1])))
    rising = [(edges[k] + edges[k + 1]) / 2 for k in range(5)]
    s = s.withColumn("_e_stop", F.when(up, _mean(p["stop_level"], rising)).otherwise(_mean(p["stop_level"], rising[::-1])))

    made = {}
    for target in ("direction", "volatility", "sentiment", "volume"):
        plan = plans[target](s)
        s, (base, extreme) = plan.rows, plan.bounds[2:]
        centres = midpoints(base, extreme)
        if target == "volume":  # in logarithms; outer classes reach a quarter of the base further
            centres = [-extreme - base / 4, -(extreme + base) / 2, F.lit(0.0), (base + extreme) / 2, extreme + base / 4]
        made[f"_e_{target}"] = _mean(p[target], centres)
        s = s.withColumn(f"_e_{target}", made[f"_e_{target}"])
    cv = F.when(F.abs(F.col("s_mean")) > 1e-10, F.col("s_std") / F.col("s_mean")).otherwise(0.01)
    return s.withColumns({"_e_momentum": F.col("_e_direction") * (1 + cv), "_e_ratio": 1 + F.col("_e_volatility"), "_e_change": F.exp("_e_volume")})


def expectations(s: DataFrame, length: int, p: dict[str, Column], params: Parameters = Parameters()) -> DataFrame:
    """(symbol, seq, price, stop, momentum, atr_ratio, stop_factor, divergence, volume_ratio): what each target's probabilities expect.

    ``p``: a column of probabilities for each target, of the summaries ``s``. Stops
    follow the direction that the direction's probabilities favour, up if equal.
    """
    return expected_values(s, length, p, params).select(
        "symbol",
        "seq",
        F.col("_e_price").alias("price"),
        F.col("_e_stop").alias("stop"),
        F.col("_e_momentum").alias("momentum"),
        F.col("_e_ratio").alias("atr_ratio"),
        clamp("_e_ratio", 0.5, 2.5).alias("stop_factor"),
        F.col("_e_sentiment").alias("divergence"),
        F.col("_e_change").alias("volume_ratio"),
    )
