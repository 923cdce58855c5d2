"""Further window indicators: weighted averages, channels, directional movement, accumulation and liquidity measures.

All take bars ``with_base`` and return columns; warm-up rows are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.safe import div
from ..functions.windows import by_symbol, ever, from_index, full, inc, lag


def wma(c: str, n: int) -> Column:
    """Linearly weighted mean, the current bar the heaviest; two running sums instead of n lags."""
    weight = F.col("i") - F.lag("i", n - 1).over(by_symbol())  # defined where the frame is full
    first = F.col("i") - (n - 1)
    total = F.sum(F.col(c) * (F.col("i") + 1)).over(inc(n)) - F.sum(c).over(inc(n)) * first
    return F.when(weight.isNotNull() & (F.count(c).over(inc(n)) == n), total / (n * (n + 1) / 2))


def hull_stages(c: str, n: int) -> list[dict[str, Column]]:
    """Two stages: ``hull_raw`` = 2 wma(n / 2) - wma(n), and ``hull`` = its wma over the root of n."""
    return [{"hull_raw": 2 * wma(c, n // 2) - wma(c, n)}, {"hull": wma("hull_raw", int(n**0.5))}]


def donchian(n: int) -> dict[str, Column]:
    upper, lower = full(F.max("high"), "high", n, inc(n)), full(F.min("low"), "low", n, inc(n))
    return {"donchian_upper": upper, "donchian_lower": lower, "donchian_middle": (upper + lower) / 2}


def aroon(n: int) -> dict[str, Column]:
    """Bars since the last high and the last low of n + 1 bars, as percentages; the latest of equals."""
    frame = inc(n + 1)
    high = F.max(F.struct("high", "i")).over(frame)["i"]
    low = F.max(F.struct((-F.col("low")).alias("l"), "i")).over(frame)["i"]
    up, down = (from_index((n - (F.col("i") - at)) * 100.0 / n, n) for at in (high, low))
    return {"aroon_up": up, "aroon_down": down, "aroon": up - down}


def movement() -> dict[str, Column]:
    """Plus and minus directional movement of each bar."""
    up, down = F.col("high") - lag("high"), lag("low") - F.col("low")
    return {"dm_plus": F.when((up > down) & (up > 0), up).otherwise(0.0), "dm_minus": F.when((down > up) & (down > 0), down).otherwise(0.0)}


def directional(n: int) -> dict[str, Column]:
    """Directional indicators from plain sums over n bars, and their index; after ``movement``."""
    tr = full(F.sum("tr"), "tr", n, inc(n))
    plus, minus = (div(F.sum(c).over(inc(n)) * 100, tr) for c in ("dm_plus", "dm_minus"))
    return {"di_plus": from_index(plus, n), "di_minus": from_index(minus, n), "dx": from_index(div(F.abs(plus - minus) * 100, plus + minus), n)}


def adx(n: int) -> Column:
    """Mean of the directional index over n bars; after ``directional``."""
    return full(F.avg("dx"), "dx", n, inc(n))


def money_flow() -> Column:
    """Close location in the bar's range times volume; 0 without a range."""
    spread = F.col("high") - F.col("low")
    return F.coalesce(div(2 * F.col("close") - F.col("high") - F.col("low"), spread), F.lit(0.0)) * F.col("volume")


def accumulation() -> Column:
    """Running sum of the money flow."""
    return F.sum(money_flow()).over(ever())


def chaikin_flow(n: int) -> Column:
    """Money flow over volume of n bars."""
    return div(full(F.sum(money_flow()), "volume", n, inc(n)), F.sum("volume").over(inc(n)))


def ease_of_movement(scale: float = 1e6) -> Column:
    """Move of the bar's middle times its range over its volume."""
    middle = (F.col("high") + F.col("low")) / 2
    return div((middle - lag(middle)) * (F.col("high") - F.col("low")), F.col("volume") / scale)


def negative_volume_index(start: float = 1000.0) -> Column:
    """Grows by the return where volume falls; as a product of such returns. After ``falling``."""
    return start * F.exp(F.sum(F.when(F.col("volume_falls") & (F.col("ret") > -1), F.log1p("ret")).otherwise(0.0)).over(ever()))


def falling() -> dict[str, Column]:
    return {"volume_falls": F.coalesce(F.col("volume") < lag("volume"), F.lit(False))}


def jerk(c: str = "close") -> Column:
    """Third difference."""
    return F.col(c) - 3 * lag(c, 1) + 3 * lag(c, 2) - lag(c, 3)


def trade_intensity(n: int) -> Column:
    """Volume over the mean volume of n bars."""
    return div("volume", full(F.avg("volume"), "volume", n, inc(n)))


def depth(n: int) -> Column:
    """Volume that moved the price by one unit, over n bars: a proxy of market depth."""
    return div(full(F.sum("volume"), "volume", n, inc(n)), F.sum(F.abs(F.col("chg"))).over(inc(n)))


def expanding_atr() -> Column:
    """Mean true range from the symbol's second bar on."""
    return F.avg(F.when(F.col("i") >= 1, F.col("tr"))).over(ever())


def consistency(c: str, n: int) -> Column:
    """1 over 1 plus the coefficient of variation of n bars."""
    mean = full(F.avg(c), c, n, inc(n))
    return F.try_divide(F.lit(1.0), 1 + div(F.stddev_pop(c).over(inc(n)), mean))


def volume_weighted(c: str, n: int) -> Column:
    return div(full(F.sum(F.col(c) * F.col("volume")), c, n, inc(n)), F.sum("volume").over(inc(n)))


def percentile_rank(c: str, n: int) -> Column:
    """Share of the n bars before whose value is below the current one, in percent; 50 while there are fewer.

    The values of the frame are compared in an array, n of them a bar.
    """
    before = by_symbol().rowsBetween(-n, -1)
    held = F.collect_list(c).over(before)
    below = F.size(F.filter(held, lambda x: x < F.col(c)))
    return F.when(F.size(held) == n, below * 100.0 / n).otherwise(50.0)
