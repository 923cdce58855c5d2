"""Confidence of joint predictions, their agreement, and the position sizes that follow.

Every target is an array column of five probabilities, worst class first: dump to
pump, strong down to strong up, minimal to extreme adverse stop, very bearish to very
bullish, very low to very high volume and volatility. ``Prediction`` names them; a
null array stands for a target that is not predicted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.safe import clamp
from .metrics import calibrated_confidence, combined_confidence, entropy_confidence, top

VOLUME_LABELS = ("VERY_LOW", "LOW", "MEDIUM", "HIGH", "VERY_HIGH")
SENTIMENT_LABELS = ("VERY_BEARISH", "BEARISH", "NEUTRAL", "BULLISH", "VERY_BULLISH")

# Confidence where the largest probability is 0.5, its rise from there; below it the
# foot, height and steepness of a logistic curve, and the least and the most.
CURVES = {
    "volatility": (0.85, 0.30, 0.25, 0.60, 7.0, 0.20, 0.95),
    "sentiment": (0.88, 0.24, 0.28, 0.62, 7.5, 0.22, 0.96),
    "volume": (0.87, 0.26, 0.27, 0.61, 7.2, 0.21, 0.96),
}
# Fixed values by volatility label: factors of confidence, of scalping, of size; of the first and last exit.
RISK = {"VERY_LOW": 0.90, "LOW": 0.98, "MEDIUM": 1.02, "HIGH": 0.98, "VERY_HIGH": 0.85}
SCALP = {"LOW": 0.7, "MEDIUM": 1.0, "HIGH": 0.6}
SIZE = {"VERY_LOW": 1.3, "LOW": 1.2, "MEDIUM": 1.0, "HIGH": 0.8, "VERY_HIGH": 0.5}
EXIT = {"VERY_LOW": 0.8, "LOW": 0.8, "MEDIUM": 1.0, "HIGH": 1.2, "VERY_HIGH": 1.2}


def at(p: Column, *k: int) -> Column:
    """Sum of the probabilities of classes."""
    return sum((F.get(p, F.lit(i)) for i in k[1:]), F.get(p, F.lit(k[0])))


def steps(x: Column, *rules: tuple[float, float], other: float, inclusive: bool = False) -> Column:
    """The value of the first limit that ``x`` exceeds (or reaches)."""
    out = None
    for limit, value in rules:
        held = x >= limit if inclusive else x > limit
        out = F.when(held, value) if out is None else out.when(held, value)
    return out.otherwise(other)


def of_label(name: Column, table: dict[str, float], other: float = 1.0) -> Column:
    out = None
    for label, value in table.items():
        out = F.when(name == label, value) if out is None else out.when(name == label, value)
    return out.otherwise(other)


def class_label(p: Column, names: tuple[str, ...]) -> Column:
    """Name of the most probable class, the last of equals."""
    last = F.size(p) - F.array_position(F.reverse(p), F.array_max(p)).cast("int")
    return F.when(p.isNotNull(), F.get(F.array(*[F.lit(n) for n in names]), last))


def regime_confidence(p: Column, target: str) -> Column:
    """Confidence of a volatility, sentiment or volume class, by the target's own curve."""
    start, rise, foot, height, steep, least, most = CURVES[target]
    m = top(p)
    raw = entropy_confidence(p) * 0.5 + F.greatest((m - 0.2) / 0.8, F.lit(0.0)) * 0.5
    curve = foot + height / (1 + F.exp(-steep * ((m - 0.2) * 3.125 - 0.4)))
    return F.when(m >= 0.5, start + (m - 0.5) * rise).otherwise(clamp(curve * 0.7 + raw * 0.3, least, most))


def direction_confidence(p: Column) -> Column:
    """Class confidence of a direction: 0.4 of entropy, deviation and inequality, 0.6 of the calibrated curve."""
    m = top(p)
    pairs = F.aggregate(p, F.lit(0.0), lambda s, x: s + F.aggregate(p, F.lit(0.0), lambda t, y: t + F.abs(x - y)))
    mixed = entropy_confidence(p) * 0.4 + F.greatest((m - 0.2) / 0.8, F.lit(0.0)) * 0.4 + pairs / 10 * 0.2
    return clamp(mixed * 0.4 + calibrated_confidence(m) * 0.6, 0.20, 0.98)


def risk_reward(p: Column, bandwidth: Column) -> Column:
    """Expected rise over expected fall; 10 where next to no fall is expected."""
    fall = (at(p, 1) * 0.5 + at(p, 0) * 1.5) * bandwidth
    return F.when(fall > 0.001, (at(p, 3) * 0.5 + at(p, 4) * 1.5) * bandwidth / fall).otherwise(10.0)


@dataclass(frozen=True)
class Prediction:
    """Columns of the targets' probabilities, and the sequence's bandwidth in percent."""

    direction: Column
    price: Column
    stop: Column
    sentiment: Column
    volume: Column
    volatility: Column
    bandwidth: Column

    @property
    def reward(self) -> Column:
        return risk_reward(self.direction, self.bandwidth)

    @property
    def regime(self) -> Column:
        return class_label(self.volatility, VOLUME_LABELS)


def direction_signal(x: Prediction) -> Column:
    """The calibrated share of up, down or sideways, by reward over risk and by the lead of the first over the second."""
    d = x.direction
    shares = F.array_sort(F.array(at(d, 3, 4), at(d, 0, 1), at(d, 2)))
    lead = clamp((F.get(shares, F.lit(2)) - F.get(shares, F.lit(1))) / (1 - 1 / 3), 0, 1)
    reward = steps(x.reward, (4.0, 1.08), (2.5, 1.04), (1.5, 1.0), other=0.95, inclusive=True)
    return clamp(calibrated_confidence(F.get(shares, F.lit(2))) * reward * (1 + 0.08 * lead), 0.20, 0.95)


def price_signal(x: Prediction) -> Column:
    return clamp(combined_confidence(x.price) * 1.05, 0.20, 0.95)


def sentiment_signal(x: Prediction) -> Column:
    return clamp(combined_confidence(x.sentiment) * steps(at(x.sentiment, 0, 4), (0.6, 1.08), (0.4, 1.04), other=1.0, inclusive=True), 0.20, 0.95)


def volume_signal(x: Prediction) -> Column:
    return clamp(combined_confidence(x.volume) * steps(at(x.volume, 3, 4), (0.6, 1.08), (0.4, 1.04), other=1.0, inclusive=True), 0.20, 0.95)


def price_agreement(x: Prediction) -> Column:
    """How near the shares of rises and of falls are, between price levels and direction."""
    return (2 - F.abs(at(x.price, 3, 4) - at(x.direction, 3, 4)) - F.abs(at(x.price, 0, 1) - at(x.direction, 0, 1))) / 2


def stop_agreement(x: Prediction) -> Column:
    """Tight stops (first two classes) go with a decided direction, wide ones (last two) with doubt."""
    decided = F.abs(at(x.direction, 3, 4) - at(x.direction, 0, 1))
    return clamp((1 - F.abs(decided - at(x.stop, 0, 1))) * 0.6 + (1 - F.least(at(x.stop, 3, 4), F.lit(1.0))) * 0.4, 0, 1)


def sentiment_agreement(x: Prediction) -> Column:
    return (2 - F.abs(at(x.sentiment, 3, 4) - at(x.direction, 3, 4)) - F.abs(at(x.sentiment, 0, 1) - at(x.direction, 0, 1))) / 2


def volume_agreement(x: Prediction) -> Column:
    """High volume confirms strong moves, low volume a market without direction."""
    d = x.direction
    strong = at(d, 0, 4) + F.abs(at(d, 3, 4) - 0.5) + F.abs(at(d, 0, 1) - 0.5)
    return clamp(F.least(at(x.volume, 3, 4) * strong, F.lit(1.0)) * 0.7 + F.least(at(x.volume, 0, 1) * at(d, 2), F.lit(1.0)) * 0.3, 0, 1)


def agreement(x: Prediction, bonus: float = 1.3, penalty: float = 0.8) -> Column:
    """A factor from the mean of the four agreements that are defined; 1 without any."""
    each = F.array_compact(F.array(price_agreement(x), stop_agreement(x), sentiment_agreement(x), volume_agreement(x)))
    mean = F.try_divide(F.aggregate(each, F.lit(0.0), lambda s, v: s + v), F.size(each))
    made = F.when(mean > 0.7, F.least(F.lit(bonus), mean * 1.2)).when(mean < 0.3, F.greatest(F.lit(penalty), mean * 0.9)).otherwise(F.least(mean * 1.1, F.lit(1.0)))
    return F.coalesce(made, F.lit(1.0))


def overall(x: Prediction, expected_range: Column) -> Column:
    """0.7 of direction and price, 0.3 of volume and sentiment, by volatility and agreement; 0.05 to 0.95.

    Without price levels the confirming signals alone count, with 0.6.
    """
    d, p = direction_signal(x), price_signal(x)
    edge = F.greatest(at(x.direction, 0), at(x.direction, 4))
    core = F.when(edge > 0.3, (d * 0.5 + p * 0.5) * (0.7 + price_agreement(x) * 0.5)).otherwise((d * 0.60 + p * 0.40) * (0.8 + price_agreement(x) * 0.4))
    volume = F.coalesce(volume_signal(x) * (0.8 + F.coalesce(volume_agreement(x), F.lit(0.5)) * 0.4), F.lit(0.0))
    volume = F.when((at(x.volume, 3, 4) > 0.5) & (edge > 0.2), volume * 1.3).otherwise(volume)
    mood = F.coalesce(F.when(at(x.sentiment, 0, 4) > 0.6, sentiment_signal(x) * 0.7).otherwise(sentiment_signal(x)), F.lit(0.0))
    n = x.volume.isNotNull().cast("int") + x.sentiment.isNotNull().cast("int")
    confirming = F.coalesce(F.try_divide(volume + mood, n), F.lit(0.0))
    risk = of_label(x.regime, RISK) * F.when((x.regime == "MEDIUM") & (expected_range > 10), 1.1).otherwise(1.0)
    both = x.direction.isNotNull() & x.price.isNotNull()
    base = F.when(both, core * 0.7 + confirming * 0.3).otherwise(confirming * 0.6) * risk
    a = agreement(x)
    return clamp(base * F.when(a > 1.05, F.least(a * 1.15, F.lit(1.25))).when(a < 0.9, 0.8 + a * 0.2).otherwise(1.0), 0.05, 0.95)


def breakout(x: Prediction) -> Column:
    """Mean of the signals that speak for a break-out, more if several do."""
    edge, high = F.greatest(at(x.direction, 0), at(x.direction, 4)), at(x.volume, 3, 4)
    outer, mood = at(x.price, 0, 4), at(x.sentiment, 0, 4)
    rules = ((edge, 0.3, 1.5), (high, 0.5, 1.0), (outer, 0.4, 0.8), (mood, 0.4, 0.6))
    total = sum((F.when(v > limit, v * w).otherwise(0.0) for v, limit, w in rules), F.lit(0.0))
    n = sum((F.coalesce(v > limit, F.lit(False)).cast("int") for v, limit, _ in rules), F.lit(0))
    return F.coalesce(F.least(F.try_divide(total, n) * (1 + (n - 1) * 0.15), F.lit(1.0)), F.lit(0.0))


def scalping(x: Prediction) -> Column:
    """Medium volatility, a clear direction and neutral price levels suit quick trades."""
    regime = F.when(x.volatility.isNotNull(), of_label(x.regime, SCALP, 0.3)).otherwise(0.0)
    clear = F.coalesce(F.abs(at(x.direction, 3, 4) - 0.5) * 2 * 0.8, F.lit(0.0))
    return F.least((regime + clear + F.coalesce(at(x.price, 2) * 0.6, F.lit(0.0))) / 2.4, F.lit(1.0))


def size_factor(x: Prediction, confidence: Column) -> Column:
    """Multiplier of the position, 0.25 to 3: by confidence, volatility, reward over risk, momentum and volume."""
    base = steps(confidence, (0.75, 2.0), (0.65, 1.5), (0.55, 1.2), (0.45, 1.0), (0.35, 0.75), other=0.5)
    reward = F.when(x.direction.isNull(), 1.0).otherwise(steps(x.reward, (10.0, 1.5), (6.0, 1.2), (4.0, 1.0), (2.0, 0.8), other=0.5))
    momentum = F.when(F.greatest(at(x.direction, 0), at(x.direction, 4)) > 0.4, F.when(confidence > 0.6, 1.3).otherwise(0.7)).otherwise(1.0)
    high = at(x.volume, 3, 4)
    volume = F.when(high.isNull(), 0.9).when(high > 0.6, 1.2).when(high < 0.2, 0.8).otherwise(1.0)
    return clamp(base * of_label(x.regime, SIZE) * reward * momentum * volume, 0.25, 3.0)


def entry_sizes(x: Prediction, confidence: Column) -> Column:
    """Shares of capital for three entries: weighed by the price classes against the direction, neutral second."""
    whole = F.greatest(F.least(size_factor(x, confidence), F.lit(1.0)), F.lit(0.1))
    long = F.coalesce(at(x.direction, 3, 4) > at(x.direction, 0, 1), F.lit(True))
    near, far, flat = F.when(long, at(x.price, 1)).otherwise(at(x.price, 3)), F.when(long, at(x.price, 0)).otherwise(at(x.price, 4)), at(x.price, 2)
    total = near + far + flat
    share = lambda v: whole * v * F.when(total > 0, 1 / total).otherwise(1.0)
    return F.when(x.price.isNull(), F.array(*[whole / 3] * 3)).otherwise(F.array(share(near) * 1.2, share(flat), share(far) * 0.8))


def exit_sizes(x: Prediction, confidence: Column) -> Column:
    """Shares sold at three exits; earlier with little confidence or much volatility."""
    factor = of_label(x.regime, EXIT)
    first = steps(confidence, (0.7, 0.3), (0.5, 0.4), other=0.5)
    second = steps(confidence, (0.7, 0.4), (0.5, 0.35), other=0.3)
    third = steps(confidence, (0.7, 0.3), (0.5, 0.25), other=0.2)
    return F.array(F.least(first * factor, F.lit(0.6)), second, F.greatest(third / factor, F.lit(0.1)))


def volatility_outlook(p: Column, bandwidth: Column) -> dict[str, Column]:
    """Expected range, stop distance and size factor of a volatility prediction."""
    # Range of each class as a share of the bandwidth; size factor by label.
    ranges, sizes = (0.3, 0.6, 1.0, 1.6, 2.5), {"VERY_LOW": 1.5, "LOW": 1.2, "MEDIUM": 1.0, "HIGH": 0.8, "VERY_HIGH": 0.5}
    expected = sum((at(p, k) * r for k, r in enumerate(ranges)), F.lit(0.0)) * bandwidth
    return {"expected_range": expected, "stop_distance": F.greatest(expected, bandwidth), "size": of_label(class_label(p, VOLUME_LABELS), sizes)}


def model_boundaries(bins: Column, price: Column, long: Column, fallback: Column) -> Column:
    """(boundary, absolute): centre and outer edge of the farthest price range on the direction's side.

    ``bins``: array of structs (low, high). Without any, the fallback percentage and half more of it.
    """
    centred = F.transform(bins, lambda b: F.struct(((b["low"] + b["high"]) / 2).alias("centre"), b["low"].alias("low"), b["high"].alias("high")))
    up = F.array_max(F.filter(centred, lambda b: b["centre"] > price))
    down = F.array_min(F.filter(centred, lambda b: b["centre"] < price))
    sign = F.when(long, 1.0).otherwise(-1.0)
    boundary = F.coalesce(F.when(long, up["centre"]).otherwise(down["centre"]), price * (1 + sign * fallback / 100))
    absolute = F.coalesce(F.when(long, up["high"]).otherwise(down["low"]), price * (1 + sign * fallback / 100 * 1.5))
    return F.struct(boundary.alias("boundary"), absolute.alias("absolute"))
