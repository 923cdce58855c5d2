"""Five-class targets of a sequence and its horizon, 0 to 4, with a strength from 0.1 to 1.

Every function takes the summaries of ``sequences`` and returns (symbol, seq,
class, strength). Boundaries are strict or inclusive as each target states.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import clamp, div
from .sequences import ranked, summaries_by_horizon


@dataclass(frozen=True)
class Bands:
    """Percentile levels: a band of ``bandwidth`` ranges beyond them and a neutral one around their middle."""

    low: float = 0.1
    high: float = 0.9
    bandwidth: float = 0.25
    neutral: float = 0.3


@dataclass(frozen=True)
class Direction:
    sensitivity: float = 1.0
    base: float = 1.0
    extreme: float = 2.0
    min_base: float = 0.02
    min_extreme: float = 0.05


@dataclass(frozen=True)
class Volatility:
    bandwidth: float = 0.2
    extreme: float = 2.0
    least: float = 1e-4
    volume_weight: float = 0.1


@dataclass(frozen=True)
class Sentiment:
    sensitivity: float = 0.5
    extreme: float = 2.0
    low: float = 0.1
    high: float = 0.9


@dataclass(frozen=True)
class Volume:
    bandwidth: float = 0.4
    extreme: float = 2.0
    low: float = 0.1
    high: float = 0.9


def _within(x: Column, low: Column, high: Column) -> Column:
    """1 less the distance from the middle of a range, in half widths; 0.1 at least."""
    return F.greatest(1 - F.least(F.coalesce(div(F.abs(x - (low + high) / 2), (high - low) / 2), F.lit(1.0)), F.lit(1.0)), F.lit(0.1))


def _beyond(x: Column, width: Column) -> Column:
    return F.coalesce(clamp(div(F.greatest(x, F.lit(0.0)), width), 0.1, 1.0), F.lit(0.1))


def _strength(x: Column, b: list[Column], width: Column, cls: Column) -> Column:
    return (
        F.when(cls == 0, _beyond(b[0] - x, width))
        .when(cls == 1, _within(x, b[0], b[1]))
        .when(cls == 2, _within(x, b[1], b[2]))
        .when(cls == 3, _within(x, b[2], b[3]))
        .otherwise(_beyond(x - b[3], width))
    )


def _strict(x: Column, b: list[Column]) -> Column:
    return F.when(x < b[0], 0).when(x < b[1], 1).when(x < b[2], 2).when(x < b[3], 3).when(x.isNotNull(), 4)


def _inclusive_low(x: Column, base: Column, extreme: Column) -> Column:
    return F.when(x <= -extreme, 0).when(x <= -base, 1).when(x < base, 2).when(x < extreme, 3).when(x.isNotNull(), 4)


@dataclass(frozen=True)
class Parameters:
    """Parameters of all targets."""

    price_level: Bands = Bands()
    stop_level: Bands = Bands()
    direction: Direction = Direction()
    volatility: Volatility = Volatility()
    sentiment: Sentiment = Sentiment()
    volume: Volume = Volume()


@dataclass
class _Plan:
    """The summaries with what a target adds to them; its score, class, boundaries and the width that extremes are measured by."""

    rows: DataFrame
    x: Column
    cls: Column
    bounds: list[Column]
    width: Column
    flat: Column | None = None
    falling: Column | None = None

    def strength(self, cls: Column) -> Column:
        """Strength of a class; where ``falling``, the classes run from the highest boundary down."""
        side = cls if self.falling is None else F.when(self.falling, 4 - cls).otherwise(cls)
        made = F.when(cls.isNotNull(), _strength(self.x, self.bounds, self.width, side))
        return made if self.flat is None else F.when(self.flat, 0.3).otherwise(made)


def _labelled(p: _Plan) -> DataFrame:
    strength = p.strength(F.col("class"))
    return p.rows.withColumn("class", p.cls.cast("int")).select("symbol", "seq", "class", strength.alias("strength"))


def _price_levels(s: DataFrame, p: Bands) -> _Plan:
    d = s.withColumns({"_pl_lo": ranked(F.col("s_closes"), p.low), "_pl_hi": ranked(F.col("s_closes"), p.high)})
    lo, hi, x = F.col("_pl_lo"), F.col("_pl_hi"), F.col("h_wclose")
    width, middle, half = (hi - lo) * p.bandwidth, (lo + hi) / 2, (hi - lo) * p.neutral / 2
    b = [lo - width, middle - half, middle + half, hi + width]
    cls = F.when(hi == lo, F.when(x >= lo, 3).otherwise(2)).otherwise(_strict(x, b))
    return _Plan(d, x, cls, b, F.when(hi > lo, width), hi == lo)


def price_levels(s: DataFrame, p: Bands = Bands()) -> DataFrame:
    """The horizon's weighted close against the levels of the sequence's closes; strict. A flat sequence gives 3 or 2, strength 0.3."""
    return _labelled(_price_levels(s, p))


def _stop_levels(s: DataFrame, p: Bands) -> _Plan:
    n, ref = F.size("h_bars"), F.col("s_wclose")
    d = s.withColumn("_sl_up", F.col("h_wclose") >= ref)
    up = F.col("_sl_up")
    side = F.when(up, F.col("s_lows")).otherwise(F.col("s_highs"))
    severity = F.transform(
        "h_bars",
        lambda r: F.struct(
            (F.greatest(F.when(up, ref - r["low"]).otherwise(r["high"] - ref), F.lit(0.0)) * (0.5 + 0.5 * F.pow((r["k"] + 1) / n, F.lit(2.0)))).alias("sev"),
            (-r["k"]).alias("early"),
            F.when(up, r["low"]).otherwise(r["high"]).alias("price"),
        ),
    )
    d = d.withColumns({"_sl_lo": ranked(side, p.low), "_sl_hi": ranked(side, p.high), "_sl_worst": F.array_max(severity)})
    lo, hi, worst = F.col("_sl_lo"), F.col("_sl_hi"), F.col("_sl_worst")
    d = d.withColumn("_sl_x", F.when(worst["sev"] > 0, worst["price"]).otherwise(ref))
    x, spread, other = F.col("_sl_x"), F.abs(hi - lo), F.abs(ref - lo)
    d = d.withColumn("_sl_reach", F.when(spread > 0, spread).when(other > 0, other).otherwise(F.abs(lo) * 0.01))
    reach = F.col("_sl_reach")
    middle, half = (lo + hi) / 2, reach * p.neutral / 2
    b = [lo - reach * p.bandwidth, middle - half, middle + half, hi + reach * p.bandwidth]
    falling = F.when(x > b[3], 0).when(x > b[2], 1).when(x > b[1], 2).when(x > b[0], 3).when(x.isNotNull(), 4)
    return _Plan(d, x, F.when(up, _strict(x, b)).otherwise(falling), b, reach * p.bandwidth, falling=~up)


def stop_levels(s: DataFrame, p: Bands = Bands()) -> DataFrame:
    """The horizon's worst move against its direction, later bars weighing more, against levels of lows (up) or highs (down)."""
    plan = _stop_levels(s, p)
    rows = plan.rows.withColumn("class", plan.cls.cast("int"))
    return rows.select("symbol", "seq", "class", plan.strength(F.col("class")).alias("strength"), F.round(plan.x, 6).alias("worst"))


def consistency(path: Column, length: int) -> Column:
    """Deviation of the changes of momentum between adjacent thirds, at least 0.005; 0.01 for short paths."""
    size = max(length // 3, 2)
    if length < 3 or length <= size * 2:
        return F.lit(0.01)
    at = F.sequence(F.lit(1), F.lit(length - size * 2))
    changes = F.filter(
        F.transform(
            at,
            lambda j: div(F.get(path, j - 1 + 2 * size) - F.get(path, j - 1 + size), F.get(path, j - 1 + size))
            - div(F.get(path, j - 1 + size) - F.get(path, j - 1), F.get(path, j - 1)),
        ),
        lambda x: x.isNotNull(),
    )
    n = F.size(changes)
    total = F.aggregate(changes, F.lit(0.0), lambda a, x: a + x)
    mean = div(total, n)
    square = F.aggregate(changes, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.when(n == 0, 0.01).otherwise(F.greatest(F.sqrt(div(square, n)), F.lit(0.005)))


def _direction(s: DataFrame, length: int, p: Direction) -> _Plan:
    first, last = F.get("s_path", F.lit(0)), F.get("s_path", F.lit(length - 1))
    rise = lambda a, b: F.when(F.abs(a) < 1e-10, 0.0).otherwise(div(b - a, a))
    cv = F.when(F.abs(F.col("s_mean")) > 1e-10, F.col("s_std") / F.col("s_mean")).otherwise(0.01)
    change = (rise(F.col("h_first"), F.col("h_last")) - rise(first, last)) / (1 + cv)
    d = s.withColumns({"_d_x": change, "_d_t": consistency(F.col("s_path"), length) * p.sensitivity * p.base})
    x, t = F.col("_d_x"), F.col("_d_t")
    base, extreme = F.greatest(t, F.lit(p.min_base)), F.greatest(t * p.extreme, F.lit(p.min_extreme))
    cls = F.when(x <= -extreme, 0).when(x <= -base, 1).when(F.abs(x) <= base, 2).when(x <= extreme, 3).when(x.isNotNull(), 4)
    return _Plan(d, x, cls, [-extreme, -base, base, extreme], extreme)


def direction(s: DataFrame, length: int, p: Direction = Direction()) -> DataFrame:
    """Change of momentum from sequence to horizon over 1 plus the coefficient of variation; inclusive at every threshold."""
    return _labelled(_direction(s, length, p))


def _volatility(s: DataFrame, p: Volatility) -> _Plan:
    before = F.greatest(F.coalesce("s_atr", F.lit(0.0)), F.lit(p.least))
    after = F.greatest(F.coalesce("h_atr", F.lit(0.0)), F.lit(p.least))
    amount = F.when((F.col("s_volume") > 0) & (F.col("h_volume") > 0), clamp(F.log(F.col("h_volume") / F.col("s_volume")), -2, 2)).otherwise(0.0)
    d = s.withColumn("_v_x", (after - before) / before + amount * p.volume_weight)
    base, extreme = F.lit(p.bandwidth), F.lit(p.bandwidth * p.extreme)
    return _Plan(d, F.col("_v_x"), _inclusive_low(F.col("_v_x"), base, extreme), [-extreme, -base, base, extreme], extreme)


def volatility(s: DataFrame, p: Volatility = Volatility()) -> DataFrame:
    """Relative change of the true range share, plus the weighed log volume ratio limited to 2."""
    return _labelled(_volatility(s, p))


def _sentiment(s: DataFrame, p: Sentiment) -> _Plan:
    ratio = F.col("h_volume") / F.greatest(F.col("s_volume"), F.lit(1.0))
    move = F.when(F.col("h_mid0") > 0, F.col("h_mid1") / F.col("h_mid0") - 1).otherwise(0.0)
    scale = F.greatest(F.abs(F.coalesce(ranked(F.col("s_divs"), p.high, "ceil"), F.lit(1.0))), F.lit(0.1))
    d = s.withColumns({"_s_x": F.when(ratio > 0, F.log(ratio)) - move, "_s_t": scale * p.sensitivity})
    x, base, extreme = F.col("_s_x"), F.col("_s_t"), F.col("_s_t") * p.extreme
    return _Plan(d, x, _inclusive_low(x, base, extreme), [-extreme, -base, base, extreme], extreme)


def sentiment(s: DataFrame, p: Sentiment = Sentiment()) -> DataFrame:
    """Log volume ratio less the horizon's price change, against the sequence's own divergences."""
    return _labelled(_sentiment(s, p))


def _volume(s: DataFrame, p: Volume) -> _Plan:
    low, high = ranked(F.col("s_volumes"), p.low), ranked(F.col("s_volumes"), p.high, "ceil")
    typical = F.when(low > 1e-10, F.log(high / low)).otherwise(0.693)
    held = F.col("s_smooth") >= 1e-10
    d = s.withColumns({"_w_x": F.when(held, F.log(F.col("h_smooth") / F.col("s_smooth"))), "_w_t": typical * p.bandwidth})
    x, t = F.col("_w_x"), F.col("_w_t")
    b = [-t * p.extreme, -t, t, t * p.extreme]
    return _Plan(d, x, F.when(held, _strict(x, b)).otherwise(2), b, t * p.extreme)


def volume(s: DataFrame, p: Volume = Volume()) -> DataFrame:
    """Log ratio of smoothed volumes against the log range of the sequence's volumes; strict. No volume gives class 2."""
    return _labelled(_volume(s, p))


def _plans(length: int, p: Parameters) -> dict:
    return {
        "price_level": lambda d: _price_levels(d, p.price_level),
        "stop_level": lambda d: _stop_levels(d, p.stop_level),
        "direction": lambda d: _direction(d, length, p.direction),
        "volatility": lambda d: _volatility(d, p.volatility),
        "sentiment": lambda d: _sentiment(d, p.sentiment),
        "volume": lambda d: _volume(d, p.volume),
    }


def all_targets(s: DataFrame, length: int, p: Parameters = Parameters(), *keys: str) -> DataFrame:
    """(symbol, seq, target, class, strength), after further ``keys``: every target as rows, from one pass over the summaries."""
    found = []
    for name, make in _plans(length, p).items():
        plan = make(s)
        s = plan.rows.withColumn(f"_c_{name}", plan.cls.cast("int"))
        s = s.withColumn(f"_f_{name}", plan.strength(F.col(f"_c_{name}")))
        found.append(F.struct(F.lit(name).alias("target"), F.col(f"_c_{name}").alias("class"), F.col(f"_f_{name}").alias("strength")))
    return s.select(*keys, "symbol", "seq", F.inline(F.array(*found)))


def of_horizon(params: dict[int, Parameters]) -> Parameters:
    """Parameters that follow the row's ``horizon``, so that one pass serves horizons with values of their own; values that all share stay plain."""
    out = {}
    for f in fields(Parameters):
        own = {h: getattr(p, f.name) for h, p in params.items()}
        first = next(iter(own.values()))
        varied = {}
        for g in fields(first):
            values = {h: getattr(o, g.name) for h, o in own.items()}
            if len(set(values.values())) > 1:
                chosen = None
                for h, v in values.items():
                    chosen = F.when(F.col("horizon") == h, float(v)) if chosen is None else chosen.when(F.col("horizon") == h, float(v))
                varied[g.name] = chosen
        out[f.name] = replace(first, **varied)
    return Parameters(**out)


def by_horizon(bars: DataFrame, length: int, step: int, horizons: tuple[int, ...], p: Parameters | dict[int, Parameters] = Parameters()) -> DataFrame:
    """(horizon, symbol, seq, target, class, strength): all targets of several horizons over the same sequences, in one pass.

    ``p``: parameters of all horizons, or of each.
    """
    s = summaries_by_horizon(bars, length, step, horizons)
    return all_targets(s, length, of_horizon(p) if isinstance(p, dict) else p, "horizon")


#: The parameter of each target that calibration varies.
VARIED = {"price_level": "bandwidth", "stop_level": "bandwidth", "direction": "sensitivity", "volatility": "bandwidth", "sentiment": "sensitivity", "volume": "bandwidth"}


def candidates(s: DataFrame, length: int, grid: dict[str, tuple[float, ...]]) -> DataFrame:
    """(target, value, n, n0 .. n4): class counts of every candidate value of every target, in one pass over the summaries."""
    made = []
    for target, values in grid.items():
        for value in values:
            own = replace(getattr(Parameters(), target), **{VARIED[target]: value})
            plan = _plans(length, replace(Parameters(), **{target: own}))[target](s)
            name = f"_k{len(made)}"
            s = plan.rows.withColumn(name, plan.cls.cast("int"))
            made.append(F.struct(F.lit(target).alias("target"), F.lit(float(value)).alias("value"), F.col(name).alias("class")))
    rows = s.select(F.inline(F.array(*made))).filter("class is not null")
    return rows.groupBy("target", "value").agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("class") == k, 1)).alias(f"n{k}") for k in range(5)])


def calibrated(counts: DataFrame) -> DataFrame:
    """(target, value, score): the candidate of each target whose classes are best balanced, the least value of equals.

    The score is the mean distance of the shares from 20 % over 20, with 1000 more if a
    class is missing, or ten for each time that the largest share exceeds ten of the smallest.
    """
    share = [F.col(f"n{k}") * 100.0 / F.col("n") for k in range(5)]
    off = sum((F.abs(p - 20) for p in share[1:]), F.abs(share[0] - 20)) / 5
    ratio = F.try_divide(F.greatest(*share), F.least(*share))
    score = off / 20 + F.when(F.least(*share) == 0, 1000.0).when(ratio > 10, (ratio - 10) * 10).otherwise(0.0)
    best = counts.withColumn("score", F.round(score, 6)).groupBy("target").agg(F.min(F.struct("score", "value")).alias("best"))
    return best.select("target", "best.value", "best.score")


def parameters(found: DataFrame) -> Parameters:
    """Calibrated parameters from the rows of ``calibrated``, one a target."""
    out = Parameters()
    for r in found.collect():
        out = replace(out, **{r["target"]: replace(getattr(out, r["target"]), **{VARIED[r["target"]]: r["value"]})})
    return out


def class_distribution(targets: DataFrame) -> DataFrame:
    """Count and percentage of each class of each target; undefined classes are left out."""
    counts = targets.filter("class is not null").groupBy("target", "class").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("target")))


def one_hot(targets: DataFrame, names: tuple[str, ...] = ("price_level", "direction", "volatility")) -> DataFrame:
    """One row a sequence with five 0/1 columns for each named target."""
    made = [F.max(F.when((F.col("target") == t) & (F.col("class") == k), 1).otherwise(0)).alias(f"{t}_{k}") for t in names for k in range(5)]
    return targets.filter(F.col("target").isin(*names)).groupBy("symbol", "seq").agg(*made)
