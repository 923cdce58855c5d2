"""Queries of joint predictions: six targets' probabilities made of one, each with its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import confidence as C
from .evaluation import _CAL, _ENT, _PSQL, _probabilities, _q, _r
from .indicators import shown

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _turned(k: int):
    """The probabilities with the class order turned by ``k``."""
    return F.concat(F.slice("p", k + 1, 5 - k), F.slice("p", 1, k))


def _joint(s: SparkSession, d: str) -> tuple[DataFrame, C.Prediction]:
    rows = _probabilities(s, d).withColumns({f"p{k}": _turned(k) for k in range(5)} | {"p5": F.reverse("p")})
    rows = rows.withColumn("bandwidth", (F.col("high") - F.col("low")) / 10)
    return rows, C.Prediction(*[F.col(c) for c in ("p0", "p5", "p1", "p2", "p3", "p4", "bandwidth")])


_TURNED = ", ".join("[" + ", ".join(f"p[{(j + k) % 5 + 1}]" for j in range(5)) + f"] as p{k}" for k in range(5))
_J = f"{_PSQL}, j as (select *, {_TURNED}, list_reverse(p) as p5, (high - low) / 10 as bandwidth from p)"
_HEAD = "select symbol, epoch(ts)::bigint as t"


def _conf(p: str) -> tuple[str, str]:
    """Calibrated and combined confidence of a list column."""
    cal = _CAL.replace("confidence", f"list_max({p})")
    ent = _ENT.replace("(p,", f"({p},")
    return cal, f"least(greatest(({cal}) * 0.6 + ({ent}) * 0.25 + greatest((list_max({p}) - 0.2) / 0.8, 0) * 0.15, 0.2), 0.98)"


def _clip(x: str, a: float, b: float) -> str:
    return f"least(greatest({x}, {a}), {b})"


def _label(p: str, names: tuple[str, ...]) -> str:
    return f"[{', '.join(repr(n) for n in names)}][6 - list_position(list_reverse({p}), list_max({p}))]"


def _case(x: str, table: dict[str, float], other: float = 1.0) -> str:
    return f"case {x} " + " ".join(f"when '{k}' then {v}" for k, v in table.items()) + f" else {other} end"


# labels and confidence of single targets
def _regimes(s: SparkSession, d: str) -> DataFrame:
    rows, x = _joint(s, d)
    made = {"volatility": (x.volatility, C.VOLUME_LABELS), "sentiment": (x.sentiment, C.SENTIMENT_LABELS), "volume": (x.volume, C.VOLUME_LABELS)}
    out = rows.select("symbol", F.unix_timestamp("ts").alias("t"), *[e for n, (p, names) in made.items() for e in (C.class_label(p, names).alias(f"{n}_label"), C.regime_confidence(p, n).alias(n))])
    return _r(out, *made)


QUERIES["regime_labels"] = _regimes
_cols = []
for _n, _p, _names in (("volatility", "p4", C.VOLUME_LABELS), ("sentiment", "p2", C.SENTIMENT_LABELS), ("volume", "p3", C.VOLUME_LABELS)):
    _a, _b, _f, _h, _k, _lo, _hi = C.CURVES[_n]
    _m = f"list_max({_p})"
    _raw = f"(({_ENT.replace('(p,', f'({_p},')}) * 0.5 + greatest(({_m} - 0.2) / 0.8, 0) * 0.5)"
    _cols += [f"{_label(_p, _names)} as {_n}_label", _q(f"{_n}: case when {_m} >= 0.5 then {_a} + ({_m} - 0.5) * {_b} else {_clip(f'({_f} + {_h} / (1 + exp(-{_k} * (({_m} - 0.2) * 3.125 - 0.4)))) * 0.7 + {_raw} * 0.3', _lo, _hi)} end")]
ORACLE["regime_labels"] = f"{_J} {_HEAD}, {', '.join(_cols)} from j"


def _direction(s: SparkSession, d: str) -> DataFrame:
    rows, x = _joint(s, d)
    return shown(rows.withColumns({"class_confidence": C.direction_confidence(x.direction), "reward": x.reward, "signal": C.direction_signal(x)}), ["class_confidence", "reward", "signal"])


QUERIES["direction_confidence"] = _direction
_REWARD = "case when (p0[2] * 0.5 + p0[1] * 1.5) * bandwidth > 0.001 then (p0[4] * 0.5 + p0[5] * 1.5) * bandwidth / ((p0[2] * 0.5 + p0[1] * 1.5) * bandwidth) else 10 end"
_GINI = "list_sum(list_transform(p0, lambda a: list_sum(list_transform(p0, lambda b: abs(a - b))))) / 10"
_MIX = f"(({_ENT.replace('(p,', '(p0,')}) * 0.4 + greatest((list_max(p0) - 0.2) / 0.8, 0) * 0.4 + {_GINI} * 0.2)"
_S = f"""{_J}, r as (select *, {_REWARD} as reward, list_sort([p0[4] + p0[5], p0[1] + p0[2], p0[3]]) as sh, p0[4] + p0[5] as up, p0[1] + p0[2] as down, greatest(p0[1], p0[5]) as edge,
    p3[4] + p3[5] as high_volume, p2[1] + p2[5] as mood, {_label('p4', C.VOLUME_LABELS)} as regime from j),
  s as (select *, {_clip('(' + _CAL.replace('confidence', 'sh[3]') + ') * case when reward >= 4 then 1.08 when reward >= 2.5 then 1.04 when reward >= 1.5 then 1.0 else 0.95 end * (1 + 0.08 * ' + _clip('(sh[3] - sh[2]) / (1 - 1 / 3.0::double)', 0, 1) + ')', 0.2, 0.95)} as signal from r)"""
ORACLE["direction_confidence"] = f"{_S} {_HEAD}, {_q('class_confidence: ' + _clip(f'{_MIX} * 0.4 + ({_conf("p0")[0]}) * 0.6', 0.2, 0.98), 'reward: reward', 'signal: signal')} from s"

_AGREE = {"price_agreement": C.price_agreement, "stop_agreement": C.stop_agreement, "sentiment_agreement": C.sentiment_agreement, "volume_agreement": C.volume_agreement, "factor": C.agreement}


def _agreements(s: SparkSession, d: str) -> DataFrame:
    rows, x = _joint(s, d)
    return shown(rows.withColumns({n: f(x) for n, f in _AGREE.items()}), list(_AGREE))


QUERIES["target_agreement"] = _agreements
_A = f"""{_S}, a as (select *, (2 - abs(p5[4] + p5[5] - up) - abs(p5[1] + p5[2] - down)) / 2 as price_agreement,
    {_clip('(1 - abs(abs(up - down) - (p1[1] + p1[2]))) * 0.6 + (1 - least(p1[4] + p1[5], 1)) * 0.4', 0, 1)} as stop_agreement,
    (2 - abs(p2[4] + p2[5] - up) - abs(p2[1] + p2[2] - down)) / 2 as sentiment_agreement,
    {_clip('least(high_volume * (p0[1] + p0[5] + abs(up - 0.5) + abs(down - 0.5)), 1) * 0.7 + least((p3[1] + p3[2]) * p0[3], 1) * 0.3', 0, 1)} as volume_agreement from s),
  m as (select *, (price_agreement + stop_agreement + sentiment_agreement + volume_agreement) / 4 as mean from a),
  g as (select *, case when mean > 0.7 then least(1.3, mean * 1.2) when mean < 0.3 then greatest(0.8, mean * 0.9) else least(mean * 1.1, 1) end as factor from m)"""
ORACLE["target_agreement"] = f"{_A} {_HEAD}, {_q(*[f'{n}: {n}' for n in _AGREE])} from g"


def _overall(s: SparkSession, d: str) -> DataFrame:
    rows, x = _joint(s, d)
    rows = rows.withColumns(C.volatility_outlook(x.volatility, x.bandwidth))
    rows = rows.withColumns({"price": C.price_signal(x), "sentiment": C.sentiment_signal(x), "volume_signal": C.volume_signal(x), "overall": C.overall(x, F.col("expected_range")), "breakout": C.breakout(x), "scalping": C.scalping(x)})
    return shown(rows, _OVERALL)


_OVERALL = ["expected_range", "stop_distance", "price", "sentiment", "volume_signal", "overall", "breakout", "scalping"]
QUERIES["overall_confidence"] = _overall
_BOOST = "case when {x} >= 0.6 then 1.08 when {x} >= 0.4 then 1.04 else 1.0 end"
_O = f"""{_A}, v as (select *, (p4[1] * 0.3 + p4[2] * 0.6 + p4[3] + p4[4] * 1.6 + p4[5] * 2.5) * bandwidth as expected_range,
    {_clip(f'({_conf("p5")[1]}) * 1.05', 0.2, 0.95)} as price, {_clip(f'({_conf("p2")[1]}) * {_BOOST.format(x="mood")}', 0.2, 0.95)} as sentiment, {_clip(f'({_conf("p3")[1]}) * {_BOOST.format(x="high_volume")}', 0.2, 0.95)} as volume_signal from g),
  w as (select *, greatest(expected_range, bandwidth) as stop_distance,
    case when edge > 0.3 then (signal * 0.5 + price * 0.5) * (0.7 + price_agreement * 0.5) else (signal * 0.6 + price * 0.4) * (0.8 + price_agreement * 0.4) end as core,
    (volume_signal * (0.8 + volume_agreement * 0.4) * case when high_volume > 0.5 and edge > 0.2 then 1.3 else 1 end + sentiment * case when mood > 0.6 then 0.7 else 1 end) / 2 as confirming,
    {_case('regime', C.RISK)} * case when regime = 'MEDIUM' and expected_range > 10 then 1.1 else 1 end as risk,
    (edge > 0.3)::int + (high_volume > 0.5)::int + (p5[1] + p5[5] > 0.4)::int + (mood > 0.4)::int as n,
    case when edge > 0.3 then edge * 1.5 else 0 end + case when high_volume > 0.5 then high_volume else 0 end + case when p5[1] + p5[5] > 0.4 then (p5[1] + p5[5]) * 0.8 else 0 end + case when mood > 0.4 then mood * 0.6 else 0 end as total from v),
  o as (select *, {_clip('(core * 0.7 + confirming * 0.3) * risk * case when factor > 1.05 then least(factor * 1.15, 1.25) when factor < 0.9 then 0.8 + factor * 0.2 else 1 end', 0.05, 0.95)} as overall,
    coalesce(least(total / nullif(n, 0) * (1 + (n - 1) * 0.15), 1), 0) as breakout, least(({_case('regime', C.SCALP, 0.3)} + abs(up - 0.5) * 2 * 0.8 + p5[3] * 0.6) / 2.4, 1) as scalping from w)"""
ORACLE["overall_confidence"] = f"{_O} {_HEAD}, {_q(*[f'{n}: {n}' for n in _OVERALL])} from o"


def _sizes(s: SparkSession, d: str) -> DataFrame:
    rows, x = _joint(s, d)
    rows = rows.withColumns(C.volatility_outlook(x.volatility, x.bandwidth)).withColumn("overall", C.overall(x, F.col("expected_range")))
    rows = rows.withColumns({"factor": C.size_factor(x, F.col("overall")), "entries": C.entry_sizes(x, F.col("overall")), "exits": C.exit_sizes(x, F.col("overall"))})
    return shown(rows.withColumns({f"{n}{k}": F.get(c, F.lit(k)) for n, c in (("entry", "entries"), ("exit", "exits")) for k in range(3)}), _SIZES)


_SIZES = ["size", "factor", *[f"{n}{k}" for n in ("entry", "exit") for k in range(3)]]
QUERIES["position_sizes"] = _sizes
_Z = f"""{_O}, f as (select *, {_case('regime', {'VERY_LOW': 1.5, 'LOW': 1.2, 'MEDIUM': 1.0, 'HIGH': 0.8, 'VERY_HIGH': 0.5})} as size,
    {_clip(f"case when overall > 0.75 then 2.0 when overall > 0.65 then 1.5 when overall > 0.55 then 1.2 when overall > 0.45 then 1.0 when overall > 0.35 then 0.75 else 0.5 end * {_case('regime', C.SIZE)} * case when reward > 10 then 1.5 when reward > 6 then 1.2 when reward > 4 then 1.0 when reward > 2 then 0.8 else 0.5 end * case when edge > 0.4 then case when overall > 0.6 then 1.3 else 0.7 end else 1 end * case when high_volume > 0.6 then 1.2 when high_volume < 0.2 then 0.8 else 1 end", 0.25, 3.0)} as fac,
    {_case('regime', C.EXIT)} as ex from o),
  h as (select *, greatest(least(fac, 1), 0.1) as whole, case when up > down then p5[2] else p5[4] end as near, case when up > down then p5[1] else p5[5] end as far from f),
  i as (select *, whole / (near + far + p5[3]) as unit from h)"""
ORACLE["position_sizes"] = (
    f"{_Z} {_HEAD}, "
    + _q("size: size", "factor: fac", "entry0: unit * near * 1.2", "entry1: unit * p5[3]", "entry2: unit * far * 0.8")
    + ", "
    + _q(
        "exit0: least(case when overall > 0.7 then 0.3 when overall > 0.5 then 0.4 else 0.5 end * ex, 0.6)",
        "exit1: case when overall > 0.7 then 0.4 when overall > 0.5 then 0.35 else 0.3 end",
        "exit2: greatest(case when overall > 0.7 then 0.3 when overall > 0.5 then 0.25 else 0.2 end / ex, 0.1)",
    )
    + " from i"
)


def _boundaries(s: SparkSession, d: str) -> DataFrame:
    rows, _ = _joint(s, d)
    edges = [F.col("low"), (F.col("low") + F.col("close")) / 2, F.col("open"), F.col("high"), F.col("high") * 1.1]
    bins = F.array(*[F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")) for a, b in zip(edges, edges[1:])])
    found = C.model_boundaries(bins, F.col("close"), F.pmod(F.col("i"), F.lit(2)) == 0, F.lit(2.0))
    return shown(rows.withColumn("found", found).select("*", "found.*"), ["boundary", "absolute"])


QUERIES["model_boundaries"] = _boundaries
ORACLE["model_boundaries"] = f"""{_J}, ed as (select *, [low, (low + close) / 2, open, high, high * 1.1] as edges from j),
  bb as (select *, list_transform(range(1, 5), lambda k: {{'centre': (edges[k] + edges[k + 1]) / 2, 'low': least(edges[k], edges[k + 1]), 'high': greatest(edges[k], edges[k + 1])}}) as bins from ed),
  c as (select *, list_max(list_filter(bins, lambda x: x.centre > close)) as up, list_min(list_filter(bins, lambda x: x.centre < close)) as down from bb)
  {_HEAD}, {_q('boundary: case when i % 2 = 0 then coalesce(up.centre, close * 1.02) else coalesce(down.centre, close * 0.98) end', 'absolute: case when i % 2 = 0 then coalesce(up.high, close * 1.03) else coalesce(down.low, close * 0.97) end')} from c"""
