"""Prediction queries over hourly bars with probabilities made of the bars' own fields, each with its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import augment as A
from ..operators import predictions as P
from ..operators import sequences as Q
from . import sqlkit as S
from .evaluation import _PSQL, _probabilities, _q, _r
from .indicators import bars, base, shown

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
B = f"with {S.BASE}"

_DM = ["expected_move", "upside", "downside", "risk_reward", "breakout"]
QUERIES["direction_metrics"] = lambda s, d: shown(_probabilities(s, d).withColumns(P.direction_metrics(F.col("p"), F.lit(0.02))), _DM)
_UP, _DOWN = "(0.5 * p[4] + 1.5 * p[5]) * 0.02", "(1.5 * p[1] + 0.5 * p[2]) * 0.02"
ORACLE["direction_metrics"] = f"{_PSQL} select symbol, epoch(ts)::bigint as t, {_q(f'expected_move: {_UP} - {_DOWN}', f'upside: {_UP}', f'downside: {_DOWN}', f'risk_reward: least(coalesce({_UP} / nullif({_DOWN}, 0), 10), 10)', 'breakout: p[1] + p[5]')} from p"
QUERIES["direction_label"] = lambda s, d: _r(_probabilities(s, d).select("symbol", F.unix_timestamp("ts").alias("t"), P.label(F.col("p")).alias("label"), P.gini(F.col("p")).alias("gini")), "gini")
ORACLE["direction_label"] = (
    f"{_PSQL} select symbol, epoch(ts)::bigint as t, ['dump', 'down', 'sideways', 'up', 'pump'][list_position(p, list_max(p))] as label, {_q('gini: (1 - list_sum(list_transform(p, lambda v: v * v))) / 0.8')} from p"
)
_TEMPS = (0.5, 1.0, 2.0, 4.0)


def _logits(s: SparkSession, d: str) -> DataFrame:
    return base(s, d).select(F.array(*[F.col(c) / 20 for c in ("open", "high", "low", "close", "volume")]).alias("z"), F.pmod(F.col("i"), F.lit(5)).cast("int").alias("actual"))


QUERIES["temperature_grid"] = lambda s, d: _r(P.temperature_nll(_logits(s, d), "z", "actual", _TEMPS), "nll")
ORACLE["temperature_grid"] = f"""{B}, g as (select unnest([{', '.join(map(str, _TEMPS))}])::double as temperature), z as (select temperature, i % 5 as actual, [open / 20 / temperature, high / 20 / temperature, low / 20 / temperature, close / 20 / temperature, volume / 20 / temperature] as z from b, g)
    select temperature, {_q('nll: avg(list_max(z) + ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))) - z[actual + 1])')} from z group by temperature"""
QUERIES["bias_correction"] = lambda s, d: _r(
    P.bias_corrected(_probabilities(s, d).withColumn("actual", F.pmod(F.col("i"), F.lit(5)).cast("int")), "p", "actual").select("symbol", F.unix_timestamp("ts").alias("t"), F.get("corrected", F.lit(1)).alias("c1"), F.get("corrected", F.lit(4)).alias("c4")),
    "c1",
    "c4",
)
ORACLE["bias_correction"] = (
    f"{_PSQL}, r as (select [{', '.join(f'avg((i % 5 = {k})::int) / nullif(avg(p[{k + 1}]), 0)' for k in range(5))}] as r from p), w as (select symbol, ts, list_transform(range(1, 6), lambda k: p[k] * r[k]) as w from p, r) "
    f"select symbol, epoch(ts)::bigint as t, {_q('c1: w[2] / list_sum(w)', 'c4: w[5] / list_sum(w)')} from w"
)
QUERIES["ordinal_error"] = lambda s, d: _r(P.ordinal_error(base(s, d).select(F.pmod(F.col("i"), F.lit(5)).alias("a"), F.pmod(F.col("volume").cast("int"), F.lit(5)).alias("p")), "p", "a"), "mean_distance", "within_one", "mean_square")
ORACLE["ordinal_error"] = f"{B}, k as (select abs(i % 5 - volume::int % 5) as d from b) select {_q('mean_distance: avg(d)', 'within_one: avg((d <= 1)::int)', 'mean_square: avg(d * d)')} from k"
_ST = ("mean_return", "volatility", "drawdown", "run_up", "autocorrelation", "kelly")
QUERIES["series_statistics"] = lambda s, d: _r(P.series_statistics(base(s, d)), *_ST)
ORACLE["series_statistics"] = f"""{B}, k as (select *, {S.ever('max(close)')} as pk, {S.ever('min(close)')} as fl, {S.lag('ret')} as r1 from b),
    a as (select symbol, avg(ret) as mr, stddev_samp(ret) as sd, max((pk - close) / nullif(pk, 0)) as dd, max((close - fl) / nullif(fl, 0)) as ru,
      covar_pop(ret, r1) / nullif(stddev_pop(case when r1 is not null then ret end) * stddev_pop(case when ret is not null then r1 end), 0) as ac,
      avg(case when ret is not null then (ret > 0)::int end) as w, avg(case when ret > 0 then ret end) / nullif(-avg(case when ret < 0 then ret end), 0) as q from k group by symbol)
    select symbol, {_q('mean_return: mr', 'volatility: sd', 'drawdown: dd', 'run_up: ru', 'autocorrelation: ac', 'kelly: w - (1 - w) / nullif(q, 0)')} from a"""


def _regimes(s: SparkSession, d: str) -> DataFrame:
    r = _probabilities(s, d).withColumn("market", P.market_regime(20)).withColumn("adjusted", P.adjusted_confidence(F.col("confidence"), F.col("market")))
    return _r(r.select("symbol", F.unix_timestamp("ts").alias("t"), "market", "adjusted"), "adjusted")


QUERIES["market_regime"] = _regimes
ORACLE["market_regime"] = f"""{_PSQL}, k as (select *, {S.inc('stddev_pop(ret)', 20)} as sd, {S.inc('sum(ret)', 20)} as mv, {S.inc('count(ret)', 20)} as n from p),
    m as (select *, case when n = 20 then case when sd > 0.5 then 'volatile' when abs(mv) > sd * 4 then 'trending' else 'normal' end end as market from k)
    select symbol, epoch(ts)::bigint as t, market, {_q("adjusted: least(confidence * case market when 'volatile' then 0.85 when 'trending' then 1.1 else 1 end, 1)")} from m"""
QUERIES["regime_flags"] = lambda s, d: P.regime_flags(base(s, d)).select("symbol", F.unix_timestamp("ts").alias("t"), "regime")
ORACLE["regime_flags"] = f"""{B}, k as (select *, {S.full('stddev_pop(close)', 'close', 20, S.exc)} as v, abs({S.lag('close', 1)} - {S.lag('close', 20)}) as tr20, {S.lag('volume')} as v1 from b),
    q as (select symbol, (list(v order by v) filter (where v is not null))[(floor((count(v) - 1) * 0.75::double + 0.5) + 1)::int] as pv,
                 (list(tr20 order by tr20) filter (where tr20 is not null))[(floor((count(tr20) - 1) * 0.75::double + 0.5) + 1)::int] as pt,
                 (list(volume order by volume))[count(*)::int // 2 + 1] as m from k group by symbol)
    select symbol, epoch(ts)::bigint as t, case when v is not null then coalesce(v > pv, false)::int + coalesce(tr20 > pt, false)::int + coalesce(v1 > 1.5 * m, false)::int end as regime from k join q using (symbol)"""
QUERIES["position_size"] = lambda s, d: shown(_probabilities(s, d).withColumn("size", P.position_size(F.col("confidence"), F.col("ret"))), ["size"])
ORACLE["position_size"] = f"{_PSQL} select symbol, epoch(ts)::bigint as t, {_q('size: least(0.1 * (confidence / 0.5) / (1 + coalesce(ret, 0)), 0.25)')} from p"


def _distances(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return _r(e.join(after, "vec_id").select("vec_id", P.cosine_distance(F.col("v"), F.col("w")).alias("distance")), "distance")


QUERIES["cosine_distance"] = _distances
ORACLE["cosine_distance"] = f"with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings) select a.vec_id, {_q('distance: 1 - list_dot_product(a.v, b.v) / nullif(sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)), 0)')} from e a join e b on b.vec_id = a.vec_id + 1"
QUERIES["predictions_json"] = lambda s, d: P.as_json(base(s, d).select("symbol", "i"))
ORACLE["predictions_json"] = f"""{B} select concat('{{"symbol":"', symbol, '","i":', i, '}}') as json from b"""

# random transforms; tested for their invariants
for _kind in A.KINDS:
    QUERIES[f"augment_{_kind}"] = lambda s, d, k=_kind: A.augment(Q.tensors(bars(s, d), ["close", "volume"], 24, 12, 6), k)


