"""Queries of audits, light features and output forms, each with its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audits as A
from ..operators import balance as B
from ..operators import sequences as Q
from ..operators import targets as T
from . import sqlkit as S
from .evaluation import _PSQL, _probabilities, _q, _r
from .indicators import bars, base, shown
from .sequence_queries import _ALL, _SUMMARY, LENGTH, STEP, _summary, _targets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
H = 6

QUERIES["target_audit"] = lambda s, d: _r(A.target_audit(_targets(s, d)), "most", "least", "strength")
ORACLE["target_audit"] = f"""with {_SUMMARY}, a as ({_ALL}), c as (select target, class, count(*) as k, sum(strength) as st from a group by 1, 2)
  select target, sum(k)::bigint as n_rows, coalesce(sum(k) filter (where class is null), 0)::bigint as n_undefined, count(class)::int as n_classes, {_q('most: max(k) filter (where class is not null) / sum(k) filter (where class is not null)::double', 'least: min(k) filter (where class is not null) / sum(k) filter (where class is not null)::double', 'strength: sum(st) / sum(k) filter (where class is not null)')}, count(class) = 5 as complete from c group by target"""
_LIGHT = [f"{c}_{n}" for c in ("open", "high", "low", "close", "volume") for n in ("first", "middle", "last")]
QUERIES["light_features"] = lambda s, d: _r(A.light_features(bars(s, d), LENGTH, STEP, H), *_LIGHT)
ORACLE["light_features"] = f"with {_SUMMARY} select symbol, seq, {_q(*[f'{c}_{n}: max(case when k = {at} then {c} end)' for c in ('open', 'high', 'low', 'close', 'volume') for n, at in (('first', 0), ('middle', LENGTH // 2), ('last', LENGTH - 1))])} from m where part = 's' group by symbol, seq"
_CANDLE = ["candle_sentiment", "candle_sentiment_mean"]
QUERIES["candle_sentiment"] = lambda s, d: shown(base(s, d).withColumns(A.candle_sentiment()), _CANDLE)
ORACLE["candle_sentiment"] = S.staged({"v1": S.lag("volume")}, {"candle_sentiment": "case when volume > 0 and v1 > 0 then ln(volume / v1) end - ret"}, {"candle_sentiment_mean": S.inc("avg(candle_sentiment)", 3)}, out=_CANDLE)
_FORMS = ["expected", "likely", "lower", "upper"]
_CENTRES = (0.97, 0.99, 1.0, 1.01, 1.03)
QUERIES["output_forms"] = lambda s, d: shown(_probabilities(s, d).withColumns(A.output(F.col("p"), _CENTRES)), _FORMS)
_C = "[0.97, 0.99, 1.0, 1.01, 1.03]::double[]"
ORACLE["output_forms"] = f"""{_PSQL}, c as (select *, {_C} as v, list_transform(range(1, 6), lambda k: list_sum(p[1:k])) as cum from p)
  select symbol, epoch(ts)::bigint as t, {_q('expected: list_dot_product(p, v)', 'likely: v[list_position(p, list_max(p))]', 'lower: list_min(list_filter(list_transform(range(1, 6), lambda k: case when cum[k] >= 0.1 then v[k] end), lambda x: x is not null))', 'upper: coalesce(list_min(list_filter(list_transform(range(1, 6), lambda k: case when cum[k] >= 0.9 - 1e-9 then v[k] end), lambda x: x is not null)), 1.03)')} from c"""
QUERIES["resampled_sequences"] = lambda s, d: _r(_summary(s, d).select("symbol", "seq", A.resampled(F.col("s_path"), 7).alias("r")).select("symbol", "seq", *[F.get("r", F.lit(k)).alias(f"r{k}") for k in (0, 1, 3, 6)]), "r0", "r1", "r3", "r6")
ORACLE["resampled_sequences"] = f"with {_SUMMARY}, g as (select symbol, seq, s_path as x, len(s_path) as n from s) select symbol, seq, " + _q(*[f"r{k}: x[floor({k} * (n - 1) / 6.0::double)::int + 1] + (x[least(floor({k} * (n - 1) / 6.0::double)::int + 2, n)] - x[floor({k} * (n - 1) / 6.0::double)::int + 1]) * ({k} * (n - 1) / 6.0::double - floor({k} * (n - 1) / 6.0::double))" for k in (0, 1, 3, 6)]) + " from g"


def _prepared(s: SparkSession, d: str) -> DataFrame:
    split = B.exact_split(T.volatility(_summary(s, d)).filter("class in (0, 2, 4)"), 3, 2, 5)
    held = A.prepared(Q.tensors(bars(s, d), ["close"], LENGTH, STEP, H, normalize=False), split, "train")
    return _r(held.select("symbol", "seq", "class", F.get(F.element_at("features", -1), F.lit(0)).alias("last")), "last")


QUERIES["prepared_rows"] = _prepared
ORACLE["prepared_rows"] = f"""with {_SUMMARY}, a as (select symbol, seq, class from ({_ALL}) where target = 'volatility' and class in (0, 2, 4)), r as (select *, row_number() over (partition by class order by symbol, seq) - 1 as r, count(*) over (partition by class) as n from a),
  v as (select *, ceil((r + 1) * 3 / n::double) > ceil(r * 3 / n::double) as v from r), t0 as (select *, row_number() over (partition by class, v order by symbol, seq) - 1 as q from v),
  t as (select *, not v and ceil((q + 1) * 2 / (n - 3)::double) > ceil(q * 2 / (n - 3)::double) as t from t0), u as (select *, row_number() over (partition by class, v, t order by symbol, seq) as u from t), e as (select symbol, seq, max(case when k = {LENGTH - 1} then close end) as x from m where part = 's' group by symbol, seq)
  select symbol, seq, class, {_q('last: x')} from u join e using (symbol, seq) where not v and not t and u <= 5"""
QUERIES["augmentation_counts"] = lambda s, d: A.wanted_counts(_targets(s, d).filter("target = 'volatility' and class is not null").groupBy("class").agg(F.count(F.lit(1)).alias("n")))
ORACLE["augmentation_counts"] = f"""with {_SUMMARY}, c as (select class, count(*) as k from ({_ALL}) where target = 'volatility' and class is not null group by class), o as (select *, row_number() over (order by k, class) - 1 as r, count(*) over () as mm from c),
  g as (select max(case when r = floor((mm - 1) * 0.5::double + 0.5) then k end) as goal from o) select class, k as n, greatest(least(goal - k, k), 0)::bigint as extra from c, g"""
