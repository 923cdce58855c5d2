"""Queries of adaptive levels, volatility scores and sequence measures, each with its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adaptive as A
from ..operators import balance as B
from ..operators import crossasset as X
from ..operators import sequences as Q
from ..operators import validate as V
from . import sqlkit as S
from .evaluation import _q, _r
from .indicators import bars
from .sequence_queries import _SUMMARY, LENGTH, STEP, _summary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
H = 6

QUERIES["adaptive_levels"] = lambda s, d: _r(A.percentile_levels(_summary(s, d), LENGTH), "low", "high")
_CV = "case when s_mean > 1e-8 then s_std / s_mean else 0.02 end"
ORACLE["adaptive_levels"] = f"""with {_SUMMARY}, c as (select symbol, seq, s_path, {_CV} as cv, list_sum(list_transform(range(1, {LENGTH + 1}), lambda k: s_path[k] * k * k)) / {sum(k * k for k in range(1, LENGTH + 1))}.0::double as c from s),
  e as (select *, len(list_filter(s_path, lambda x: x < c)) / len(s_path)::double as below, case when cv < 0.01 then 0.05 when cv > 0.04 then -0.05 else 0 end as sh from c)
  select symbol, seq, {_q('low: least(greatest(case when below < 0.4 then 0.05 when below > 0.6 then 0.15 else 0.1 end + sh, 0.02), 0.25)', 'high: least(greatest(case when below < 0.4 then 0.85 when below > 0.6 then 0.95 else 0.9 end - sh, 0.75), 0.98)')} from e"""
QUERIES["adaptive_bandwidth"] = lambda s, d: _r(_summary(s, d).select("symbol", "seq", A.bandwidth(F.col("s_mean"), F.col("s_std"), 0.25).alias("plain"), A.bandwidth(F.col("s_mean"), F.col("s_std"), 0.25, 1.5).alias("eager")), "plain", "eager")
ORACLE["adaptive_bandwidth"] = f"with {_SUMMARY}, c as (select *, {_CV} as cv from s) select symbol, seq, {_q('plain: 0.25 * least(greatest(cv / 0.02, 0.3), 3)', 'eager: 0.25 * least(greatest(cv / 0.02, 0.3), 3) * 1.1')} from c"
_RANGES = f"""{_SUMMARY}, r0 as (select *, lag(close) over (partition by symbol, seq, part order by k) as cb from m), r1 as (select *, greatest(high - low, abs(high - cb), abs(low - cb)) as t from r0 where k >= 1),
  r2 as (select *, case when t > 0 and close > 0 then t / close end as share from r1), r3 as (select *, avg(share) over (partition by symbol, seq, part order by k rows unbounded preceding) as atr from r2)"""
_STATS = ("mean", "std", "median", "q25", "q75", "bandwidth")
QUERIES["atr_statistics"] = lambda s, d: _r(A.atr_statistics(bars(s, d), LENGTH, STEP, H), *_STATS)
ORACLE["atr_statistics"] = f"""with {_RANGES}, g as (select symbol, seq, avg(atr) as mean, stddev_pop(atr) as std, list(atr order by atr) as v from r3 where part = 's' and atr is not null group by symbol, seq),
  h as (select *, case when mean > 1e-8 then std / mean else 0.5 end as cv, len(v) as n from g)
  select symbol, seq, {_q('mean: mean', 'std: std', 'median: case when n % 2 = 0 then (v[n // 2] + v[n // 2 + 1]) / 2 else v[n // 2 + 1] end', 'q25: v[n // 4 + 1]', 'q75: v[3 * n // 4 + 1]', 'bandwidth: least(greatest(0.2 * least(greatest(cv / 0.5, 0.4), 2.5), 0.05), 1)')} from h"""
_SCORE = ("ratio", "trend", "weighted", "persistence", "score")
QUERIES["volatility_score"] = lambda s, d: _r(A.volatility_score(bars(s, d), LENGTH, STEP, H), *_SCORE)
ORACLE["volatility_score"] = f"""with {_RANGES}, p as (select symbol, seq, part, greatest(coalesce(avg(share), 0.005), 0.005) as a, coalesce(covar_pop(atr, k) / nullif(var_pop(case when atr is not null then k end), 0), 0) as sl,
    greatest(coalesce(sum(share * volume) / nullif(sum(case when share is not null then volume end), 0), avg(share), 0.005), 0.005) as w, case when count(atr) < 2 then 0.5 else 1 / (1 + case when avg(atr) > 0 then stddev_pop(atr) / avg(atr) else 1 end) end as st from r3 group by symbol, seq, part),
  q as (select h.symbol, h.seq, h.a / p.a as ratio, h.sl - p.sl as trend, h.w / p.w as weighted, (h.st + p.st) / 2 as persistence from p join p h on h.symbol = p.symbol and h.seq = p.seq and h.part = 'h' and p.part = 's'),
  x as (select *, exp(ln(ratio) + tanh(trend * 10) * 0.75 + ln(weighted) * 0.5 + (persistence - 0.5) * 0.25) as score from q)
  select symbol, seq, {_q(*[f'{c}: {c}' for c in _SCORE])}, case when score <= 0.6 then 0 when score <= 0.8 then 1 when score < 1.2 then 2 when score < 1.4 then 3 else 4 end::int as class from x"""
QUERIES["sequence_moments"] = lambda s, d: _r(A.sequence_moments(Q.tensors(bars(s, d), ["close", "volume"], LENGTH, STEP, H, normalize=False), ["close", "volume"]), "mean", "std", "low", "high", "range")
ORACLE["sequence_moments"] = f"with {_SUMMARY}, u as (" + " union all ".join(f"select symbol, seq, '{c}' as feature, avg({c}) as mean, stddev_pop({c}) as std, min({c}) as lo, max({c}) as hi from m where part = 's' group by symbol, seq" for c in ("close", "volume")) + f") select symbol, seq, feature, {_q('mean: mean', 'std: std', 'low: lo', 'high: hi', 'range: hi - lo')} from u"


def _arrays(s: SparkSession, d: str) -> DataFrame:
    rows = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    made = {"z": A.array_zscore(F.col("v")), "m": A.array_minmax(F.col("v")), "r": A.array_robust(F.col("v"))}
    return _r(rows.select("vec_id", *[c.alias(n) for n, c in made.items()]).select("vec_id", *[F.get(n, F.lit(k)).alias(f"{n}{k}") for n in made for k in (0, 5)]), *[f"{n}{k}" for n in made for k in (0, 5)])


QUERIES["array_normalizers"] = _arrays
_V = "with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), f as (select *, list_avg(v) as mean, list_stddev_pop(v) as sd, list_sort(v) as o, len(v) as n from e), g as (select *, o[(floor((n - 1) * 0.75::double + 0.5) + 1)::int] - o[(floor((n - 1) * 0.25::double + 0.5) + 1)::int] as iqr, o[(floor((n - 1) * 0.5::double + 0.5) + 1)::int] as med from f)"
ORACLE["array_normalizers"] = f"{_V} select vec_id, " + _q(*[x for k in (0, 5) for x in (f"z{k}: (v[{k + 1}] - mean) / greatest(sd, 1e-6)", f"m{k}: case when o[n] > o[1] then (v[{k + 1}] - o[1]) / (o[n] - o[1]) else 0 end", f"r{k}: (v[{k + 1}] - med) / case when iqr > 0 then iqr else 1 end")]) + " from g"

# aligned market columns, prediction sequences, repeated times, window overlaps
QUERIES["market_columns"] = lambda s, d: _r(X.with_market(bars(s, d), "purchase", "click").select("symbol", F.unix_timestamp("ts").alias("t"), *_MARKET), *_MARKET)
_MARKET = ("cross_dominance", "cross_price_ratio")
ORACLE["market_columns"] = f"with {S.BARS}, d as (select ts, coalesce(sum(case when symbol = 'purchase' then volume else 0 end) / nullif(sum(volume), 0), 0) as dom, max(case when symbol = 'click' then close end) / nullif(max(case when symbol = 'purchase' then close end), 0) as ra from bars group by ts) select symbol, epoch(bars.ts)::bigint as t, {_q('cross_dominance: coalesce(dom, 0)', 'cross_price_ratio: coalesce(ra, 0)')} from bars join d on d.ts = bars.ts"
QUERIES["prediction_sequence"] = lambda s, d: _r(Q.prediction_sequence(bars(s, d), ["close", "volume"], LENGTH).select("symbol", "k", "close_z", "volume_z", "close"), "close_z", "volume_z", "close")
ORACLE["prediction_sequence"] = f"with {S.BASE}, l as (select *, count(*) over (partition by symbol) as n from b), w as (select * from l where i >= n - {LENGTH} and n >= {LENGTH}) select symbol, i - (n - {LENGTH}) as k, {_q(*[f'{c}_z: ({c} - avg({c}) over (partition by symbol)) / greatest(stddev_pop({c}) over (partition by symbol), 1e-6)' for c in ('close', 'volume')], 'close: close')} from w"
QUERIES["repeated_rows"] = lambda s, d: V.repeated_rows(s.read.parquet(f"{d}/lineitem.parquet"), "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("last"))
ORACLE["repeated_rows"] = "select l_orderkey, l_linenumber, count(*) as n, count(*)::int as last from lineitem group by all having count(*) > 1"
QUERIES["window_overlaps"] = lambda s, d: _r(B.overlaps(Q.starts(bars(s, d), LENGTH, STEP, H), LENGTH), "ratio")
ORACLE["window_overlaps"] = f"with {_SUMMARY} select symbol, seq, {_q(f'ratio: greatest({LENGTH} - (seq - lag(seq) over (partition by symbol order by seq)), 0) / {LENGTH}.0::double')} from st"
