"""Queries of ordered classes, reports and assembled predictions, each with its DuckDB statement where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordinal as O
from ..operators import predictions as P
from ..operators import validate as V
from . import sqlkit as S
from .evaluation import _CAL, _ENT, _PSQL, _probabilities, _q, _r
from .indicators import bars, base, shown

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
B = f"with {S.BASE}"
_HEAD = "select symbol, epoch(ts)::bigint as t"


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return base(s, d).select("symbol", "ts", F.pmod("i", F.lit(5)).cast("int").alias("a"), F.pmod(F.col("volume").cast("int") + F.col("i"), F.lit(5)).cast("int").alias("p"))


_PAIRS = f"{B}, k as (select symbol, ts, (i % 5)::int as a, ((volume::int + i) % 5)::int as p from b)"


def _table(rows: tuple[tuple[float, ...], ...]) -> str:
    return "[" + ", ".join("[" + ", ".join(f"{v}::double" for v in r) + "]" for r in rows) + "]"


_REPORT = ("accuracy", "within_one", "distance", "penalty", "quality", "critical")
QUERIES["backtest_report"] = lambda s, d: _r(O.backtest_report(_pairs(s, d), "p", "a", "symbol"), *_REPORT)
_R = f"""{_PAIRS}, g as (select symbol, count(*) as n, avg((p = a)::int) as accuracy, avg((abs(p - a) <= 1)::int) as within_one, avg(abs(p - a)) as distance, avg({_table(O.PENALTY)}[a + 1][p + 1]) as penalty,
  (avg({_table(O.SCORE)}[p + 1][a + 1]) + 0.5) / 1.5 * 100 as quality, avg((sign(p - 2) * sign(a - 2) < 0 or (abs(p - 2) = 2 and a = 2))::int) as critical from k group by symbol)"""
ORACLE["backtest_report"] = f"{_R} select symbol, n, {_q(*[f'{c}: {c}' for c in _REPORT])}, case when quality >= 80 then 'good' when quality >= 60 then 'fair' else 'poor' end as verdict from g"
QUERIES["report_lines"] = lambda s, d: _r(O.report_lines(O.backtest_report(_pairs(s, d), "p", "a", "symbol"), "symbol"), "value")
ORACLE["report_lines"] = f"{_R}, u as (" + " union all ".join(f"select symbol, '{c}' as measure, {c}::double as value from g" for c in ("n", *_REPORT)) + f") select symbol, measure, {_q('value: value')} from u"
QUERIES["ordinal_weights"] = lambda s, d: shown(O.weighted(_pairs(s, d), "a", "p"), ["weight"])
ORACLE["ordinal_weights"] = f"{_PAIRS}, w as (select *, 1 + 0.3 * {_table(O.PENALTY)}[a + 1][p + 1] as w from k) {_HEAD}, {_q('weight: w * (count(*) over () / sum(w) over ())')} from w"
QUERIES["ordinal_smoothing"] = lambda s, d: shown(_probabilities(s, d).withColumn("q", O.smoothed(F.col("p"))).withColumns({f"q{k}": F.get("q", F.lit(k)) for k in (0, 2, 4)}), ["q0", "q2", "q4"])
ORACLE["ordinal_smoothing"] = f"{_PSQL}, w as (select symbol, ts, list_transform(range(1, 6), lambda k: p[k] * 0.7 + list_max(p) * exp(-0.5 * pow(k - list_position(p, list_max(p)), 2)) * 0.3) as w from p) {_HEAD}, {_q('q0: w[1] / list_sum(w)', 'q2: w[3] / list_sum(w)', 'q4: w[5] / list_sum(w)')} from w"


def _mixed(s: SparkSession, d: str) -> DataFrame:
    rows = _probabilities(s, d).select("symbol", "ts", F.unix_timestamp("ts").alias("t"), "p")
    made = O.mixed_up(rows, "p")
    return _r(made.select("symbol", "t", F.get("mixed", F.lit(0)).alias("m0"), F.get("mixed", F.lit(4)).alias("m4")), "m0", "m4")


QUERIES["mixup"] = _mixed
ORACLE["mixup"] = f"""{_PSQL}, k as (select symbol, epoch(ts)::bigint as t, p, md5('5:' || symbol || ':' || epoch(ts)::bigint) as d from p), g as (select *, ('0x' || d[1:2])::bigint % 64 as g, 0.7 + 0.3 * ('0x' || d[3:8])::bigint / 16777216.0::double as s from k),
  o as (select *, coalesce(lead(p) over (partition by g order by d), first(p) over (partition by g order by d)) as o from g) select symbol, t, {_q('m0: p[1] * s + o[1] * (1 - s)', 'm4: p[5] * s + o[5] * (1 - s)')} from o"""


# raw rows of several targets' logits to one nested prediction a bar
_SEGMENTS = ("direction", "price", "volume")


def _assembled(s: SparkSession, d: str) -> DataFrame:
    names = ("open", "high", "low", "close", "volume")
    raw = F.array(*[F.col(c) / (20.0 + 5 * k) for k in range(3) for c in names])
    rows = base(s, d).withColumn("raw", raw)
    return _r(P.assembled(rows, "raw", _SEGMENTS).select("symbol", F.unix_timestamp("ts").alias("t"), *[F.col(f"prediction.{t}.label").alias(f"{t}_label") for t in _SEGMENTS], *[F.col(f"prediction.{t}.confidence").alias(t) for t in _SEGMENTS]), *_SEGMENTS)


QUERIES["assembled_predictions"] = _assembled
_X = ", ".join(f"[open / {20.0 + 5 * k}, high / {20.0 + 5 * k}, low / {20.0 + 5 * k}, close / {20.0 + 5 * k}, volume / {20.0 + 5 * k}] as z{k}" for k in range(3))
_Y = ", ".join(f"list_transform(z{k}, lambda x: exp(x - list_max(z{k}))) as e{k}" for k in range(3))
_Z = ", ".join(f"list_transform(e{k}, lambda x: x / list_sum(e{k})) as p{k}" for k in range(3))
ORACLE["assembled_predictions"] = (
    f"{B}, x as (select *, {_X} from b), y as (select *, {_Y} from x), z as (select *, {_Z} from y) {_HEAD}, "
    + ", ".join(f"['dump', 'down', 'sideways', 'up', 'pump'][list_position(p{k}, list_max(p{k}))] as {t}_label" for k, t in enumerate(_SEGMENTS))
    + ", "
    + _q(*[f"{t}: least(greatest((" + _CAL.replace("confidence", f"list_max(p{k})") + f") * 0.6 + ({_ENT.replace('(p,', f'(p{k},')}) * 0.25 + greatest((list_max(p{k}) - 0.2) / 0.8, 0) * 0.15, 0.2), 0.98)" for k, t in enumerate(_SEGMENTS)])
    + " from z"
)
QUERIES["post_processed"] = lambda s, d: shown(P.post_processed(_probabilities(s, d), "close", "confidence", 0.3), ["close", "confidence"])
ORACLE["post_processed"] = f"""{_PSQL}, k as (select *, {S.inc('stddev_pop(ret)', 20)} as sd, {S.inc('sum(ret)', 20)} as mv, {S.inc('count(ret)', 20)} as nn from p),
  m as (select *, least(confidence * case when nn = 20 then case when sd > 0.5 then 0.85 when abs(mv) > sd * 4 then 1.1 else 1 end else 1 end, 1) as adj, row_number() over (partition by symbol order by confidence) - 1 as r, count(*) over (partition by symbol) as n from k),
  q as (select *, max(case when r = floor(n * 0.25::double) then confidence end) over (partition by symbol) as a, max(case when r = floor(n * 0.75::double) then confidence end) over (partition by symbol) as c from m)
  {_HEAD}, {_q('close: close', 'confidence: adj')} from q where confidence >= a - 1.5 * (c - a) and confidence <= c + 1.5 * (c - a) and adj >= 0.3"""
QUERIES["prediction_readiness"] = lambda s, d: V.prediction_readiness(bars(s, d), 600)
ORACLE["prediction_readiness"] = f"{B} select symbol, count(*) as n_rows, count(*) filter (where not coalesce(open > 0 and high > 0 and low > 0 and close > 0 and volume >= 0 and high >= low and high >= close and low <= close, false)) as n_bad, count(*) - count(distinct ts) as n_repeated, count(*) >= 600 and count(*) = count(distinct ts) as ready from b group by symbol"
