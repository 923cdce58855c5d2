"""Queries of targets over several horizons: calibration, expectations, splits and selections, each with its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import balance as B
from ..operators import inverse
from ..operators import metrics as M
from ..operators import sequences as Q
from ..operators import targets as T
from . import sqlkit as S
from .evaluation import _q, _r
from .indicators import bars
from .sequence_queries import _ALL, _CLASS, _D, _STOP, _SUMMARY, LENGTH, STEP, _summary, _targets, summary_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
HORIZONS = (3, 6)

# all targets of several horizons over the same sequences
QUERIES["targets_by_horizon"] = lambda s, d: _r(T.by_horizon(bars(s, d), LENGTH, STEP, HORIZONS), "strength")


def _horizon(h: int) -> str:
    return f"select {h}::int as horizon, * from (with {summary_sql(h, max(HORIZONS))} {_ALL})".replace("s_smooth) as x", "s_smooth) as x")


_BY_HORIZON = " union all ".join(_horizon(h) for h in HORIZONS)
ORACLE["targets_by_horizon"] = f"select horizon, symbol, seq, target, class, {_q('strength: strength')} from ({_BY_HORIZON})"

_NAMED = [(t, h) for t in ("direction", "volatility", "volume") for h in HORIZONS]
QUERIES["target_columns"] = lambda s, d: B.extracted(T.by_horizon(bars(s, d), LENGTH, STEP, HORIZONS), _NAMED)
ORACLE["target_columns"] = (
    "with a as (" + _BY_HORIZON + "), k as (select symbol, seq, " + ", ".join(f"max(case when target = '{t}' and horizon = {h} then class end) as {t}_{h}" for t, h in _NAMED) + " from a group by symbol, seq) "
    "select * from k where " + " and ".join(f"{t}_{h} is not null" for t, h in _NAMED)
)

# calibration: the candidates of every target, counted in one pass
GRID = {
    "price_level": (0.1, 0.25, 0.5),
    "stop_level": (0.1, 0.25, 0.5),
    "direction": (0.5, 1.0, 2.0),
    "volatility": (0.1, 0.2, 0.4),
    "sentiment": (0.25, 0.5, 1.0),
    "volume": (0.2, 0.4, 0.8),
}
_HELD = {  # where the default of the varied parameter stands in the statements
    "price_level": lambda q, v: q.replace("* 0.25 as w0", f"* {v} as w0"),
    "stop_level": lambda q, v: q.replace("reach * 0.25", f"reach * {v}"),
    "direction": lambda q, v: q.replace("greatest(c, 0.02)", f"greatest(c * {v}::double, 0.02)").replace("greatest(c * 2, 0.05)", f"greatest(c * {v}::double * 2, 0.05)"),
    "volatility": lambda q, v: q.replace("-0.4 as b0, -0.2 as b1, 0.2 as b2, 0.4 as b3, 0.4 as w", f"-{v}::double * 2 as b0, -{v}::double as b1, {v}::double as b2, {v}::double * 2 as b3, {v}::double * 2 as w"),
    "sentiment": lambda q, v: q.replace("0.1) * 0.5 as t", f"0.1) * {v} as t"),
    "volume": lambda q, v: q.replace("end * 0.4 as t", f"end * {v} as t"),
}


def _candidate(target: str, value: float) -> str:
    rows = _STOP if target == "stop_level" else f"select *, {_CLASS[target]} as class from ({_D[target]})"
    return f"select '{target}' as target, {value}::double as value, class from ({_HELD[target](rows, value)})"


QUERIES["calibration_counts"] = lambda s, d: T.candidates(_summary(s, d), LENGTH, GRID)
_COUNTS = f"with {_SUMMARY}, k as ({' union all '.join(_candidate(t, v) for t, vs in GRID.items() for v in vs)}), counted as (select target, value, count(*) as n, {', '.join(f'count(*) filter (where class = {k}) as n{k}' for k in range(5))} from k where class is not null group by target, value)"
ORACLE["calibration_counts"] = f"{_COUNTS} select * from counted"
QUERIES["calibrated_parameters"] = lambda s, d: T.calibrated(T.candidates(_summary(s, d), LENGTH, GRID))
ORACLE["calibrated_parameters"] = f"""{_COUNTS}, p as (select *, [n0, n1, n2, n3, n4] as c, list_transform([n0, n1, n2, n3, n4], lambda x: x * 100.0::double / n) as sh from counted),
  f as (select target, value, round(list_avg(list_transform(sh, lambda x: abs(x - 20))) / 20 + case when list_min(c) = 0 then 1000 when list_max(sh) / list_min(sh) > 10 then (list_max(sh) / list_min(sh) - 10) * 10 else 0 end, 6) as score from p)
  select target, value, score from f qualify row_number() over (partition by target order by score, value) = 1"""

# what the targets' probabilities expect
_LOGITS = ("s_wclose", "s_mean", "h_wclose", "s_volume", "h_volume")
_OUT = ("price", "stop", "momentum", "atr_ratio", "stop_factor", "divergence", "volume_ratio")


def _expectations(s: SparkSession, d: str) -> DataFrame:
    rows = _summary(s, d).withColumn("p", M.softmax(F.array(*[F.col(c) / 20 for c in _LOGITS])))
    turned = F.concat(F.slice("p", 3, 3), F.slice("p", 1, 2))
    return _r(inverse.expectations(rows, LENGTH, {t: turned if t == "direction" else F.col("p") for t in T.VARIED}), *_OUT)


QUERIES["expectations"] = _expectations
_MID = "(p[4] + -p[2]) * (b2 + b3) / 2 + (p[5] - p[1]) * (b3 + (b3 - b2) / 2)"
_P = f"""{_SUMMARY}, l as (select *, [{', '.join(f'{c} / 20' for c in _LOGITS)}] as z from s), e as (select *, list_transform(z, lambda x: exp(x - list_max(z))) as ex from l),
 p as (select symbol, seq, list_transform(ex, lambda x: x / list_sum(ex)) as p, s_mean, s_std, s_wclose, s_lows, s_highs from e),
 pr as (select symbol, seq, p[1] * (b0 - w / 2) + p[2] * (b0 + b1) / 2 + p[3] * (b1 + b2) / 2 + p[4] * (b2 + b3) / 2 + p[5] * (b3 + w / 2) as price from p join ({_D['price_level']}) using (symbol, seq)),
 st1 as (select *, p[1] + p[2] >= p[3] + p[4] as up from p),
 st2 as (select *, case when up then s_lows else s_highs end as side from st1),
 st3 as (select *, side[(least(floor(len(side) * 0.1::double), len(side) - 1) + 1)::int] as lo, side[(least(floor(len(side) * 0.9::double), len(side) - 1) + 1)::int] as hi from st2),
 st4 as (select *, case when abs(hi - lo) > 0 then abs(hi - lo) when abs(s_wclose - lo) > 0 then abs(s_wclose - lo) else abs(lo) * 0.01 end as reach from st3),
 st5 as (select *, [lo - 1.5 * 0.25 * reach, (lo - 0.25 * reach + (lo + hi) / 2 - 0.15 * reach) / 2, (lo + hi) / 2, ((lo + hi) / 2 + 0.15 * reach + hi + 0.25 * reach) / 2, hi + 1.5 * 0.25 * reach] as c from st4),
 so as (select symbol, seq, case when up then list_dot_product(p, c) else list_dot_product(p, list_reverse(c)) end as stop from st5),
 di as (select symbol, seq, ((p[2] + -p[4]) * (b2 + b3) / 2 + (p[3] - p[3]) + (p[3] * (b3 + (b3 - b2) / 2) * 0)) as ignored from p join ({_D['direction']}) using (symbol, seq)),
 dm as (select symbol, seq, ((p[1] - p[4]) * (b2 + b3) / 2 + (p[2] - p[3]) * (b3 + (b3 - b2) / 2)) * (1 + case when abs(s_mean) > 1e-10 then s_std / s_mean else 0.01 end) as momentum from p join ({_D['direction']}) using (symbol, seq)),
 vo as (select symbol, seq, 1 + {_MID} as atr_ratio from p join ({_D['volatility']}) using (symbol, seq)),
 se as (select symbol, seq, {_MID} as divergence from p join ({_D['sentiment']}) using (symbol, seq)),
 vm as (select symbol, seq, exp((p[4] - p[2]) * (b2 + b3) / 2 + (p[5] - p[1]) * (b3 + b2 / 4)) as volume_ratio from p left join ({_D['volume']}) using (symbol, seq))"""
_P = _P.replace(_P[_P.index(" di as (") : _P.index(" dm as (")], "")
ORACLE["expectations"] = f"with {_P} select symbol, seq, {_q('price: price', 'stop: stop', 'momentum: momentum', 'atr_ratio: atr_ratio', 'stop_factor: least(greatest(atr_ratio, 0.5), 2.5)', 'divergence: divergence', 'volume_ratio: volume_ratio')} from pr join so using (symbol, seq) join dm using (symbol, seq) join vo using (symbol, seq) join se using (symbol, seq) join vm using (symbol, seq)"

# splits and selections
QUERIES["global_balance"] = lambda s, d: B.global_balance(_targets(s, d)).select("symbol", "seq", "target", "class")
ORACLE["global_balance"] = f"""with {_SUMMARY}, a as ({_ALL}), lst as (select min(n) as least from (select count(*) as n from a where class is not null group by target, class))
  select symbol, seq, target, class from a, lst where class is not null qualify row_number() over (partition by target, class order by strength desc, symbol, seq) <= any_value(least) over ()"""


def _volume_target(s: SparkSession, d: str) -> DataFrame:
    return T.volatility(_summary(s, d)).filter("class in (0, 2, 4)")


_VT = f"with {_SUMMARY}, a as (select symbol, seq, class, strength from ({_ALL}) where target = 'volatility' and class in (0, 2, 4))"
QUERIES["exact_split"] = lambda s, d: B.exact_split(_volume_target(s, d), 3, 2, 5).select("symbol", "seq", "class", "split")
ORACLE["exact_split"] = f"""{_VT}, r as (select *, row_number() over (partition by class order by symbol, seq) - 1 as r, count(*) over (partition by class) as n from a),
  v as (select *, ceil((r + 1) * 3 / n::double) > ceil(r * 3 / n::double) as v from r), t0 as (select *, row_number() over (partition by class, v order by symbol, seq) - 1 as q from v),
  t as (select *, not v and ceil((q + 1) * 2 / (n - 3)::double) > ceil(q * 2 / (n - 3)::double) as t from t0), u as (select *, row_number() over (partition by class, v, t order by symbol, seq) as u from t)
  select symbol, seq, class, case when v then 'val' when t then 'test' else 'train' end as split from u where v or t or u <= 5"""
QUERIES["diverse_rows"] = lambda s, d: B.diverse(_volume_target(s, d), 12, 48).select("symbol", "seq", "class")
ORACLE["diverse_rows"] = f"""{_VT}, bk as (select *, least(floor((seq - min(seq) over (partition by class)) * 3.0::double / (max(seq) over (partition by class) - min(seq) over (partition by class) + 1)), 2)::int as b from a),
  f as (select *, row_number() over (partition by class, b order by strength desc, symbol, seq) = 1 as f from bk), g as (select *, f and coalesce(seq - lag(seq) over (partition by class, f order by b) >= 48, true) as g from f)
  select symbol, seq, class from g qualify row_number() over (partition by class order by g desc, strength desc, symbol, seq) <= 12"""
QUERIES["even_sample"] = lambda s, d: B.even_sample(Q.starts(bars(s, d), LENGTH, STEP, 6), 10)
ORACLE["even_sample"] = f"with {_SUMMARY}, r as (select symbol, seq, row_number() over (partition by symbol order by seq) - 1 as r, count(*) over (partition by symbol) as n from st) select symbol, seq from r where n <= 10 or ceil((r + 1) * 10 / n::double) > ceil(r * 10 / n::double)"
QUERIES["selected_targets"] = lambda s, d: B.selected(_targets(s, d), B.even_sample(Q.starts(bars(s, d), LENGTH, STEP, 6), 10)).select("symbol", "seq", "target", "class")
ORACLE["selected_targets"] = f"with {_SUMMARY}, a as ({_ALL}), r as (select symbol, seq, row_number() over (partition by symbol order by seq) - 1 as r, count(*) over (partition by symbol) as n from st) select symbol, seq, target, class from a join r using (symbol, seq) where n <= 10 or ceil((r + 1) * 10 / n::double) > ceil(r * 10 / n::double)"


def _sequences_with_targets(s: SparkSession, d: str) -> DataFrame:
    held = B.with_targets(Q.tensors(bars(s, d), ["close"], LENGTH, STEP, 6), _targets(s, d))
    return _r(held.select("symbol", "seq", F.col("targets")["direction"].alias("direction"), F.get(F.get("features", F.lit(0)), F.lit(0)).alias("first")), "first")


QUERIES["sequences_with_targets"] = _sequences_with_targets
ORACLE["sequences_with_targets"] = f"""with {_SUMMARY}, a as ({_ALL}), z as (select symbol, seq, max(case when k = 0 then close end) as x, avg(close) as mean, greatest(stddev_pop(close), 1e-6) as sd from m where part = 's' group by symbol, seq)
  select symbol, seq, class as direction, {_q('first: (x - mean) / sd')} from z join a using (symbol, seq) where target = 'direction'"""
