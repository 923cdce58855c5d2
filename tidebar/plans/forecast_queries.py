"""Queries of nested predictions, the steps that follow them, and calibration, each with its DuckDB statement."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibrators as K
from ..operators import confidence as C
from ..operators import forecasts as X
from ..operators import metrics as M
from ..operators import predictions as P
from ..operators import sequences as Q
from ..operators import targets as T
from . import sqlkit as S
from .confidence_queries import _clip, _conf, _label
from .evaluation import _ENT, _PSQL, _probabilities, _q, _r
from .indicators import bars, shown
from .sequence_queries import _D, _SUMMARY, LENGTH, STEP, summary_sql
from .target_queries import _LOGITS, _P, HORIZONS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# nested predictions of two horizons, from one pass over the bars; their parts as columns
_NUMBERS = {
    "price_low": "price_level.low_pct", "price_high": "price_level.high_pct", "price": "price_level.expected", "price_up": "price_level.ranges.strong_up.high", "price_confidence": "price_level.confidence",
    "stop_low": "stop_level.low_pct", "stop_high": "stop_level.high_pct", "stop": "stop_level.expected", "stop_worst": "stop_level.ranges.extreme_adverse.low",
    "move": "direction.expected_move", "reward": "direction.risk_reward", "breakout": "direction.breakout", "momentum": "direction.momentum", "margin": "direction.margin", "skew": "direction.skew", "entropy": "direction.entropy",
    "range": "volatility.range_high", "atr_ratio": "volatility.atr_ratio", "persistence": "volatility.persistence", "volatility_confidence": "volatility.confidence",
    "divergence": "sentiment.divergence", "sentiment_confidence": "sentiment.confidence", "ratio": "volume.ratio", "volume_confidence": "volume.confidence",
}
_NAMES = {"price_class": "price_level.likely", "stop_class": "stop_level.likely", "direction": "direction.label", "volatility": "volatility.label", "trend": "volatility.trend", "sentiment": "sentiment.label", "volume": "volume.label"}


def _structs(s: SparkSession, d: str) -> DataFrame:
    rows = Q.summaries_by_horizon(bars(s, d), LENGTH, STEP, HORIZONS).withColumn("_soft", M.softmax(F.array(*[F.col(c) / 20 for c in _LOGITS])))
    p = F.col("_soft")
    turned = F.concat(F.slice("_soft", 3, 3), F.slice("_soft", 1, 2))
    return X.structs(rows, LENGTH, {t: turned if t == "direction" else p for t in T.VARIED}, T.Parameters(), "horizon")


def _forecasts(s: SparkSession, d: str) -> DataFrame:
    made = _structs(s, d)
    return _r(made.select("horizon", "symbol", "seq", *[F.col(f"prediction.{c}").alias(n) for n, c in (_NAMES | _NUMBERS).items()]), *_NUMBERS)


def _regime(p: str, name: str) -> str:
    a, b, foot, height, steep, low, high = C.CURVES[name]
    m = f"list_max({p})"
    raw = f"(({_ENT.replace('(p,', f'({p},')}) * 0.5 + greatest(({m} - 0.2) / 0.8, 0) * 0.5)"
    return f"case when {m} >= 0.5 then {a} + ({m} - 0.5) * {b} else {_clip(f'({foot} + {height} / (1 + exp(-{steep} * (({m} - 0.2) * 3.125 - 0.4)))) * 0.7 + {raw} * 0.3', low, high)} end"


_LAST = "5 - list_position(list_reverse(p), list_max(p))"
_MOVES = "(-1.5 * q[1] - 0.5 * q[2] + 0.5 * q[4] + 1.5 * q[5]) * bw"


def _structs_sql(h: int) -> str:
    shared = _P.replace(_SUMMARY, summary_sql(h, max(HORIZONS)))
    columns = _q(
        "price_low: (pe[c + 1] - ref) / ref * 100", "price_high: (pe[c + 2] - ref) / ref * 100", "price: price", "price_up: pe[6]", f"price_confidence: {_conf('p')[1]}",
        "stop_low: (least(se[c + 1], se[c + 2]) - ref) / ref * 100", "stop_high: (greatest(se[c + 1], se[c + 2]) - ref) / ref * 100", "stop: stop", "stop_worst: least(se[1], se[2])",
        f"move: {_MOVES}", "reward: least(coalesce((0.5 * q[4] + 1.5 * q[5]) * bw / nullif((1.5 * q[1] + 0.5 * q[2]) * bw, 0), 10), 10)", "breakout: q[1] + q[5]", "momentum: momentum",
        "margin: list_reverse_sort(q)[1] - list_reverse_sort(q)[2]", "skew: q[4] + q[5] - q[1] - q[2]", f"entropy: 1 - ({_ENT})",
        "range: least(greatest(bw * atr_ratio, 0.001), 1)", "atr_ratio: atr_ratio", f"persistence: least(greatest({_ENT}, 0), 1)", f"volatility_confidence: {_regime('p', 'volatility')}",
        "divergence: divergence", f"sentiment_confidence: {_regime('p', 'sentiment')}", "ratio: volume_ratio", f"volume_confidence: {_regime('p', 'volume')}",
    )
    return f"""select * from (with {shared},
      pj as (select symbol, seq, [b0 - w, b0, b1, b2, b3, b3 + w] as pe, w from ({_D['price_level']})),
      sj as (select symbol, seq, case when up then ed else list_reverse(ed) end as se from (select symbol, seq, up,
             [lo - 0.5 * reach, lo - 0.25 * reach, (lo + hi) / 2 - 0.15 * reach, (lo + hi) / 2 + 0.15 * reach, hi + 0.25 * reach, hi + 0.5 * reach] as ed from st4)),
      al as (select p.symbol, p.seq, p.p, [p.p[3], p.p[4], p.p[5], p.p[1], p.p[2]] as q, p.s_wclose as ref, pe, se, w / p.s_wclose as bw, {_LAST} as c, price, stop, momentum, atr_ratio, divergence, volume_ratio
             from p join pj using (symbol, seq) join sj using (symbol, seq) join pr using (symbol, seq) join so using (symbol, seq) join dm using (symbol, seq) join vo using (symbol, seq) join se using (symbol, seq) join vm using (symbol, seq))
      select {h}::int as horizon, symbol, seq, {_label('p', X.PRICE_LABELS)} as price_class, {_label('p', X.STOP_LABELS)} as stop_class, {_label('q', P.LABELS)} as direction, {_label('p', C.VOLUME_LABELS)} as volatility,
             case when atr_ratio > 1.02 then 'RISING' when atr_ratio < 0.98 then 'FALLING' else 'STABLE' end as trend, {_label('p', C.SENTIMENT_LABELS)} as sentiment, {_label('p', C.VOLUME_LABELS)} as volume, {columns} from al)"""


QUERIES["forecast_structs"] = _forecasts
ORACLE["forecast_structs"] = " union all ".join(_structs_sql(h) for h in HORIZONS)


def _horizon_map(s: SparkSession, d: str) -> DataFrame:
    both = X.by_horizon(_structs(s, d), 60)
    return _r(both.select("symbol", "seq", F.array_join(F.map_keys("predictions"), ",").alias("horizons"), F.col("predictions")["3h"]["direction"]["momentum"].alias("early"), F.col("predictions")["6h"]["direction"]["momentum"].alias("late")), "early", "late")


QUERIES["forecasts_by_horizon"] = _horizon_map
_BOTH = " union all ".join(_structs_sql(h) for h in HORIZONS)
ORACLE["forecasts_by_horizon"] = f"select symbol, seq, '3h,6h' as horizons, max(case when horizon = 3 then momentum end) as early, max(case when horizon = 6 then momentum end) as late from ({_BOTH}) group by symbol, seq"

# every step over hourly predictions: means over time, then outliers, the market's factor, and the least confidence
QUERIES["processed_predictions"] = lambda s, d: shown(
    X.processed(_probabilities(s, d), ("smoothing", "outliers", "regime", "confidence"), "confidence", "p", 0.3).withColumns({f"p{k}": F.get("p", F.lit(k)) for k in range(5)}), ["confidence", "p0", "p1", "p2", "p3", "p4"]
)
_STEP = ", ".join(f"0.3::double * p.p[{k}] + 0.7::double * r.s{k}" for k in range(1, 6))
ORACLE["processed_predictions"] = f"""{_PSQL.replace('with ', 'with recursive ', 1)},
  r as (select symbol, i, confidence as c, {', '.join(f'p[{k}] as s{k}' for k in range(1, 6))} from p where i = 0
        union all select p.symbol, p.i, 0.3::double * p.confidence + 0.7::double * r.c, {_STEP} from r join p on p.symbol = r.symbol and p.i = r.i + 1),
  k as (select *, {S.inc('stddev_pop(ret)', 20)} as sd, {S.inc('sum(ret)', 20)} as mv, {S.inc('count(ret)', 20)} as nn from p),
  m as (select k.symbol, k.ts, r.*exclude (symbol, i), least(c * case when nn = 20 then case when sd > 0.5 then 0.85 when abs(mv) > sd * 4 then 1.1 else 1 end else 1 end, 1) as adj,
        row_number() over (partition by k.symbol order by c) - 1 as rk, count(*) over (partition by k.symbol) as n from k join r on r.symbol = k.symbol and r.i = k.i),
  q as (select *, max(case when rk = floor(n * 0.25::double) then c end) over (partition by symbol) as a, max(case when rk = floor(n * 0.75::double) then c end) over (partition by symbol) as b from m)
  select symbol, epoch(ts)::bigint as t, {_q('confidence: adj', *[f'p{k}: s{k + 1}' for k in range(5)])} from q where c >= a - 1.5 * (b - a) and c <= b + 1.5 * (b - a) and adj >= 0.3"""


def _held_out(s: SparkSession, d: str) -> DataFrame:
    """Probabilities of hourly bars, sharpened where the class agrees, and a class that follows them in two of three rows."""
    rows = _probabilities(s, d)
    best = (F.array_position("p", F.array_max("p")) - 1).cast("int")
    actual = F.when(F.pmod(F.col("i"), F.lit(3)) == 0, F.pmod(F.col("i"), F.lit(5))).otherwise(best).cast("int")
    return rows.withColumn("actual", actual)


def _calibration(s: SparkSession, d: str) -> DataFrame:
    c = K.fit(_held_out(s, d), "p", "actual")
    one = [("temperature", -1, c.temperature), ("nll", -1, c.nll), ("plain_nll", -1, c.plain_nll), ("ece", -1, c.ece), ("mixing", -1, c.mixing), ("rows", -1, float(c.rows))]
    each = [(n, k, v) for n, values in (("class_ece", c.class_ece), ("smoothing", c.smoothing)) for k, v in enumerate(values)]
    return _r(s.createDataFrame([*one, *each], "name string, class int, value double"), "value")


QUERIES["calibration_fit"] = _calibration
_LN = "list_transform(p, lambda v: ln(least(greatest(v, 1e-10), 1 - 1e-10)))"
_CSQL = f"{_PSQL}, h as materialized (select symbol, ts, {_LN} as z, (case when i % 3 = 0 then i % 5 else list_position(p, list_max(p)) - 1 end)::int as actual from p)"


def _nll(t: str) -> str:
    return f"avg(list_max(z) / {t} + ln(list_sum(list_transform(z, lambda x: exp((x - list_max(z)) / {t})))) - z[actual + 1] / {t})"


_rounds, _width = [], K.WIDTH
for _k in range(K.ROUNDS):
    _before = "1.0::double" if not _k else f"(select t from f{_k - 1} order by nll, t limit 1)"
    _old = "" if not _k else f"select t, nll from f{_k - 1} union "
    _rounds.append(
        f"f{_k} as materialized ({_old}select t, {_nll('t')} as nll from h, (select {_before} * exp({_width!r}::double * (2.0::double * j / {K.LADDER} - 1)) as t from (select unnest(range(0, {K.LADDER + 1})) as j)) group by t)"
    )
    _width *= 2.0 / K.LADDER
_F = f"f{K.ROUNDS - 1}"
_FIT = f"""{_CSQL}, {', '.join(_rounds)},
  pl as (select {_nll('1.0::double')} as plain, count(*) as n from h), be as (select t, nll from {_F} order by nll, t limit 1),
  te as (select case when nll < plain and t between 0.5 and 5 then t else 1 end as t, case when nll < plain and t between 0.5 and 5 then nll else plain end as nll, plain, n from be, pl),
  ex as (select actual, list_transform(z, lambda x: exp((x - list_max(z)) / t)) as e from h, te), sc as materialized (select actual, list_transform(e, lambda x: x / list_sum(e)) as p from ex),
  tb as (select count(*) as n, avg(list_max(p)) as c, avg((list_position(p, list_max(p)) - 1 = actual)::int) as a from sc group by least(floor(list_max(p) * 15), 14)),
  ec as (select sum(n * abs(c - a)) / sum(n) as ece from tb), lo as (select actual, unnest(range(0, 5))::int as class, unnest(p) as q, 5 - list_position(list_reverse(p), list_max(p)) as top from sc),
  cb as (select class, count(*) as n, avg(q) as c, avg((actual = class)::int) as a from lo group by class, least(floor(q * 15), 14)), ce as (select class, sum(n * abs(c - a)) / sum(n) as v from cb group by class),
  sm as (select class, avg(q) - coalesce(avg(case when actual = class then (top = class)::int end), 0) as g from lo group by class),
  al as (select 'temperature' as name, -1 as class, t as v from te union all select 'nll', -1, nll from te union all select 'plain_nll', -1, plain from te union all select 'rows', -1, n from te union all select 'ece', -1, ece from ec
         union all select 'mixing', -1, least(greatest(0.2 * (1 + least(ece * 2, 1)), 0.1), 0.5) from ec union all select 'class_ece', class, v from ce union all select 'smoothing', class, case when g > 0 then least(g * (1 + g), 0.3) else 0 end from sm)"""
ORACLE["calibration_fit"] = f"{_FIT} select name, class::int as class, {_q('value: v')} from al"

BASE_TEMPERATURE, RAMP = 1.4, 0.5


def _adaptive(s: SparkSession, d: str) -> DataFrame:
    rows = _probabilities(s, d).withColumn("z", K.logits_of(F.col("p")))
    made = K.entropy_adaptive(rows, "z", BASE_TEMPERATURE, RAMP, "symbol")
    return shown(made.withColumns({"first": F.get("adapted", F.lit(0)), "last": F.get("adapted", F.lit(4))}), ["temperature", "first", "last"])


QUERIES["entropy_temperature"] = _adaptive
ORACLE["entropy_temperature"] = f"""{_PSQL}, h as (select symbol, ts, {_LN} as z from p), e as (select *, list_transform(z, lambda x: exp((x - list_max(z)) / {BASE_TEMPERATURE})) as e from h),
  s as (select *, list_transform(e, lambda x: least(greatest(x / list_sum(e), 1e-10), 1 - 1e-10)) as s from e), m as (select symbol, avg(-list_sum(list_transform(s, lambda x: x * ln(x))) / {math.log(5)!r}) as m from s group by symbol),
  t as (select symbol, ts, z, 1 + ({BASE_TEMPERATURE} * (0.75 + 0.5 * (1 - m)) - 1) * {RAMP}::double as t from h join m using (symbol)), w as (select *, list_transform(z, lambda x: exp((x - list_max(z)) / t)) as w from t)
  select symbol, epoch(ts)::bigint as t, {_q('temperature: t', 'first: w[1] / list_sum(w)', 'last: w[5] / list_sum(w)')} from w"""
