"""Queries of feature importance, balanced truncation, alignment and adjusted ranges, each with its DuckDB statement where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import by_symbol
from ..operators import balance as B
from ..operators import confidence as C
from ..operators import measures as E
from ..operators import selection as L
from ..operators import sequences as Q
from ..operators import targets as T
from . import sqlkit as S
from .confidence_queries import _label
from .evaluation import _PSQL, _probabilities, _q, _r
from .indicators import bars, base, shown
from .sequence_queries import _ALL, _SUMMARY, HORIZON, LENGTH, STEP, _summary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
B0 = f"with {S.BASE}"

# what bars tell of the class of the return that follows
FEATURES = ["open", "high", "low", "close", "volume", "ret", "chg", "tr"]
_LIMITS = (-0.5, -0.1, 0.1, 0.5)


def _labelled(s: SparkSession, d: str) -> DataFrame:
    after = F.lead("ret").over(by_symbol())
    cls = F.when(after < _LIMITS[0], 0).when(after < _LIMITS[1], 1).when(after < _LIMITS[2], 2).when(after < _LIMITS[3], 3).when(after.isNotNull(), 4)
    return base(s, d).withColumn("class", cls)


QUERIES["feature_importance"] = lambda s, d: _r(L.importance(_labelled(s, d), FEATURES, "class"), "information", "ratio", "importance")
_CASE = " ".join(f"when after < {v} then {k}" for k, v in enumerate(_LIMITS))
ORACLE["feature_importance"] = f"""{B0}, a as (select *, lead(ret) over ({S.W}) as after from b), c as (select *, case {_CASE} when after is not null then 4 end as class from a),
  l as ({' union all '.join(f"select '{f}' as feature, class, {f}::double as x from c where class is not null" for f in FEATURES)}),
  e as (select feature, min(x) as low, max(x) as high, avg(x) as a from l group by feature),
  g as (select l.*, low, high, a, case when x is null then -1 else coalesce(least(floor((x - low) / nullif(high - low, 0) * {L.BINS}), {L.BINS - 1}), 0) end as bin from l join e using (feature)),
  n as (select feature, class, bin, count(*) as n from g group by all),
  p as (select *, n / sum(n) over (partition by feature)::double as p, sum(n) over (partition by feature, class) / sum(n) over (partition by feature)::double as pc, sum(n) over (partition by feature, bin) / sum(n) over (partition by feature)::double as pb from n),
  i as (select feature, sum(p * ln(p / (pc * pb))) / nullif(-sum(p * ln(pc)), 0) as i from p group by feature),
  m as (select feature, class, count(x) as n, avg(x) as c, any_value(a) as a from g group by feature, class),
  t as (select feature, sum((x - a) * (x - a)) as t from g group by feature), r as (select feature, sum(n * (c - a) * (c - a)) / nullif(any_value(t), 0) as r from m join t using (feature) group by feature)
  select feature, {_q('information: i', 'ratio: r', 'importance: (i + r) / 2')} from i join r using (feature)"""

# the set that is chosen of them; the greedy part is tested against hand-made tables
QUERIES["chosen_features"] = lambda s, d: _r(
    s.createDataFrame([(k, f, v) for k, (f, v) in enumerate(L.chosen(_labelled(s, d).fillna(0.0, FEATURES), FEATURES, "class", most=5))], "place int, feature string, importance double"), "importance"
)

# a balanced table cut to twenty rows
_COUNT = 20


def _truncated(s: SparkSession, d: str) -> DataFrame:
    labelled = T.volatility(_summary(s, d)).filter("class is not null").withColumn("class", F.pmod(F.floor(F.col("seq") / STEP), F.lit(5)).cast("int"))
    return B.truncated(B.balance_to_min(labelled), _COUNT).select("symbol", "seq", "class")


QUERIES["balanced_truncation"] = _truncated
ORACLE["balanced_truncation"] = f"""with {_SUMMARY}, a as (select symbol, seq, ((seq // {STEP}) % 5)::int as class, strength from ({_ALL}) where target = 'volatility' and class is not null),
  k as (select *, row_number() over (partition by class order by strength desc, symbol, seq) as r, count(*) over (partition by class) as n from a), kept as (select * exclude (r, n) from k where r <= (select min(n) from k)),
  q as (select *, row_number() over (partition by class order by symbol, seq) - 1 as r, count(*) over (partition by class) as n from kept)
  select symbol, seq, class from q where ceil((2 * r + 1) * {_COUNT // 5} / (2 * n)::double) > ceil(greatest((2 * r - 1) * {_COUNT // 5}, 0) / (2 * n)::double)"""

QUERIES["alignment_report"] = lambda s, d: Q.alignment(Q.starts(bars(s, d), LENGTH, STEP, 2 * HORIZON), T.direction(_summary(s, d), LENGTH).filter("class <> 2"), bars(s, d))
ORACLE["alignment_report"] = f"""with {_SUMMARY}, a as (select distinct symbol, seq from ({_ALL}) where target = 'direction' and class <> 2), n2 as (select symbol, count(*) as n_bars from b group by symbol),
  o as (select symbol, i as seq from n where i % {STEP} = 0 and i + {LENGTH + 2 * HORIZON} <= n_bars), f as (select coalesce(o.symbol, a.symbol) as symbol, coalesce(o.seq, a.seq) as seq, o.seq is not null as s, a.seq is not null as t from o full join a on o.symbol = a.symbol and o.seq = a.seq),
  g as (select f.symbol, count(*) filter (where s) as n_sequences, count(*) filter (where t) as n_targets, count(*) filter (where s and not t) as unlabelled, count(*) filter (where t and not s) as unmatched, count(*) filter (where seq >= n_bars) as outside from f join n2 using (symbol) group by f.symbol)
  select symbol, coalesce(n_sequences, 0)::bigint as n_sequences, coalesce(n_targets, 0)::bigint as n_targets, coalesce(unlabelled, 0)::bigint as unlabelled, coalesce(unmatched, 0)::bigint as unmatched, 0::bigint as repeated, coalesce(outside, 0)::bigint as outside, n_bars::bigint as n_bars from n2 left join g using (symbol)"""

QUERIES["adjusted_atr"] = lambda s, d: shown(_probabilities(s, d).withColumn("atr", E.sequence_atr(None, LENGTH)).withColumn("adjusted", E.adjusted_atr(F.col("atr"), C.class_label(F.col("p"), C.VOLUME_LABELS))), ["atr", "adjusted"])
ORACLE["adjusted_atr"] = f"""{_PSQL}, k as (select *, coalesce(tr, high - low) / case when close > 0 then close end * 100 as share, {_label('p', C.VOLUME_LABELS)} as label from p), a as (select *, {S.inc('avg(share)', LENGTH)} as atr from k)
  select symbol, epoch(ts)::bigint as t, {_q('atr: atr', 'adjusted: atr * case label ' + ' '.join(f"when '{n}' then {v}" for n, v in E.ATR_FACTOR.items()) + ' end')} from a"""
