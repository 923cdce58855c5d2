"""Queries of searched parameters, overlaps, paths, the parabolic stop and stored models, with the DuckDB statements of those that have one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import checkpointed, shared_folder
from ..operators import balance as B
from ..operators import container, intervals, model, parabolic, paths, search
from ..operators import diversity as D
from ..operators import sequences as Q
from ..operators import targets as T
from . import sqlkit as S
from .evaluation import _q, _r
from .indicators import bars, shown
from .sequence_queries import _DIR, _SUMMARY, HORIZON, LENGTH, STEP, _labelled, _summary
from .target_queries import GRID, HORIZONS, ORACLE as TARGET_ORACLE, _volume_target

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


# counts steer the search, so it has no SQL form; tests hold it against the grid
def _searched(s: SparkSession, d: str) -> DataFrame:
    b = bars(s, d)
    given = {target: [{T.VARIED[target]: v} for v in values] for target, values in GRID.items()}
    return search.as_rows(b, search.searched(b, LENGTH, STEP, HORIZONS, given))


QUERIES["searched_parameters"] = _searched

_SPLIT = f"select * from ({TARGET_ORACLE['exact_split']})"
_PAIR = f"""x as (select distinct symbol, seq, split from ({_SPLIT})),
  p as (select a.symbol, least(a.split, b.split) as low, greatest(a.split, b.split) as high, greatest({LENGTH} - abs(a.seq - b.seq), 0) / {LENGTH}::double as r, a.seq as sa, b.seq as sb, a.split as pa, b.split as pb
        from x a join x b on a.symbol = b.symbol and (a.seq < b.seq or (a.seq = b.seq and a.split < b.split)))"""
QUERIES["split_overlaps"] = lambda s, d: _r(intervals.overlap_report(B.exact_split(_volume_target(s, d), 3, 2, 5), LENGTH, "split"), "mean_overlap", "most")
ORACLE["split_overlaps"] = f"with {_PAIR} select low, high, count(*) as pairs, count(*) filter (where r > 0) as overlapping, {_q('mean_overlap: avg(r)', 'most: max(r)')} from p group by low, high"
QUERIES["split_without_leaks"] = lambda s, d: intervals.without_overlaps(B.exact_split(_volume_target(s, d), 3, 2, 5), LENGTH, "val").select("symbol", "seq", "class", "split")
ORACLE["split_without_leaks"] = (
    f"with {_PAIR} select symbol, seq, class, split from ({_SPLIT}) y where split = 'val' or not exists "
    "(select 1 from x v where v.split = 'val' and v.symbol = y.symbol and abs(v.seq - y.seq) < " + str(LENGTH) + ")"
)

# one array a sequence
_PATH = ("rise", "fall", "mean_rise", "mean_fall", "entropy", "hurst")


def _paths(s: SparkSession, d: str) -> DataFrame:
    arrays = Q.tensors(bars(s, d), ["close"], LENGTH, STEP, 1, False).select("symbol", "seq", F.transform("features", lambda r: r[0]).alias("path"))
    return _r(paths.path_statistics(arrays), *_PATH)


QUERIES["path_statistics"] = _paths
_RS = "case when stddev_pop(m) > 1e-12 then (greatest(max(c), 0) - least(min(c), 0)) / stddev_pop(m) end"
ORACLE["path_statistics"] = f"""with {S.BASE}, n as (select *, count(*) over (partition by symbol) as n_bars from b),
  k as (select x.symbol, x.i as seq, y.i - x.i as k, y.close as p from n x join n y on y.symbol = x.symbol and y.i >= x.i and y.i < x.i + {LENGTH} where x.i % {STEP} = 0 and x.i + {LENGTH} + 1 <= x.n_bars),
  w as (select *, max(p) over f as up, min(p) over f as down, ln(p / lag(p) over (partition by symbol, seq order by k)) as m from k window f as (partition by symbol, seq order by k rows between 1 following and unbounded following)),
  e as (select symbol, seq, max(p) / first(p order by k) - 1 as rise, min(p) / first(p order by k) - 1 as fall, avg(up / p - 1) as mean_rise, avg(down / p - 1) as mean_fall from w group by symbol, seq),
  bn as (select symbol, seq, least(floor((m - min(m) over s) / nullif(max(m) over s - min(m) over s, 0) * 10), 9) as bin from w where m is not null window s as (partition by symbol, seq)),
  en as (select symbol, seq, -sum(q * ln(q)) / ln(10) as entropy from (select symbol, seq, bin, count(*) / sum(count(*)) over (partition by symbol, seq) as q from bn where bin is not null group by symbol, seq, bin) group by symbol, seq),
  h as (select symbol, seq, k, m, (k - 1) // {(LENGTH - 1) // 2} as part from w where m is not null and k <= {(LENGTH - 1) // 2 * 2}),
  c as (select *, sum(m - a) over (partition by symbol, seq, part order by k) as c from (select *, avg(m) over (partition by symbol, seq, part) as a from h)),
  cw as (select *, sum(m - a) over (partition by symbol, seq order by k) as c from (select *, avg(m) over (partition by symbol, seq) as a from h)),
  rs as (select symbol, seq, sum(r) / 2 as half, count(r) as n from (select symbol, seq, part, {_RS} as r from c group by symbol, seq, part) group by symbol, seq),
  rw as (select symbol, seq, {_RS} as whole from cw group by symbol, seq)
  select symbol, seq, {_q('rise: rise', 'fall: fall', 'mean_rise: mean_rise', 'mean_fall: mean_fall', 'entropy: coalesce(entropy, 0)', 'hurst: coalesce(case when n = 2 and half > 0 and whole > 0 then ln(whole / half) / ln(2) end, 0.5)')}
  from e left join en using (symbol, seq) join rs using (symbol, seq) join rw using (symbol, seq)"""

# weighted diversity: the statement makes all pairs
_BARS5 = ("open", "high", "low", "close", "volume")


def _described(s: SparkSession, d: str) -> DataFrame:
    rows = D.described(Q.tensors(bars(s, d), list(_BARS5), LENGTH, STEP, HORIZON, False))
    return rows.join(_labelled(s, d), ["symbol", "seq"]).filter("class is not null")


QUERIES["weighted_diversity"] = lambda s, d: _r(D.weighted(_described(s, d), LENGTH * len(_BARS5), "symbol"), "feature", "temporal", "market_part", "target", "composite").select(
    "symbol", "seq", "class", "feature", "temporal", "market_part", "target", "composite"
)
ORACLE["weighted_diversity"] = f"""with {_SUMMARY}, l as ({_DIR}), m5 as (
    select x.symbol, x.i as seq, list([y.open, y.high, y.low, y.close, y.volume] order by y.i) as a
    from (select *, count(*) over (partition by symbol) as n_bars from b) x join b y on y.symbol = x.symbol and y.i >= x.i and y.i < x.i + {LENGTH}
    where x.i % {STEP} = 0 and x.i + {LENGTH} + {HORIZON} <= x.n_bars group by x.symbol, x.i),
  c as (
    select symbol, seq, flatten(a) as u, list_avg(list_transform(a, lambda r: r[4])) as mean,
           list_avg(list_transform(range(2, {LENGTH + 1}), lambda k: greatest(a[k][2] - a[k][3], abs(a[k][2] - a[k - 1][4]), abs(a[k][3] - a[k - 1][4])))) as tr,
           list_sum(list_transform(range(1, {LENGTH + 1}), lambda k: (k - 1 - {(LENGTH - 1) / 2}) * a[k][4])) / {sum((k - (LENGTH - 1) / 2) ** 2 for k in range(LENGTH))} as slope,
           list_avg(list_transform(a, lambda r: r[5])) as vol, list_max(list_transform(a, lambda r: r[2])) - list_min(list_transform(a, lambda r: r[3])) as reach
    from m5),
  r as (select c.symbol, c.seq, class, u, [tr, slope, case when mean > 0 then vol / mean else 0 end, reach / mean] as m from c join l using (symbol, seq) where class is not null),
  g as (select *, count(*) over (partition by symbol) as n, count(*) over (partition by symbol, class) as same, min(seq) over (partition by symbol) as lo, max(seq) over (partition by symbol) as hi from r),
  p as (select x.symbol, x.seq, avg(1 - list_cosine_similarity(x.u, y.u)) as f, avg(1 - list_cosine_similarity(x.m, y.m)) as k from r x join r y on x.symbol = y.symbol and x.seq <> y.seq group by 1, 2),
  z as (select g.symbol, g.seq, class, coalesce(f, 1) as feature, case when (hi - lo) // 2 > 0 then least(abs(g.seq - (hi + lo) // 2) / ((hi - lo) // 2), 1) else 1 end as temporal,
               case when n = 1 then 0.5 else greatest(least(k, 1), 0) end as market_part, 0.2 + 0.6 * (1 - same / n) as target from g left join p on p.symbol = g.symbol and p.seq = g.seq)
  select symbol, seq, class, {_q('feature: feature', 'temporal: temporal', 'market_part: market_part', 'target: target', 'composite: 0.3 * feature + 0.25 * temporal + 0.25 * market_part + 0.2 * target')} from z"""
QUERIES["diverse_picks"] = lambda s, d: D.farthest_first(_described(s, d), 8, "symbol")

# a recurrence that switches direction; the statement follows the bars one by one
QUERIES["parabolic"] = lambda s, d: shown(parabolic.parabolic(bars(s, d)).withColumn("sar_rising", F.col("sar_rising").cast("double")), ["sar", "sar_rising"])
_AT = "case when r.up then least(r.v + r.a * (r.e - r.v), c.l1, coalesce(c.l2, c.l1)) else greatest(r.v + r.a * (r.e - r.v), c.h1, coalesce(c.h2, c.h1)) end"
ORACLE["parabolic"] = f"""with recursive {S.BASE}, c0 as (select *, {S.lag('low')} as l1, {S.lag('low', 2)} as l2, {S.lag('high')} as h1, {S.lag('high', 2)} as h2 from b),
  r as (
    select symbol, ts, i, null::boolean as up, null::double as v, null::double as e, null::double as a from c0 where i = 0
    union all
    select c.symbol, c.ts, c.i,
      case when c.i = 1 then c.chg >= 0 when r.up then not (c.low < {_AT}) else c.high > {_AT} end,
      case when c.i = 1 then case when c.chg >= 0 then c.l1 else c.h1 end when (r.up and c.low < {_AT}) or (not r.up and c.high > {_AT}) then r.e else {_AT} end,
      case when c.i = 1 then case when c.chg >= 0 then greatest(c.h1, c.high) else least(c.l1, c.low) end
           when r.up then case when c.low < {_AT} then c.low else greatest(r.e, c.high) end else case when c.high > {_AT} then c.high else least(r.e, c.low) end end,
      case when c.i = 1 or (r.up and c.low < {_AT}) or (not r.up and c.high > {_AT}) then 0.02::double
           when (r.up and c.high > r.e) or (not r.up and c.low < r.e) then least(r.a + 0.02::double, 0.2::double) else r.a end
    from r join c0 c on c.symbol = r.symbol and c.i = r.i + 1
  )
  select symbol, epoch(ts)::bigint as t, {_q('sar: v', 'sar_rising: up::int')} from r"""

# forests have no SQL form; fitted on the earlier part, stored, loaded, and scored on the later one
_NAMED = [(t, h) for t in ("direction", "volatility", "volume") for h in HORIZONS]


def _backtest(s: SparkSession, d: str) -> DataFrame:
    classes = B.extracted(T.by_horizon(bars(s, d), LENGTH, STEP, HORIZONS), _NAMED)
    rows = checkpointed(model.sequence_features(_summary(s, d)).join(classes, ["symbol", "seq"]))
    early, later = container.early_and_later(rows)
    folder = f"{shared_folder(s)}/models-{uuid.uuid4().hex}"
    container.fit(early, list(model.FEATURES), [f"{t}_{h}" for t, h in _NAMED], trees=10, depth=4).save(s, folder)
    return container.scored(container.Container.load(s, folder), later)


QUERIES["backtest_models"] = _backtest
