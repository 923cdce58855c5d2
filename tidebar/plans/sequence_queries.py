"""Sequence and target queries over hourly bars (24 bars, then 6, half overlapping), each with its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import balance as B
from ..operators import diversity as D
from ..operators import inverse, model
from ..operators import sequences as Q
from ..operators import targets as T
from . import sqlkit as S
from .indicators import bars

LENGTH, HORIZON = 24, 6
STEP = Q.step_size(0.5, LENGTH)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_S, _H = "filter (where part = 's')", "filter (where part = 'h')"


def _members(horizon: int = HORIZON, reach: int = HORIZON) -> str:
    return f"""{S.BASE},
    n as (select *, count(*) over (partition by symbol) as n_bars from b),
    st as (select symbol, i as seq from n where i % {STEP} = 0 and i + {LENGTH + reach} <= n_bars),
    m as (select n.*, st.seq, case when n.i - st.seq < {LENGTH} then 's' else 'h' end as part,
                 case when n.i - st.seq < {LENGTH} then n.i - st.seq else n.i - st.seq - {LENGTH} end as k
          from st join n on n.symbol = st.symbol and n.i >= st.seq and n.i < st.seq + {LENGTH + horizon})"""


def summary_sql(horizon: int = HORIZON, reach: int = HORIZON) -> str:
    """Common tables that end in ``s``, a row a sequence; sequences leave room for the longest horizon, ``reach``."""
    return f"""{_members(horizon, reach)},
    m1 as (select *, (open + high + low + close) / 4 as o4, (open + close) / 2 as mid,
                  case when tr > 0 and close > 0 and k >= 1 then tr / close end as share,
                  case when volume > 0 then ln(volume / greatest(lag(volume) over (partition by symbol, seq, part order by k), 1)) end as dv,
                  lag(volume) over (partition by symbol, seq, part order by k) as pv from m),
    s as (select symbol, seq,
           sum(close * pow((k + 1) / {LENGTH}.0::double, 2)) {_S} / sum(pow((k + 1) / {LENGTH}.0::double, 2)) {_S} as s_wclose,
           sum(close * pow((k + 1) / {horizon}.0::double, 2)) {_H} / sum(pow((k + 1) / {horizon}.0::double, 2)) {_H} as h_wclose,
           list(close order by close) {_S} as s_closes, list(low order by low) {_S} as s_lows, list(high order by high) {_S} as s_highs,
           list(volume order by volume) {_S} as s_volumes,
           list(dv order by dv) filter (where part = 's' and dv is not null) as s_divs,
           list(o4 order by k) {_S} as s_path, list(low order by k) {_H} as h_lows, list(high order by k) {_H} as h_highs,
           max(case when part = 'h' and k = 0 then o4 end) as h_first, max(case when part = 'h' and k = {horizon - 1} then o4 end) as h_last,
           max(case when part = 'h' and k = 0 then mid end) as h_mid0, max(case when part = 'h' and k = {horizon - 1} then mid end) as h_mid1,
           avg(o4) {_S} as s_mean, stddev_pop(o4) {_S} as s_std, avg(share) {_S} as s_atr,
           sum(share * pow(0.9::double, {horizon} - k - 1)) {_H} / nullif(sum(pow(0.9::double, {horizon} - k - 1)) filter (where part = 'h' and share is not null), 0) as h_atr,
           avg(volume) {_S} as s_volume, avg(volume) {_H} as h_volume,
           coalesce(avg(volume) filter (where part = 's' and k >= {LENGTH - 3} and volume > 0), 1) as s_smooth,
           coalesce(avg(volume) filter (where part = 'h' and k >= {horizon - 3} and volume > 0), 1) as h_smooth
          from m1 group by symbol, seq)"""


_MEMBERS, _SUMMARY = _members(), summary_sql()


def _rank(c: str, p: float, rule: str = "floor") -> str:
    return f"{c}[(least({rule}(len({c}) * {p!r}::double), len({c}) - 1) + 1)::int]"


def _within(lo: str, hi: str) -> str:
    return f"greatest(1 - least(coalesce(abs(x - ({lo} + {hi}) / 2) / nullif(({hi} - {lo}) / 2, 0), 1), 1), 0.1)"


def _beyond(x: str) -> str:
    return f"coalesce(least(greatest(greatest({x}, 0) / nullif(w, 0), 0.1), 1), 0.1)"


_STRENGTH = f"case when class = 0 then {_beyond('b0 - x')} when class = 1 then {_within('b0', 'b1')} when class = 2 then {_within('b1', 'b2')} when class = 3 then {_within('b2', 'b3')} when class = 4 then {_beyond('x - b3')} end"
_STRICT = "case when x < b0 then 0 when x < b1 then 1 when x < b2 then 2 when x < b3 then 3 when x is not null then 4 end"
_INCL = "case when x <= b0 then 0 when x <= b1 then 1 when x < b2 then 2 when x < b3 then 3 when x is not null then 4 end"

_D: dict[str, str] = {
    "price_level": f"""select symbol, seq, x, lo - w0 as b0, (lo + hi) / 2 - (hi - lo) * 0.3 / 2 as b1, (lo + hi) / 2 + (hi - lo) * 0.3 / 2 as b2, hi + w0 as b3, w0 as w, lo, hi
        from (select symbol, seq, h_wclose as x, {_rank('s_closes', 0.1)} as lo, {_rank('s_closes', 0.9)} as hi, ({_rank('s_closes', 0.9)} - {_rank('s_closes', 0.1)}) * 0.25 as w0 from s)""",
    "volatility": """select symbol, seq, (a - e) / e + v * 0.1 as x, -0.4 as b0, -0.2 as b1, 0.2 as b2, 0.4 as b3, 0.4 as w from
        (select symbol, seq, greatest(coalesce(s_atr, 0), 1e-4) as e, greatest(coalesce(h_atr, 0), 1e-4) as a,
                case when s_volume > 0 and h_volume > 0 then least(greatest(ln(h_volume / s_volume), -2), 2) else 0 end as v from s)""",
    "sentiment": f"""select symbol, seq, x, -2 * t as b0, -t as b1, t as b2, 2 * t as b3, 2 * t as w from
        (select symbol, seq, case when h_volume > 0 then ln(h_volume / greatest(s_volume, 1)) end - case when h_mid0 > 0 then h_mid1 / h_mid0 - 1 else 0 end as x,
                greatest(abs(coalesce({_rank('s_divs', 0.9, 'ceil')}, 1)), 0.1) * 0.5 as t from s)""",
    "volume": f"""select symbol, seq, x, -2 * t as b0, -t as b1, t as b2, 2 * t as b3, 2 * t as w from
        (select symbol, seq, ln(h_smooth / s_smooth) as x,
                case when {_rank('s_volumes', 0.1)} > 1e-10 then ln({_rank('s_volumes', 0.9, 'ceil')} / {_rank('s_volumes', 0.1)}) else 0.693 end * 0.4 as t from s where s_smooth >= 1e-10)""",
    "direction": """select symbol, seq, x, -e as b0, -t as b1, t as b2, e as b3, e as w from
        (select symbol, seq, x, greatest(c, 0.02) as t, greatest(c * 2, 0.05) as e from
        (select symbol, seq, (case when abs(h_first) < 1e-10 then 0 else h_last / h_first - 1 end - case when abs(s_path[1]) < 1e-10 then 0 else s_path[24] / s_path[1] - 1 end)
                / (1 + case when abs(s_mean) > 1e-10 then s_std / s_mean else 0.01 end) as x,
                greatest(list_aggregate(list_transform(range(1, 9), lambda j: (s_path[j + 16] / s_path[j + 8] - 1) - (s_path[j + 8] / s_path[j] - 1)), 'stddev_pop'), 0.005) as c from s))""",
}
_CLASS = {
    "price_level": f"case when hi = lo then case when x >= lo then 3 else 2 end else {_STRICT} end",
    "volatility": _INCL,
    "sentiment": _INCL,
    "volume": _STRICT,
    "direction": "case when x <= b0 then 0 when x <= b1 then 1 when abs(x) <= b2 then 2 when x <= b3 then 3 when x is not null then 4 end",
}
_STOP = """select symbol, seq, class, worst from (select *, case when up then case when x < b0 then 0 when x < b1 then 1 when x < b2 then 2 when x < b3 then 3 when x is not null then 4 end
       else case when x > b3 then 0 when x > b2 then 1 when x > b1 then 2 when x > b0 then 3 when x is not null then 4 end end as class, round(x, 6) as worst from
  (select *, lo - reach * 0.25 as b0, (lo + hi) / 2 - reach * 0.3 / 2 as b1, (lo + hi) / 2 + reach * 0.3 / 2 as b2, hi + reach * 0.25 as b3 from
  (select *, case when abs(hi - lo) > 0 then abs(hi - lo) when abs(s_wclose - lo) > 0 then abs(s_wclose - lo) else abs(lo) * 0.01 end as reach,
          case when list_max(sev) > 0 then px[list_position(sev, list_max(sev))] else s_wclose end as x from
  (select *, side[(least(floor(len(side) * 0.1::double), len(side) - 1) + 1)::int] as lo, side[(least(floor(len(side) * 0.9::double), len(side) - 1) + 1)::int] as hi,
          list_transform(range(1, len(px) + 1), lambda j: greatest(case when up then s_wclose - px[j] else px[j] - s_wclose end, 0) * (0.5 + 0.5 * pow(j / len(px)::double, 2))) as sev from
  (select *, h_wclose >= s_wclose as up, case when h_wclose >= s_wclose then s_lows else s_highs end as side, case when h_wclose >= s_wclose then h_lows else h_highs end as px from s)))))"""


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.summaries(bars(spark, sf_dir), LENGTH, STEP, HORIZON)


def _register(name: str, make: Callable[[DataFrame], DataFrame]) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(_summary(spark, sf_dir)).withColumn("strength", F.round(F.col("strength") + S.TIE, 6))

    QUERIES[f"target_{name}"] = query
    flat = "case when hi = lo then 0.3 else " if name == "price_level" else "("
    end = " end" if name == "price_level" else ")"
    ORACLE[f"target_{name}"] = (
        f"with {_SUMMARY}, d as ({_D[name]}), c as (select *, {_CLASS[name]} as class from d) "
        f"select symbol, seq, class, round(({flat}{_STRENGTH}{end})::double + {S.TIE!r}, 6) as strength from c"
    )


_register("price_level", T.price_levels)
_register("direction", lambda s: T.direction(s, LENGTH))
_register("volatility", T.volatility)
_register("sentiment", T.sentiment)
_register("volume", T.volume)
QUERIES["target_stop_level"] = lambda spark, sf_dir: T.stop_levels(_summary(spark, sf_dir)).withColumn("strength", F.round(F.col("strength") + S.TIE, 6))
# the classes of a fall run from the highest boundary down
_STOP_STRENGTH = _STRENGTH.replace("class =", "(case when up then class else 4 - class end) =").replace("case when (case", "case when class is null then null when (case", 1)
_STOP = _STOP.replace("select symbol, seq, class, worst from (select *,", f"select symbol, seq, class, worst, {_STOP_STRENGTH} as strength from (select *, reach * 0.25 as w,")
ORACLE["target_stop_level"] = f"with {_SUMMARY} select symbol, seq, class, worst, round(strength::double + {S.TIE!r}, 6) as strength from ({_STOP})"

_ALL = "select symbol, seq, 'stop_level' as target, class, strength from (" + _STOP + ")"
for _n in _D:
    _made = f"case when hi = lo then 0.3 else {_STRENGTH} end" if _n == "price_level" else _STRENGTH
    _ALL += f" union all select symbol, seq, '{_n}' as target, class, {_made} as strength from (select *, {_CLASS[_n]} as class from ({_D[_n]}))"


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.all_targets(_summary(spark, sf_dir), LENGTH)


QUERIES["all_targets"] = lambda spark, sf_dir: _targets(spark, sf_dir).withColumn("strength", F.round(F.col("strength") + S.TIE, 6))
ORACLE["all_targets"] = f"with {_SUMMARY} select symbol, seq, target, class, round(strength::double + {S.TIE!r}, 6) as strength from ({_ALL})"
QUERIES["class_distribution"] = lambda spark, sf_dir: T.class_distribution(_targets(spark, sf_dir)).withColumn("percent", F.round("percent", 6))
ORACLE["class_distribution"] = (
    f"with {_SUMMARY}, a as ({_ALL}) select target, class, count(*) as n, round(count(*) * 100.0::double / sum(count(*)) over (partition by target), 6) as percent from a where class is not null group by target, class"
)
QUERIES["one_hot"] = lambda spark, sf_dir: T.one_hot(_targets(spark, sf_dir))
_HOT = ", ".join(f"max(case when target = '{t}' and class = {k} then 1 else 0 end) as {t}_{k}" for t in ("price_level", "direction", "volatility") for k in range(5))
ORACLE["one_hot"] = f"with {_SUMMARY}, a as ({_ALL}) select symbol, seq, {_HOT} from a where target in ('price_level', 'direction', 'volatility') group by symbol, seq"

QUERIES["sequence_starts"] = lambda spark, sf_dir: Q.starts(bars(spark, sf_dir), LENGTH, STEP, HORIZON)
ORACLE["sequence_starts"] = f"with {_MEMBERS} select symbol, seq from st"
QUERIES["sequence_zscores"] = lambda spark, sf_dir: Q.zscores(bars(spark, sf_dir), "close", LENGTH, STEP, HORIZON).withColumn("z", F.round(F.col("z") + S.TIE, 6))
ORACLE["sequence_zscores"] = (
    f"with {_MEMBERS} select symbol, seq, k, round((close - avg(close) over w) / greatest(stddev_pop(close) over w, 1e-6) + {S.TIE!r}, 6) as z from m where part = 's' window w as (partition by symbol, seq)"
)
QUERIES["last_sequence"] = lambda spark, sf_dir: Q.last_sequence(bars(spark, sf_dir), LENGTH).select("symbol", "i", F.round("close", 6).alias("close"))
ORACLE["last_sequence"] = f"with {_MEMBERS} select symbol, i, round(close, 6) as close from n where n_bars >= {LENGTH} and i >= n_bars - {LENGTH}"

# balance and splits
_DIR = f"select symbol, seq, {_CLASS['direction']} as class, round(({_STRENGTH.replace('class', 'cls')})::double, 6) as strength from (select *, {_CLASS['direction']} as cls from ({_D['direction']}))"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.direction(_summary(spark, sf_dir), LENGTH).withColumn("strength", F.round("strength", 6))


_TOP = "row_number() over (partition by class order by strength desc, symbol, seq)"
QUERIES["balance_to_min"] = lambda spark, sf_dir: B.balance_to_min(_labelled(spark, sf_dir)).select("symbol", "seq", "class")
ORACLE["balance_to_min"] = (
    f"with {_SUMMARY}, l as ({_DIR}), c as (select min(n) as least from (select count(*) as n from l where class is not null group by class)) "
    f"select symbol, seq, class from (select *, {_TOP} as rn from l where class is not null), c where rn <= least"
)
QUERIES["diverse_selection"] = lambda spark, sf_dir: B.strongest_per_bucket(_labelled(spark, sf_dir), 5).select("symbol", "seq", "class", "bucket")
ORACLE["diverse_selection"] = (
    f"with {_SUMMARY}, l as ({_DIR}), x as (select *, least(floor((seq - min(seq) over (partition by class)) * 5.0::double / nullif(max(seq) over (partition by class) - min(seq) over (partition by class) + 1, 0)), 4)::int as bucket from l where class is not null) "
    "select symbol, seq, class, bucket from (select *, row_number() over (partition by class, bucket order by strength desc, symbol, seq) as rn from x) where rn = 1"
)
QUERIES["stratified_split"] = lambda spark, sf_dir: B.stratified_split(_labelled(spark, sf_dir), 0.2, 0.1).select("symbol", "seq", "class", "split")
ORACLE["stratified_split"] = (
    f"with {_SUMMARY}, l as ({_DIR}), x as (select *, row_number() over (partition by class order by symbol, seq) - 1 as r from l where class is not null) "
    "select symbol, seq, class, case when floor((r + 1) * 0.2::double) > floor(r * 0.2::double) then 'val' when floor((r + 1) * 0.1::double + 0.5) > floor(r * 0.1::double + 0.5) then 'test' else 'train' end as split from x"
)
QUERIES["chronological_split"] = lambda spark, sf_dir: B.chronological_split(bars(spark, sf_dir), 0.7, 0.15).groupBy("symbol", "split").agg(F.count(F.lit(1)).alias("n"))
ORACLE["chronological_split"] = (
    f"with {_MEMBERS} select symbol, case when i < floor(n_bars * 0.7::double) then 'train' when i < floor(n_bars * 0.7::double) + floor(n_bars * 0.15::double) then 'val' else 'test' end as split, count(*) as n from n group by all"
)
QUERIES["balance_score"] = lambda spark, sf_dir: B.balance_score(_targets(spark, sf_dir))
ORACLE["balance_score"] = f"""with {_SUMMARY}, a as ({_ALL}), p as (select target, k.class as class, count(a.class) * 100.0::double / (select count(*) from a z where z.target = t.target and z.class is not null) as pct
    from (select distinct target from a) t cross join (select unnest(range(0, 5)) as class) k left join a using (target, class) group by target, k.class)
    select target, round(avg(abs(pct - 20)), 6) as mean_off, round(case when min(pct) > 0 then max(pct) / min(pct) end, 6) as imbalance,
           round(avg(abs(pct - 20)) / 20 + case when min(pct) = 0 then 1000 when max(pct) / min(pct) > 10 then (max(pct) / min(pct) - 10) * 10 else 0 end, 6) as score from p group by target"""
_GRID = (0.5, 1.0, 1.5, 2.0)
QUERIES["calibrate_direction"] = lambda spark, sf_dir: B.direction_grid(_summary(spark, sf_dir), LENGTH, _GRID)
ORACLE["calibrate_direction"] = f"""with {_SUMMARY}, g as (select unnest([{', '.join(map(str, _GRID))}])::double as sensitivity), d0 as (
    select symbol, seq, (case when abs(h_first) < 1e-10 then 0 else h_last / h_first - 1 end - case when abs(s_path[1]) < 1e-10 then 0 else s_path[24] / s_path[1] - 1 end)
                / (1 + case when abs(s_mean) > 1e-10 then s_std / s_mean else 0.01 end) as x,
                greatest(list_aggregate(list_transform(range(1, 9), lambda j: (s_path[j + 16] / s_path[j + 8] - 1) - (s_path[j + 8] / s_path[j] - 1)), 'stddev_pop'), 0.005) as c from s),
    d as (select sensitivity, x, greatest(c * sensitivity, 0.02) as t, greatest(c * sensitivity * 2, 0.05) as e from d0, g)
    select sensitivity, count(*) as n, {', '.join(f"count(*) filter (where (case when x <= -e then 0 when x <= -t then 1 when abs(x) <= t then 2 when x <= e then 3 else 4 end) = {k}) as n_{k}" for k in range(5))} from d group by sensitivity"""
QUERIES["overlap_ratio"] = lambda spark, sf_dir: B.mean_overlap(Q.starts(bars(spark, sf_dir), LENGTH, STEP, HORIZON), LENGTH, STEP)
ORACLE["overlap_ratio"] = f"""with {_MEMBERS}, o as (select a.symbol, greatest(0, {LENGTH} - (b.seq - a.seq)) / {LENGTH}.0::double as r from st a join st b on a.symbol = b.symbol and a.seq < b.seq)
    select symbol, count(*) as n_pairs, round(avg(r), 6) as mean_overlap from o group by symbol"""
QUERIES["shuffle_order"] = lambda spark, sf_dir: B.shuffled(Q.starts(bars(spark, sf_dir), LENGTH, STEP, HORIZON), 7).select("symbol", "seq", "order")
ORACLE["shuffle_order"] = f"with {_MEMBERS} select symbol, seq, md5(concat_ws(':', 7, symbol, seq)) as \"order\" from st"

# inverse mapping and diversity
QUERIES["price_bins"] = lambda spark, sf_dir: inverse.price_bins(_summary(spark, sf_dir)).select(
    "symbol", "seq", "class", *[F.round(F.col(c) + S.TIE, 6).alias(c) for c in ("low", "high", "change_pct")]
)
ORACLE["price_bins"] = f"""with {_SUMMARY}, d as (select symbol, seq, s_wclose as ref, {_rank('s_closes', 0.1)} as lo, {_rank('s_closes', 0.9)} as hi from s),
    e as (select *, [lo - 0.5 * (hi - lo), lo - 0.25 * (hi - lo), (lo + hi) / 2 - (hi - lo) * 0.15, (lo + hi) / 2 + (hi - lo) * 0.15, hi + 0.25 * (hi - lo), hi + 0.5 * (hi - lo)] as b from d)
    select symbol, seq, k::int as class, round(b[k + 1] + {S.TIE!r}, 6) as low, round(b[k + 2] + {S.TIE!r}, 6) as high, round(((b[k + 1] + b[k + 2]) / 2 - ref) / nullif(ref, 0) * 100 + {S.TIE!r}, 6) as change_pct
    from e, (select unnest(range(0, 5)) as k)"""
QUERIES["temporal_diversity"] = lambda spark, sf_dir: D.temporal(_labelled(spark, sf_dir).filter("class is not null"), "symbol", "class").withColumn("temporal", F.round(F.col("temporal") + S.TIE, 6))
ORACLE["temporal_diversity"] = (
    f"with {_SUMMARY}, l as ({_DIR}), g as (select symbol, class, (seq - lag(seq) over (partition by symbol, class order by seq))::double as g from l where class is not null) "
    f"select symbol, class, round(greatest(1 - coalesce(stddev_pop(g) / nullif(avg(g), 0), 0), 0) + {S.TIE!r}, 6) as temporal from g group by symbol, class"
)
_SHAPES = ("close", "volume", "high")
QUERIES["feature_diversity"] = lambda spark, sf_dir: D.feature_space(bars(spark, sf_dir), list(_SHAPES)).withColumn("diversity", F.round(F.col("diversity") + S.TIE, 6))
ORACLE["feature_diversity"] = f"with {S.BASE}" + " ".join(
    (" union all " if k else " ")
    + f"select '{c}' as feature, round(1 - sum(abs(share - 0.2)) / 1.6 + {S.TIE!r}, 6) as diversity from (select k, count(x.bin) * 1.0::double / (select count(*) from b) as share from (select unnest(range(0, 5)) as k) left join (select least(floor(({c} - (select min({c}) from b)) * 5 / nullif((select max({c}) - min({c}) from b), 0)), 4)::int as bin from b) x on x.bin = k group by k)"
    for k, c in enumerate(_SHAPES)
)
QUERIES["market_conditions"] = lambda spark, sf_dir: D.market_conditions(_summary(spark, sf_dir))
ORACLE["market_conditions"] = f"""with {_SUMMARY}, r as (select symbol, (h_wclose - s_wclose) / nullif(s_wclose, 0) as m, row_number() over (partition by symbol order by (h_wclose - s_wclose) / nullif(s_wclose, 0)) - 1 as r, count(*) over (partition by symbol) as n from s),
    q as (select *, max(case when r = floor((n - 1) * 0.33::double + 0.5) then m end) over (partition by symbol) as a, max(case when r = floor((n - 1) * 0.67::double + 0.5) then m end) over (partition by symbol) as z from r)
    select symbol, case when m < a then 'bear' when m > z then 'bull' else 'side' end as market, count(*) as n from q group by all"""
# four bars each, so that some sequences of event counts do repeat
QUERIES["repeated_sequences"] = lambda spark, sf_dir: D.repeated_sequences(Q.tensors(bars(spark, sf_dir), ["volume"], 4, 4, 1, False)).select("symbol", "seq", "n")
ORACLE["repeated_sequences"] = f"""with {S.BASE}, n as (select *, count(*) over (partition by symbol) as n_bars from b), k as (select x.symbol, x.i as seq, list(y.volume order by y.i) as l from n x join n y on y.symbol = x.symbol and y.i >= x.i and y.i < x.i + 4 where x.i % 4 = 0 and x.i + 5 <= x.n_bars group by x.symbol, x.i)
    select symbol, min(seq) as seq, count(*) as n from k group by symbol, l having count(*) > 1"""
# trained on the earlier part of each symbol; no SQL form
QUERIES["backtest_forest"] = lambda spark, sf_dir: model.backtest(model.sequence_features(_summary(spark, sf_dir)), T.direction(_summary(spark, sf_dir), LENGTH))
