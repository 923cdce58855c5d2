"""Queries of preparation pipelines and of scores and characteristics, each with its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import measures as M
from ..operators import pipelines as L
from ..operators import predictions as P
from ..operators import trend as T
from . import sqlkit as S
from .evaluation import _PSQL, _probabilities, _q, _r
from .indicators import bars, base, shown
from .prediction_queries import _TEMPS, ORACLE as _PREDICTIONS, _logits
from .sequence_queries import _ALL, _SUMMARY, _targets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
B = f"with {S.BASE}"
_HEAD = "select symbol, epoch(ts)::bigint as t"


def _features():
    return {"sma_20": T.sma("close", 20), "mom_10": T.momentum("close", 10)}


_F = f"{S.full('avg(close)', 'close', 20)} as sma_20, (close - {S.lag('close', 10)}) / nullif({S.lag('close', 10)}, 0) as mom_10"
_TRIM = "k as (select *, (sma_20 is null or mom_10 is null)::int as bad from f), o as (select *, max(1 - bad) over (partition by symbol order by ts rows unbounded preceding) as started from k), tm as (select * from o where started = 1)"


def _stats(table: str, columns: tuple[str, ...], name: str) -> str:
    """A common table of statistics by symbol and feature."""
    each = " union all ".join(
        f"select symbol, '{c}' as feature, {c}::double as x, row_number() over (partition by symbol order by {c}) - 1 as r, count(*) over (partition by symbol) as n from {table} where {c} is not null" for c in columns
    )
    at = lambda p: f"max(case when r = floor((n - 1) * {p}::double + 0.5) then x end)"
    return f"{name} as (select symbol, feature, avg(x) as mean, stddev_pop(x) as std, min(x) as min, max(x) as max, {at(0.5)} as median, {at(0.25)} as q25, {at(0.75)} as q75 from ({each}) group by symbol, feature)"


QUERIES["saved_statistics"] = lambda s, d: _r(L.fit(base(s, d), ["close", "volume"]), *L.STATISTICS)
ORACLE["saved_statistics"] = f"{B}, {_stats('b', ('close', 'volume'), 'st')} select symbol, feature, {_q(*[f'{n}: {n}' for n in L.STATISTICS])} from st"


def _apply(s: SparkSession, d: str) -> DataFrame:
    rows = base(s, d)
    stats = L.fit(rows.filter("i < 500"), ["close", "volume"])
    out = rows
    for how in ("robust", "minmax", "standard", "quantile"):
        made = L.apply(rows, stats, ["close", "volume"], how).select("symbol", "ts", F.col("close").alias(f"close_{how}"), F.col("volume").alias(f"volume_{how}"))
        out = out.join(made, ["symbol", "ts"])
    return shown(out, _APPLIED)


_APPLIED = [f"{c}_{h}" for h in ("robust", "minmax", "standard", "quantile") for c in ("close", "volume")]
QUERIES["apply_statistics"] = _apply


def _norm(c: str, how: str) -> str:
    shift, scale = {"minmax": ("min", "max - y.min"), "standard": ("mean", "std")}.get(how, ("median", "q75 - y.q25"))
    y = {"close": "y", "volume": "z"}[c]
    scale = scale.replace("y.", f"{y}.")
    return f"{c}_{how}: case when {y}.{scale} > 0 then (b.{c} - {y}.{shift}) / ({y}.{scale}) else b.{c} end"


ORACLE["apply_statistics"] = f"{B}, early as (select * from b where i < 500), {_stats('early', ('close', 'volume'), 'st')} select b.symbol, epoch(b.ts)::bigint as t, {_q(*[_norm(c, h) for h in ('robust', 'minmax', 'standard', 'quantile') for c in ('close', 'volume')])} from b join st y on y.symbol = b.symbol and y.feature = 'close' join st z on z.symbol = b.symbol and z.feature = 'volume'"

QUERIES["training_pipeline"] = lambda s, d: shown(L.training(bars(s, d), _features())[0], ["volume", "sma_20", "mom_10"])
ORACLE["training_pipeline"] = f"""{B}, {_stats('b', ('volume',), 'sv')}, f as (select b.* replace (case when q75 > q25 then least(greatest(volume, q25 - 1.5 * (q75 - q25)), q75 + 1.5 * (q75 - q25)) else volume end as volume), {_F} from b join sv using (symbol)), {_TRIM}, {_stats('tm', ('sma_20', 'mom_10'), 'st')}
  select tm.symbol, epoch(tm.ts)::bigint as t, {_q('volume: volume', 'sma_20: case when y.q75 > y.q25 then (sma_20 - y.median) / (y.q75 - y.q25) else sma_20 end', 'mom_10: case when z.q75 > z.q25 then (mom_10 - z.median) / (z.q75 - z.q25) else mom_10 end')} from tm join st y on y.symbol = tm.symbol and y.feature = 'sma_20' join st z on z.symbol = tm.symbol and z.feature = 'mom_10'"""

QUERIES["prediction_pipeline"] = lambda s, d: shown(L.prediction(bars(s, d).filter(F.hour("ts") < 12), _features(), L.training(bars(s, d), _features())[1]), ["sma_20", "mom_10"])
_HALF = S.BASE.replace("from events group by", "from events where hour(ts) < 12 group by").replace("bars as", "hbars as").replace("b1 as", "h1 as").replace("from bars", "from hbars").replace("b as (", "h as (").replace("from b1", "from h1")
ORACLE["prediction_pipeline"] = f"""{B}, f as (select *, {_F} from b), {_TRIM}, {_stats('tm', ('sma_20', 'mom_10'), 'st')}, {_HALF}, hf as (select *, {_F} from h), {_TRIM.replace('k as', 'hk as').replace('from f', 'from hf').replace('o as', 'ho as').replace('from k', 'from hk').replace('tm as', 'ht as').replace('from o', 'from ho')}
  select tm.symbol, epoch(tm.ts)::bigint as t, {_q('sma_20: case when y.q75 > y.q25 then (sma_20 - y.median) / (y.q75 - y.q25) else sma_20 end', 'mom_10: case when z.q75 > z.q25 then (mom_10 - z.median) / (z.q75 - z.q25) else mom_10 end')} from ht tm join st y on y.symbol = tm.symbol and y.feature = 'sma_20' join st z on z.symbol = tm.symbol and z.feature = 'mom_10'"""

QUERIES["features_only"] = lambda s, d: shown(L.features_only(bars(s, d), _features()), ["sma_20", "mom_10"])
ORACLE["features_only"] = f"""{B}, f as (select *, {_F} from b), {_TRIM}, {_stats('tm', ('sma_20', 'mom_10'), 'st')},
  j as (select tm.*, y.median as ym, sma_20 < y.q25 - 1.5 * (y.q75 - y.q25) or sma_20 > y.q75 + 1.5 * (y.q75 - y.q25) as yo, mom_10 < z.q25 - 1.5 * (z.q75 - z.q25) or mom_10 > z.q75 + 1.5 * (z.q75 - z.q25) as zo
        from tm join st y on y.symbol = tm.symbol and y.feature = 'sma_20' join st z on z.symbol = tm.symbol and z.feature = 'mom_10'),
  g as (select *, last_value(case when mom_10 is not null then {{'v': mom_10, 'i': i}} end ignore nulls) over (partition by symbol order by ts rows between unbounded preceding and 1 preceding) as a, first_value(case when mom_10 is not null then {{'v': mom_10, 'i': i}} end ignore nulls) over (partition by symbol order by ts rows between 1 following and unbounded following) as c from j)
  {_HEAD}, {_q('sma_20: case when yo then ym else sma_20 end', 'mom_10: case when zo then coalesce(a.v + (c.v - a.v) * (i - a.i) / (c.i - a.i), a.v, c.v, mom_10) else mom_10 end')} from g"""


def _market(s: SparkSession, d: str) -> DataFrame:
    b = bars(s, d)
    market = b.groupBy("ts").agg(F.avg("close").alias("cross_close"))
    rows, _ = L.cross_asset(b, _features(), market)
    return shown(rows, ["sma_20", "cross_close"])


QUERIES["cross_asset_pipeline"] = _market
ORACLE["cross_asset_pipeline"] = f"with p as ({ORACLE['training_pipeline']}), {S.BARS}, mk as (select epoch(ts)::bigint as t, avg(close) as cross_close from bars group by ts) select symbol, t, sma_20, {_q('cross_close: coalesce(cross_close, 0)')} from p left join mk using (t)"

# scores and characteristics
_SCORES = ("mae", "rmse", "mape", "sharpe", "drawdown", "direction", "composite")
QUERIES["market_regime_six"] = lambda s, d: _r(M.regime(base(s, d)), "volatility", "trend")
_RG = """h as (select *, i < floor(count(*) over (partition by symbol) / 2) as early from b), g as (select symbol, coalesce(stddev_pop(ret), 0.02) as volatility, avg(close) filter (where early) as a, avg(close) filter (where not early) as c, count(*) as n from h group by symbol),
  rg as (select symbol, volatility, coalesce((c - a) / nullif(a, 0), 0) as trend, n from g),
  rx as (select *, case when n < 20 then 'medium_volatility' when volatility > 0.05 then 'high_volatility' when volatility < 0.02 then 'low_volatility' when trend > 0.1 then 'bull' when trend < -0.1 then 'bear' when abs(trend) < 0.05 then 'range_bound' else 'medium_volatility' end as regime from rg)"""
ORACLE["market_regime_six"] = f"{B}, {_RG} select symbol, regime, {_q('volatility: volatility', 'trend: trend')} from rx"
QUERIES["objective_scores"] = lambda s, d: _r(M.objective_scores(base(s, d).filter("c1 is not null").withColumn("signal", (F.col("close") - F.col("open")) / (F.col("high") - F.col("low") + 1)), "c1", "close", "signal"), *_SCORES)
_GAIN = "ret * sign(sg) * case when abs(sg) > 0.5 then 0.8 when abs(sg) > 0.2 then 0.4 else 0 end"
ORACLE["objective_scores"] = f"""with b0 as ({B} select * from b where c1 is not null), b as (select * from b0), {_RG}, s1 as (select *, least(greatest((close - open) / (high - low + 1), -1), 1) as sg from b), s2 as (select *, {_GAIN} as gain from s1),
  s3 as (select *, exp({S.ever('sum(case when gain > -1 then ln(1 + gain) else 0 end)')}) as v, c1 - {S.lag('c1')} as dp, close - {S.lag('close')} as da from s2), s4 as (select *, greatest({S.ever('max(v)')}, 1) as pk from s3),
  sc as (select symbol, 1 / (1 + avg(abs(c1 - close))) as mae, 1 / (1 + sqrt(avg(pow(c1 - close, 2)))) as rmse, 1 / (1 + avg(case when abs(close) > 1e-8 then abs((c1 - close) / close) end)) as mape,
    coalesce(least(greatest((avg(gain) / nullif(stddev_pop(gain), 0) + 1) / 3, 0), 1), 0) as sharpe, 1 - max(least((pk - v) / pk, 1)) as drawdown, avg(case when dp is not null and da is not null then (sign(dp) = sign(da))::int end) as direction from s4 group by symbol)
  select symbol, regime, {_q(*[f'{n}: {n}' for n in _SCORES[:-1]], "composite: least(greatest((mae * 0.2 + direction * 0.3 + sharpe * 0.25 + drawdown * 0.25) * case regime " + ' '.join(f"when '{k}' then {v}" for k, v in M.REGIME_FACTOR.items()) + " end, 0), 1)")} from sc join rx using (symbol)"""
QUERIES["class_calibration"] = lambda s, d: _r(M.class_calibration_error(_probabilities(s, d).withColumn("actual", F.pmod(F.col("i"), F.lit(5)).cast("int")), "p", "actual"), "ece")
ORACLE["class_calibration"] = f"{_PSQL}, x5 as (select unnest(range(5))::int as class, unnest(p) as q, i % 5 as actual from p), y5 as (select class, least(floor(q * 15), 14) as bin, count(*) as n, avg(q) as q, avg((actual = class)::int) as a from x5 group by 1, 2) select class, {_q('ece: sum(n * abs(q - a)) / sum(n)')} from y5 group by class"
_BOUNDS = ("low", "high", "mean", "std", "p10", "p25", "p50", "p75", "p90", "iqr", "fall", "rise", "range")
QUERIES["adaptive_bounds"] = lambda s, d: _r(M.adaptive_bounds(base(s, d)).select("symbol", *_BOUNDS), *_BOUNDS)
_PCT = "case when last > 0 then greatest({x}, 0) / last * 100 else 0 end"
ORACLE["adaptive_bounds"] = f"""{B}, k as (select symbol, close, ts, row_number() over (partition by symbol order by close) - 1 as r, count(*) over (partition by symbol) as n from b),
  g as (select symbol, min(close) as lo, max(close) as hi, avg(close) as mean, stddev_pop(close) as std, max_by(close, ts) as last, {', '.join(f'max(case when r = floor((n - 1) * {p}::double + 0.5) then close end) as p{round(p * 100)}' for p in (0.1, 0.25, 0.5, 0.75, 0.9))} from k group by symbol)
  select symbol, {_q('low: lo', 'high: hi', 'mean: mean', 'std: std', *[f'p{k}: p{k}' for k in (10, 25, 50, 75, 90)], 'iqr: coalesce((p75 - p25) / nullif(p50, 0) * 100, 0)', 'fall: ' + _PCT.format(x='last - lo'), 'rise: ' + _PCT.format(x='hi - last'), 'range: ' + _PCT.format(x='hi - lo'))} from g"""
QUERIES["balance_confidence"] = lambda s, d: _r(M.balance_confidence(_targets(s, d)), "balance", "overall")
ORACLE["balance_confidence"] = f"""with {_SUMMARY}, a as ({_ALL}), c as (select target, class, count(*) as k from a where class is not null group by 1, 2), e as (select target, k / sum(k) over (partition by target)::double as q from c),
  g as (select target, case when count(*) <= 1 then 0.1 else -sum(q * log2(q)) / log2(count(*)) end as balance from e group by target)
  select target, {_q('balance: balance', 'overall: least(greatest((sum(balance) over () + 1) / (count(*) over () + 1), 0.1), 0.95)')} from g"""
_FIVE = ("least", "q1", "median", "q3", "most")
QUERIES["five_numbers"] = lambda s, d: _r(M.five_numbers(_probabilities(s, d), "confidence", "symbol"), *_FIVE)
ORACLE["five_numbers"] = f"{_PSQL}, k as (select symbol, confidence as x, row_number() over (partition by symbol order by confidence) - 1 as r, count(*) over (partition by symbol) as n from p) select symbol, count(*) as n, {_q('least: min(x)', *[f'{c}: max(case when r = floor(n * {k} / 4) then x end)' for c, k in (('q1', 1), ('median', 2), ('q3', 3))], 'most: max(x)')} from k group by symbol"


def _corrected(s: SparkSession, d: str) -> DataFrame:
    rows = M.linear_correction(_probabilities(s, d).withColumn("actual", F.pmod(F.col("i"), F.lit(5)).cast("int")), "p", "actual")
    return shown(rows.withColumns({f"c{k}": F.get("corrected", F.lit(k)) for k in (0, 4)}), ["c0", "c4"])


QUERIES["linear_correction"] = _corrected
_LINE = ", ".join(f"coalesce(covar_pop(p[{k + 1}], (i % 5 = {k})::int) / nullif(var_pop(p[{k + 1}]), 0), 0) as b{k}, avg(p[{k + 1}]) as m{k}, avg((i % 5 = {k})::int) as h{k}" for k in range(5))
ORACLE["linear_correction"] = f"{_PSQL}, ln as (select {_LINE} from p), w as (select symbol, ts, [{', '.join(f'greatest(h{k} - b{k} * m{k} + b{k} * p[{k + 1}], 0.001)' for k in range(5))}] as w from p, ln) {_HEAD}, {_q('c0: w[1] / list_sum(w)', 'c4: w[5] / list_sum(w)')} from w"
QUERIES["best_temperature"] = lambda s, d: _r(M.best_temperature(P.temperature_nll(_logits(s, d), "z", "actual", _TEMPS)), "nll", "plain")
ORACLE["best_temperature"] = f"with g as ({_PREDICTIONS['temperature_grid']}), h as (select min_by(temperature, nll) as t, min(nll) as m, max(case when temperature = 1 then nll end) as plain from g where temperature between 0.5 and 5) select case when m < plain then t else 1.0::double end as temperature, case when m < plain then m else plain end as nll, plain from h"
_CHARS = ("volatility", "trend", "quality", "extreme", "autocorrelation", "zeros")
QUERIES["data_characteristics"] = lambda s, d: _r(M.characteristics(base(s, d)), *_CHARS)
ORACLE["data_characteristics"] = f"""{B}, k as (select *, avg(close) over (partition by symbol) as m, stddev_pop(close) over (partition by symbol) as sd, {S.lag('ret')} as r1 from b)
  select symbol, {_q('volatility: stddev_pop(ret)', 'trend: covar_pop(close, i) / nullif(var_pop(i), 0) / nullif(avg(close), 0)', 'quality: 1 - 0.5 * avg((close is null)::int) - 0.3 * (1 - count(distinct ts) / count(*)::double)', 'extreme: avg((abs(close - m) > 3 * sd)::int)', 'autocorrelation: covar_pop(ret, r1) / nullif(stddev_pop(case when r1 is not null then ret end) * stddev_pop(case when ret is not null then r1 end), 0)', 'zeros: avg((close = 0)::int)')} from k group by symbol"""
QUERIES["sequence_atr"] = lambda s, d: shown(base(s, d).withColumn("atr_pct", M.sequence_atr(base(s, d), 24)).withColumn("clipped", M.within_deviations(F.col("close"), F.col("open"), F.col("tr") / 10)), ["atr_pct", "clipped"])
ORACLE["sequence_atr"] = f"{B}, k as (select *, coalesce(greatest(high - low, abs(high - c1), abs(low - c1)), high - low) / case when close > 0 then close end * 100 as sh, tr / 10 as sd from b) {_HEAD}, {_q(f'atr_pct: {S.inc('avg(sh)', 24)}', 'clipped: case when sd > 0 then greatest(least(close, open + 3 * sd), open - 3 * sd) else close end')} from k"
QUERIES["pinball_loss"] = lambda s, d: _r(base(s, d).groupBy("symbol").agg(*[F.avg(M.pinball(F.col("close"), F.col("c1"), q)).alias(f"q{round(q * 100)}") for q in (0.1, 0.5, 0.9)]), "q10", "q50", "q90")
ORACLE["pinball_loss"] = f"{B} select symbol, {_q(*[f'q{round(q * 100)}: avg(greatest({q} * (close - c1), ({q} - 1) * (close - c1)))' for q in (0.1, 0.5, 0.9)])} from b where c1 is not null group by symbol"
