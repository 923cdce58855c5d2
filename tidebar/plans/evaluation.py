"""Validation, preprocessing, metric, confidence and streaming queries, each with its DuckDB statement where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import recurrences as R
from ..operators import fractal
from ..operators import metrics as M
from ..operators import preprocess as P
from ..operators import trend as T
from ..operators import validate as V
from ..sources.bars import data_info
from ..streaming import bars as stream
from . import sqlkit as S
from .indicators import bars, base, shown

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double") + S.TIE, 6) for n in names})


def _q(*exprs: str) -> str:
    """``name: sql`` pairs to rounded columns."""
    return ", ".join(f"round(({e.split(': ', 1)[1]})::double + {S.TIE!r}, 6) as {e.split(': ', 1)[0]}" for e in exprs)


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


B = f"with {S.BASE}"

# validation
add(
    "data_info",
    lambda s, d: data_info(bars(s, d)).select("symbol", "n_rows", "n_times", F.unix_timestamp("first_ts").alias("first_t"), F.unix_timestamp("last_ts").alias("last_t"), "n_features"),
    f"{B} select symbol, count(*) as n_rows, count(distinct ts) as n_times, epoch(min(ts))::bigint as first_t, epoch(max(ts))::bigint as last_t, 0::int as n_features from b group by symbol",
)
add(
    "ohlc_report",
    lambda s, d: V.ohlc_report(bars(s, d)),
    f"""{B} select symbol, count(*) as n_rows, count(*) filter (where high < low or high < open or high < close or low > open or low > close) as n_broken,
    count(*) filter (where least(open, high, low, close) < 0) as n_negative_price, count(*) filter (where volume < 0) as n_negative_volume,
    count(*) filter (where not (open > 0 and high > 0 and low > 0 and close > 0 and volume >= 0 and high >= low and high >= close and low <= close)) as n_invalid,
    max(close) - min(close) < 1e-12 as flat from b group by symbol""",
)
add("duplicate_keys", lambda s, d: V.duplicates(_table(s, d, "lineitem"), "l_orderkey", "l_linenumber"), "select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
_ORDER_COLUMNS = (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderpriority", "string"))
add(
    "schema_info",
    lambda s, d: V.schema_info(_table(s, d, "orders").select(*[c for c, _ in _ORDER_COLUMNS])),
    " union all ".join(f"select '{c}' as \"column\", '{t}' as type, count(*) filter (where {c} is null) as n_null, count(*) as n_rows from orders" for c, t in _ORDER_COLUMNS),
)
add(
    "bar_scalars",
    lambda s, d: shown(V.scalars(bars(s, d)), ["typical", "range", "change", "change_pct"]),
    S.staged({"typical": "tp", "range": "high - low", "change": "close - open", "change_pct": "(close - open) / nullif(open, 0) * 100"}, out=["typical", "range", "change", "change_pct"]),
)
add(
    "timeframe",
    lambda s, d: V.timeframe(bars(s, d)),
    f"""{B}, g as (select symbol, i, epoch(ts)::bigint - lag(epoch(ts)::bigint) over ({S.W}) as g from b), l as (select symbol, list(g order by g) as l from g where i < 100 and g > 0 group by symbol)
    select symbol, greatest(floor(l[len(l) // 2 + 1] / 60), 1)::bigint as minutes from l""",
)
_FEATURES = ["sma_20", "mom_10"]


def _featured(s: SparkSession, d: str) -> DataFrame:
    return base(s, d).withColumns({"sma_20": T.sma("close", 20), "mom_10": T.momentum("close", 10)})


_FEATURED = f"{B}, f as (select *, {S.full('avg(close)', 'close', 20)} as sma_20, (close - {S.lag('close', 10)}) / nullif({S.lag('close', 10)}, 0) as mom_10 from b)"
add(
    "trim_leading",
    lambda s, d: V.trim_leading(_featured(s, d), _FEATURES).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("n_bad")),
    f"{_FEATURED}, k as (select *, (sma_20 is null or mom_10 is null)::int as bad from f), o as (select *, max(1 - bad) over ({S.W} rows unbounded preceding) as started from k) select symbol, count(*) as n, sum(bad)::bigint as n_bad from o where started = 1 group by symbol",
)
add(
    "recent_clean_window",
    lambda s, d: V.recent_clean(_featured(s, d), _FEATURES, 30).select("symbol", F.unix_timestamp("last_ts").alias("last_t")),
    f"{_FEATURED}, k as (select *, (sma_20 is null or mom_10 is null)::int as bad from f), o as (select *, {S.inc('sum(bad)', 30)} as nb, {S.inc('count(bad)', 30)} as nn from k) select symbol, epoch(max(ts))::bigint as last_t from o where nb = 0 and nn = 30 group by symbol",
)
add(
    "feature_report",
    lambda s, d: V.feature_report(_featured(s, d), _FEATURES),
    _FEATURED
    + " ".join(
        (" union all " if k else " ")
        + f"select '{c}' as feature, count(*) filter (where {c} is null) as n_missing, 0::bigint as n_infinite, count({c}) as n_finite, case when avg(({c} is null)::int) > 0.5 then 'error' when avg(({c} is null)::int) > 0.1 then 'warning' else 'ok' end as verdict from f"
        for k, c in enumerate(_FEATURES)
    ),
)
add(
    "sanitize",
    lambda s, d: shown(base(s, d).withColumn("ret_clean", V.sanitize("ret", -0.5, 0.5, 0.0)), ["ret_clean"]),
    S.staged({"ret_clean": "case when ret < -0.5 or ret > 0.5 then 0 else ret end"}, out=["ret_clean"]),
)
add("enough_rows", lambda s, d: V.enough_rows(bars(s, d), 300), f"{B} select symbol, count(*) as n_rows, count(*) >= 600 as enough from b group by symbol")

# preprocessing
_STATS = """st as (select symbol, avg(x) as mean, stddev_pop(x) as std, min(x) as min, max(x) as max,
    max(case when r = floor((n - 1) * 0.5::double + 0.5) then x end) as median, max(case when r = floor((n - 1) * 0.25::double + 0.5) then x end) as q25,
    max(case when r = floor((n - 1) * 0.75::double + 0.5) then x end) as q75
    from (select symbol, {c} as x, row_number() over (partition by symbol order by {c}) - 1 as r, count(*) over (partition by symbol) as n from b where {c} is not null) group by symbol)"""
_NAMES = ("mean", "std", "min", "max", "median", "q25", "q75")
add("column_stats", lambda s, d: _r(P.column_stats(bars(s, d), "close"), *_NAMES), f"{B}, {_STATS.format(c='close')} select symbol, {_q(*[f'{n}: {n}' for n in _NAMES])} from st")
add(
    "global_percentiles",
    lambda s, d: s.createDataFrame(list(zip((0.25, 0.5, 0.9), P.global_rank(_table(s, d, "lineitem"), "l_extendedprice", [0.25, 0.5, 0.9]))), "share double, value double"),
    " union all ".join(
        f"select {p}::double as share, max(l_extendedprice) as value from (select l_extendedprice, row_number() over (order by l_extendedprice) - 1 as r, count(*) over () as n from lineitem) where r = floor((n - 1) * {p}::double + 0.5)"
        for p in (0.25, 0.5, 0.9)
    ),
)


def _stat_rows(s: SparkSession, d: str) -> DataFrame:
    return P.with_stats(base(s, d), "close")


_JOINED = f"{B}, {_STATS.format(c='close')}, j as (select b.*, st.* exclude (symbol) from b join st using (symbol))"


def _outliers(s: SparkSession, d: str) -> DataFrame:
    j = _stat_rows(s, d)
    made = {"iqr_outlier": P.is_outlier("close", P.iqr_bounds()), "z_outlier": P.is_outlier("close", P.zscore_bounds(2.0)), "iqr_capped": P.capped("close", P.iqr_bounds())}
    j = j.withColumns(made).withColumn("filled", P.interpolated("close", "iqr_outlier"))
    return j.select("symbol", F.unix_timestamp("ts").alias("t"), "iqr_outlier", "z_outlier", *[F.round(F.col(c) + S.TIE, 6).alias(c) for c in ("iqr_capped", "filled")])


add(
    "outliers",
    _outliers,
    f"""{_JOINED}, k as (select *, q25 - 1.5 * (q75 - q25) as lo, q75 + 1.5 * (q75 - q25) as hi from j), o as (select *, close < lo or close > hi as iqr_outlier, close < mean - 2 * std or close > mean + 2 * std as z_outlier from k)
    select symbol, epoch(ts)::bigint as t, iqr_outlier, z_outlier, round(least(greatest(close, lo), hi) + {S.TIE!r}, 6) as iqr_capped,
    round(case when iqr_outlier then coalesce((lag(close) over w + lead(close) over w) / 2, lag(close) over w, lead(close) over w, close) else close end + {S.TIE!r}, 6) as filled from o window w as ({S.W})""",
)
add(
    "modified_z",
    lambda s, d: shown(P.modified_z(base(s, d), "close"), ["mod_z"]),
    f"{_JOINED}, k as (select *, abs(close - median) as off from j), md as (select symbol, max(case when r = floor((n - 1) * 0.5::double + 0.5) then off end) as mad from (select symbol, off, row_number() over (partition by symbol order by off) - 1 as r, count(*) over (partition by symbol) as n from k) group by symbol) "
    f"select symbol, epoch(ts)::bigint as t, round(0.6745 * (close - median) / nullif(mad, 0) + {S.TIE!r}, 6) as mod_z from k join md using (symbol)",
)
_HOWS = ("robust", "minmax", "standard")
add(
    "normalize",
    lambda s, d: shown(_stat_rows(s, d).withColumns({**{h: P.normalized("close", h) for h in _HOWS}, "quantile": P.quantile_rank("close")}), [*_HOWS, "quantile"]),
    f"{_JOINED} select symbol, epoch(ts)::bigint as t, {_q('robust: (close - median) / nullif(q75 - q25, 0)', 'minmax: (close - min) / nullif(max - min, 0)', 'standard: (close - mean) / nullif(std, 0)', 'quantile: percent_rank() over (partition by symbol order by close)')} from j",
)

# metrics
_LABELLED = "select quality as p, toxic as a from labels"
add("confusion", lambda s, d: M.confusion(_table(s, d, "labels"), "quality", "toxic"), "select quality as predicted, toxic as actual, count(*) as n from labels group by all")
_PC = """pc as (select class, coalesce(hit / nullif(p, 0), 0) as precision, coalesce(hit / nullif(support, 0), 0) as recall, support, hit from
    (select class, sum(p)::double as p, sum(a)::double as support, sum(hit)::double as hit from (select quality as class, 1 as p, 0 as a, (quality = toxic)::int as hit from labels union all select toxic, 0, 1, 0 from labels) group by class)),
    pf as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from pc)"""
add("per_class", lambda s, d: _r(M.per_class(_table(s, d, "labels"), "quality", "toxic").drop("hit"), "precision", "recall", "f1"), f"with {_PC} select class, {_q('precision: precision', 'recall: recall', 'f1: f1')}, support::bigint as support from pf")
add(
    "classification",
    lambda s, d: _r(M.classification(_table(s, d, "labels"), "quality", "toxic"), "accuracy", "macro_f1", "weighted_f1"),
    f"with {_PC} select {_q('accuracy: sum(hit) / sum(support)', 'macro_f1: avg(f1)', 'weighted_f1: sum(f1 * support) / sum(support)')} from pf",
)
_REG = ("mse", "rmse", "mae", "r2", "mape")
add(
    "regression",
    lambda s, d: _r(M.regression(base(s, d), "c1", "close", "symbol"), *_REG),
    f"{B} select symbol, {_q('mse: avg(pow(c1 - close, 2))', 'rmse: sqrt(avg(pow(c1 - close, 2)))', 'mae: avg(abs(c1 - close))', 'r2: 1 - avg(pow(c1 - close, 2)) / nullif(var_pop(close), 0)', 'mape: avg(case when close <> 0 then abs((c1 - close) / close) end) * 100')} from b where c1 is not null group by symbol",
)
add("sharpe", lambda s, d: _r(M.sharpe(base(s, d), "ret", "symbol"), "sharpe"), f"{B} select symbol, {_q('sharpe: coalesce(avg(ret) / nullif(stddev_samp(ret), 0), 0)')} from b group by symbol")
add(
    "max_drawdown",
    lambda s, d: _r(M.max_drawdown(bars(s, d), "close"), "max_drawdown"),
    f"{B}, k as (select symbol, close, {S.ever('max(close)')} as peak from b) select symbol, {_q('max_drawdown: max(coalesce((peak - close) / nullif(peak, 0), 0))')} from k group by symbol",
)
add(
    "directional_accuracy",
    lambda s, d: _r(M.directional_accuracy(base(s, d).withColumn("before", T.lag("chg")), "before", "chg", "symbol"), "directional_accuracy"),
    f"{B}, k as (select symbol, chg, {S.lag('chg')} as before from b) select symbol, {_q('directional_accuracy: avg((sign(before) = sign(chg))::int)')} from k where before is not null and chg is not null group by symbol",
)


def _probabilities(s: SparkSession, d: str) -> DataFrame:
    b = base(s, d)
    logits = F.array(*[F.col(c) / 20 for c in ("open", "high", "low", "close", "volume")])
    return b.withColumn("p", M.softmax(logits)).withColumns({"confidence": M.top(F.col("p")), "correct": (F.array_position("p", F.array_max("p")) == 2)})


_PSQL = f"""{B}, x as (select *, greatest(open, high, low, close, volume) / 20 as mx from b),
y as (select *, [exp(open / 20 - mx), exp(high / 20 - mx), exp(low / 20 - mx), exp(close / 20 - mx), exp(volume / 20 - mx)] as e from x),
z as (select *, list_transform(e, lambda v: v / list_sum(e)) as p from y), p as (select *, list_max(p) as confidence, list_position(p, list_max(p)) = 2 as correct from z)"""
_BIN = "least(floor(confidence * 15), 14)::int"
add(
    "reliability",
    lambda s, d: _r(M.reliability(_probabilities(s, d), "confidence", "correct"), "confidence", "accuracy"),
    f"{_PSQL} select {_BIN} as bin, count(*) as n, round(avg(confidence) + {S.TIE!r}, 6) as confidence, round(avg(correct::int) + {S.TIE!r}, 6) as accuracy from p group by {_BIN}",
)
add(
    "calibration_error",
    lambda s, d: _r(M.expected_calibration_error(_probabilities(s, d), "confidence", "correct"), "ece"),
    f"{_PSQL}, r as (select count(*) as n, avg(confidence) as c, avg(correct::int) as a from p group by {_BIN}) select {_q('ece: sum(n * abs(c - a)) / sum(n)')} from r",
)
_CAL = "case when confidence >= 0.5 then 0.85 + (confidence - 0.5) * 0.3 when confidence >= 0.42 then 0.8 + (confidence - 0.42) * 0.625 when confidence >= 0.35 then 0.7 + (confidence - 0.35) * 1.4285714286 when confidence >= 0.3 then 0.55 + (confidence - 0.3) * 3 when confidence >= 0.25 then 0.42 + (confidence - 0.25) * 2.6 when confidence >= 0.2 then 0.25 + (confidence - 0.2) * 3.4 else confidence * 2 end"
_ENT = "1 - list_sum(list_transform(p, lambda v: case when v > 0 then -v * ln(v) else 0 end)) / ln(5)"
add(
    "class_confidence",
    lambda s, d: shown(_probabilities(s, d).withColumns({"calibrated": M.calibrated_confidence(F.col("confidence")), "entropy": M.entropy_confidence(F.col("p")), "combined": M.combined_confidence(F.col("p"))}), ["calibrated", "entropy", "combined"]),
    f"{_PSQL} select symbol, epoch(ts)::bigint as t, {_q(f'calibrated: {_CAL}', f'entropy: {_ENT}', f'combined: least(greatest(({_CAL}) * 0.6 + ({_ENT}) * 0.25 + greatest((confidence - 0.2) / 0.8, 0) * 0.15, 0.2), 0.98)')} from p",
)
_CORR = ["open", "high", "low", "close", "volume"]
add(
    "feature_correlations",
    lambda s, d: _r(M.correlations(bars(s, d), _CORR), "r"),
    f"{B} " + " union all ".join(f"select '{a}' as a, '{c}' as b, {_q(f'r: coalesce(covar_pop({a}, {c}) / nullif(stddev_pop({a}) * stddev_pop({c}), 0), 0)')} from b" for k, a in enumerate(_CORR) for c in _CORR[k + 1 :]),
)
_OWN = "over (partition by symbol)"
add(
    "iqr_filter",
    lambda s, d: shown(M.iqr_filter(_probabilities(s, d), "confidence"), ["confidence"]),
    f"""{_PSQL}, k as (select *, row_number() over (partition by symbol order by confidence) - 1 as r, count(*) {_OWN} as n from p),
    q as (select *, max(case when r = floor(n * 0.25::double) then confidence end) {_OWN} as a, max(case when r = floor(n * 0.75::double) then confidence end) {_OWN} as c from k)
    select symbol, epoch(ts)::bigint as t, {_q('confidence: confidence')} from q where confidence >= a - 1.5 * (c - a) and confidence <= c + 1.5 * (c - a)""",
)
add(
    "ensemble",
    lambda s, d: _r(M.ensemble(_probabilities(s, d).withColumn("hour", F.hour("ts")), "close", "confidence", "hour"), "value", "confidence"),
    f"{_PSQL} select hour(ts)::int as hour, {_q('value: sum(close * confidence) / nullif(sum(confidence), 0)', 'confidence: avg(confidence)')}, count(*) as n from p group by hour(ts)",
)
add(
    "predictions_long",
    lambda s, d: M.unpivoted(shown(_probabilities(s, d).withColumn("price", F.col("close")), ["price", "confidence"])),
    f"{_PSQL}, k as (select symbol, epoch(ts)::bigint as t, {_q('price: close', 'confidence: confidence')} from p) select symbol, t, 'price' as prediction_type, price as value from k union all select symbol, t, 'confidence', confidence from k",
)


def _smoothed(s: SparkSession, d: str) -> DataFrame:
    predicted = _probabilities(s, d).select("symbol", "ts", "open", "high", "low", F.col("confidence").alias("close"), "volume")
    smoothing = R.Ema(1, name="smoothed", k=0.3, first=0)  # of the confidence, which stands in the place of the close
    return shown(R.apply(predicted, smoothing), ["smoothed"])


add(
    "smoothed_predictions",
    _smoothed,
    f"{_PSQL.replace('with ', 'with recursive ', 1)}, r as (select symbol, ts, i, confidence as s from p where i = 0 union all select p.symbol, p.ts, p.i, 0.3::double * p.confidence + 0.7::double * r.s from r join p on p.symbol = r.symbol and p.i = r.i + 1) select symbol, epoch(ts)::bigint as t, {_q('smoothed: s')} from r",
)

# joins and aggregates over the star schema that bar work leans on
add(
    "market_report",
    lambda s, d: _r(
        _table(s, d, "lineitem")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(F.sum("l_quantity").alias("sum_qty"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.count(F.lit(1)).alias("n")),
        "sum_qty",
    ).withColumn("revenue", F.round("revenue", 2)),
    f"select l_returnflag, l_linestatus, {_q('sum_qty: sum(l_quantity)')}, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem group by all",
)

# streaming: the whole table through a stream, and its batch statement
add("stream_bars", stream.replayed_bars, f"with {S.BARS} select symbol, epoch(ts)::bigint as t, {_q(*[f'{c}: {c}' for c in ('open', 'high', 'low', 'close', 'volume')])} from bars")
add(
    "stream_sessions",
    stream.replayed_sessions,
    """with e as (select event_type as symbol, ts, case when ts - lag(ts) over (partition by event_type order by ts) < interval 30 minute then 0 else 1 end as fresh from events),
    g as (select *, sum(fresh) over (partition by symbol order by ts rows unbounded preceding) as g from e) select symbol, floor(epoch(min(ts)))::bigint as t, count(*) as n from g group by symbol, g""",
)
add("stream_dedup", stream.replayed_unique, "select distinct event_type as symbol, epoch(date_trunc('minute', ts))::bigint as t from events")


_FINE = "open > 0 and low > 0 and high > 0 and close > 0 and high >= low and high >= close and low <= close"
add(
    "stream_ring",
    stream.replayed_ring,
    f"""with {S.BARS}, v as (select *, row_number() over (partition by symbol order by ts desc) as back, count(*) over (partition by symbol) as n from bars where {_FINE})
    select symbol, least(any_value(n), 300)::bigint as n, epoch(min(ts))::bigint as first_t, epoch(max(ts))::bigint as last_t,
           {_q('last_close: last(close order by ts)', 'mean_close: avg(close)', 'high: max(high)', 'low: min(low)')} from v where back <= 50 and n >= 50 group by symbol""",
)
add(
    "stream_join",
    stream.replayed_joins,
    """select p.user_id, p.event_id, c.event_id as earlier_id, epoch_us(p.ts) - epoch_us(c.ts) as gap_us, c_mktsegment as segment
    from events p join events c on c.user_id = p.user_id and c.ts < p.ts and c.ts >= p.ts - interval 6 hour join customer on c_custkey = p.user_id
    where p.event_type = 'purchase' and c.event_type = 'click'""",
)
add(
    "stream_tail",
    stream.replayed_tail,
    f"""with {S.BARS}, v as (select *, (epoch(ts)::bigint // 3600) % 9 <> 0 and {_FINE} as ok from bars)
    select symbol, ok, count(*) as n, round(sum(round(close, 6)) + 1e-9, 5) as sum_close, epoch(max(ts))::bigint as last_t from v group by symbol, ok""",
)

# pattern measures in Arrow batches; no SQL form, tested on hand-made windows
add("fractal_measures", lambda s, d: shown(fractal.measures(bars(s, d)), ["hurst", "fractal_dimension"]))
