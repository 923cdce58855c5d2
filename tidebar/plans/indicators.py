"""Indicator queries over hourly bars, each with its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import from_index, lag, staged, with_base
from ..operators import crossasset as X
from ..operators import recurrences as R
from ..operators import trend as T
from ..operators import volatility as V
from ..sources.bars import resample
from . import sqlkit as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the events, a symbol for each event type."""
    return resample(spark.read.parquet(f"{sf_dir}/events.parquet"))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_base(bars(spark, sf_dir))


def shown(df: DataFrame, names: list[str]) -> DataFrame:
    """symbol, t (epoch seconds) and the named doubles, rounded to six places."""
    return df.select("symbol", F.unix_timestamp("ts").alias("t"), *[F.round(F.col(n).cast("double") + S.TIE, 6).alias(n) for n in names])


def add(name: str, out: list[str], spark_stages: list[dict[str, Column] | Callable], sql_stages: list[dict[str, str]]) -> None:
    """Registers a query; each Spark stage is made when it runs, as columns need a session."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(staged(base(spark, sf_dir), *[s() for s in spark_stages]), out)

    QUERIES[name] = query
    ORACLE[name] = S.staged(*sql_stages, out=out)


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(bars(spark, sf_dir), ["open", "high", "low", "close", "volume"])


QUERIES["bars"] = _bars
ORACLE["bars"] = S.staged(out=["open", "high", "low", "close", "volume"], base=S.BARS, source="bars")

# trend
add("sma", ["sma_5", "sma_20"], [lambda: {f"sma_{n}": T.sma("close", n) for n in (5, 20)}], [{f"sma_{n}": S.full("avg(close)", "close", n) for n in (5, 20)}])
add(
    "bollinger",
    ["bb_upper", "bb_middle", "bb_lower"],
    [T.bollinger],
    [
        {"m": S.full("avg(close)", "close", 20), "sd": S.full("stddev_pop(close)", "close", 20)},
        {"bb_upper": "m + 2 * sd", "bb_middle": "m", "bb_lower": "m - 2 * sd"},
    ],
)
add("trend_slope", ["slope_20"], [lambda: {"slope_20": T.slope("close", 20)}], [{"slope_20": f"case when i >= 19 then {S.slope('close', 20)} end"}])
add("price_velocity", ["velocity"], [lambda: {"velocity": T.velocity("close")}], [{"velocity": "(close - c1) / nullif(c1, 0) * 100"}])
_ENGINEERED = ["price_volume_ratio", "close_squared", "close_log", "high_low_ratio", "close_lag_1", "close_lag_3", "close_mean_5", "close_mean_20", "close_std_5", "close_std_20"]
add(
    "engineered_features",
    _ENGINEERED,
    [T.engineered],
    [
        {
            "price_volume_ratio": "case when volume > 0 then close / volume else 0 end",
            "close_squared": "close * close",
            "close_log": "case when close > 0 then ln(close) else 0 end",
            "high_low_ratio": "case when low > 0 then high / low else 1 end",
            "close_lag_1": S.lag("close", 1),
            "close_lag_3": S.lag("close", 3),
            "close_mean_5": S.full("avg(close)", "close", 5, S.exc),
            "close_mean_20": S.full("avg(close)", "close", 20, S.exc),
            "close_std_5": S.full("stddev_pop(close)", "close", 5, S.exc),
            "close_std_20": S.full("stddev_pop(close)", "close", 20, S.exc),
        }
    ],
)


def _momentum(c: str, n: int) -> str:
    l = S.lag(c, n)  # noqa: E741
    return f"case when abs({c} - {l}) < 1e-15 then 0 when abs({l}) < 1e-15 then {c} - {l} else ({c} - {l}) / nullif({l}, 0) end"


add(
    "momentum",
    ["mom_10", "accel_10", "mom_slope"],
    [
        lambda: {"mom_10": T.momentum("close", 10)},
        lambda: {"accel_10": T.acceleration("mom_10"), "mom_slope": from_index(T.slope("mom_10", 10), 19)},
    ],
    [{"mom_10": _momentum("close", 10)}, {"accel_10": f"mom_10 - {S.lag('mom_10')}", "mom_slope": f"case when i >= 19 then {S.slope('mom_10', 10)} end"}],
)


def _custom(c: str, n: int) -> str:
    return f"coalesce(({c} - {S.lag(c, n)}) / nullif({S.lag(c, n)}, 0), 0)"


add(
    "custom_features",
    ["mom_3", "mom_7", "mom_14", "vmom_5", "vpt", "price_accel"],
    [
        lambda: {"mom_3": T.custom_momentum("close", 3), "mom_7": T.custom_momentum("close", 7), "mom_14": T.custom_momentum("close", 14), "mom_5": T.custom_momentum("close", 5), "vmom_5": T.custom_momentum("volume", 5), "vpt": V.volume_price_trend()},
        lambda: {"price_accel": F.coalesce(F.col("mom_5") - lag("mom_5", 5), F.lit(0.0))},
    ],
    [
        {"mom_3": _custom("close", 3), "mom_7": _custom("close", 7), "mom_14": _custom("close", 14), "mom_5": _custom("close", 5), "vmom_5": _custom("volume", 5), "vpt": S.ever("sum(coalesce(volume * ret, 0))")},
        {"price_accel": f"coalesce(mom_5 - {S.lag('mom_5', 5)}, 0)"},
    ],
)
add(
    "stochastic",
    ["stoch_k", "stoch_d"],
    [lambda: {"stoch_k": T.stochastic_k(14)}, lambda: {"stoch_d": T.sma("stoch_k", 3)}],
    [
        {"ll": S.inc("min(low)", 14), "hh": S.inc("max(high)", 14)},
        {"stoch_k": "case when i >= 13 then coalesce((close - ll) / nullif(hh - ll, 0) * 100, 50) end"},
        {"stoch_d": S.full("avg(stoch_k)", "stoch_k", 3)},
    ],
)
add(
    "williams_r",
    ["williams_r"],
    [lambda: {"williams_r": T.williams_r(14)}],
    [{"ll": S.inc("min(low)", 14), "hh": S.inc("max(high)", 14)}, {"williams_r": "case when i >= 14 then coalesce((hh - close) / nullif(hh - ll, 0) * -100, -50) end"}],
)
add(
    "cci",
    ["cci"],
    [lambda: {"cci": T.cci(20)}],
    [
        {"l": S.inc("list(tp)", 20), "m": S.inc("avg(tp)", 20)},
        {"d": "list_sum(list_transform(l, lambda x: abs(x - m))) / 20"},
        {"cci": "case when i >= 19 then case when d = 0 then 0 else (tp - m) / (0.015 * d) end end"},
    ],
)
add(
    "mfi",
    ["mfi"],
    [T.money_flow, lambda: {"mfi": T.mfi(14)}],
    [
        {"tp1": S.lag("tp")},
        {"up": "case when tp > tp1 then tp * volume else 0 end", "down": "case when tp < tp1 then tp * volume else 0 end"},
        {"su": S.inc("sum(up)", 14), "sd": S.inc("sum(down)", 14)},
        {"mfi": "case when i >= 14 then case when su = 0 and sd = 0 then 50 when sd = 0 then 100 else 100 - 100 / (1 + su / sd) end end"},
    ],
)
_TOP, _BOT = "greatest(open, close)", "least(open, close)"


def _clamp(x: str, a: float, b: float) -> str:
    return f"case when ({x}) is not null then least(greatest({x}, {a}), {b}) end"


add(
    "wick_ratios",
    ["upper_wick", "lower_wick", "body", "wick_asymmetry"],
    [T.wick_ratios],
    [
        {"rg": "greatest(high - low, 1e-12)"},
        {"upper_wick": _clamp(f"(high - {_TOP}) / rg", 0, 1), "lower_wick": _clamp(f"({_BOT} - low) / rg", 0, 1), "body": _clamp(f"({_TOP} - {_BOT}) / rg", 0, 1)},
        {"wick_asymmetry": "upper_wick - lower_wick"},
    ],
)

# volatility
add(
    "volatility_features",
    ["realized_vol", "range_vol", "vol_of_vol"],
    [lambda: {"realized_vol": V.realized_vol(24), "range_vol": V.range_vol()}, lambda: {"vol_of_vol": V.vol_of_vol()}],
    [
        {
            "realized_vol": f"case when i = 0 then null when {S.exc('count(lret)', 24)} = 24 then {S.exc('stddev_samp(lret)', 24)} * sqrt(24) else 0 end",
            "range_vol": "pow(ln(high / low), 2) / (4 * ln(2))",
        },
        {"vol_of_vol": f"case when i = 0 then null when {S.exc('count(realized_vol)', 12)} = 12 then {S.exc('stddev_samp(realized_vol)', 12)} * sqrt(24) else 0 end"},
    ],
)
add(
    "volatility_clustering",
    ["vol_cluster"],
    [lambda: {"vol_cluster": V.volatility_clustering(20)}],
    [
        {"q": "lret * lret"},
        {"l": f"list(q) filter (where q is not null) over ({S.W} rows between 19 preceding and 1 preceding)"},
        {"m": "list_sum(l) / 19"},
        {
            "o": "list_sum(list_transform(range(1, 19), lambda k: (l[k] - m) * (l[k + 1] - m)))",
            "u": "list_sum(list_transform(l, lambda x: (x - m) * (x - m)))",
        },
        {"vol_cluster": f"case when len(l) = 19 then case when u <= 1e-10 then 0 else {_clamp('o / nullif(u, 0)', -1, 1)} end end"},
    ],
)
add(
    "mean_reversion",
    ["mean_reversion"],
    [lambda: {"mean_reversion": V.mean_reversion(20)}],
    [
        {"l": S.exc("list(close)", 20), "m": S.exc("avg(close)", 20)},
        {"s": "list_sum(list_transform(range(1, 20), lambda k: case when (l[k] > m and l[k + 1] < l[k]) or (l[k] < m and l[k + 1] > l[k]) then abs(l[k + 1] - l[k]) else 0 end))"},
        {"mean_reversion": "case when len(l) = 20 then least(coalesce(s / 19 / nullif(m, 0), 0), 1) end"},
    ],
)
add(
    "bb_squeeze",
    ["bb_squeeze", "tightness"],
    [lambda: {"bb_squeeze": V.bb_squeeze(20), "tightness": V.tightness()}],
    [{"sd": S.full("stddev_pop(close)", "close", 20)}, {"bb_squeeze": "4 * sd / nullif(close, 0)", "tightness": "(high - low) / nullif(close, 0)"}],
)

# volume
add(
    "obv",
    ["obv", "obv_mom", "volume_sma", "pv_divergence", "pv_div_slope"],
    [
        lambda: {"signed": V.signed_volume(), "volume_sma": T.sma("volume", 20)},
        lambda: {"obv": V.obv()},
        lambda: {"obv_mom": T.momentum("obv", 10), "pv_divergence": T.momentum("volume", 10) - T.momentum("close", 10)},
        lambda: {"pv_div_slope": from_index(T.slope("pv_divergence", 10), 19)},
    ],
    [
        {"sg": "case when c1 is null or chg > 0 then volume when chg < 0 then -volume else 0 end", "volume_sma": S.full("avg(volume)", "volume", 20)},
        {"obv": S.ever("sum(sg)")},
        {"obv_mom": _momentum("obv", 10), "pv_divergence": f"({_momentum('volume', 10)}) - ({_momentum('close', 10)})"},
        {"pv_div_slope": f"case when i >= 19 then {S.slope('pv_divergence', 10)} end"},
    ],
)
add(
    "vwap",
    ["vwap_20", "vwap"],
    [lambda: {"vwap_20": V.periodic_vwap(20), "vwap": V.cumulative_vwap()}],
    [
        {
            "vwap_20": f"case when {S.exc('count(close)', 20)} = 20 then coalesce({S.exc('sum(case when volume > 0 then close * volume end)', 20)} / nullif({S.exc('sum(case when volume > 0 then volume end)', 20)}, 0), close) end",
            "vwap": f"{S.ever('sum(tp * volume)')} / nullif({S.ever('sum(volume)')}, 0)",
        }
    ],
)
add(
    "price_volume_corr",
    ["pv_corr"],
    [lambda: {"pv_corr": V.price_volume_corr(20)}],
    [
        {
            "pv_corr": f"case when {S.exc('count(close)', 20)} = 20 then coalesce({S.exc('covar_pop(close, volume)', 20)} / nullif({S.exc('stddev_pop(close)', 20)} * {S.exc('stddev_pop(volume)', 20)}, 0), 0) end"
        }
    ],
)
add(
    "volume_momentum",
    ["vol_mom", "vol_accel", "vol_slope"],
    [lambda: {"vol_mom": V.volume_momentum(20)}, lambda: {"vol_accel": T.acceleration("vol_mom"), "vol_slope": from_index(T.slope("vol_mom", 10), 29)}],
    [
        {"m": S.inc("avg(volume)", 20)},
        {"vol_mom": "case when i >= 20 then (volume - m) / nullif(m, 0) end"},
        {"vol_accel": f"vol_mom - {S.lag('vol_mom')}", "vol_slope": f"case when i >= 29 then {S.slope('vol_mom', 10)} end"},
    ],
)
add(
    "candle_shape",
    ["body_share", "wick_imbalance", "intraday_range"],
    [V.candle_shape],
    [
        {"u": f"high - {_TOP}", "lo": f"{_BOT} - low"},
        {
            "body_share": f"coalesce({_clamp('(close - open) / nullif(high - low, 0) * 100', -100, 100)}, 0)",
            "wick_imbalance": f"coalesce({_clamp('(u - lo) / nullif(u + lo, 0) * 100', -100, 100)}, 0)",
            "intraday_range": "(high - low) / nullif(close, 0) * 100",
        },
    ],
)
add(
    "microstructure",
    ["spread", "volume_spread", "impact", "impact_early"],
    [V.spreads, lambda: {"impact": V.price_impact(), "impact_early": V.price_impact(False)}],
    [
        {"spread": "(high - low) / nullif((high + low) / 2, 0)"},
        {
            "volume_spread": "spread * volume",
            "impact": "abs(chg) / nullif(sqrt(volume), 0)",
            "impact_early": f"coalesce(abs(lead(close) over ({S.W}) - close) / nullif(sqrt(lead(volume) over ({S.W})), 0), 0)",
        },
    ],
)

# liquidity
add(
    "liquidity_sweeps",
    ["sweep_up", "sweep_down", "sweep_size"],
    [lambda: V.sweeps(20)],
    [
        {"t20": S.full("max(high)", "high", 20, S.exc), "b20": S.full("min(low)", "low", 20, S.exc)},
        {"u": "coalesce(high > t20 and close < t20, false)", "d": "coalesce(low < b20 and close > b20, false)"},
        {"sweep_up": "u::int", "sweep_down": "d::int", "sweep_size": "case when d then b20 - low when u then high - t20 else 0 end"},
    ],
)
add(
    "volume_delta",
    ["cvd", "cvd_slope", "cvd_divergence"],
    [lambda: {"cvd": V.volume_delta()}, lambda: {"cvd_slope": F.coalesce(V.normalized_slope("cvd", 20), F.lit(0.0)), "cvd_divergence": V.divergence("cvd", "close", 20)}],
    [
        {"cvd": S.ever("sum((2 * coalesce((close - low) / nullif(high - low, 0), 0.5) - 1) * volume)")},
        {"sd1": S.inc("stddev_pop(cvd)", 20), "sd2": S.inc("stddev_pop(close)", 20), "sl": S.slope("cvd", 20), "l1": S.lag("cvd", 19), "l2": S.lag("close", 19)},
        {
            "cvd_slope": "case when i >= 19 then coalesce(sl / nullif(sd1, 0), 0) else 0 end",
            "cvd_divergence": "case when i >= 19 then coalesce((cvd - l1) / nullif(sd1, 0), 0) - coalesce((close - l2) / nullif(sd2, 0), 0) else 0 end",
        },
    ],
)

# consolidation and regime
add(
    "consolidation",
    ["choppiness", "efficiency", "dm_balance"],
    [lambda: {"choppiness": V.choppiness(14), "efficiency": V.efficiency(10), **V.directional_moves()}, lambda: {"dm_balance": V.directional_balance(14)}],
    [
        {
            "rg": f"{S.inc('max(high)', 14)} - {S.inc('min(low)', 14)}",
            "st": S.inc("sum(tr)", 13),
            "up": f"high - {S.lag('high')}",
            "dn": f"{S.lag('low')} - low",
            "path": S.inc("sum(abs(chg))", 9),
            "far": S.lag("close", 9),
        },
        {"pu": "case when up > dn and up > 0 then up else 0 end", "pd": "case when dn > up and dn > 0 then dn else 0 end"},
        {"su": S.inc("sum(pu)", 14), "sd": S.inc("sum(pd)", 14)},
        {
            "choppiness": "case when i >= 14 then case when rg > 0 and st > 0 then 100 * ln(st / rg) / ln(14) else 100 end end",
            "efficiency": "case when i >= 9 then coalesce(abs(close - far) / nullif(path, 0), 0) end",
            "dm_balance": "case when i >= 14 then coalesce(abs(su - sd) / nullif(su + sd, 0), 0) end",
        },
    ],
)
add(
    "regime",
    ["range_position", "squeeze_on", "squeeze_duration", "range_compression"],
    [
        lambda: {"range_position": V.position_in_range(20), "squeeze_on": V.squeeze_on(20), "range_compression": V.range_compression(10, 40)},
        lambda: {"squeeze_island": V.squeeze_island()},
        lambda: {"squeeze_duration": V.squeeze_duration()},
    ],
    [
        {
            "ll": S.inc("min(low)", 20),
            "hh": S.inc("max(high)", 20),
            "sd": S.inc("stddev_pop(close)", 20),
            "ar": S.inc("avg(high - low)", 20),
            "r1": f"{S.inc('max(high)', 10)} - {S.inc('min(low)', 10)}",
            "r2": f"{S.inc('max(high)', 40)} - {S.inc('min(low)', 40)}",
        },
        {
            "range_position": f"coalesce({_clamp('case when i >= 19 then (close - ll) / nullif(hh - ll, 0) end', 0, 1)}, 0.5)",
            "squeeze_on": "case when i >= 19 then (2 * sd <= 1.5 * ar)::int else 0 end",
            "range_compression": "coalesce(case when i >= 39 then r1 / nullif(r2, 0) end, 1)",
        },
        {"isl": S.ever("sum(1 - squeeze_on)")},
        {"squeeze_duration": "sum(squeeze_on) over (partition by symbol, isl order by ts rows unbounded preceding)"},
    ],
)


# recurrences: the statement follows the bars one by one; these hourly bars are cut into weeks, so that every symbol is in several blocks
CUT = {"span": 7 * 24 * 3600, "whole": 100}


def add_recurrence(name: str, parts: list[R.Recurrence], state: dict[str, tuple[str, str]], out: dict[str, str]) -> None:
    """``state``: name to (start, step) in terms of the bar ``b`` and the state before ``r``."""
    names = list(out)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(R.apply(bars(spark, sf_dir), *parts, **CUT), names)

    QUERIES[name] = query
    start = ", ".join(f"({a})::double as {n}" for n, (a, _) in state.items())
    step = ", ".join(f"({s})::double" for _, s in state.values())
    cols = ", ".join(f"round(({e})::double + {S.TIE!r}, 6) as {n}" for n, e in out.items())
    ORACLE[name] = (
        f"with recursive {S.BASE}, r as (select b.symbol, b.ts, b.i, b.close, {start} from b where i = 0 "
        f"union all select b.symbol, b.ts, b.i, b.close, {step} from r join b on b.symbol = r.symbol and b.i = r.i + 1) "
        f"select symbol, epoch(ts)::bigint as t, {cols} from r"
    )


def _ema(n: int, x: str, e: str) -> str:
    return f"{2.0 / (n + 1)!r}::double * ({x}) + (1 - {2.0 / (n + 1)!r}::double) * r.{e}"


add_recurrence("ema", [R.Ema(9), R.Ema(21)], {"e9": ("b.close", _ema(9, "b.close", "e9")), "e21": ("b.close", _ema(21, "b.close", "e21"))}, {"ema_9": "case when i >= 1 then e9 end", "ema_21": "case when i >= 1 then e21 end"})
_E1 = _ema(10, "b.close", "e1")
_E2 = f"case when b.i = 1 then {_E1} else {_ema(10, _E1, 'e2')} end"
_E3 = f"case when b.i <= 1 then null when b.i = 2 then ({_E2}) else {_ema(10, _E2, 'e3')} end"
add_recurrence(
    "dema_tema",
    [R.Dema(10), R.Tema(10)],
    {"e1": ("b.close", _E1), "e2": ("null", _E2), "e3": ("null", _E3)},
    {"dema_10": "case when i >= 19 then 2 * e1 - e2 end", "tema_10": "case when i >= 28 then 3 * e1 - 3 * e2 + e3 end"},
)
_UP, _DN = "greatest(b.chg, 0)", "greatest(-b.chg, 0)"
add_recurrence("rsi", [R.Rsi(14)], {"u": ("0", _ema(14, _UP, "u")), "d": ("0", _ema(14, _DN, "d"))}, {"rsi_14": "case when i >= 14 then coalesce(100 * u / nullif(u + d, 0), 50) end"})
add_recurrence("atr", [R.Atr(14)], {"a": ("b.tr", _ema(14, "b.tr", "a"))}, {"atr_14": "case when i >= 14 then a end"})
add_recurrence(
    "keltner",
    [R.Keltner(20, 2.0)],
    {"m": ("b.close", _ema(20, "b.close", "m")), "a": ("b.tr", _ema(20, "b.tr", "a"))},
    {"keltner_upper": "case when i >= 20 then m + 2 * a end", "keltner_middle": "case when i >= 20 then m end", "keltner_lower": "case when i >= 20 then m - 2 * a end"},
)
_F, _SL = _ema(12, "b.close", "f"), _ema(26, "b.close", "s")
add_recurrence(
    "macd",
    [R.Macd()],
    {"f": ("b.close", _F), "s": ("b.close", _SL), "g": ("0", _ema(9, f"({_F}) - ({_SL})", "g"))},
    {"macd": "case when i >= 34 then f - s end", "macd_signal": "case when i >= 34 then g end", "macd_hist": "case when i >= 34 then f - s - g end"},
)
QUERIES["zlema_kama"] = lambda spark, sf_dir: shown(R.apply(bars(spark, sf_dir), R.Zlema(9), R.Kama(10), **CUT), ["zlema_9", "kama_10"])
_K = "pow(er * (2.0::double / 3 - 2.0::double / 31) + 2.0::double / 31, 2)"
ORACLE["zlema_kama"] = (
    f"with recursive {S.BASE}, c0 as (select *, 2 * close - {S.lag('close', 4)} as z, coalesce(abs(close - {S.lag('close', 10)}) / nullif({S.inc('sum(abs(chg))', 10)}, 0), 0) as er from b), "
    f"r as (select symbol, ts, i, close, null::double as e, null::double as k from c0 where i = 0 union all "
    f"select c.symbol, c.ts, c.i, c.close, case when c.i < 4 then null when c.i = 4 then c.z else 0.2::double * c.z + (1 - 0.2::double) * r.e end, "
    f"case when c.i < 9 then null when c.i = 9 then c.close else r.k + {_K.replace('er', 'c.er')} * (c.close - r.k) end "
    f"from r join c0 c on c.symbol = r.symbol and c.i = r.i + 1) "
    "select symbol, epoch(ts)::bigint as t, round(case when i >= 12 then e end + 1e-9, 6) as zlema_9, round(k + 1e-9, 6) as kama_10 from r"
)
QUERIES["garch"] = lambda spark, sf_dir: shown(R.apply(bars(spark, sf_dir), R.Garch(), **CUT), ["garch_vol"])
ORACLE["garch"] = (
    f"with recursive {S.BASE}, c0 as (select *, {S.lag('lret')} as p from b), "
    "r as (select symbol, ts, i, null::double as v from c0 where i = 0 union all select c.symbol, c.ts, c.i, "
    "case when c.i = 1 then c.lret * c.lret else 1e-6::double + 0.1::double * c.p * c.p + 0.85::double * r.v end from r join c0 c on c.symbol = r.symbol and c.i = r.i + 1) "
    "select symbol, epoch(ts)::bigint as t, round(sqrt(v) * case when i = 1 then 1 else sqrt(24) end + 1e-9, 6) as garch_vol from r"
)


def _atr_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = with_base(R.apply(bars(spark, sf_dir), R.Atr(14), **CUT))
    b = staged(b, {"atr_mom": T.momentum("atr_14", 5)}, {"atr_accel": T.acceleration("atr_mom"), "atr_slope": from_index(T.slope("atr_14", 10), 23)})
    return shown(b, ["atr_14", "atr_mom", "atr_accel", "atr_slope"])


QUERIES["atr_features"] = _atr_features
_ATR = f"with recursive {S.BASE}, r as (select symbol, ts, i, tr as a from b where i = 0 union all select b.symbol, b.ts, b.i, {_ema(14, 'b.tr', 'a')} from r join b on b.symbol = r.symbol and b.i = r.i + 1), q as (select symbol, ts, i, case when i >= 14 then a end as atr_14 from r)"
ORACLE["atr_features"] = (
    f"{_ATR}, q1 as (select *, {_momentum('atr_14', 5)} as atr_mom from q), q2 as (select *, atr_mom - {S.lag('atr_mom')} as atr_accel, case when i >= 23 then {S.slope('atr_14', 10)} end as atr_slope from q1) "
    "select symbol, epoch(ts)::bigint as t, round(atr_14 + 1e-9, 6) as atr_14, round(atr_mom + 1e-9, 6) as atr_mom, round(atr_accel + 1e-9, 6) as atr_accel, round(atr_slope + 1e-9, 6) as atr_slope from q2"
)


_LIQ = ("liq_upper_wick_ratio", "liq_lower_wick_ratio", "liq_body_ratio", "liq_wick_asymmetry", "liq_sweep_up_20", "liq_sweep_down_20", "liq_sweep_strength_20", "liq_cvd_slope_20", "liq_cvd_price_div_20")
QUERIES["liquidity_driver"] = lambda spark, sf_dir: shown(V.liquidity(bars(spark, sf_dir), 20, 14), list(_LIQ))
ORACLE["liquidity_driver"] = f"""{_ATR}, w as (select b.*, atr_14, {S.full("max(high)", "high", 20, S.exc).replace(S.W, "partition by b.symbol order by b.ts")} as t20, {S.full("min(low)", "low", 20, S.exc).replace(S.W, "partition by b.symbol order by b.ts")} as b20,
    {S.ever("sum((2 * coalesce((close - low) / nullif(high - low, 0), 0.5) - 1) * volume)").replace(S.W, "partition by b.symbol order by b.ts")} as cvd from b join q on q.symbol = b.symbol and q.i = b.i),
  x as (select *, coalesce(high > t20 and close < t20, false) as u, coalesce(low < b20 and close > b20, false) as d, coalesce((high - greatest(open, close)) / nullif(high - low, 0), 0) as liq_upper_wick_ratio,
    coalesce((least(open, close) - low) / nullif(high - low, 0), 0) as liq_lower_wick_ratio, coalesce(abs(close - open) / nullif(high - low, 0), 0) as liq_body_ratio,
    {S.inc("stddev_pop(cvd)", 20)} as sd1, {S.inc("stddev_pop(close)", 20)} as sd2, {S.slope("cvd", 20)} as sl, {S.lag("cvd", 19)} as l1, {S.lag("close", 19)} as l2 from w),
  y as (select *, liq_upper_wick_ratio - liq_lower_wick_ratio as liq_wick_asymmetry, u::int as liq_sweep_up_20, d::int as liq_sweep_down_20,
    coalesce(case when d then case when atr_14 > 0 then -(b20 - low) / atr_14 end when u then case when atr_14 > 0 then (high - t20) / atr_14 end end, 0) as liq_sweep_strength_20,
    case when i >= 19 then coalesce(sl / nullif(sd1, 0), 0) else 0 end as liq_cvd_slope_20, case when i >= 19 then coalesce((cvd - l1) / nullif(sd1, 0), 0) - coalesce((close - l2) / nullif(sd2, 0), 0) else 0 end as liq_cvd_price_div_20 from x)
  select symbol, epoch(ts)::bigint as t, {", ".join(f"round(({c})::double + {S.TIE!r}, 6) as {c}" for c in _LIQ)} from y"""


# cross-asset
def add_market(name: str, column: str, make: Callable[[DataFrame], DataFrame], sql: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(bars(spark, sf_dir)).select(F.unix_timestamp("ts").alias("t"), F.round(F.col(column) + S.TIE, 6).alias(column))

    QUERIES[name] = query
    ORACLE[name] = f"with {S.BASE} select epoch(ts)::bigint as t, round({column} + {S.TIE!r}, 6) as {column} from ({sql}) where {column} is not null"


add_market("cross_dominance", "dominance", lambda b: X.dominance(b, "purchase"), "select ts, coalesce(sum(case when symbol = 'purchase' then volume else 0 end) / nullif(sum(volume), 0), 0) as dominance from b group by ts")
add_market(
    "cross_ratio",
    "price_ratio",
    lambda b: X.price_ratio(b, "click", "purchase"),
    "select ts, max(case when symbol = 'click' then close end) / nullif(max(case when symbol = 'purchase' then close end), 0) as price_ratio from b group by ts",
)
add_market(
    "cross_sentiment",
    "sentiment",
    X.sentiment,
    f"""select ts, avg(case when vol > 0.05 then 0.5 when mv > 0 and sp > 1.5 then 0.5 + least(mv * sp, 0.5) when mv < 0 and sp > 1.5 then 0.5 + greatest(mv * sp, -0.5) else 0.5 end) as sentiment
    from (select *, coalesce(volume / nullif({S.exc('avg(volume)', 20)}, 0), 1) as sp, {S.exc('stddev_pop(close)', 20)} / nullif({S.exc('avg(close)', 20)}, 0) as vol,
          case when c1 > 0 then ret else 0 end as mv from b) where i >= 20 group by ts""",
)
_PF = "(partition by s1, s2 order by ts rows between 20 preceding and 1 preceding)"
add_market(
    "cross_correlation",
    "correlation",
    X.mean_correlation,
    f"""select ts, avg(c) as correlation from (select ts, case when count(x) over {_PF} = 20 then covar_pop(x, y) over {_PF} / nullif(stddev_pop(x) over {_PF} * stddev_pop(y) over {_PF}, 0) end as c
    from (select l.ts, l.symbol as s1, q.symbol as s2, l.close as x, q.close as y from b l join b q on l.ts = q.ts and l.symbol < q.symbol)) group by ts""",
)
add_market("cross_momentum", "momentum", X.market_momentum, f"select ts, tanh(avg(m)) as momentum from (select ts, (close - {S.lag('close', 10)}) / nullif({S.lag('close', 10)}, 0) as m from b) group by ts having avg(m) is not null")
_C9, _C19 = f"({S.W} rows between 9 preceding and 1 preceding)", f"({S.W} rows between 19 preceding and 1 preceding)"
add_market(
    "cross_clustering",
    "clustering",
    X.volatility_clusters,
    f"select ts, least(abs(avg(r) - 1), 1) as clustering from (select ts, case when count(ret) over {_C19} = 19 then stddev_pop(ret) over {_C9} / nullif(stddev_pop(ret) over {_C19}, 0) end as r from b) group by ts having avg(r) is not null",
)
