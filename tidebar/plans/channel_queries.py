"""Queries of further indicators, each with its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import channels as C
from ..operators import trend as T
from . import sqlkit as S
from .indicators import ORACLE as _INDICATORS
from .indicators import QUERIES as _QUERIES
from .indicators import add as _add

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def add(name: str, *rest) -> None:
    """Registered here instead of among the indicators."""
    _add(name, *rest)
    QUERIES[name], ORACLE[name] = _QUERIES.pop(name), _INDICATORS.pop(name)


def _wma(c: str, n: int) -> str:
    return f"case when i >= {n - 1} and {S.inc(f'count({c})', n)} = {n} then (" + " + ".join(f"{n - k} * lag({c}, {k}) over ({S.W})" for k in range(n)) + f") / {n * (n + 1) / 2} end"


add("wma", ["wma_10"], [lambda: {"wma_10": C.wma("close", 10)}], [{"wma_10": _wma("close", 10)}])
add("hull", ["hull"], [lambda: C.hull_stages("close", 16)[0], lambda: C.hull_stages("close", 16)[1]], [{"w8": _wma("close", 8), "w16": _wma("close", 16)}, {"raw": "2 * w8 - w16"}, {"hull": _wma("raw", 4)}])
add("donchian", ["donchian_upper", "donchian_lower", "donchian_middle"], [lambda: C.donchian(20)], [{"donchian_upper": S.full("max(high)", "high", 20), "donchian_lower": S.full("min(low)", "low", 20)}, {"donchian_middle": "(donchian_upper + donchian_lower) / 2"}])
add(
    "aroon",
    ["aroon_up", "aroon_down", "aroon"],
    [lambda: C.aroon(14)],
    [{"hs": S.inc("list(high)", 15), "ls": S.inc("list(low)", 15)}, {"aroon_up": "case when i >= 14 then (15 - list_position(list_reverse(hs), list_max(hs))) * 100.0::double / 14 end", "aroon_down": "case when i >= 14 then (15 - list_position(list_reverse(ls), list_min(ls))) * 100.0::double / 14 end"}, {"aroon": "aroon_up - aroon_down"}],
)
_UP, _DOWN = f"(high - {S.lag('high')})", f"({S.lag('low')} - low)"
add(
    "adx",
    ["di_plus", "di_minus", "dx", "adx"],
    [C.movement, lambda: C.directional(14), lambda: {"adx": C.adx(14)}],
    [
        {"mu": _UP, "md": _DOWN},
        {"dp": "case when mu > md and mu > 0 then mu else 0 end", "dm": "case when md > mu and md > 0 then md else 0 end"},
        {"tr14": S.full("sum(tr)", "tr", 14), "sp": S.inc("sum(dp)", 14), "sm": S.inc("sum(dm)", 14)},
        {"di_plus": "case when i >= 14 then sp * 100 / nullif(tr14, 0) end", "di_minus": "case when i >= 14 then sm * 100 / nullif(tr14, 0) end"},
        {"dx": "abs(di_plus - di_minus) * 100 / nullif(di_plus + di_minus, 0)"},
        {"adx": S.full("avg(dx)", "dx", 14)},
    ],
)
_MF = "coalesce((2 * close - high - low) / nullif(high - low, 0), 0) * volume"
add("accumulation", ["ad_line", "chaikin_flow"], [lambda: {"ad_line": C.accumulation(), "chaikin_flow": C.chaikin_flow(20)}], [{"mf": _MF}, {"ad_line": S.ever("sum(mf)"), "chaikin_flow": S.div(S.full("sum(mf)", "volume", 20), S.inc("sum(volume)", 20))}])
add(
    "liquidity_measures",
    ["eom", "nvi", "jerk", "intensity", "depth"],
    [C.falling, lambda: {"eom": C.ease_of_movement(), "nvi": F.log(C.negative_volume_index(1.0)), "jerk": C.jerk(), "intensity": C.trade_intensity(20), "depth": C.depth(20)}],
    [
        {"mid": "(high + low) / 2", "v1": S.lag("volume"), "g": "case when ret > -1 then ln(1 + ret) end"},
        {"eom": f"(mid - {S.lag('mid')}) * (high - low) / nullif(volume / 1e6, 0)", "lg": "case when volume < v1 and ret > -1 then g else 0 end"},
        {"nvi": S.ever("sum(lg)"), "jerk": f"close - 3 * {S.lag('close')} + 3 * {S.lag('close', 2)} - {S.lag('close', 3)}", "intensity": S.div("volume", S.full("avg(volume)", "volume", 20)), "depth": S.div(S.full("sum(volume)", "volume", 20), S.inc("sum(abs(chg))", 20))},
    ],
)
add(
    "atr_helpers",
    ["atr_ever", "atr_slope", "tr_weighted", "tr_consistency", "tr_percentile"],
    [lambda: {"atr_ever": C.expanding_atr(), "tr_weighted": C.volume_weighted("tr", 14), "tr_consistency": C.consistency("tr", 14), "tr_percentile": C.percentile_rank("tr", 20)}, lambda: {"atr_slope": T.slope("atr_ever", 14)}],
    [
        {"atr_ever": S.ever("avg(case when i >= 1 then tr end)"), "tr_weighted": S.div(S.full("sum(tr * volume)", "tr", 14), S.inc("sum(volume)", 14)), "tr_consistency": f"1 / nullif(1 + {S.div(S.inc('stddev_pop(tr)', 14), S.full('avg(tr)', 'tr', 14))}, 0)", "held": f"list(tr) filter (where tr is not null) over ({S.W} rows between 20 preceding and 1 preceding)"},
        {"tr_percentile": "case when len(held) = 20 then len(list_filter(held, lambda x: x < tr)) * 100.0::double / 20 else 50 end", "atr_slope": f"case when {S.inc('count(atr_ever)', 14)} = 14 then {S.slope('atr_ever', 14)} end"},
    ],
)
