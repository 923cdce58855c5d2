"""Small builders for the DuckDB statements that check the operators."""

from __future__ import annotations

#: Added before rounding, on both sides: moves values that end in 5 at the seventh place off the tie.
TIE = 1e-9
W = "partition by symbol order by ts"
BARS = """bars as (
    select event_type as symbol, date_trunc('hour', ts) as ts, first(value order by ts, event_id) as open, max(value) as high,
           min(value) as low, last(value order by ts, event_id) as close, count(*)::double as volume
    from events group by event_type, date_trunc('hour', ts)
)"""
BASE = f"""{BARS},
b1 as (select *, row_number() over ({W}) - 1 as i, (high + low + close) / 3 as tp, lag(close) over ({W}) as c1 from bars),
b as (select *, close - c1 as chg, (close - c1) / nullif(c1, 0) as ret,
             case when close / nullif(c1, 0) > 0 then ln(close / nullif(c1, 0)) end as lret,
             greatest(high - low, abs(high - c1), abs(low - c1)) as tr from b1)"""


def inc(agg: str, n: int) -> str:
    return f"{agg} over ({W} rows between {n - 1} preceding and current row)"


def exc(agg: str, n: int) -> str:
    return f"{agg} over ({W} rows between {n} preceding and 1 preceding)"


def full(agg: str, c: str, n: int, frame=inc) -> str:
    return f"case when {frame(f'count({c})', n)} = {n} then {frame(agg, n)} end"


def lag(c: str, k: int = 1) -> str:
    return f"lag({c}, {k}) over ({W})"


def ever(agg: str) -> str:
    return f"{agg} over ({W} rows unbounded preceding)"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def slope(c: str, n: int, frame=inc) -> str:
    return f"({frame(f'covar_pop({c}, i)', n)} / nullif({frame('var_pop(i)', n)}, 0))"


def staged(*stages: dict[str, str], out: list[str], base: str = BASE, source: str = "b", where: str = "") -> str:
    """Each stage adds its columns to the one before; doubles of the output are rounded to six places."""
    parts, last = [base], source
    for k, stage in enumerate(stages):
        made = ", ".join(f"{sql} as {name}" for name, sql in stage.items())
        parts.append(f"s{k} as (select *, {made} from {last})")
        last = f"s{k}"
    shown = ", ".join(f"round(({c})::double + {TIE!r}, 6) as {c}" for c in out)
    return f"with {', '.join(parts)} select symbol, epoch(ts)::bigint as t, {shown} from {last} {where}"
