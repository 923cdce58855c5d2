"""Moving averages, slopes, momentum and engineered features as window expressions over ``with_base`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.safe import clamp, col, div
from ..functions.windows import exc, from_index, full, inc, lag


def sma(c: Column | str, n: int) -> Column:
    """Mean of the last n values, the current one included."""
    return full(F.avg(col(c)), c, n, inc(n))


def slope(c: Column | str, n: int) -> Column:
    """Least-squares slope per bar over the last n values."""
    c, at = col(c), F.col("i").cast("double")
    return F.when(F.count(c).over(inc(n)) == n, F.try_divide(F.covar_pop(c, at).over(inc(n)), F.var_pop(at).over(inc(n))))


def velocity(c: Column | str) -> Column:
    """Change from the bar before, in percent."""
    return div(col(c) - lag(c), lag(c)) * 100


def rolling_mean(c: Column | str, n: int) -> Column:
    """Mean of the n values before the current bar."""
    return full(F.avg(col(c)), c, n, exc(n))


def rolling_std(c: Column | str, n: int) -> Column:
    """Population deviation of the n values before the current bar."""
    return full(F.stddev_pop(col(c)), c, n, exc(n))


def bollinger(c: Column | str = "close", n: int = 20, k: float = 2.0) -> dict[str, Column]:
    """Mean and k population deviations of the last n values."""
    middle, spread = sma(c, n), full(F.stddev_pop(col(c)), c, n, inc(n))
    return {"bb_upper": middle + k * spread, "bb_middle": middle, "bb_lower": middle - k * spread}


def engineered(lags: tuple[int, ...] = (1, 3), windows: tuple[int, ...] = (5, 20)) -> dict[str, Column]:
    """Interaction, polynomial, lag, rolling and ratio features of the close."""
    c, v = F.col("close"), F.col("volume")
    made = {
        "price_volume_ratio": F.when(v > 0, F.try_divide(c, v)).otherwise(0.0),
        "close_squared": c * c,
        "close_log": F.when(c > 0, F.log(c)).otherwise(0.0),
        "high_low_ratio": F.when(F.col("low") > 0, F.try_divide(F.col("high"), F.col("low"))).otherwise(1.0),
    }
    made |= {f"close_lag_{k}": lag("close", k) for k in lags}
    made |= {f"close_mean_{n}": rolling_mean("close", n) for n in windows}
    return made | {f"close_std_{n}": rolling_std("close", n) for n in windows}


def momentum(c: Column | str, n: int) -> Column:
    """Relative change over n bars: 0 if the values agree to 1e-15, the plain difference from a base of about 0."""
    c = col(c)
    base = lag(c, n)
    change = c - base
    return F.when(F.abs(change) < 1e-15, 0.0).when(F.abs(base) < 1e-15, change).otherwise(F.try_divide(change, base))


def acceleration(m: Column | str) -> Column:
    """First difference of a momentum column."""
    return col(m) - lag(m)


def custom_momentum(c: Column | str, n: int) -> Column:
    """Relative change over n bars, 0 in the warm-up and from a base of 0."""
    return F.coalesce(div(col(c) - lag(c, n), lag(c, n)), F.lit(0.0))


def stochastic_k(k: int = 14) -> Column:
    """Place of the close in the last k bars' range, in percent; 50 if the range is 0."""
    low, high = F.min("low").over(inc(k)), F.max("high").over(inc(k))
    return from_index(F.coalesce(F.try_divide(F.col("close") - low, high - low) * 100, F.lit(50.0)), k - 1)


def williams_r(n: int = 14) -> Column:
    """-100 (HH - C) / (HH - LL) over the last n bars, from index n; -50 on a flat range."""
    low, high = F.min("low").over(inc(n)), F.max("high").over(inc(n))
    return from_index(F.coalesce(F.try_divide(high - F.col("close"), high - low) * -100, F.lit(-50.0)), n)


def cci(n: int = 20) -> Column:
    """(TP - SMA) / (0.015 mean absolute deviation) over the last n bars; 0 if the deviation is 0."""
    seen, mean = F.collect_list("tp").over(inc(n)), F.avg("tp").over(inc(n))
    spread = F.aggregate(seen, F.lit(0.0), lambda a, x: a + F.abs(x - mean)) / n
    return from_index(F.when(spread == 0, 0.0).otherwise(F.try_divide(F.col("tp") - mean, 0.015 * spread)), n - 1)


def money_flow() -> dict[str, Column]:
    """Signed money flow of a bar: typical price times volume, by the direction of the typical price."""
    before = lag("tp")
    flow = F.col("tp") * F.col("volume")
    return {"flow_up": F.when(F.col("tp") > before, flow).otherwise(0.0), "flow_down": F.when(F.col("tp") < before, flow).otherwise(0.0)}


def mfi(n: int = 14) -> Column:
    """Money flow index over the last n bars' flows (``money_flow``), from index n: 50 without flow, 100 without outflow."""
    up, down = F.sum("flow_up").over(inc(n)), F.sum("flow_down").over(inc(n))
    return from_index(F.when((up == 0) & (down == 0), 50.0).when(down == 0, 100.0).otherwise(100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(up, down))), n)


def wick_ratios() -> dict[str, Column]:
    """Upper wick, lower wick and body over the bar's range, and the wicks' asymmetry."""
    width = F.greatest(F.col("high") - F.col("low"), F.lit(1e-12))
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    upper, lower = clamp((F.col("high") - top) / width, 0, 1), clamp((bottom - F.col("low")) / width, 0, 1)
    return {"upper_wick": upper, "lower_wick": lower, "body": clamp((top - bottom) / width, 0, 1), "wick_asymmetry": upper - lower}
