"""Recurrences one bar at a time, as the library's parallel ones must come out."""

from __future__ import annotations

import math

Row = tuple[float | None, ...]


class Ema:
    def __init__(self, n: int, k: float | None = None):
        self.k, self.value = (2.0 / (n + 1) if k is None else k), None

    def __call__(self, x: float | None) -> float | None:
        if x is None:
            return None
        self.value = x if self.value is None else self.k * x + (1.0 - self.k) * self.value
        return self.value


class Fold:
    """Takes a bar (open, high, low, close, volume) and its index; returns one value for each of ``names``."""

    names: tuple[str, ...] = ()

    def __call__(self, i: int, bar: Row) -> tuple[float | None, ...]:
        raise NotImplementedError


class EmaFold(Fold):
    def __init__(self, n: int):
        self.names, self.of = (f"ema_{n}",), Ema(n)

    def __call__(self, i, bar):
        value = self.of(bar[3])
        return (value if i >= 1 else None,)


class DemaFold(Fold):
    """2 E1 - E2; the second average starts at the first output of the first."""

    def __init__(self, n: int):
        self.names, self.n, self.one, self.two = (f"dema_{n}",), n, Ema(n), Ema(n)

    def __call__(self, i, bar):
        a = self.one(bar[3])
        b = self.two(a) if i >= 1 else None
        return (2 * a - b if a is not None and b is not None and i >= 2 * self.n - 1 else None,)


class TemaFold(Fold):
    """3 E1 - 3 E2 + E3."""

    def __init__(self, n: int):
        self.names, self.n, self.one, self.two, self.three = (f"tema_{n}",), n, Ema(n), Ema(n), Ema(n)

    def __call__(self, i, bar):
        a = self.one(bar[3])
        b = self.two(a) if i >= 1 else None
        c = self.three(b) if i >= 2 else None
        return (3 * a - 3 * b + c if c is not None and a is not None and i >= 3 * self.n - 2 else None,)


class ZlemaFold(Fold):
    """EMA of the close plus its change over (n - 1) / 2 bars."""

    def __init__(self, n: int):
        self.names, self.n, self.lag, self.of, self.seen = (f"zlema_{n}",), n, (n - 1) // 2, Ema(n), []

    def __call__(self, i, bar):
        self.seen.append(bar[3])
        if len(self.seen) > self.lag + 1:
            self.seen.pop(0)
        old = self.seen[0] if len(self.seen) == self.lag + 1 else None
        value = self.of(2 * bar[3] - old) if old is not None and bar[3] is not None else None
        return (value if i >= self.n + self.lag - 1 else None,)


class KamaFold(Fold):
    """Adaptive average: seeded with the n-th close, its rate follows the efficiency of the last n changes."""

    def __init__(self, n: int):
        self.names, self.n, self.value, self.seen = (f"kama_{n}",), n, None, []

    def __call__(self, i, bar):
        p, n = bar[3], self.n
        self.seen.append(p)
        if len(self.seen) > n + 1:
            self.seen.pop(0)
        if i == n - 1:
            self.value = p
        elif i >= n and self.value is not None and None not in self.seen:
            path = sum(abs(b - a) for a, b in zip(self.seen, self.seen[1:]))
            share = abs(p - self.seen[0]) / path if path > 0 else 0.0
            rate = (share * (2.0 / 3.0 - 2.0 / 31.0) + 2.0 / 31.0) ** 2
            self.value += rate * (p - self.value)
        return (self.value,)


class MacdFold(Fold):
    def __init__(self, fast: int = 12, slow: int = 26, signal: int = 9):
        if fast >= slow:
            raise ValueError("the fast period must be below the slow one")
        self.names, self.first = ("macd", "macd_signal", "macd_hist"), slow + signal - 1
        self.fast, self.slow, self.signal = Ema(fast), Ema(slow), Ema(signal)

    def __call__(self, i, bar):
        a, b = self.fast(bar[3]), self.slow(bar[3])
        line = None if a is None else a - b
        signal = self.signal(line)
        return (line, signal, line - signal) if line is not None and i >= self.first else (None, None, None)


class RsiFold(Fold):
    def __init__(self, n: int = 14, wilder: bool = False):
        k = 1.0 / n if wilder else None
        self.names, self.n, self.up, self.down, self.before = (f"rsi_{n}",), n, Ema(n, k), Ema(n, k), None

    def __call__(self, i, bar):
        p, before = bar[3], self.before
        if p is None:
            return (None,)
        self.before = p
        move = 0.0 if before is None else p - before
        up, down = self.up(max(move, 0.0)), self.down(max(-move, 0.0))
        return ((100.0 * up / (up + down) if up + down > 0 else 50.0) if i >= self.n else None,)


def _true_range(bar: Row, before: float | None) -> float | None:
    high, low = bar[1], bar[2]
    if high is None or low is None:
        return None
    return high - low if before is None else max(high - low, abs(high - before), abs(low - before))


class AtrFold(Fold):
    def __init__(self, n: int = 14):
        self.names, self.n, self.of, self.before = (f"atr_{n}",), n, Ema(n), None

    def __call__(self, i, bar):
        value = self.of(_true_range(bar, self.before))
        self.before = bar[3]
        return (value if i >= self.n else None,)


class KeltnerFold(Fold):
    """EMA plus and minus ``k`` average true ranges of the same period."""

    def __init__(self, n: int = 20, k: float = 2.0):
        self.names, self.n, self.k = ("keltner_upper", "keltner_middle", "keltner_lower"), n, k
        self.middle, self.spread, self.before = Ema(n), Ema(n), None

    def __call__(self, i, bar):
        middle, spread = self.middle(bar[3]), self.spread(_true_range(bar, self.before))
        self.before = bar[3]
        if i < self.n or middle is None or spread is None:
            return (None, None, None)
        return (middle + self.k * spread, middle, middle - self.k * spread)


class GarchFold(Fold):
    """Fixed GARCH(1,1) volatility of log returns; only outputs after the first are scaled by sqrt(24)."""

    OMEGA, ALPHA, BETA = 1e-6, 0.1, 0.85

    def __init__(self):
        self.names, self.variance, self.ret, self.before = ("garch_vol",), None, None, None

    def __call__(self, i, bar):
        p, before = bar[3], self.before
        self.before = p
        ret = math.log(p / before) if p is not None and before is not None and p > 0 and before > 0 else None
        last, self.ret = self.ret, ret
        if self.variance is None:
            if ret is None:
                return (None,)
            self.variance = ret * ret
            return (math.sqrt(self.variance),)
        if last is None:
            return (None,)
        self.variance = self.OMEGA + self.ALPHA * last * last + self.BETA * self.variance
        return (math.sqrt(self.variance) * math.sqrt(24.0),)


def fold(bars: list[Row], *folds: Fold) -> list[tuple[float | None, ...]]:
    """Outputs of all folds for the bars (open, high, low, close, volume) of one symbol."""
    return [tuple(v for f in folds for v in f(i, bar)) for i, bar in enumerate(bars)]
