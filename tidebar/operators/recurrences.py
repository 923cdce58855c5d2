"""Recurrences over a symbol's bars, in parallel over blocks of time: the moving-average family, RSI, ATR, MACD, Keltner, KAMA, GARCH.

Each of them takes its state by an affine step, s' = a s + b, where a and b follow
from the bars alone. Affine steps compose, so a symbol of over ``WHOLE`` bars is cut into
blocks of ``SPAN`` of time that are worked on by different tasks:

1. every block is run as if nothing were before it; from the place on at which all its states
   have a value, its steps are composed into one,
2. the blocks of a symbol are gone through in order, one composed step each, which gives what
   each block starts from,
3. every block is run from there.

The first two steps concern such symbols only. Within a batch of rows all
symbols are run at once, by a prefix scan over pairs (a, b): no Python call a bar. The bars are
exchanged once, by symbol and block; what moves besides is a few bars and numbers a block.

Choices where smoothing conventions differ: an EMA has k = 2 / (n + 1) and starts
from the first value; its first output is null. The first true range is high less
low. RSI smooths rises and falls with an EMA (``wilder=True``: k = 1 / n) and is
50 without movement. Null inputs leave the state as it is and give null; so does NaN.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = ("open", "high", "low", "close", "volume")
#: Seconds of a block: 30 days, 43,200 minute bars. Any span gives the same values.
SPAN = 30 * 24 * 3600
#: Bars up to which a symbol is one block.
WHOLE = 100_000
#: Symbols of several blocks that are broadcast.
FEW = 50_000


def scan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """s of s[t] = a[t] s[t - 1] + b[t] from 0, by doubling."""
    a, b, step = a.copy(), b.copy(), 1
    while step < len(b):
        b[step:] += a[step:] * b[:-step]
        a[step:] = a[step:] * a[:-step]
        step *= 2
        if not a[step:].any():
            break
    return b


class Bars:
    """Rows of several segments, each the start of a symbol or the rest of one after some bars that were seen already."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray, seen: np.ndarray, first: np.ndarray, carried: dict[tuple, np.ndarray]):
        """``sizes``: rows a segment; the first ``seen`` of them are old. ``first``: index of its first new bar. ``carried``: states (NaN: none)."""
        self.values, self.carried = dict(zip(FIELDS, values)), carried
        self.starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        self.ends = self.starts + sizes
        self.segment = np.repeat(np.arange(len(sizes)), sizes)
        self.place = np.arange(len(self.segment)) - self.starts[self.segment]
        self.old = self.place < seen[self.segment]
        self.i = self.place - seen[self.segment] + first[self.segment]
        self.states: dict[tuple, np.ndarray] = {}
        self.owner: object = None

    def __getitem__(self, name: str) -> np.ndarray:
        return self.values[name]

    def lag(self, x: np.ndarray, k: int = 1) -> np.ndarray:
        out = np.full(len(x), np.nan)
        out[k:] = x[: max(0, len(x) - k)]
        out[self.place < k] = np.nan
        return out

    def affine(self, name: str, a: np.ndarray | float, b: np.ndarray, at: np.ndarray, seeds: np.ndarray, seed: np.ndarray) -> np.ndarray:
        """The state after each row: set to ``seed`` at the first of ``seeds`` if it has no value, then stepped where ``at``."""
        key = (self.owner, name)
        before = self.carried.get(key, np.full(len(self.starts), np.nan))
        seeds = seeds & ~self.old & np.isnan(before)[self.segment]
        count = np.cumsum(seeds)
        count -= (count - seeds)[self.starts][self.segment]
        first = seeds & (count == 1)
        is_set = ~np.isnan(before)[self.segment] | (count > 0)
        stepped = at & ~self.old & is_set & ~first
        up, plus = np.where(stepped, a, 1.0), np.where(stepped, b, 0.0)
        up[first], plus[first] = 0.0, seed[first]
        up[~is_set] = 0.0
        # a segment starts from what was carried, if anything
        at_start = self.starts
        plus[at_start] += np.where(first[at_start], 0.0, up[at_start] * np.nan_to_num(before))
        up[at_start] = 0.0
        state = scan(up, plus)
        state[~is_set] = np.nan
        self.states[key] = state
        return state

    def ema(self, name: str, x: np.ndarray, k: float, when: np.ndarray | bool = True) -> np.ndarray:
        """Smoothed ``x``; null where ``x`` is."""
        at = ~np.isnan(x) & when
        return np.where(at, self.affine(name, 1.0 - k, k * x, at, at, x), np.nan)

    def latest(self, name: str, x: np.ndarray) -> np.ndarray:
        """The last value of ``x`` that was not null, before each row."""
        at = ~np.isnan(x)
        state = self.affine(name, 0.0, x, at, at, x)
        return self.lag(state)

    def final(self, key: tuple) -> np.ndarray:
        """A state after each segment."""
        return self.states[key][self.ends - 1]


def _rate(n: int) -> float:
    return 2.0 / (n + 1)


class Recurrence:
    """Columns ``names`` from bars; ``states`` step affinely, ``held`` are values of the last bars, ``lags`` how many bars back it looks."""

    names: tuple[str, ...] = ()
    states: tuple[str, ...] = ()
    held: tuple[str, ...] = ()
    lags = 1

    def __call__(self, b: Bars) -> tuple[np.ndarray, ...]:
        raise NotImplementedError


class Ema(Recurrence):
    def __init__(self, n: int, of: str = "close", name: str | None = None, k: float | None = None, first: int = 1):
        self.names, self.states, self.of, self.k, self.first = (name or f"ema_{n}",), ("e",), of, _rate(n) if k is None else k, first

    def __call__(self, b):
        return (np.where(b.i >= self.first, b.ema("e", b[self.of], self.k), np.nan),)


class Dema(Recurrence):
    """2 E1 - E2; the second average starts at the first output of the first."""

    def __init__(self, n: int):
        self.names, self.states, self.n = (f"dema_{n}",), ("e1", "e2"), n

    def __call__(self, b):
        one = b.ema("e1", b["close"], _rate(self.n))
        two = b.ema("e2", one, _rate(self.n), b.i >= 1)
        return (np.where(b.i >= 2 * self.n - 1, 2 * one - two, np.nan),)


class Tema(Recurrence):
    """3 E1 - 3 E2 + E3."""

    def __init__(self, n: int):
        self.names, self.states, self.n = (f"tema_{n}",), ("e1", "e2", "e3"), n

    def __call__(self, b):
        one = b.ema("e1", b["close"], _rate(self.n))
        two = b.ema("e2", one, _rate(self.n), b.i >= 1)
        three = b.ema("e3", two, _rate(self.n), b.i >= 2)
        return (np.where(b.i >= 3 * self.n - 2, 3 * one - 3 * two + three, np.nan),)


class Zlema(Recurrence):
    """EMA of the close plus its change over (n - 1) / 2 bars."""

    def __init__(self, n: int):
        self.names, self.states, self.n, self.lags = (f"zlema_{n}",), ("e",), n, max(1, (n - 1) // 2)

    def __call__(self, b):
        lag = (self.n - 1) // 2
        old = b.lag(b["close"], lag) if lag else b["close"]
        return (np.where(b.i >= self.n + lag - 1, b.ema("e", 2 * b["close"] - old, _rate(self.n)), np.nan),)


class Kama(Recurrence):
    """Adaptive average: seeded with the n-th close, its rate follows the efficiency of the last n changes."""

    def __init__(self, n: int):
        self.names, self.states, self.n, self.lags = (f"kama_{n}",), ("v",), n, n

    def __call__(self, b):
        p, n = b["close"], self.n
        back = [p, *(b.lag(p, k) for k in range(1, n + 1))]
        path = sum(np.abs(x - y) for x, y in zip(back, back[1:]))
        share = np.divide(np.abs(p - back[n]), path, out=np.zeros(len(p)), where=path > 0)
        rate = (share * (2.0 / 3.0 - 2.0 / 31.0) + 2.0 / 31.0) ** 2
        return (b.affine("v", 1.0 - rate, rate * p, (b.i >= n) & ~np.isnan(path), (b.i == n - 1) & ~np.isnan(p), p),)


class Macd(Recurrence):
    def __init__(self, fast: int = 12, slow: int = 26, signal: int = 9):
        if fast >= slow:
            raise ValueError("the fast period must be below the slow one")
        self.names, self.states = ("macd", "macd_signal", "macd_hist"), ("f", "s", "g")
        self.rates, self.first = (_rate(fast), _rate(slow), _rate(signal)), slow + signal - 1

    def __call__(self, b):
        line = b.ema("f", b["close"], self.rates[0]) - b.ema("s", b["close"], self.rates[1])
        signal = b.ema("g", line, self.rates[2])
        return tuple(np.where(b.i >= self.first, x, np.nan) for x in (line, signal, line - signal))


class Rsi(Recurrence):
    def __init__(self, n: int = 14, wilder: bool = False):
        self.names, self.states, self.held, self.n, self.k = (f"rsi_{n}",), ("u", "d"), ("last",), n, 1.0 / n if wilder else _rate(n)

    def __call__(self, b):
        p = b["close"]
        move = np.where(np.isnan(p), np.nan, np.nan_to_num(p - b.latest("last", p)))
        up, down = b.ema("u", np.maximum(move, 0.0), self.k), b.ema("d", np.maximum(-move, 0.0), self.k)
        level = np.where(up + down > 0, np.divide(100.0 * up, up + down, out=np.full(len(p), np.nan), where=up + down > 0), 50.0)
        return (np.where((b.i >= self.n) & ~np.isnan(p), level, np.nan),)


def _true_range(b: Bars) -> np.ndarray:
    spread, before = b["high"] - b["low"], b.lag(b["close"])
    return np.where(np.isnan(before), spread, np.maximum(spread, np.maximum(np.abs(b["high"] - before), np.abs(b["low"] - before))))


class Atr(Recurrence):
    def __init__(self, n: int = 14):
        self.names, self.states, self.n = (f"atr_{n}",), ("e",), n

    def __call__(self, b):
        return (np.where(b.i >= self.n, b.ema("e", _true_range(b), _rate(self.n)), np.nan),)


class Keltner(Recurrence):
    """EMA plus and minus ``k`` average true ranges of the same period."""

    def __init__(self, n: int = 20, k: float = 2.0):
        self.names, self.states, self.n, self.k = ("keltner_upper", "keltner_middle", "keltner_lower"), ("m", "r"), n, k

    def __call__(self, b):
        middle, spread = b.ema("m", b["close"], _rate(self.n)), b.ema("r", _true_range(b), _rate(self.n))
        middle = np.where((b.i >= self.n) & ~np.isnan(spread), middle, np.nan)
        return middle + self.k * spread, middle, middle - self.k * spread


class Garch(Recurrence):
    """Fixed GARCH(1,1) volatility of log returns; only outputs after the first are scaled by sqrt(24)."""

    names, states, lags = ("garch_vol",), ("v",), 2
    OMEGA, ALPHA, BETA = 1e-6, 0.1, 0.85

    def __call__(self, b):
        p = b["close"]
        before = b.lag(p)
        fine = (p > 0) & (before > 0)
        ret = np.log(np.divide(p, before, out=np.full(len(p), np.nan), where=fine))
        last = b.lag(ret)
        variance = b.affine("v", self.BETA, self.OMEGA + self.ALPHA * last * last, ~np.isnan(last), ~np.isnan(ret), ret * ret)
        seeded = np.isnan(b.lag(variance))  # there was no variance before
        return (np.where(seeded, np.sqrt(variance), np.where(np.isnan(last), np.nan, np.sqrt(variance) * np.sqrt(24.0))),)


class _Program:
    """Several recurrences over the same rows."""

    def __init__(self, parts: tuple[Recurrence, ...]):
        self.parts = parts
        self.names = [n for p in parts for n in p.names]
        self.lags = max([1, *(p.lags for p in parts)])
        self.states = [(k, s) for k, p in enumerate(parts) for s in p.states]
        self.held = [(k, s) for k, p in enumerate(parts) for s in p.held]
        self.keys = self.states + self.held
        #: the place of a state among those of its recurrence
        self.rank = [p.states.index(s) for p, s in ((parts[k], s) for k, s in self.states)]

    def run(self, bars: Bars) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            for k, part in enumerate(self.parts):
                bars.owner = k
                out += part(bars)
        return out

    def from_(self, values: np.ndarray, first: int, seen: int, states: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Outputs, and the states afterwards, of one segment."""
        bars = Bars(values, np.array([values.shape[1]]), np.array([seen]), np.array([first]), {k: states[j : j + 1] for j, k in enumerate(self.keys)})
        return self.run(bars), np.array([bars.final(k)[0] for k in self.keys])


def _summaries(program: _Program, at: list[int]):
    """Rows sorted by symbol and block to one row a block: (symbol, block, first time, pickled summary)."""

    def made(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        names, blocks = rows.column(at[0]), rows.column(at[1]).to_numpy()
        values = np.stack([_floats(rows.column(k)) for k in at[3:]])
        cuts = np.flatnonzero(_changes(names, blocks))
        sizes = np.diff(np.append(cuts, len(blocks)))
        none = np.zeros(len(sizes), np.int64)
        fresh = Bars(values, sizes, none, none, {})
        program.run(fresh)
        # from where on every state has a value, and the bars looked back at are of this block
        last = np.full(len(sizes), program.lags)
        for key in program.keys:
            unset = np.isnan(fresh.states[key])
            last = np.maximum(last, np.add.reduceat(unset.astype(np.int64), fresh.starts) + 1)
        heads = np.minimum(last, sizes)
        rest = np.flatnonzero(heads < sizes)
        steps = np.zeros((len(program.states), 1 + max([0, *program.rank]) + 1, len(sizes)))
        finals = {k: np.full(len(sizes), np.nan) for k in program.held}
        if len(rest):
            kept = program.lags
            pick = np.concatenate([np.arange(cuts[s] + heads[s] - kept, cuts[s] + sizes[s]) for s in rest])
            after = cuts[rest] + heads[rest] - 1
            fixed = {k: fresh.states[k][after] for k in program.held}
            scale = np.zeros((len(program.states), len(rest)))
            for unit in range(steps.shape[1]):  # from zero, then with one state of each recurrence at its scale
                carried = fixed | {k: scale[j] * (program.rank[j] == unit - 1) for j, k in enumerate(program.states)}
                bars = Bars(values[:, pick], sizes[rest] - heads[rest] + kept, np.full(len(rest), kept), heads[rest], carried)
                program.run(bars)
                for j, k in enumerate(program.states):
                    steps[j, unit, rest] = bars.final(k)
                if not unit:  # a power of two as large as what the recurrence reaches, so that differences lose no digits
                    reached = {p: np.max([np.abs(steps[j, 0, rest]) for j, (q, _) in enumerate(program.states) if q == p], axis=0) for p, _ in program.states}
                    scale[:] = [np.exp2(np.ceil(np.log2(np.where(reached[p] > 0, reached[p], 1.0)))) for p, _ in program.states]
            for j, (p, _) in enumerate(program.states):
                for unit in range(1, 1 + len(program.parts[p].states)):
                    steps[j, unit, rest] = (steps[j, unit, rest] - steps[j, 0, rest]) / scale[j]
        for k in program.held:
            finals[k] = fresh.states[k][cuts + sizes - 1]
        times = rows.column(at[2])
        packed = []
        for s, (cut, size, head) in enumerate(zip(cuts, sizes, heads)):
            tail = values[:, max(cut, cut + size - program.lags) : cut + size]
            step = steps[:, :, s] if head < size else None
            packed.append(pickle.dumps((int(size), values[:, cut : cut + head].copy(), tail.copy(), step, [finals[k][s] for k in program.held])))
        take = pa.array(cuts)
        yield pa.record_batch([names.take(take).combine_chunks(), pa.array(blocks[cuts]), times.take(take).combine_chunks(), pa.array(packed, pa.binary())], names=["symbol", "block", "ts", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = int(np.flatnonzero(_changes(batch.column(at[0]), batch.column(at[1]).to_numpy()))[-1])
            if cut:  # all but the last block of the batch are whole
                yield from made([*held, batch.slice(0, cut)])
                held = []
            elif held and _key(held[-1], at, -1) != _key(batch, at, 0):
                yield from made(held)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from made(held)

    return run


def _key(batch: pa.RecordBatch, at: list[int], row: int) -> tuple:
    return batch.column(at[0])[row].as_py(), batch.column(at[1])[row].as_py()


def _floats(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.cast(pa.float64()).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.cast(pa.float64()).to_numpy(), np.float64)


def _changes(names: pa.Array | pa.ChunkedArray, blocks: np.ndarray) -> np.ndarray:
    """Whether a row begins another symbol or block than the row before; the first does."""
    if isinstance(names, pa.ChunkedArray):
        names = names.combine_chunks()
        names = names.chunk(0) if isinstance(names, pa.ChunkedArray) else names
    codes = names.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[True], (codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])])


def _carried(program: _Program):
    """Summaries in order of symbol and block to (symbol, block, ts, carried): what every block but a symbol's first starts from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, first, context, states = object(), 0, None, None
        for batch in batches:
            out = []
            for name, block, ts, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                if name != symbol:
                    symbol, first, context, states = name, 0, np.empty((len(FIELDS), 0)), np.full(len(program.keys), np.nan)
                else:
                    out.append((name, block, ts, pickle.dumps((first, context, states))))
                size, head, tail, step, finals = pickle.loads(raw)
                _, states = program.from_(np.concatenate([context, head], axis=1), first, context.shape[1], states)
                if step is not None:
                    after = step[:, 0].copy()
                    for j, (k, _) in enumerate(program.states):
                        for o, (other, _) in enumerate(program.states):
                            if other == k:
                                after[j] += step[j, 1 + program.rank[o]] * states[o]
                    states = np.concatenate([after, finals])
                first += size
                context = np.concatenate([context, tail], axis=1)[:, -program.lags :]
            if out:
                yield pa.record_batch([pa.array([o[0] for o in out], batch.schema.field(0).type), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], batch.schema.field(2).type), pa.array([o[3] for o in out], pa.binary())], names=["symbol", "block", "ts", "carried"])

    return run


def _finished(program: _Program, at: list[int], columns: list[str], shown: int):
    """Rows sorted by symbol and block, a block's first with what it starts from, to rows with all outputs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, going = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            names, blocks = batch.column(at[0]), batch.column(at[1]).to_numpy()
            values = np.stack([_floats(batch.column(k)) for k in at[3:]])
            cuts = np.flatnonzero(_changes(names, blocks))
            sizes = np.diff(np.append(cuts, len(blocks)))
            raw = batch.column(batch.num_columns - 1)
            begun = {}
            if _key(batch, at, 0) == last:
                begun[0] = going
            for s in np.flatnonzero(raw.is_valid().to_numpy(zero_copy_only=False)[cuts]).tolist():
                if s or not begun:
                    begun[s] = pickle.loads(raw[int(cuts[s])].as_py())
            seen, first = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            carried = {k: np.full(len(sizes), np.nan) for k in program.keys}
            for s, (index, context, states) in begun.items():
                seen[s], first[s] = context.shape[1], index
                for j, k in enumerate(program.keys):
                    carried[k][s] = states[j]
            if begun:
                parts, at_row = [], 0
                for s in sorted(begun):
                    parts += [values[:, at_row : cuts[s]], begun[s][1]]
                    at_row = cuts[s]
                laid = np.concatenate([*parts, values[:, at_row:]], axis=1)
            else:
                laid = values
            bars = Bars(laid, sizes + seen, seen, first, carried)
            made = program.run(bars)
            new = ~bars.old
            outputs = [pa.array(v[new], pa.float64(), mask=np.isnan(v[new])) for v in made]
            end = slice(int(bars.ends[-1]) - min(program.lags, int(sizes[-1] + seen[-1])), int(bars.ends[-1]))
            last, going = _key(batch, at, -1), (int(first[-1] + sizes[-1]), laid[:, end].copy(), np.array([bars.final(k)[-1] for k in program.keys]))
            yield pa.record_batch([*batch.columns[:shown], *outputs], names=columns)

    return run


def apply(bars: DataFrame, *parts: Recurrence, span: int = SPAN, whole: int = WHOLE) -> DataFrame:
    """``bars`` with the columns of every recurrence.

    Symbols of more than ``whole`` bars are cut into blocks of ``span`` seconds; their number is
    looked up first. Rows without a time go. Other columns pass through, whatever their names.
    """
    program = _Program(parts)
    columns = bars.columns
    block, carried, of, since, start = (_free(name, columns) for name in ("block", "carried", "of", "since", "start"))
    timed = bars.filter(F.col("ts").isNotNull())
    several = timed.groupBy(F.col("symbol").alias(of)).count().filter(F.col("count") > whole).select(of, F.lit(True).alias(start))
    large = several.limit(FEW + 1).count()
    if large:
        several = F.broadcast(several) if large <= FEW else several
        number = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / span).cast("bigint")
        marked = timed.join(several, F.col("symbol").eqNullSafe(F.col(of)), "left")
        timed = marked.withColumn(block, F.when(F.col(start), number).otherwise(0)).select(*[F.col(f"`{c}`") for c in columns], block)
    else:
        timed = timed.withColumn(block, F.lit(0).cast("bigint"))
    at = [timed.columns.index(c) for c in ("symbol", block, "ts", *FIELDS)]
    every = [F.col(f"`{c}`") for c in timed.columns]
    dealt = timed.repartition("symbol", block)

    key = [timed.schema["symbol"], T.StructField("block", T.LongType()), timed.schema["ts"]]
    names = [*columns, *program.names]
    schema = T.StructType([*bars.schema.fields, *(T.StructField(n, T.DoubleType()) for n in program.names)])
    finish = lambda laid: laid.sortWithinPartitions("symbol", block, "ts").mapInArrow(_finished(program, at, names, len(columns)), schema)
    if not large:
        return finish(dealt.withColumn(carried, F.lit(None).cast("binary")))

    cut = dealt.join(several, F.col("symbol").eqNullSafe(F.col(of)), "left_semi").sortWithinPartitions("symbol", block, "ts")
    summed = cut.mapInArrow(_summaries(program, at), T.StructType([*key, T.StructField("packed", T.BinaryType())]))
    begun = summed.repartition("symbol").sortWithinPartitions("symbol", "block").mapInArrow(_carried(program), T.StructType([*key, T.StructField("carried", T.BinaryType())]))

    # the state goes with a block's first bar
    begun = begun.select(F.col("symbol").alias(of), F.col("block").alias(since), F.col("ts").alias(start), F.col("carried").alias(carried))
    met = F.col("symbol").eqNullSafe(F.col(of)) & (F.col(block) == F.col(since)) & (F.col("ts") <= F.col(start))
    return finish(dealt.join(begun, met, "left").select(*every, carried))


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def _running(x: np.ndarray, rate: float, mean: float | None) -> tuple[np.ndarray, float | None]:
    """The running mean at each value of one symbol, and the last one, from the one before, if any; NaN stays and is passed over."""
    at, out = ~np.isnan(x), np.full(len(x), np.nan)
    parts = (rate * x[at]).tolist()
    n = len(parts)
    if not n:
        return out, mean
    if mean is None:
        mean, parts = float(x[at][0]), parts[1:]
    steps = list(accumulate(parts, lambda s, part: part + (1.0 - rate) * s, initial=mean))
    out[at] = steps[-n:]
    return out, steps[-1]


def _means(of: int, at: list[int], rate: float):
    """Rows sorted by symbol (column ``of``) and time to rows whose columns ``at`` are running means."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, means = None, [None] * len(at)
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(of)
            cuts = np.flatnonzero(_changes(names, np.zeros(len(names))))
            begun = last is not None and last[0] == names[0].as_py()
            made = list(batch.columns)
            for k, column in enumerate(at):
                parts = []
                for s, x in enumerate(np.split(_floats(batch.column(column)), cuts[1:])):
                    part, means[k] = _running(x, rate, means[k] if begun and not s else None)
                    parts.append(part)
                values = np.concatenate(parts)
                made[column] = pa.array(values, pa.float64(), mask=np.isnan(values))
            last = (names[-1].as_py(),)
            yield pa.record_batch(made, names=batch.schema.names)

    return run


def smoothed(rows: DataFrame, columns: list[str], rate: float) -> DataFrame:
    """``rows`` with numeric columns replaced by their running means by symbol and time, each step a share ``rate`` of the way to the new value.

    The first value stands as it is; a null stays null and leaves the mean alone. Rows without a time go.
    The steps are taken one by one, so means are to the last bit those of the plain recurrence: what is
    filtered by quartiles afterwards may depend on it. A symbol is gone through by one task, as in windows.
    """
    numbers = rows.filter(F.col("ts").isNotNull()).select(*[F.col(f"`{n}`").cast("double").alias(n) if n in columns else F.col(f"`{n}`") for n in rows.columns])
    schema = T.StructType([T.StructField(f.name, T.DoubleType()) if f.name in columns else f for f in rows.schema.fields])
    of, at = rows.columns.index("symbol"), [rows.columns.index(c) for c in columns]
    return numbers.repartition("symbol").sortWithinPartitions("symbol", "ts").mapInArrow(_means(of, at, rate), schema)
