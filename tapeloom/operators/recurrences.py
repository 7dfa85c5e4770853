"""Order-dependent indicators over series that spread over tasks.

Every recurrence here is an affine step y -> a * y + b once its inputs are known, and such steps compose: a segment of
a series has one factor and one summand for each recurrence. So a series is cut into segments, written as one row
each; a pass over the segments gives their steps, a fold over these few numbers in the order of a series gives the
values that each segment starts with, and a last pass gives the values of its rows. Recurrences of recurrences (the
signal line, the mean of directional movement, the mean of volume balance) take one more pass and fold.

Rows move once, by ticker and calendar part, and no task holds a series.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.scratch import cut

SMALL = 500_000
KEY = ["ticker", "part", "number"]
SMOOTH = 2 / 21  # of the mean of volume balance, 20 rows


@dataclass(frozen=True)
class Periods:
    rsi: tuple[int, ...] = (14,)
    ema: tuple[int, ...] = (9, 20, 50)
    macd: tuple[int, int, int] = (12, 26, 9)
    atr: tuple[int, ...] = (14,)
    adx: int = 14

    def means(self) -> list[int]:
        """Periods of all exponential means, those of the two lines of MACD last."""
        return [*self.ema, *self.macd[:2]]

    def wilder(self) -> list[tuple[str, int, int]]:
        """Input, period and first row of all of Wilder's averages."""
        return [*[(x, n, 1) for n in self.rsi for x in ("gain", "loss")], *[("range", n, 0) for n in self.atr], *[(x, self.adx, 1) for x in ("range", "plus", "minus")]]

    def columns(self) -> list[str]:
        return [*[f"rsi_{n}" for n in self.rsi], *[f"ema_{n}" for n in self.ema], "macd", "macd_signal", "macd_hist", *[f"atr_{n}" for n in self.atr], "adx", "adx_plus", "adx_minus", "obv", "obv_ema"]

    def flags(self) -> list[str]:
        return [*(["ema_9_20_cross"] if {9, 20} <= set(self.ema) else []), "macd_cross_above", "macd_cross_below"]


def smooth(x: np.ndarray, alpha: float, before: float) -> np.ndarray:
    """y = (1 - alpha) * y + alpha * x from `before` on."""
    return pd.Series(np.concatenate([[before], x])).ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:]


def wilder(x: np.ndarray, n: int, first: int, at: int, before: float) -> tuple[np.ndarray, float]:
    """Values (null while warming up) and end of Wilder's average over rows `at` and on of a series: the sum of n
    values from row `first`, then their mean, then y += (x - y) / n. `before` is the sum or the mean so far."""
    y, last = np.full(len(x), np.nan), first + n - 1
    lo, hi = max(first - at, 0), min(max(last + 1 - at, 0), len(x))
    if hi > lo:
        before += x[lo:hi].sum()
        if at <= last < at + len(x):
            before /= n
            y[hi - 1] = before
    rest = max(hi, 0) if last >= at else 0
    if at + rest > last and rest < len(x):
        y[rest:] = smooth(x[rest:], 1 / n, before)
        before = y[-1]
    return y, before


def wilder_factor(n: int, first: int, at: int, rows: int) -> float:
    last = first + n - 1
    return (1 / n if at <= last < at + rows else 1.0) * (1 - 1 / n) ** max(0, at + rows - max(at, last + 1))


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full(len(a), np.nan), where=b != 0)


class Segment:
    """The rows of a segment with prices, where they lie in their series (`at`), and the row before them."""

    def __init__(self, p: Periods, at: int, before: tuple, high, low, close, volume):
        self.p, self.at, self.rows = p, at, len(close)
        h, l, c = before if at else (high[:1], low[:1], close[:1])
        ph, pl, pc = (np.concatenate([np.atleast_1d(b), x[:-1]]) for b, x in ((h, high), (l, low), (c, close)))
        step, up, down = close - pc, high - ph, pl - low
        self.close = close
        self.inputs = {
            "gain": np.maximum(step, 0), "loss": np.maximum(-step, 0), "range": np.maximum.reduce([high - low, np.abs(high - pc), np.abs(low - pc)]),
            "plus": np.where((up > down) & (up > 0), up, 0.0), "minus": np.where((down > up) & (down > 0), down, 0.0),
        }
        self.balance = np.sign(step) * volume

    def first(self, state: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Values and ends of the first level: exponential means, Wilder's averages, volume balance."""
        means = [smooth(self.close, 2 / (n + 1), s if self.at else self.close[0]) for n, s in zip(self.p.means(), state, strict=False)]
        averages = [wilder(self.inputs[x], n, first, self.at, s) for (x, n, first), s in zip(self.p.wilder(), state[len(means) :], strict=False)]
        balance = state[-1] + np.cumsum(self.balance)
        return [*means, *[y for y, _ in averages], balance], np.array([*[y[-1] for y in means], *[e for _, e in averages], balance[-1]])

    def first_factors(self) -> np.ndarray:
        return np.array([*[(1 - 2 / (n + 1)) ** self.rows if self.at else 0.0 for n in self.p.means()], *[wilder_factor(n, first, self.at, self.rows) for _, n, first in self.p.wilder()], 1.0])

    def lines(self, values: list[np.ndarray]) -> dict[str, np.ndarray]:
        """What follows from the first level row by row, null while warming up."""
        p, i, names = self.p, self.at + np.arange(self.rows), iter(values)
        out = {f"ema_{n}": np.where(i >= n - 1, next(names), np.nan) for n in p.ema}
        fast, slow = next(names), next(names)
        out["macd"] = np.where(i >= p.macd[1] - 1, fast - slow, np.nan)
        for n in p.rsi:
            gain, loss = next(names), next(names)
            out[f"rsi_{n}"] = np.where(np.isnan(gain), np.nan, 100 * np.nan_to_num(ratio(gain, gain + loss), nan=0.5))
        for n in p.atr:
            out[f"atr_{n}"] = next(names)
        moved, plus, minus = next(names), next(names), next(names)
        out["adx_plus"], out["adx_minus"] = 100 * ratio(plus, moved), 100 * ratio(minus, moved)
        out["dx"] = 100 * np.nan_to_num(ratio(np.abs(out["adx_plus"] - out["adx_minus"]), out["adx_plus"] + out["adx_minus"]))
        out["obv"] = next(names)
        return out

    def second(self, lines: dict[str, np.ndarray], state: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Values and ends of the second level: signal line, mean of directional movement, mean of balance (unscaled)."""
        p, start = self.p, self.p.macd[1] - 1 - self.at
        signal, end = np.full(self.rows, np.nan), state[0]
        if start < self.rows:
            lo = max(start, 0)
            signal[lo:] = smooth(lines["macd"][lo:], 2 / (p.macd[2] + 1), lines["macd"][lo] if start >= 0 else state[0])
            end = signal[-1]
        adx, adx_end = wilder(lines["dx"], p.adx, p.adx, self.at, state[1])
        mean = smooth(lines["obv"], SMOOTH, state[2])
        return [signal, adx, mean], np.array([end, adx_end, mean[-1]])

    def second_factors(self) -> np.ndarray:
        start = self.p.macd[1] - 1 - self.at
        signal = 1.0 if start >= self.rows else 0.0 if start >= 0 else (1 - 2 / (self.p.macd[2] + 1)) ** self.rows
        return np.array([signal, wilder_factor(self.p.adx, self.p.adx, self.at, self.rows), (1 - SMOOTH) ** self.rows])

    def crosses(self, lines: dict[str, np.ndarray], state: np.ndarray, second: np.ndarray) -> dict[str, np.ndarray]:
        """Rows at which a line passes another; the row before the segment is known from what it starts with."""
        p, at, means = self.p, self.at, dict(zip(self.p.means(), state, strict=False))
        fast, slow, sign = p.macd

        def turns(one, two, before: tuple[float, float] | None) -> tuple[np.ndarray, np.ndarray]:
            x, y = (np.concatenate([[b], v]) for b, v in zip(before or (np.nan, np.nan), (one, two), strict=True))
            known, over = ~(np.isnan(x) | np.isnan(y)), x > y
            both = known[1:] & known[:-1]
            return both & over[1:] & ~over[:-1], both & ~over[1:] & over[:-1]

        out = {}
        if "ema_9_20_cross" in p.flags():
            out["ema_9_20_cross"] = turns(lines["ema_9"], lines["ema_20"], (means[9], means[20]) if at >= 20 else None)[0]
        before = state[len(p.ema)] - state[len(p.ema) + 1], second[0]
        out["macd_cross_above"], out["macd_cross_below"] = turns(lines["macd"], lines["macd_signal"], before if at >= slow + sign - 1 else None)
        return out


def _segments(bars: DataFrame, time: str, span: str) -> DataFrame:
    """One row a segment: its key, its rows as they are, how many of them have prices, and the last of these.

    A segment is what an Arrow batch holds of a ticker's calendar part, whose rows lie in one task in order.
    """
    part = F.date_trunc(span, F.col(time)).cast("date")
    ties = [c for c in ("close", "high", "low", "volume") if c in bars.columns]
    sorted_ = bars.withColumn("_part", part).repartition("ticker", "_part").sortWithinPartitions("ticker", "_part", time, *ties)
    names = bars.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            code = [pd.factorize(batch.column(c).to_pandas(), use_na_sentinel=False)[0] for c in ("ticker", "_part")]
            first = np.flatnonzero(np.concatenate([[True], *[(code[0][1:] != code[0][:-1]) | (code[1][1:] != code[1][:-1])]]))
            prices = np.column_stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("high", "low", "close")])
            fine = ~np.isnan(prices).any(axis=1)
            ends = np.concatenate([first[1:], [len(fine)]])
            up_to = np.concatenate([[0], np.cumsum(fine)])
            last = np.maximum.accumulate(np.where(fine, np.arange(len(fine)), -1))[ends - 1]
            last = np.where(last >= first, last, -1)
            rows = pa.StructArray.from_arrays([batch.column(c) for c in names], fields=[batch.schema.field(c) for c in names])
            at = pa.array(first)
            known = [pa.array(np.where(last >= 0, prices[last, k], np.nan), from_pandas=True) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("ticker").take(at), batch.column("_part").take(at), pa.array(number + np.arange(len(first))), pa.ListArray.from_arrays(pa.array(np.append(first, len(fine)).astype(np.int32)), rows), pa.array(up_to[ends] - up_to[first]), *known],
                [*KEY, "rows", "priced", "last_high", "last_low", "last_close"],
            )
            number += len(first)

    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in bars.schema)
    kind = bars.schema["ticker"].dataType.simpleString()
    return sorted_.mapInArrow(run, f"ticker {kind}, part date, number long, rows array<struct<{fields}>>, priced long, last_high double, last_low double, last_close double")


def _with(segments: DataFrame, more: DataFrame, few: bool) -> DataFrame:
    """Segments with columns that another table has for each of them, which is broadcast where these are few."""
    names = {k: f"_{k}" for k in KEY}
    m = more.withColumnsRenamed(names)
    on = F.col("ticker").eqNullSafe(F.col("_ticker")) & F.col("part").eqNullSafe(F.col("_part")) & (F.col("number") == F.col("_number"))
    return segments.join(F.broadcast(m) if few else m, on).drop(*names.values())


def _folded(steps: DataFrame, kind: str) -> DataFrame:
    """What each segment starts with: the steps of all segments of its ticker before it, composed in order."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "number"], na_position="first")
        state, out = np.zeros(len(pdf["a"].iloc[0])), []
        for a, b in zip(pdf["a"], pdf["b"], strict=True):
            out.append(state)
            state = np.asarray(a) * state + np.asarray(b)
        return pdf[KEY].assign(state=out)

    return steps.groupBy("ticker").applyInPandas(run, f"ticker {kind}, part date, number long, state array<double>")


PRICES = ["high", "low", "close", "volume"]


def _opened(batch: pa.RecordBatch, p: Periods) -> Iterator[tuple[int, Segment | None, np.ndarray]]:
    """Number in the batch, segment (None without prices) and mask of the priced rows."""
    lists = [batch.column(c) for c in PRICES]
    values = [c.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) for c in lists]
    values[3] = np.nan_to_num(values[3])
    ends = np.concatenate([[0], np.cumsum(lists[0].value_lengths().to_numpy(zero_copy_only=False))])
    at = batch.column("at").to_numpy(zero_copy_only=False)
    before = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("ph", "pl", "pc")])
    for k, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        own = [v[lo:hi] for v in values]
        fine = ~np.isnan(np.column_stack(own[:3])).any(axis=1)
        yield k, Segment(p, int(at[k]), tuple(before[k]), *[v[fine] for v in own]) if fine.any() else None, fine


def _states(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def recursive(bars: DataFrame, time: str = "date", span: str = "year", p: Periods | None = None) -> DataFrame:
    """Bars with the columns of `Periods.columns` and the flags of `Periods.flags`; doubles, null while warming up.

    A row without high, low or close has no values and changes none: recurrences pass over it. A null volume counts as 0.
    Rows that repeat a ticker and time follow each other, by their prices. `span` is the calendar part that rows are
    dealt by (year, month, day): a ticker's part should be small beside a task, and results don't depend on it.
    """
    p = p or Periods()
    segs = cut(_segments(bars, time, span), "segments")
    kind = bars.schema["ticker"].dataType.simpleString()
    before = Window.partitionBy("ticker").orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # a row a segment
    last = {f"p{c[0]}": F.last(f"last_{c}", ignorenulls=True).over(before) for c in ("high", "low", "close")}
    starts = cut(segs.select(*KEY, F.coalesce(F.sum("priced").over(before), F.lit(0)).alias("at"), *[c.alias(k) for k, c in last.items()]), "starts")
    few = starts.count() <= SMALL  # a row a segment, in all tables of states
    prices = [F.col("rows")[c].alias(c) for c in PRICES]
    number, second_number = len(p.means()) + len(p.wilder()) + 1, 3

    def steps(batch, of) -> pa.RecordBatch:
        n = number if of == 1 else second_number
        a, b = np.ones((batch.num_rows, n)), np.zeros((batch.num_rows, n))
        for k, s, _ in _opened(batch, p):
            if s is not None and of == 1:
                a[k], b[k] = s.first_factors(), s.first(np.zeros(n))[1]
            elif s is not None:
                lines = s.lines(s.first(_states(batch, "state")[k])[0])
                a[k], b[k] = s.second_factors(), s.second(lines, np.zeros(n))[1]
        ends = pa.array(np.arange(0, (batch.num_rows + 1) * n, n, dtype=np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (a, b)]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in KEY], *lists], [*KEY, "a", "b"])

    step_schema = f"ticker {kind}, part date, number long, a array<double>, b array<double>"
    placed = _with(segs, starts, few).select(*KEY, "at", "ph", "pl", "pc", *prices)
    one = cut(_folded(placed.mapInArrow(lambda bs: (steps(b, 1) for b in bs), step_schema), kind), "first")
    two = cut(_folded(_with(placed, one, few).mapInArrow(lambda bs: (steps(b, 2) for b in bs), step_schema), kind), "second")
    fields, columns, flags = bars.schema, p.columns(), p.flags()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("rows").flatten()
            out = {c: np.full(len(rows), np.nan) for c in columns} | {c: np.zeros(len(rows), bool) for c in flags}
            states, seconds, base = _states(batch, "state"), _states(batch, "state2"), 0
            for k, s, fine in _opened(batch, p):
                if s is not None:
                    lines = s.lines(s.first(states[k])[0])
                    signal, adx, mean = s.second(lines, seconds[k])[0]
                    i = s.at + np.arange(s.rows)
                    lines["macd_signal"] = np.where(i >= p.macd[1] + p.macd[2] - 2, signal, np.nan)
                    lines |= {"macd_hist": lines["macd"] - lines["macd_signal"], "adx": adx, "obv_ema": mean / (1 - (1 - SMOOTH) ** (i + 1.0))}
                    lines |= s.crosses(lines, states[k], seconds[k])
                    at = base + np.flatnonzero(fine)
                    for c in (*columns, *flags):
                        out[c][at] = lines[c]
                base += len(fine)
            yield pa.RecordBatch.from_arrays([*rows.flatten(), *[pa.array(out[c], from_pandas=True) for c in columns], *[pa.array(out[c].astype(np.int32)) for c in flags]], [*fields.names, *columns, *flags])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], *[f"`{c}` double" for c in columns], *[f"`{c}` int" for c in flags]])
    full = _with(_with(_with(segs, starts, few), one, few), two.withColumnRenamed("state", "state2"), few)
    return full.select("at", "ph", "pl", "pc", "state", "state2", *prices, "rows").mapInArrow(run, schema)
