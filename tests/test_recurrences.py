"""Recurrences over segments: the same values however a series is cut, and defined ones for nulls and repeated rows."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tapeloom.operators import indicators
from tapeloom.operators.recurrences import Periods

BARS = "ticker string, date date, open double, high double, low double, close double, volume bigint"


def bars(n=150, seed=3, tickers=("A", "B", None)):
    g = np.random.default_rng(seed)
    rows = []
    for t in tickers:
        x = 100 + np.cumsum(g.normal(0, 1, n))
        rows += [(t, dt.date(2023, 11, 1) + dt.timedelta(i), float(x[i]), float(x[i] + g.uniform(0, 2)), float(x[i] - g.uniform(0, 2)), float(x[i] + 0.3), int(g.integers(1, 1000))) for i in range(n)]
    return rows


def plain(rows, p=Periods()):
    """One series row by row."""
    out, n = [], 0
    state, sums, signal, last = {}, {}, None, None
    obv = num = den = 0.0
    for *_, h, lo, c, v in rows:
        r = {k: None for k in p.columns()}
        if h is None or lo is None or c is None:
            out.append(r)
            continue
        ph, pl, pc = last or (h, lo, c)
        up, down = h - ph, pl - lo
        x = {"gain": max(c - pc, 0), "loss": max(pc - c, 0), "range": max(h - lo, abs(h - pc), abs(lo - pc)), "plus": up if up > down and up > 0 else 0.0, "minus": down if down > up and down > 0 else 0.0}
        for k in p.means():
            state[k] = c if n == 0 else state[k] + 2 / (k + 1) * (c - state[k])

        def average(name, value, k, first):
            if n < first:
                return None
            s, m = sums.get(name, (0.0, 0))
            s, m = (s + value, m + 1) if m < k - 1 else ((s + value) / k, k) if m == k - 1 else (s + (value - s) / k, k)
            sums[name] = s, m
            return s if m == k else None

        for k in p.rsi:
            up_, down_ = average(f"g{k}", x["gain"], k, 1), average(f"l{k}", x["loss"], k, 1)
            if up_ is not None:
                r[f"rsi_{k}"] = 100 * (up_ / (up_ + down_) if up_ + down_ else 0.5)
        for k in p.atr:
            r[f"atr_{k}"] = average(f"a{k}", x["range"], k, 0)
        tr, pd_, md = (average(f"d{q}", x[q], p.adx, 1) for q in ("range", "plus", "minus"))
        if tr:
            r["adx_plus"], r["adx_minus"] = 100 * pd_ / tr, 100 * md / tr
            total = r["adx_plus"] + r["adx_minus"]
        r["adx"] = average("adx", 100 * abs(r["adx_plus"] - r["adx_minus"]) / total if tr and total else 0.0, p.adx, p.adx)
        r |= {f"ema_{k}": state[k] for k in p.ema if n >= k - 1}
        if n >= p.macd[1] - 1:
            r["macd"] = state[p.macd[0]] - state[p.macd[1]]
            signal = r["macd"] if signal is None else signal + 2 / (p.macd[2] + 1) * (r["macd"] - signal)
            if n >= p.macd[1] + p.macd[2] - 2:
                r["macd_signal"], r["macd_hist"] = signal, r["macd"] - signal
        obv += np.sign(c - pc) * (v or 0)
        num, den = num * 19 / 21 + obv, den * 19 / 21 + 1
        r["obv"], r["obv_ema"] = obv, num / den
        last, n = (h, lo, c), n + 1
        out.append(r)
    return out


def check(spark, rows, span, **periods):
    p = Periods(**periods)
    got = indicators.recursive_indicators(spark.createDataFrame(rows, BARS), span=span, **periods)
    assert len(got.columns) == len(set(got.columns))
    table = got.toPandas().sort_values(["ticker", "date", "close"], na_position="last")
    assert len(table) == len(rows)
    crossed = 0
    for t in {r[0] for r in rows}:
        own = sorted([r for r in rows if r[0] == t], key=lambda r: (r[1], r[5] is not None, r[5]))
        mine = table[table["ticker"].isna() if t is None else table["ticker"] == t].sort_values(["date", "close"], na_position="first")
        want = pd.DataFrame(plain(own, p))
        for c in p.columns():
            assert np.allclose(mine[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-9, atol=1e-9, equal_nan=True), (t, c)
        known = want[want["obv"].notna()]
        over = (known["macd"] > known["macd_signal"])[known["macd_signal"].notna()]
        assert mine["macd_cross_above"].sum() == (over & ~over.shift(fill_value=True)).sum() and mine["macd_cross_below"].sum() == (~over & over.shift(fill_value=False)).sum()
        crossed += mine["macd_cross_above"].sum()
    assert crossed


@pytest.mark.parametrize("span, batch", [("year", 10_000), ("day", 10_000), ("month", 7), ("year", 1)])
def test_any_cut_gives_the_same(spark, span, batch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(batch))
    try:
        check(spark, bars(), span)
        check(spark, bars(60, tickers=("A",)), span, rsi=(3, 14), ema=(5,), macd=(3, 6, 4), atr=(2, 7), adx=4)
    finally:
        spark.conf.set(key, before)


def test_nulls_are_passed_over(spark):
    rows = bars(100, tickers=("A", "B"))
    for i, column in ((0, 5), (7, 5), (50, 3), (51, 4), (52, 6), (99, 5), (120, 5)):
        rows[i] = (*rows[i][:column], None, *rows[i][column + 1 :])
    rows += [("C", dt.date(2024, 1, 1), None, None, None, None, None)]
    check(spark, rows, "month")


def test_repeated_rows_come_back_as_often(spark):
    rows = bars(80, tickers=("A",))
    check(spark, rows + rows[40:41] + [(*rows[60][:5], rows[60][5] + 0.5, 7)], "month")


def test_no_bars(spark):
    assert indicators.recursive_indicators(spark.createDataFrame([], BARS)).count() == 0
