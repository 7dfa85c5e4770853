"""Pairwise correlations of series, block by block.

Series are dealt into blocks, and each pair of blocks is one group: a row of a series goes to as many groups as there
are blocks, instead of once to every other series. A group streams through its dates in order and adds up six
products of matrices of block by block numbers, so its memory is that of a block, however long the series are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 256  # series
NAMES = 4096  # pairs handed on at once


class Sums:
    """Sums over common dates of two blocks of series; series get their place as they come."""

    def __init__(self):
        self.place: tuple[dict, dict] = ({}, {})
        self.sums = np.zeros((6, 0, 0))

    def add(self, pdf: pd.DataFrame, same: bool) -> None:
        """Rows (side, ticker, date, x) of whole dates; in a block with itself both sides are the same rows."""
        day = pd.factorize(pdf["date"])[0]
        parts = []
        for side in (0, 1):
            own = pdf if same else pdf[pdf["side"] == side]
            place = self.place[0 if same else side]
            at = np.array([place.setdefault(t, len(place)) for t in own["ticker"]], np.int64)
            v, m = (np.zeros((day.max() + 1, len(place))) for _ in range(2))
            rows = day if same else day[(pdf["side"] == side).to_numpy()]
            v[rows, at], m[rows, at] = own["x"].to_numpy(), 1.0
            parts.append((v, m))
        (x, mx), (y, my) = parts
        size = (x.shape[1], y.shape[1])
        grown = np.zeros((6, *size))
        grown[:, : self.sums.shape[1], : self.sums.shape[2]] = self.sums
        self.sums = grown
        for out, one, two in zip(self.sums, (mx, x, mx, x * x, mx, x), (my, my, y, my, y * y, y), strict=True):
            out += one.T @ two

    def pairs(self, same: bool, least: float | None) -> Iterator[pd.DataFrame]:
        """src, dst, corr of pairs with a common date, the names in order; NaN for fewer than two dates or a constant side."""
        n, sx, sy, sxx, syy, sxy = self.sums
        vx, vy = n * sxx - sx * sx, n * syy - sy * sy
        fine = (n > 1) & (vx > 0) & (vy > 0)
        c = np.full(n.shape, np.nan)
        c[fine] = (n * sxy - sx * sy)[fine] / (np.sqrt(vx[fine]) * np.sqrt(vy[fine]))
        one = np.array(list(self.place[0]), object)
        two = one if same else np.array(list(self.place[1]), object)
        keep = (n > 0) & ((one[:, None] < two[None, :]) if same else True)
        if least is not None:
            keep &= np.abs(np.nan_to_num(c)) >= least
        a, b = np.nonzero(keep)
        for i in range(0, len(a), NAMES):
            s, d = one[a[i : i + NAMES]], two[b[i : i + NAMES]]
            swap = s > d
            yield pd.DataFrame({"src": np.where(swap, d, s), "dst": np.where(swap, s, d), "corr": c[a[i : i + NAMES], b[i : i + NAMES]]})


def pairwise(values: DataFrame, by: str | None = None, name: str = "ticker", date: str = "date", value: str = "ret", least: float | None = None) -> DataFrame:
    """Correlation of every pair of series with a common date: by (if given), src < dst, corr.

    `least` leaves out pairs whose correlation is smaller in size, in the block where they arise. A constant side gives
    null. Nulls don't count; a name has one value a date. Work is dates times pairs, in products of blocks.
    """
    rows = values.filter(F.col(value).isNotNull() & F.col(name).isNotNull() & F.col(date).isNotNull())
    blocks = max(1, math.ceil(rows.select(name).distinct().count() / BLOCK))
    own = F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int")
    key = ["i", "j", "by"]
    placed = rows.select(F.col(by) if by else F.lit(0).alias("by"), F.col(name).cast("string").alias("ticker"), F.col(date).alias("date"), F.col(value).cast("double").alias("x"), own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    placed = placed.withColumnRenamed(by, "by") if by else placed
    placed = placed.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "by", (F.col("own") > F.col("other")).cast("int").alias("side"), "ticker", "date", "x")
    kind = placed.schema["by"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_, sums, rest = None, Sums(), None

        def out() -> Iterator[pd.DataFrame]:
            for pdf in sums.pairs(open_[0] == open_[1], least):
                yield pdf.assign(by=open_[2])[["by", "src", "dst", "corr"]]

        for last, pdf in _marked(batches):
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not last:  # the last date of a batch may go on in the next one
                final = (pdf[[*key, "date"]] == pdf[[*key, "date"]].iloc[-1]).all(axis=1)
                pdf, rest = pdf[~final], pdf[final]
            for k, g in pdf.groupby(key, sort=False, dropna=False):
                if k != open_ and open_ is not None:
                    yield from out()
                    sums = Sums()
                open_ = k
                sums.add(g, k[0] == k[1])
        if open_ is not None:
            yield from out()

    dealt = placed.repartition(*key).sortWithinPartitions(*key, "date")
    found = dealt.mapInPandas(run, f"by {kind}, src string, dst string, corr double").withColumn("corr", F.nanvl("corr", F.lit(None).cast("double")))
    return found.withColumnRenamed("by", by) if by else found.drop("by")


def _marked(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[bool, pd.DataFrame]]:
    """Batches with whether they are the last; empty ones are left out."""
    before = None
    for pdf in batches:
        if len(pdf):
            if before is not None:
                yield False, before
            before = pdf
    if before is not None:
        yield True, before
