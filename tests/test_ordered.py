"""Work that spreads an order over tasks, against plain code."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import calendar, metrics, ordered, selection


@pytest.fixture
def many_tasks(spark):
    """As many tasks as shuffle partitions, however small the data."""
    conf = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_running_products_cross_tasks(spark, many_tasks):
    g = np.random.default_rng(1)
    rows = [(k, i, None if i == 5 else float(x)) for k, scale in ((1, 0.02), (2, 0.9), (None, 0.1)) for i, x in enumerate(g.normal(0, scale, 200))]
    df = spark.createDataFrame(rows, "k int, i int, s double")
    assert ordered.dealt(df, ["k"], ["i"]).select("_task").distinct().count() == 7
    got = {(r["k"], r["i"]): (r["running"], r["highest"]) for r in ordered.running_product(df, ["k"], ["i"], 1 + F.col("s")).collect()}
    assert len(got) == 600
    for k in (1, 2, None):
        c, top = 1.0, None
        for _, i, s in [r for r in rows if r[0] == k]:
            c *= 1 if s is None else 1 + s
            top = c if top is None else max(top, c)
            assert np.allclose(got[k, i], (c, top), rtol=1e-9)


def test_drawdown_at_full_stake(spark, many_tasks):
    """The whole capital in each trade: running wealth may fall to nothing and below."""
    g = random.Random(3)
    rows = [(h, dt.date(2024, 1, 1) + dt.timedelta(i), g.choice([1.0, -1.0]), g.uniform(-1.4, 1.4) if h == 7 else g.uniform(-0.1, 0.1), 0.5) for h in (1, 7) for i in range(150)]
    df = spark.createDataFrame(rows, "horizon_days int, prediction_date date, predicted_return double, actual_return double, confidence_score double")
    got = {r["horizon_days"]: (r["max_drawdown"], r["calmar_ratio"]) for r in metrics.drawdown(df, ["prediction_date"]).collect()}
    for h in (1, 7):
        s = np.array([np.sign(r[2]) * r[3] for r in rows if r[0] == h])
        c = np.cumprod(1 + s)
        m = np.maximum.accumulate(c)
        assert np.allclose(got[h], (((c - m) / m).min(), s.mean() * 252 / abs(((c - m) / m).min())))


@pytest.mark.parametrize("few, width", [(10_000, 4096), (1, 4), (3, 2)])
def test_quantiles_match_numpy(spark, monkeypatch, few, width):
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "WIDTH", width)
    g = np.random.default_rng(4)
    values = {"a": g.normal(0, 1, 301), "b": np.repeat([1.5, -2.0, 0.0], 50), "c": 10.0 ** g.uniform(-300, 300, 40) * g.choice([-1, 1], 40), "d": [7.0], None: [1.0, 1.0 + 2**-52, 1.0 + 2**-51, 3.0]}
    rows = [(k, float(x), i % 3 * 1.0) for k, xs in values.items() for i, x in enumerate(xs)] + [("e", None, None), ("a", None, 2.0)]
    qs = [0.0, 0.05, 0.25, 0.5, 0.77, 1.0]
    df = spark.createDataFrame(rows, "key string, x double, y double")
    got = {r["key"]: (r["x"], r["y"]) for r in selection.quantiles(df, ["key"], ["x", "y"], qs).collect()}
    assert set(got) == {*values, "e"} and got["e"] == (None, None)
    for k in values:
        for have, i in zip(got[k], (1, 2), strict=True):
            assert np.allclose(have, np.quantile([r[i] for r in rows if r[0] == k and r[i] is not None], qs), rtol=1e-12, atol=0)
    one = selection.quantiles(df, [], ["x"], [0.5]).collect()
    assert len(one) == 1 and np.isclose(one[0]["x"][0], np.median([r[1] for r in rows if r[1] is not None]))
    assert selection.quantiles(df.limit(0), [], ["x"], [0.5]).collect()[0]["x"] is None and selection.quantiles(df.limit(0), ["key"], ["x"], [0.5]).count() == 0


def test_magnitudes_never_fall():
    g = np.random.default_rng(2)
    x = np.sort(np.concatenate([10.0 ** g.uniform(-320, 308, 3000), -(10.0 ** g.uniform(-320, 308, 3000)), [0.0, 5e-324, -5e-324, 1.7e308]]))
    with np.errstate(divide="ignore"):
        m = np.sign(x) * np.where(x == 0, 0, np.floor(4 * np.log2(np.abs(x))) + 4400)
    assert (np.diff(m) >= 0).all() and len(np.unique(m)) < 20_000


@pytest.mark.parametrize("block", [4096, 3])
def test_events_carry_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(calendar, "BLOCK", block)
    start = dt.date(1969, 12, 1)
    days = [start + dt.timedelta(i) for i in range(90)]
    events = [start + dt.timedelta(i) for i in (0, 4, 5, 30, 31, 60, 95)]
    got = calendar.distance_to_events(spark.createDataFrame([(d,) for d in days], "date date"), spark.createDataFrame([(d,) for d in events], "date date"), "ahead", "behind", none=999)
    assert sorted(tuple(r) for r in got.collect()) == [(d, min([(e - d).days for e in events if e > d], default=999), min([(d - e).days for e in events if e < d], default=999)) for d in days]
