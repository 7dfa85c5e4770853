"""Indicators against pandas and worked cases."""

import datetime as dt

import numpy as np
import pandas as pd

from tapeloom.operators import indicators


def frame(spark, n=80, seed=3, tickers=("A", "B")):
    g = np.random.default_rng(seed)
    rows = []
    for t in tickers:
        x = 100 + np.cumsum(g.normal(0, 1, n))
        rows += [(t, dt.date(2024, 1, 1) + dt.timedelta(i), float(x[i]), float(x[i] + 1), float(x[i] - 1), float(x[i] + 0.3), int(g.integers(1, 1000))) for i in range(n)]
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume bigint")


def test_recursions_match_pandas(spark):
    b = frame(spark)
    got = indicators.recursive_indicators(b).toPandas().sort_values(["ticker", "date"])
    for t, g in got.groupby("ticker"):
        close = g["close"].reset_index(drop=True)
        ema = close.ewm(span=20, adjust=False).mean()
        assert np.allclose(g["ema_20"].to_numpy()[19:], ema[19:]) and np.isnan(g["ema_20"].to_numpy()[:19].astype(float)).all()
        d = close.diff()
        up, down = d.clip(lower=0).to_numpy(), (-d).clip(lower=0).to_numpy()
        u, w = up[1:15].mean(), down[1:15].mean()
        for i in range(15, len(close)):
            u, w = u + (up[i] - u) / 14, w + (down[i] - w) / 14
        assert np.isclose(g["rsi_14"].iloc[-1], 100 * u / (u + w))
        obv = (np.sign(d.fillna(0)) * g["volume"].reset_index(drop=True)).cumsum()
        assert np.allclose(g["obv_ema"].astype(float), obv.ewm(span=20).mean())
        assert g["rsi_14"].dropna().between(0, 100).all() and g["adx"].dropna().between(0, 100).all()


def test_bands_are_ordered_and_rolling_needs_all_rows(spark):
    b = indicators.bollinger(frame(spark)).toPandas()
    x = b.dropna(subset=["bb_middle"])
    assert len(x) == 2 * 61 and (x["bb_lower"] <= x["bb_middle"]).all() and (x["bb_middle"] <= x["bb_upper"]).all()


def test_crosses_exist_in_default_order(spark):
    n = 300
    x = np.concatenate([np.linspace(200, 100, 150), np.linspace(100, 300, 150)])
    rows = [("A", dt.date(2023, 1, 1) + dt.timedelta(i), float(x[i]), float(x[i]), float(x[i]), float(x[i]), 1) for i in range(n)]
    s = indicators.sma(spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume bigint")).toPandas()
    assert s["golden_cross"].sum() == 1


def test_short_and_constant_series(spark):
    rows = [("A", dt.date(2024, 1, i), 5.0, 5.0, 5.0, 5.0, 0) for i in range(1, 31)] + [("B", dt.date(2024, 1, 1), 1.0, 1.0, 1.0, 1.0, 1)]
    b = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume bigint")
    got = indicators.all_indicators(b).toPandas()
    assert len(got) == 31 and not np.isinf(got.select_dtypes("number").to_numpy(float)).any()


def test_lag_features_and_statistics(spark):
    b = frame(spark, 30)
    assert {"close_lag_20", "close_mean_10", "close_std_5", "close_diff_5"} <= set(indicators.lag_features(b, ["close"]).columns)
    s = indicators.statistics(b, ["close"]).first()
    p = b.toPandas()["close"]
    assert s["records"] == 60 and np.isclose(s["std"], p.std())


def test_hourly_set_has_named_columns(spark):
    rows = [("A", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), (dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)).date(), i % 24, 1.0 + i % 7, 2.0 + i % 7, 0.5, 1.5 + i % 5, 10) for i in range(60)]
    h = spark.createDataFrame(rows, "ticker string, datetime timestamp_ntz, date date, hour int, open double, high double, low double, close double, volume bigint")
    got = indicators.hourly_indicators(h)
    assert {"rsi_14h", "rsi_98h", "ema_12h", "atr_98h", "sma_140h", "bb_upper_20h", "pct_from_high"} <= set(got.columns) and got.count() == 60


def test_refresh_returns_last_rows(spark):
    b = frame(spark, 60)
    got = indicators.refresh(b, b.filter("ticker = 'A'"), dt.date(2024, 3, 1), keep=5).toPandas()
    assert isinstance(got, pd.DataFrame) and len(got) == 5 and set(got["ticker"]) == {"A"}
