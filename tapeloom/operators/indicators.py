"""Technical indicators per ticker. Window indicators share one sort; recursions run over segments of series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import change, corr_over, flag, rolling, series
from tapeloom.operators.recurrences import Periods, recursive


def sma(bars: DataFrame, periods: Sequence[int] = (20, 50, 200), time: str = "date", suffix: str = "") -> DataFrame:
    """Rolling means; crosses of the second and third period once both are there."""
    w = series("ticker", time)
    names = [f"sma_{n}{suffix}" for n in periods]
    df = bars.withColumns({c: rolling(F.avg, F.col("close"), w, n) for c, n in zip(names, periods, strict=True)})
    df = df.withColumns({f"close_to_{c}": F.try_divide("close", c) - 1 for c in names})
    if len(periods) < 3:
        return df
    fast, slow = F.col(names[1]), F.col(names[2])
    up, before = fast > slow, F.lag(fast > slow).over(w)
    return df.withColumns({"golden_cross": flag(up & ~before), "death_cross": flag(~up & before)})


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0, time: str = "date") -> DataFrame:
    """Bands of k population deviations; width and position in them; squeeze against the mean width."""
    w = series("ticker", time)
    x = F.col("close")
    df = bars.withColumns({"bb_middle": rolling(F.avg, x, w, n), "_sd": rolling(F.stddev_pop, x, w, n)})
    df = df.withColumns({"bb_upper": F.col("bb_middle") + k * F.col("_sd"), "bb_lower": F.col("bb_middle") - k * F.col("_sd")}).drop("_sd")
    df = df.withColumns({"bb_width": F.try_divide(F.col("bb_upper") - F.col("bb_lower"), "bb_middle") * 100, "bb_percent": F.try_divide(x - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower"))})
    return df.withColumns({"bb_squeeze": flag(F.col("bb_width") < rolling(F.avg, F.col("bb_width"), w, n)), "bb_overbought": flag(x > F.col("bb_upper")), "bb_oversold": flag(x < F.col("bb_lower"))})


def vwap(bars: DataFrame, time: str = "date") -> DataFrame:
    """Volume-weighted typical price so far, starting anew each date, and the deviation of the close."""
    w = series(["ticker", "date"], time).rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    df = bars.withColumn("vwap", F.try_divide(F.sum(typical * F.col("volume")).over(w), F.sum("volume").over(w)))
    return df.withColumn("vwap_deviation", F.try_divide(F.col("close") - F.col("vwap"), "vwap") * 100)


def price_features(bars: DataFrame, time: str = "date") -> DataFrame:
    w = series("ticker", time)
    x = F.col("close")
    df = bars.withColumns({f"return_{n}": change(x, w, n) for n in (1, 5, 20)} | {
        "high_low_ratio": F.try_divide("high", "low"), "close_to_high": F.try_divide("close", "high"), "close_to_low": F.try_divide("close", "low"),
        "high_20": rolling(F.max, F.col("high"), w, 20), "low_20": rolling(F.min, F.col("low"), w, 20),
        "momentum_10": x - F.lag(x, 10).over(w), "momentum_30": x - F.lag(x, 30).over(w),
    })
    return df.withColumns({"price_position": F.try_divide(x - F.col("low_20"), F.col("high_20") - F.col("low_20"))} | {f"volatility_{n}": rolling(F.stddev_samp, F.col("return_1"), w, n) for n in (20, 60)})


def volume_features(bars: DataFrame, time: str = "date") -> DataFrame:
    w = series("ticker", time)
    v = F.col("volume").cast("double")
    df = bars.withColumns({"volume_change": change(v, w), "volume_ma_10": rolling(F.avg, v, w, 10), "volume_ma_20": rolling(F.avg, v, w, 20), "_sd": rolling(F.stddev_samp, v, w, 20), "_ret": change(F.col("close"), w)})
    df = df.withColumns({"volume_ratio": F.try_divide(v, "volume_ma_20"), "price_volume_corr": corr_over(F.col("_ret"), F.col("volume_change"), w, 20), "volume_spike": flag(v > F.col("volume_ma_20") + 2 * F.col("_sd"))})
    return df.drop("_sd", "_ret")


def lag_features(df: DataFrame, columns: Sequence[str], lags=(1, 5, 10, 20), windows=(5, 10, 20), diffs=(1, 5), time: str = "date") -> DataFrame:
    """Lags, rolling means and deviations, and differences of each column, all from one sort."""
    w = series("ticker", time)
    new = {}
    for c in columns:
        x = F.col(c)
        new |= {f"{c}_lag_{n}": F.lag(x, n).over(w) for n in lags}
        new |= {f"{c}_mean_{n}": rolling(F.avg, x, w, n) for n in windows} | {f"{c}_std_{n}": rolling(F.stddev_samp, x, w, n) for n in windows}
        new |= {f"{c}_diff_{n}": x - F.lag(x, n).over(w) for n in diffs}
    return df.withColumns(new)


def statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null share, range, mean and deviation of each column: one pass, one row a column."""
    def of(c: str):
        x = F.col(c).cast("double")
        return F.struct(F.lit(c).alias("indicator"), F.count("*").alias("records"), F.count_if(x.isNull()).alias("null_count"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev(x).alias("std"), F.count_if(F.abs(x) == float("inf")).alias("infinite_count"))

    return df.agg(F.array(*map(of, columns)).alias("s")).select(F.inline("s"))


def intraday_position(hourly: DataFrame, open_hour: int = 9, close_hour: int = 16) -> DataFrame:
    """Hour flags and the high and low of the day so far."""
    w = series(["ticker", "date"], "datetime")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    df = hourly.withColumns({
        "hour_of_day": F.hour("datetime"), "is_market_open": flag(F.col("hour").between(open_hour, close_hour - 1)), "is_first_hour": flag(F.row_number().over(w) == 1), "is_last_hour": flag(F.lead("datetime").over(w).isNull()),
        "high_of_day": F.max("high").over(so_far), "low_of_day": F.min("low").over(so_far),
    })
    return df.withColumns({"pct_from_high": F.try_divide(F.col("close") - F.col("high_of_day"), "high_of_day") * 100, "pct_from_low": F.try_divide(F.col("close") - F.col("low_of_day"), "low_of_day") * 100})


def recursive_indicators(bars: DataFrame, time: str = "date", span: str = "year", **periods) -> DataFrame:
    """RSI, EMA, MACD, ATR, ADX and OBV with their flags, from series of any length (see `recurrences`).

    A row without high, low or close has no values and changes none; rows that repeat a ticker and time come back as
    often as they occur.
    """
    p = Periods(**{k: v if isinstance(v, int) else tuple(v) for k, v in periods.items()})
    shape = p.columns()
    df = recursive(bars, time, span, p)
    new = {}
    for c in shape:
        if c.startswith("rsi_"):
            tag = "" if c == "rsi_14" else c[3:]
            new |= {f"rsi_oversold{tag}": flag(F.col(c) < 30), f"rsi_overbought{tag}": flag(F.col(c) > 70)}
        elif c.startswith("ema_"):
            new[f"close_to_{c}"] = F.try_divide("close", c) - 1
        elif c.startswith("atr_"):
            new[f"{c}_percent"] = F.try_divide(c, "close") * 100
    new |= {"adx_strong": flag(F.col("adx") > 25), "adx_weak": flag(F.col("adx") < 20), "obv_trend": flag(F.col("obv") > F.col("obv_ema"))}
    return df.withColumns(new)


# Periods of the hourly parameter set.
HOURLY = {"sma": (20, 140, 350), "ema": (12, 84, 182), "rsi": (14, 98), "macd": (84, 182, 63), "bollinger": (20, 140), "atr": (14, 98)}


def hourly_indicators(hourly: DataFrame) -> DataFrame:
    """The hourly set: names carry the period in hours."""
    df = recursive_indicators(hourly, "datetime", rsi=HOURLY["rsi"], ema=HOURLY["ema"], macd=HOURLY["macd"], atr=HOURLY["atr"])
    df = df.withColumnsRenamed({f"{kind}_{n}": f"{kind}_{n}h" for kind in ("rsi", "ema", "atr") for n in HOURLY[kind]})
    df = sma(df, HOURLY["sma"], "datetime", "h")
    w = series("ticker", "datetime")
    for n in HOURLY["bollinger"]:
        mid, sd = rolling(F.avg, F.col("close"), w, n), rolling(F.stddev_pop, F.col("close"), w, n)
        df = df.withColumns({f"bb_upper_{n}h": mid + 2 * sd, f"bb_middle_{n}h": mid, f"bb_lower_{n}h": mid - 2 * sd})
    return intraday_position(df)


def all_indicators(bars: DataFrame) -> DataFrame:
    """Every daily indicator of every ticker."""
    return volume_features(price_features(vwap(bollinger(sma(recursive_indicators(bars))))))


def refresh(bars: DataFrame, changed: DataFrame, as_of, lookback: int = 200, least: int = 20, keep: int = 5) -> DataFrame:
    """Indicators of the tickers that changed, from their last days; the last rows of each are returned."""
    from tapeloom.operators.bars import enough_history, last_days, last_per_key

    recent = last_days(bars.join(changed.select("ticker").distinct(), "ticker", "left_semi"), as_of, lookback)
    return last_per_key(all_indicators(enough_history(recent, least)), keep)
