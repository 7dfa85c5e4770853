"""Price bars: building, normalising, rolling up hours to days, coverage and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import series
from tapeloom.operators.selection import quantiles

PRICES = ("open", "high", "low", "close")


def ticks_to_bars(ticks: DataFrame, keys: list, order: list[str]) -> DataFrame:
    """Open, high, low, close and volume of prices per key; first and last by the order columns."""
    at = F.struct(*order)
    return ticks.groupBy(*keys).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").alias("volume")
    )


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in the given order, which should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def normalise_daily(raw: DataFrame, arrival: str, date_col: str = "date") -> DataFrame:
    """Dates from text, numbers from text (bad ones become null), one row a (ticker, date): the last to arrive."""
    number = {c: F.expr(f"try_cast({c} AS double)") for c in (*PRICES, "adjusted_close") if c in raw.columns}
    df = raw.withColumns(number | {"date": F.expr(f"try_cast({date_col} AS date)"), "volume": F.expr("try_cast(volume AS bigint)")})
    return keep_one(df, ["ticker", "date"], [F.col(arrival).desc()])


def normalise_hourly(raw: DataFrame, arrival: str) -> DataFrame:
    """As daily, keyed by (ticker, datetime), with date and hour derived."""
    number = {c: F.expr(f"try_cast({c} AS double)") for c in (*PRICES, "adjusted_close") if c in raw.columns}
    df = raw.withColumns(number | {"datetime": F.expr("try_cast(datetime AS timestamp_ntz)"), "volume": F.expr("try_cast(volume AS bigint)")})
    df = df.withColumns({"date": F.to_date("datetime"), "hour": F.hour("datetime")})
    return keep_one(df, ["ticker", "datetime"], [F.col(arrival).desc()])


# Column names of a vendor payload and their standard names.
VENDOR_COLUMNS = {
    "1. open": "open", "2. high": "high", "3. low": "low", "4. close": "close", "5. adjusted close": "adjusted_close", "5. volume": "volume", "6. volume": "volume",
    "7. dividend amount": "dividend_amount", "8. split coefficient": "split_coefficient",
}
FILE_COLUMNS = ("symbol", "timestamp", "open", "high", "low", "close", "adjusted_close", "volume", "dividend_amount", "split_coefficient", "year", "month")


def map_columns(raw: DataFrame, symbol: str | None = None) -> DataFrame:
    """Standard names and order with year and month for partitioning; absent columns become null."""
    df = raw.withColumnsRenamed({k: v for k, v in VENDOR_COLUMNS.items() if k in raw.columns})
    df = df.withColumn("symbol", F.lit(symbol)) if symbol else df
    df = df.withColumns({"year": F.year("timestamp"), "month": F.month("timestamp")})
    absent = {c: F.lit(None).cast("double") for c in FILE_COLUMNS if c not in df.columns}
    return df.withColumns(absent).select(*FILE_COLUMNS)


def concat_months(pieces: list[DataFrame], keys: list[str], arrival: str) -> DataFrame:
    """Union of pieces, one row a key: the first to arrive."""
    df = pieces[0]
    for p in pieces[1:]:
        df = df.unionByName(p, allowMissingColumns=True)
    return keep_one(df, keys, [F.col(arrival)])


def hourly_to_daily(hourly: DataFrame, first_hour: int = 9, last_hour: int = 15, least_hours: int = 6) -> DataFrame:
    """Daily bars of trading hours; days with fewer hours are left out. One aggregate, no windows."""
    day = hourly.filter(F.col("hour").between(first_hour, last_hour)).groupBy("ticker", "date")
    out = day.agg(
        F.min_by("open", "datetime").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "datetime").alias("close"),
        F.sum("volume").alias("volume"), F.max_by("adjusted_close", "datetime").alias("adjusted_close"), F.count("*").alias("hours"),
    )
    return out.filter(F.col("hours") >= least_hours)


def hourly_coverage(hourly: DataFrame, first_hour: int = 9, last_hour: int = 15) -> DataFrame:
    regular = F.col("hour").between(first_hour, last_hour)
    return hourly.groupBy("ticker").agg(
        F.countDistinct("date").alias("days"), F.countDistinct("hour").alias("hours"), F.count("*").alias("records"), F.avg("volume").alias("avg_volume"),
        F.min("datetime").alias("first_bar"), F.max("datetime").alias("last_bar"), F.count_if(regular).alias("regular_hours"), F.count_if(~regular).alias("extended_hours"),
    )


def quality_per_ticker(bars: DataFrame) -> DataFrame:
    """Counts, range and dispersion of each ticker in one pass."""
    return bars.groupBy("ticker").agg(
        F.count("*").alias("total_records"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.countDistinct("date").alias("unique_dates"),
        F.count_if(F.col("close").isNull()).alias("null_close"), F.count_if(F.col("volume").isNull()).alias("null_volume"), F.count_if(F.col("volume") == 0).alias("zero_volume"),
        (F.try_divide(F.avg(F.col("high") - F.col("low")), F.avg("close")) * 100).alias("avg_range_pct"), (F.try_divide(F.stddev("close"), F.avg("close")) * 100).alias("price_cv_pct"),
    )


def high_water(df: DataFrame, time: str, key: str | None = None) -> DataFrame:
    """Latest time, of all rows or per key."""
    return (df.groupBy(key) if key else df).agg(F.max(time).alias("latest"))


def newer_than_mark(incoming: DataFrame, stored: DataFrame, key: str, time: str) -> DataFrame:
    """Rows later than the latest stored row of their key; keys without stored rows pass whole."""
    mark = high_water(stored, time, key)
    return incoming.join(mark, key, "left").filter(F.col("latest").isNull() | (F.col(time) > F.col("latest"))).drop("latest")


def between_dates(df: DataFrame, start, end, col: str = "date") -> DataFrame:
    return df.filter(F.col(col).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def last_days(df: DataFrame, as_of, days: int, col: str = "date") -> DataFrame:
    """Rows not older than `days` before the as-of date, which is a parameter and not the clock."""
    return df.filter(F.col(col) >= F.date_sub(F.lit(as_of).cast("date"), days))


def of_tickers(df: DataFrame, tickers: list[str], col: str = "ticker") -> DataFrame:
    return df.filter(F.col(col).isin(tickers))


def of_group(df: DataFrame, metadata: DataFrame, sector: str | None) -> DataFrame:
    """Rows of the tickers of one group, or of all known ones. The metadata table has one row an instrument."""
    m = metadata.filter(F.col("sector") == sector) if sector else metadata
    return df.join(m.select("ticker"), "ticker", "left_semi")


def at_latest(df: DataFrame, col: str) -> DataFrame:
    """Rows at the greatest value of a column, by a scalar aggregate."""
    top = df.agg(F.max(col).alias("_top"))
    return df.join(F.broadcast(top), F.col(col) == F.col("_top"), "left_semi")  # one row


def enough_history(df: DataFrame, least: int, key: str = "ticker") -> DataFrame:
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(key))).filter(F.col("_n") >= least).drop("_n")


def violations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Rows that break each rule, counted in one pass: rule, broken. A rule that gives null isn't broken."""
    counts = df.agg(*[F.count_if(F.expr(f"NOT ({sql})")).alias(name) for name, sql in rules.items()])
    return counts.unpivot([], list(rules), "rule", "broken")


def last_per_key(df: DataFrame, n: int, key: str = "ticker", time: str = "date") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(time).desc())
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def symbol_summary(df: DataFrame, symbol: str = "ticker", time: str = "date") -> DataFrame:
    return df.groupBy(symbol).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("records")).withColumn("days", F.datediff("last", "first"))


def overall_summary(per_symbol: DataFrame) -> DataFrame:
    return per_symbol.agg(F.count("*").alias("symbols"), F.sum("records").alias("records"), F.min("first").alias("first"), F.max("last").alias("last"))


def table_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Distinct tickers and dates, range and count of each table, as one union."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("table_name"), F.countDistinct("ticker").alias("tickers"), F.countDistinct("date").alias("dates"), F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("records"))
        out = one if out is None else out.unionByName(one)
    return out


def coverage_by_month(df: DataFrame) -> DataFrame:
    """Bars of each ticker and month, long; pivot by month for a matrix."""
    return df.groupBy("ticker", F.trunc("date", "month").alias("month")).agg(F.count("*").alias("bars"))


def price_statistics(df: DataFrame) -> DataFrame:
    return df.filter("close > 0").agg(F.avg("close").alias("avg_close"), F.min("close").alias("min_close"), F.max("close").alias("max_close"), F.stddev("close").alias("std_close"), F.avg("volume").alias("avg_volume"), F.max("volume").alias("max_volume"))


def missing_business_days(bars: DataFrame, start, end) -> DataFrame:
    """Weekdays of the range on which a ticker has no bar, for all tickers at once."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    expected = bars.select("ticker").distinct().withColumn("date", F.explode(days)).filter(F.weekday("date") < 5)
    return expected.join(bars.select("ticker", "date"), ["ticker", "date"], "left_anti")


def sector_returns(bars: DataFrame, metadata: DataFrame) -> DataFrame:
    """Annualised return and volatility of each sector from daily returns of its tickers."""
    w = series()
    daily = bars.withColumn("ret", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1).join(metadata.select("ticker", "sector"), "ticker")
    g = daily.groupBy("sector").agg((F.avg("ret") * 252).alias("annual_return"), (F.stddev("ret") * F.sqrt(F.lit(252.0))).alias("annual_volatility"), F.countDistinct("ticker").alias("tickers"))
    return g.withColumn("sharpe", F.try_divide("annual_return", "annual_volatility"))


def sector_risk(bars: DataFrame, metadata: DataFrame, exact: bool = True) -> DataFrame:
    """Volatility, value at risk and extremes of daily returns by sector. Quantiles are exact by distributed selection, or
    come from sketches."""
    w = series()
    daily = bars.withColumn("ret", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1).join(metadata.select("ticker", "sector"), "ticker")
    risks = [F.percentile_approx("ret", q, 10_000).alias(c) for c, q in (("var_95", 0.05), ("var_99", 0.01)) if not exact]
    g = daily.groupBy("sector").agg((F.stddev("ret") * F.sqrt(F.lit(252.0))).alias("volatility"), *risks, F.min("ret").alias("worst_day"), F.max("ret").alias("best_day"))
    if not exact:
        return g
    found = quantiles(daily, ["sector"], ["ret"], [0.05, 0.01]).select(F.col("sector").alias("_s"), F.col("ret")[0].alias("var_95"), F.col("ret")[1].alias("var_99"))
    return g.join(found, F.col("sector").eqNullSafe(F.col("_s"))).select("sector", "volatility", "var_95", "var_99", "worst_day", "best_day")


def return_matrix(bars: DataFrame, tickers: list[str]) -> DataFrame:
    """Closes of the given tickers side by side."""
    return bars.groupBy("date").pivot("ticker", tickers).agg(F.first("close"))
