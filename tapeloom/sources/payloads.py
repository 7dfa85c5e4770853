"""Parsing of landed vendor payloads: frames with a JSON text column `value` (and `ticker`) to rows.

A payload with an error message, or without its data key, gives no rows. Bad numbers become null. The rows of a
payload come in the order of time; payloads come as they are, as what follows deals them out by its own keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SERIES = "map<string,map<string,string>>"


def _series(raw: DataFrame, key: str) -> DataFrame:
    """One row a point of time of the nested map under `key`, in the order of time."""
    # the key holds blanks and brackets, so the payload is read as a map of texts first
    top = F.from_json("value", "map<string,string>")
    found = raw.withColumn("_s", F.from_json(F.try_element_at(top, F.lit(key)), SERIES))
    points = found.select("ticker", "_s", F.explode(F.array_sort(F.map_keys("_s"))).alias("at"))
    return points.select("ticker", "at", F.element_at("_s", F.col("at")).alias("x"))


def _number(field: str, kind: str = "double") -> Column:
    return F.try_element_at(F.col("x"), F.lit(field)).try_cast(kind)


def daily(raw: DataFrame) -> DataFrame:
    s = _series(raw, "Time Series (Daily)")
    return s.select(
        "ticker", F.col("at").try_cast("date").alias("date"), _number("1. open").alias("open"), _number("2. high").alias("high"), _number("3. low").alias("low"), _number("4. close").alias("close"), _number("5. adjusted close").alias("adjusted_close"),
        _number("6. volume", "bigint").alias("volume"), _number("7. dividend amount").alias("dividend_amount"), _number("8. split coefficient").alias("split_coefficient"),
    )


def intraday(raw: DataFrame, interval: str = "60min") -> DataFrame:
    s = _series(raw, f"Time Series ({interval})")
    return s.select("ticker", F.col("at").try_cast("timestamp_ntz").alias("datetime"), _number("1. open").alias("open"), _number("2. high").alias("high"), _number("3. low").alias("low"), _number("4. close").alias("close"), _number("5. volume", "bigint").alias("volume"))


def hourly(raw: DataFrame) -> DataFrame:
    """Hours with date and hour; the adjusted close is the close."""
    d = F.col("datetime")
    return intraday(raw, "60min").withColumns({"date": F.to_date(d), "hour": F.hour(d), "adjusted_close": F.col("close")})


def economic(raw: DataFrame, indicator: str) -> DataFrame:
    """Points of the `data` array: the first field that isn't the date is the value."""
    data = F.from_json(F.try_element_at(F.from_json("value", "map<string,string>"), F.lit("data")), "array<map<string,string>>")
    value = lambda x: F.try_element_at(F.map_values(F.map_filter(x, lambda k, v: k != "date")), F.lit(1))
    point = lambda x: F.struct(F.try_element_at(x, F.lit("date")).try_cast("date").alias("date"), value(x).try_cast("double").alias("value"))
    return raw.select(F.inline(F.array_sort(F.transform(data, point)))).withColumn("indicator", F.lit(indicator))


FEED = "struct<feed:array<struct<title:string,time_published:string,source:string,overall_sentiment_score:double,ticker_sentiment:array<struct<ticker:string,relevance_score:string,ticker_sentiment_score:string>>>>>"


def news(raw: DataFrame) -> DataFrame:
    """Articles that mention the ticker in their scores or their title."""
    a = raw.select("ticker", F.explode(F.from_json("value", FEED)["feed"]).alias("a"))
    own = F.try_element_at(F.filter("a.ticker_sentiment", lambda s: s["ticker"] == F.col("ticker")), F.lit(1))
    out = a.select("ticker", F.try_to_timestamp("a.time_published", F.lit("yyyyMMdd'T'HHmmss")).cast("timestamp_ntz").alias("timestamp"), F.col("a.title").alias("title"), F.col("a.source").alias("source"), "a.overall_sentiment_score", own.alias("own"))
    out = out.filter(F.col("own").isNotNull() | F.col("title").contains(F.col("ticker")))
    return out.select(F.col("ticker").alias("symbol"), "timestamp", "title", "source", "overall_sentiment_score", F.col("own.relevance_score").try_cast("double").alias("relevance_score"), F.col("own.ticker_sentiment_score").try_cast("double").alias("ticker_sentiment_score"))


def sector_performance(raw: DataFrame) -> DataFrame:
    """Ranks of sectors with shares from text such as 1.2%: period, sector, performance."""
    top = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("period", "x")).filter(F.col("period") != "Meta Data")
    s = top.select("period", F.explode(F.from_json("x", "map<string,string>")).alias("sector", "t"))
    return s.select("period", "sector", (F.regexp_replace("t", "%", "").try_cast("double") / 100).alias("performance"))
