"""Bars, normalisation, validation and payloads on small frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import bars, quality
from tapeloom.sources import payloads

DAY = "ticker string, date date, open double, high double, low double, close double, volume bigint"


def valid(spark, n=10):
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(i), 100.0 + i, 101.0 + i, 99.0 + i, 100.5 + i, 1000) for i in range(n)]
    return spark.createDataFrame(rows, DAY)


def test_valid_bars_have_no_issue(spark):
    assert quality.validate_bars(valid(spark)).count() == 0


def test_invalid_bars_are_reported(spark):
    rows = [("A", dt.date(2024, 1, 1 + i), 100.0, 103.0 if i == 2 else 106.0, 105.0 if i == 2 else 99.0, 102.0, v) for i, v in enumerate((1000, -1000, 0, 10, 10))]
    found = {r["check"] for r in quality.validate_bars(spark.createDataFrame(rows, DAY)).collect()}
    assert "price: high_below_low" in found and "volume" in found


def test_missing_column_and_types(spark):
    assert [tuple(r) for r in quality.validate_bars(valid(spark).drop("close")).collect()] == [("missing_column", "close")]
    assert quality.type_issues(valid(spark).withColumn("open", F.lit("x"))) == ["open: string"]


def test_daily_payload_is_parsed_in_order_and_errors_give_nothing(spark):
    text = '{"Meta Data": {"2. Symbol": "X"}, "Time Series (Daily)": {"2024-01-15": {"1. open": "150", "4. close": "151.50", "6. volume": "45000000"}, "2024-01-12": {"1. open": "bad", "4. close": "150.00"}}}'
    raw = spark.createDataFrame([("X", text), ("Y", '{"Error Message": "no"}'), ("Z", "not json"), ("W", None)], "ticker string, value string")
    got = payloads.daily(raw).select("ticker", "date", "open", "close", "volume").collect()
    assert [tuple(r) for r in got] == [("X", dt.date(2024, 1, 12), None, 150.0, None), ("X", dt.date(2024, 1, 15), 150.0, 151.5, 45000000)]


def test_news_keeps_own_articles(spark):
    feed = '{"feed": [{"title": "about X", "time_published": "20240102T030405", "source": "w", "overall_sentiment_score": 0.2, "ticker_sentiment": []}, {"title": "other", "time_published": "20240102T030405", "source": "w", "overall_sentiment_score": 0.1, "ticker_sentiment": [{"ticker": "X", "relevance_score": "0.9", "ticker_sentiment_score": "-0.3"}]}, {"title": "none", "ticker_sentiment": [{"ticker": "Q"}]}]}'
    got = payloads.news(spark.createDataFrame([("X", feed)], "ticker string, value string")).collect()
    assert sorted((r["title"], r["ticker_sentiment_score"]) for r in got) == [("about X", None), ("other", -0.3)]


def test_sector_and_economic_payloads(spark):
    s = payloads.sector_performance(spark.createDataFrame([('{"Meta Data": {"a": "b"}, "Rank A": {"Energy": "1.2%", "Tech": "-3%"}}',)], "value string"))
    assert {r["sector"]: round(r["performance"], 6) for r in s.collect()} == {"Energy": 0.012, "Tech": -0.03}
    e = payloads.economic(spark.createDataFrame([('{"name": "gdp", "data": [{"date": "2024-02-01", "value": "."}, {"date": "2024-01-01", "value": "3.5"}]}',)], "value string"), "gdp")
    assert [tuple(r) for r in e.collect()] == [(dt.date(2024, 1, 1), 3.5, "gdp"), (dt.date(2024, 2, 1), None, "gdp")]


def test_hourly_needs_six_hours(spark):
    rows = [("A", dt.datetime(2024, 1, d, h), dt.date(2024, 1, d), h, 1.0 + h, 2.0 + h, 0.5 + h, 1.5 + h, 10, 1.5 + h) for d, hs in ((1, range(9, 16)), (2, range(9, 14)), (3, range(0, 24))) for h in hs]
    h = spark.createDataFrame(rows, "ticker string, datetime timestamp_ntz, date date, hour int, open double, high double, low double, close double, volume bigint, adjusted_close double")
    got = {r["date"].day: r for r in bars.hourly_to_daily(h).collect()}
    assert set(got) == {1, 3} and got[1]["open"] == 10.0 and got[1]["close"] == 16.5 and got[3]["hours"] == 7


def test_missing_business_days(spark):
    b = spark.createDataFrame([("A", dt.date(2024, 1, 1)), ("A", dt.date(2024, 1, 3))], "ticker string, date date")
    assert [r["date"].day for r in bars.missing_business_days(b, "2024-01-01", "2024-01-07").orderBy("date").collect()] == [2, 4, 5]


def test_outlier_rule_cannot_fire_on_its_own_window(spark):
    b = valid(spark, 40).withColumn("close", F.when(F.dayofyear("date") == 30, 9999.0).otherwise(F.col("close")))
    assert quality.price_outliers(b).count() == 0
    assert quality.price_outliers(b, include_self=False).count() == 1


@pytest.mark.parametrize("empty", [True, False])
def test_empty_tables(spark, empty):
    b = valid(spark, 0 if empty else 3)
    assert bars.quality_per_ticker(b).count() == (0 if empty else 1)
    assert quality.volume_validity(b).first()["valid"]


def test_violations_ignore_null_results(spark):
    b = spark.createDataFrame([(1.0,), (None,), (-1.0,)], "close double")
    assert bars.violations(b, {"positive": "close > 0"}).first()["broken"] == 1
