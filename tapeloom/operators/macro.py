"""Macro series (long: date, indicator, value) and news sentiment."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import flag, last_rows, rolling, series

# How often each indicator appears.
FREQUENCY = {
    "gdp": "quarterly", "real_gdp_per_capita": "quarterly", "cpi": "monthly", "inflation": "monthly", "retail_sales": "monthly", "durables": "monthly", "unemployment_rate": "monthly", "nonfarm_payroll": "monthly",
    "federal_funds_rate": "monthly", "consumer_confidence": "monthly", "treasury_3m": "daily", "treasury_2y": "daily", "treasury_10y": "daily", "treasury_30y": "daily", "wti_oil": "daily", "brent_oil": "daily",
}
PERIODS = {"monthly": 12, "quarterly": 4}
EXPECTED_DAYS = {"daily": 1, "monthly": 30, "quarterly": 90}


def frequency(indicator):
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in FREQUENCY.items() for x in kv]), indicator), F.lit("monthly"))


def normalise(df: DataFrame, indicator: str) -> DataFrame:
    return df.select(F.to_date("date").alias("date"), F.col("value").cast("double").alias("value"), F.lit(indicator).alias("indicator"))


def derive(long: DataFrame) -> DataFrame:
    """Year on year, moving averages, trend and z-score of each series; short series get nulls."""
    w, all_rows = series("indicator"), Window.partitionBy("indicator")
    x, n, f = F.col("value"), F.count("*").over(all_rows), frequency(F.col("indicator"))
    back = F.when(f == "monthly", F.lag(x, 12).over(w)).when(f == "quarterly", F.lag(x, 4).over(w))
    ma3, ma12 = F.when(n > 3, rolling(F.avg, x, w, 3)), F.when(n > 12, rolling(F.avg, x, w, 12))
    return long.withColumns({
        "yoy_change": (F.try_divide(x, back) - 1) * 100, "yoy_diff": x - back, "ma3": ma3, "ma12": ma12, "trend_up": F.when(n > 3, flag(x > ma3)),
        "zscore": F.when(n > 20, F.try_divide(x - rolling(F.avg, x, w, 20), rolling(F.stddev_samp, x, w, 20))),
    })


def wide(derived: DataFrame, indicators: list[str]) -> DataFrame:
    """One row a day from the first to the last date; values carried on for at most the series' own interval."""
    spread = derived.groupBy("date").pivot("indicator", indicators).agg(F.first("value").alias("value"), F.first("yoy_change").alias("yoy"), F.first("ma3").alias("ma3"), F.first("zscore").alias("zscore"))
    spread = spread.withColumnsRenamed({f"{i}_value": i for i in indicators})
    days = derived.agg(F.sequence(F.min("date"), F.max("date")).alias("d")).select(F.explode("d").alias("date"))
    w = Window.partitionBy(F.lit(0)).orderBy("date")  # one row a day
    return days.join(spread, "date", "left").withColumns({i: F.last(i, True).over(w.rowsBetween(-EXPECTED_DAYS[FREQUENCY.get(i, "monthly")], 0)) for i in indicators})


def composites(daily: DataFrame) -> DataFrame:
    """Economic health: the mean of the z-scores that a row has, where at least two of their columns exist; yield,
    inflation and oil measures where their inputs are."""
    sign = {"gdp": 1, "unemployment_rate": -1, "cpi": 1, "consumer_confidence": 1}
    have = [c for c in sign if c in daily.columns]
    df = daily
    if len(have) >= 2:
        stats = daily.agg(*[f(F.col(c)).alias(f"_{c}_{n}") for c in have for n, f in (("m", F.avg), ("s", F.stddev))])
        z = [sign[c] * F.try_divide(F.col(c) - F.col(f"_{c}_m"), f"_{c}_s") for c in have]
        total, count = sum(F.coalesce(x, F.lit(0.0)) for x in z), sum(x.isNotNull().cast("int") for x in z)
        df = daily.crossJoin(F.broadcast(stats))  # one row of statistics
        df = df.withColumn("economic_health", F.when(count >= 1, total / count)).select(*daily.columns, "economic_health")
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    if {"treasury_10y", "treasury_2y"} <= set(daily.columns):
        df = df.withColumn("yield_curve", F.col("treasury_10y") - F.col("treasury_2y"))
        df = df.withColumns({"yield_inverted": flag(F.col("yield_curve") < 0), "yield_curve_ma30": rolling(F.avg, F.col("yield_curve"), w, 30)})
    if {"cpi", "inflation"} <= set(daily.columns):
        df = df.withColumn("inflation_avg", (F.col("cpi") + F.col("inflation")) / 2)
    if {"wti_oil", "brent_oil"} <= set(daily.columns):
        df = df.withColumns({"oil_avg": (F.col("wti_oil") + F.col("brent_oil")) / 2, "oil_spread": F.col("brent_oil") - F.col("wti_oil")})
    if {"gdp", "retail_sales"} <= set(daily.columns):
        df = df.withColumn("growth_proxy", (F.col("gdp") + F.col("retail_sales")) / 2)
    return df


def latest(long: DataFrame, as_of, days: int = 90) -> DataFrame:
    recent = long.filter(F.col("date").between(F.date_sub(F.lit(as_of).cast("date"), days), F.lit(as_of).cast("date")))
    return recent.groupBy("indicator").agg(F.max("date").alias("date"), F.max_by("value", "date").alias("value"))


def freshness(long: DataFrame, as_of) -> DataFrame:
    """Age of each series; due when older than one and a half of its intervals."""
    f = frequency(F.col("indicator"))
    expected = F.element_at(F.create_map(*[F.lit(x) for kv in EXPECTED_DAYS.items() for x in kv]), F.col("frequency"))
    g = long.groupBy("indicator").agg(F.max("date").alias("latest_date")).withColumn("frequency", f)
    return g.withColumn("days_old", F.datediff(F.lit(as_of).cast("date"), "latest_date")).withColumn("needs_update", F.col("days_old") > 1.5 * expected)


def to_update(long: DataFrame, as_of) -> DataFrame:
    return freshness(long, as_of).filter("needs_update").select("indicator")


# --- news sentiment ---

# Upper bounds of the right-closed bins above -1, with ordinal and name.
CATEGORIES = ((-0.35, 0, "very_negative"), (-0.15, 1, "negative"), (0.15, 2, "neutral"), (0.35, 3, "positive"), (1.0, 4, "very_positive"))


def categorise(df: DataFrame, score: str = "overall_sentiment_score") -> DataFrame:
    """Ordinal and name of the bin; exactly -1, and all outside, is null."""
    x = F.col(score)
    ordinal, name = F.when(x <= -1, None), F.when(x <= -1, None)
    for top, i, label in CATEGORIES:
        ordinal, name = ordinal.when(x <= top, i), name.when(x <= top, label)
    return df.withColumns({"category_rank": ordinal, "sentiment_category": name})


def normalise_news(raw: DataFrame, ingested) -> DataFrame:
    """Standard columns; missing scores are 0. The ingestion time is a parameter."""
    scores = {c: 0.0 for c in raw.columns if c.endswith("score")}
    return raw.fillna(scores).withColumns({"date": F.to_date("timestamp"), "ingestion_timestamp": F.lit(ingested).cast("timestamp")})


def lookback(df: DataFrame, as_of, days: int, time: str = "timestamp") -> DataFrame:
    return df.filter(F.col(time) >= F.date_sub(F.lit(as_of).cast("date"), days))


def daily_sentiment(news: DataFrame, score: str = "overall_sentiment_score") -> DataFrame:
    """Mean, deviation, count and most frequent category (ties: the lowest) by symbol and day; strength and trend."""
    c = categorise(news.withColumn("date", F.to_date("timestamp")), score)
    names = F.array(*[F.lit(n) for _, _, n in CATEGORIES])
    g = c.groupBy("symbol", "date").agg(F.avg(score).alias("sentiment_mean"), F.stddev(score).alias("sentiment_std"), F.count(score).alias("article_count"), F.mode("category_rank", True).alias("_rank"))
    w = series("symbol")
    three = last_rows(w, 3)
    g = g.withColumn("dominant_category", F.try_element_at(names, F.col("_rank") + 1)).drop("_rank")
    return g.withColumns({"sentiment_strength": F.abs("sentiment_mean"), "sentiment_trend": F.col("sentiment_mean") - F.first("sentiment_mean").over(three)})


def bias(x, edge=0.1):
    return F.when(x > edge, "bullish").when(x < -edge, "bearish").otherwise("neutral")


def mean_bias(score: str):
    """Bias of the mean score, an aggregate. A mean at 0.1 is neutral in whatever order rows are added: sums are of
    decimals of 18 places, against a tenth of the count. A symbol with scores that aren't such decimals (not finite,
    1e10 or more) goes by its mean in doubles."""
    exact = F.col(score).try_cast("decimal(28,18)")
    tenths = (F.count(score) * F.lit(Decimal("0.1"))).cast("decimal(38,18)")
    return F.when(F.count(exact) == F.count(score), bias(F.sum(exact), tenths)).otherwise(bias(F.avg(score)))


def sentiment_summary(news: DataFrame, score: str = "overall_sentiment_score") -> DataFrame:
    g = news.groupBy("symbol").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.count("*").alias("articles"), F.avg(score).alias("mean"), F.stddev(score).alias("std"), F.min(score).alias("lowest"), F.max(score).alias("highest"), mean_bias(score).alias("bias"))
    return g.withColumn("days", F.datediff("last", "first")).select(*[c for c in g.columns if c != "bias"], "days", "bias")


def bias_distribution(summary: DataFrame) -> DataFrame:
    g = summary.groupBy("bias").agg(F.count("*").alias("n"))
    return g.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))  # three rows


def top_sentiment(summary: DataFrame, k: int = 10) -> DataFrame:
    """Most bullish, bearish and volatile symbols: kind, rank, symbol, value."""
    out = None
    for kind, col, order in (("bullish", "mean", F.desc("mean")), ("bearish", "mean", F.asc("mean")), ("volatile", "std", F.desc("std"))):
        top = summary.orderBy(order, "symbol").limit(k)
        one = top.select(F.lit(kind).alias("kind"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order, "symbol")).alias("rank"), "symbol", F.col(col).alias("value"))  # k rows
        out = one if out is None else out.unionByName(one)
    return out


def trends(daily: DataFrame, as_of, days: int = 7, k: int = 5) -> DataFrame:
    """Symbols with the highest and lowest last trend of the recent days."""
    recent = daily.filter(F.col("date").between(F.date_sub(F.lit(as_of).cast("date"), days), F.lit(as_of).cast("date")))
    g = recent.groupBy("symbol").agg(F.avg("sentiment_mean").alias("mean_score"), F.max_by("sentiment_trend", "date").alias("last_trend"))
    return g.orderBy(F.desc("last_trend"), "symbol").limit(k).withColumn("side", F.lit("top")).unionByName(g.orderBy("last_trend", "symbol").limit(k).withColumn("side", F.lit("bottom")))
