"""Calendar features on a spine of days. Holidays and events follow rules, so any range of years works."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.functions import corr, flag

CAP = 365
NO_EVENT = 999
BLOCK = 4096  # days


def spine(spark: SparkSession, start, end) -> DataFrame:
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return spark.range(1).select(F.explode(days).alias("date"))


def basic(df: DataFrame) -> DataFrame:
    """Parts of the date (Monday is 0) and starts and ends of month, quarter and year."""
    d = F.col("date")
    quarter_start, quarter_end = F.trunc(d, "quarter"), F.last_day(F.add_months(F.trunc(d, "quarter"), 2))
    return df.withColumns({
        "day_of_week": F.weekday(d), "day_of_month": F.dayofmonth(d), "week_of_year": F.weekofyear(d), "month": F.month(d), "quarter": F.quarter(d), "year": F.year(d),
        "day_name": F.date_format(d, "EEEE"), "month_name": F.date_format(d, "MMMM"),
        "is_month_start": flag(F.dayofmonth(d) == 1), "is_month_end": flag(d == F.last_day(d)), "is_quarter_start": flag(d == quarter_start), "is_quarter_end": flag(d == quarter_end),
        "is_year_start": flag(F.dayofyear(d) == 1), "is_year_end": flag((F.month(d) == 12) & (F.dayofmonth(d) == 31)), "days_to_quarter_end": F.datediff(quarter_end, d),
    })


def nth_weekday(first_of_month: Column, day: str, n: int) -> Column:
    """The n-th given weekday of a month."""
    return F.date_add(F.next_day(F.date_sub(first_of_month, 1), day), 7 * (n - 1))


def observed(d: Column) -> Column:
    """Saturday is observed on Friday, Sunday on Monday."""
    return F.when(F.weekday(d) == 5, F.date_sub(d, 1)).when(F.weekday(d) == 6, F.date_add(d, 1)).otherwise(d)


def holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """US federal holidays by rule, fixed ones also on the day they are observed: date, holiday."""
    day = lambda m, d: F.make_date(F.col("y"), F.lit(m), F.lit(d))
    fixed = {"New Year": day(1, 1), "Independence Day": day(7, 4), "Veterans Day": day(11, 11), "Christmas": day(12, 25)}
    floating = {
        "Martin Luther King Day": nth_weekday(day(1, 1), "Mon", 3), "Presidents Day": nth_weekday(day(2, 1), "Mon", 3), "Memorial Day": F.date_sub(F.next_day(day(5, 31), "Mon"), 7),
        "Labor Day": nth_weekday(day(9, 1), "Mon", 1), "Columbus Day": nth_weekday(day(10, 1), "Mon", 2), "Thanksgiving": nth_weekday(day(11, 1), "Thu", 4),
    }
    june = F.when(F.col("y") >= 2021, day(6, 19))
    each = [F.struct(d.alias("date"), F.lit(k).alias("holiday")) for k, d in (fixed | floating).items()]
    each += [F.struct(observed(d).alias("date"), F.lit(k).alias("holiday")) for k, d in fixed.items()]
    each += [F.struct(june.alias("date"), F.lit("Juneteenth").alias("holiday")), F.struct(observed(june).alias("date"), F.lit("Juneteenth").alias("holiday"))]
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("y"))
    return years.select(F.inline(F.array(*each))).filter("date is not null").distinct()


def distance_to_events(df: DataFrame, events: DataFrame, ahead: str, behind: str | None = None, cap: int | None = None, none: int | None = None) -> DataFrame:
    """Days to the next later and since the last earlier event.

    The calendar is cut into blocks of BLOCK days, in which windows find the events nearby; the first and last event of
    each block, one row a block and at most a thousand blocks in all years 1 to 9999, are carried on to the others.
    """
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    marked = df.withColumn("_event", F.lit(None).cast("date")).unionByName(events.select("date", F.col("date").alias("_event")).distinct(), allowMissingColumns=True)
    marked = marked.withColumn("_block", F.floor(day / BLOCK))
    blocks = marked.groupBy("_block").agg(F.min("_event").alias("_first"), F.max("_event").alias("_last"))
    over = Window.orderBy("_block")  # a row a block
    carried = blocks.select(F.col("_block").alias("_b"), F.max("_last").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.min("_first").over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    marked = marked.join(F.broadcast(carried), F.col("_block") == F.col("_b"))  # at most a thousand rows
    here = Window.partitionBy("_block").orderBy(day)
    later, earlier = F.min("_event").over(here.rangeBetween(1, Window.unboundedFollowing)), F.max("_event").over(here.rangeBetween(Window.unboundedPreceding, -1))
    to, since = F.datediff(F.coalesce(later, "_after"), "date"), F.datediff("date", F.coalesce(earlier, "_before"))
    limit = lambda x: F.least(F.coalesce(x, F.lit(none if none is not None else cap)), F.lit(cap)) if cap else F.coalesce(x, F.lit(none))
    out = marked.withColumn(ahead, limit(to))
    out = out.withColumn(behind, limit(since)) if behind else out
    return out.withColumn("_day", F.col("_event").isNull()).filter("_day").drop("_event", "_day", "_block", "_b", "_before", "_after")


def holiday_flags(df: DataFrame, days: DataFrame) -> DataFrame:
    d, m, week = F.col("date"), F.month("date"), F.weekofyear("date")
    df = df.join(days.select("date").distinct().withColumn("_h", F.lit(True)), "date", "left").withColumn("is_holiday", flag(F.col("_h"))).drop("_h")
    df = distance_to_events(df, days, "days_to_next_holiday", "days_since_last_holiday", cap=CAP)
    return df.withColumns({
        "is_thanksgiving_week": flag((m == 11) & week.isin(47, 48)), "is_christmas_season": flag((m == 12) & (F.dayofmonth(d) >= 15)),
        "is_new_year_period": flag(((m == 12) & (F.dayofmonth(d) >= 26)) | ((m == 1) & (F.dayofmonth(d) <= 7))), "is_summer": flag(m.isin(6, 7, 8)),
    })


def trading_days(df: DataFrame) -> DataFrame:
    """Trading day flag, totals and running counts by month and quarter, first and last, triple witching."""
    d = F.col("date")
    df = df.withColumn("is_trading_day", flag((F.weekday(d) < 5) & (F.col("is_holiday") == 0)))
    new, t = {}, F.col("is_trading_day")
    for name, unit in (("month", "month"), ("quarter", "quarter")):
        by = Window.partitionBy(F.trunc(d, unit))
        so_far = by.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        new |= {f"trading_days_in_{name}": F.sum(t).over(by), f"trading_day_of_{name}": F.sum(t).over(so_far)}
    df = df.withColumns(new)
    third_friday = nth_weekday(F.trunc(d, "month"), "Fri", 3)
    return df.withColumns({
        "is_first_trading_day": flag((t == 1) & (F.col("trading_day_of_month") == 1)), "is_last_trading_day": flag((t == 1) & (F.col("trading_day_of_month") == F.col("trading_days_in_month"))),
        "is_triple_witching": flag((d == third_friday) & F.month(d).isin(3, 6, 9, 12)),
    })


def third_fridays(spark: SparkSession, start, end) -> DataFrame:
    """Options expiry and quarter-end dates of a range: date, kind."""
    months = spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(start).cast("date"), "month"), F.lit(end).cast("date"), F.expr("interval 1 month"))).alias("m"))
    friday = months.select(nth_weekday(F.col("m"), "Fri", 3).alias("date"), F.lit("options_expiry").alias("kind"))
    return friday.unionByName(months.filter(F.month("m").isin(3, 6, 9, 12)).select(F.last_day("m").alias("date"), F.lit("quarter_end").alias("kind")))


# Months of scheduled policy meetings, taken to be on the 15th.
MEETING_MONTHS = (1, 3, 5, 6, 7, 9, 11, 12)


def market_events(df: DataFrame, first_year: int, last_year: int) -> DataFrame:
    d = F.col("date")
    years = df.sparkSession.range(first_year, last_year + 1).select(F.explode(F.array(*[F.make_date(F.col("id").cast("int"), F.lit(m), F.lit(15)) for m in MEETING_MONTHS])).alias("date"))
    df = distance_to_events(df, years, "days_to_fomc", none=NO_EVENT)
    near = lambda n: F.date_add(d, n)
    end_of = lambda x: F.last_day(F.add_months(F.trunc(x, "quarter"), 2))
    return df.withColumns({
        "is_earnings_season": flag(F.month(d).isin(1, 4, 7, 10)), "is_fomc_week": flag(F.col("days_to_fomc") <= 7), "is_options_expiry": flag(d == nth_weekday(F.trunc(d, "month"), "Fri", 3)),
        "is_quarter_end_rebalance": flag((near(5) == end_of(near(5))) | (near(-5) == end_of(near(-5)))), "is_tax_loss_season": flag(F.month(d).isin(11, 12)),
    })


def cyclic(df: DataFrame) -> DataFrame:
    d = F.col("date")
    parts = {"dow": (F.weekday(d), 7), "dom": (F.dayofmonth(d), 31), "month": (F.month(d), 12), "week": (F.weekofyear(d), 52)}
    return df.withColumns({f"{k}_{f.__name__}": f(x * (2 * math.pi / n)) for k, (x, n) in parts.items() for f in (F.sin, F.cos)})


def seasonality(df: DataFrame) -> DataFrame:
    d, m, day = F.col("date"), F.month("date"), F.dayofmonth("date")
    season = F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring").when(m.isin(6, 7, 8), "summer").otherwise("fall")
    return df.withColumns({
        "season": season, "is_january_effect": flag(m == 1), "is_sell_in_may": flag(m.between(5, 10)), "is_santa_rally": flag((m == 12) & (day >= 20)),
        "is_window_dressing": flag(m.isin(3, 6, 9, 12) & (F.datediff(F.last_day(d), d) <= 5)), "is_low_volume": flag(m.isin(7, 8) | ((m == 12) & (day >= 20))),
    })


def calendar(spark: SparkSession, start, end, years: tuple[int, int]) -> DataFrame:
    """The spine with every feature."""
    df = holiday_flags(basic(spine(spark, start, end)), holidays(spark, years[0] - 1, years[1] + 1))
    return seasonality(cyclic(market_events(trading_days(df), years[0], years[1] + 1)))


def market_return(bars: DataFrame, tickers: list[str]) -> DataFrame:
    x = F.try_divide(F.col("close") - F.col("open"), "open")
    return bars.filter(F.col("ticker").isin(tickers)).groupBy("date").agg(F.avg(x).alias("market_return"), F.stddev(x).alias("market_volatility"))


def feature_importance(calendar_df: DataFrame, market: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Correlation of each feature with mean return and its dispersion, all features in one pass.

    Without a list these are all numeric and boolean columns. Columns that don't vary get null."""
    kinds = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double")
    features = features or [f.name for f in calendar_df.schema if f.dataType.simpleString() in kinds]
    joined = calendar_df.join(market, "date")
    wide = joined.agg(*[corr(F.col(c).cast("double"), F.col(y)).alias(f"{c}|{y}") for c in features for y in ("market_return", "market_volatility")])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}|market_return`").alias("return_corr"), F.col(f"`{c}|market_volatility`").alias("volatility_corr")) for c in features])))
