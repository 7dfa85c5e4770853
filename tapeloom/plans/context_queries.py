"""Queries over calendar, macro series, sentiment, data quality and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import rounded, series
from tapeloom.operators import calendar, features, graph, indicators, macro, quality
from tapeloom.plans import fixtures as fx
from tapeloom.plans import indicator_sql as isql
from tapeloom.plans.bar_queries import AS_OF, NEWS_AS_OF, W, roll
from tapeloom.plans.graph_queries import EDGES
from tapeloom.plans.registry import query


def _days(spark, sf):
    """The spine from the first to the last order date."""
    o = fx.table(spark, sf, "orders")
    return o.agg(F.sequence(F.to_date(F.min("o_orderdate")), F.to_date(F.max("o_orderdate"))).alias("d")).select(F.explode("d").alias("date"))


SPINE = {"d": "SELECT unnest(generate_series((SELECT min(o_orderdate) FROM orders)::DATE, (SELECT max(o_orderdate) FROM orders)::DATE, INTERVAL 1 DAY))::DATE AS date"}
QEND = "last_day((date_trunc('quarter', date) + INTERVAL 2 MONTH)::DATE)"


@query("c2_calendar_basic", (), f"""SELECT date, (isodow(date) - 1)::INT AS day_of_week, day(date)::INT AS day_of_month, week(date)::INT AS week_of_year, month(date)::INT AS month, quarter(date)::INT AS quarter, year(date)::INT AS year, dayname(date) AS day_name, monthname(date) AS month_name,
 (day(date) = 1)::INT AS is_month_start, (date = last_day(date))::INT AS is_month_end, (date = date_trunc('quarter', date))::INT AS is_quarter_start, (date = {QEND})::INT AS is_quarter_end, (dayofyear(date) = 1)::INT AS is_year_start, (month(date) = 12 AND day(date) = 31)::INT AS is_year_end,
 ({QEND} - date)::INT AS days_to_quarter_end FROM d""", SPINE)
def _(spark, sf):
    return calendar.basic(_days(spark, sf))


HOLIDAYS = SPINE | {
    "y": "SELECT DISTINCT unnest([year(date) - 1, year(date), year(date) + 1]) AS y FROM d",
    "fixed": "SELECT unnest([make_date(y, 1, 1), make_date(y, 7, 4), make_date(y, 11, 11), make_date(y, 12, 25)]) AS date FROM y",
    "m": "SELECT y, unnest(generate_series(1, 12)) AS mo FROM y",
    "days": "SELECT y, mo, unnest(generate_series(make_date(y, mo, 1), last_day(make_date(y, mo, 1)), INTERVAL 1 DAY))::DATE AS date FROM m",
    "nth": "SELECT y, mo, date, isodow(date) AS dow, row_number() OVER (PARTITION BY y, mo, isodow(date) ORDER BY date) AS n, row_number() OVER (PARTITION BY y, mo, isodow(date) ORDER BY date DESC) AS back FROM days",
    "h": """SELECT date FROM fixed UNION SELECT CASE isodow(date) WHEN 6 THEN date - 1 WHEN 7 THEN date + 1 ELSE date END FROM fixed
  UNION SELECT date FROM nth WHERE (mo = 1 AND dow = 1 AND n = 3) OR (mo = 2 AND dow = 1 AND n = 3) OR (mo = 5 AND dow = 1 AND back = 1) OR (mo = 9 AND dow = 1 AND n = 1) OR (mo = 10 AND dow = 1 AND n = 2) OR (mo = 11 AND dow = 4 AND n = 4)""",
    "dist": "SELECT date, date IN (SELECT date FROM h) AS is_h, (SELECT min(h.date) FROM h WHERE h.date > d.date) - date AS nxt, date - (SELECT max(h.date) FROM h WHERE h.date < d.date) AS prv FROM d",
}


def _with_holidays(spark, sf):
    d = _days(spark, sf)
    lo, hi = d.agg(F.year(F.min("date")), F.year(F.max("date"))).first()
    return calendar.holiday_flags(d, calendar.holidays(spark, lo - 1, hi + 1)), lo, hi


@query("c3_holidays", (), """SELECT date, is_h::INT AS is_holiday, least(coalesce(nxt, 365), 365)::INT AS days_to_next_holiday, least(coalesce(prv, 365), 365)::INT AS days_since_last_holiday, (month(date) = 11 AND week(date) IN (47, 48))::INT AS is_thanksgiving_week, (month(date) = 12 AND day(date) >= 15)::INT AS is_christmas_season,
 ((month(date) = 12 AND day(date) >= 26) OR (month(date) = 1 AND day(date) <= 7))::INT AS is_new_year_period, (month(date) IN (6, 7, 8))::INT AS is_summer FROM dist""", HOLIDAYS)
def _(spark, sf):
    return _with_holidays(spark, sf)[0]


@query("c4_trading_days", (), """SELECT date, t AS is_trading_day, sum(t) OVER m::BIGINT AS trading_days_in_month, sum(t) OVER (PARTITION BY date_trunc('month', date) ORDER BY date)::BIGINT AS trading_day_of_month, sum(t) OVER q::BIGINT AS trading_days_in_quarter,
 sum(t) OVER (PARTITION BY date_trunc('quarter', date) ORDER BY date)::BIGINT AS trading_day_of_quarter FROM (SELECT date, (isodow(date) < 6 AND NOT is_h)::INT AS t FROM dist) WINDOW m AS (PARTITION BY date_trunc('month', date)), q AS (PARTITION BY date_trunc('quarter', date))""", HOLIDAYS)
def _(spark, sf):
    return calendar.trading_days(_with_holidays(spark, sf)[0]).select("date", "is_trading_day", "trading_days_in_month", "trading_day_of_month", "trading_days_in_quarter", "trading_day_of_quarter")


@query("c5_market_events", (), """SELECT date, (month(date) IN (1, 4, 7, 10))::INT AS is_earnings_season, coalesce((SELECT min(e) FROM f WHERE e > date) - date, 999)::INT AS days_to_fomc, (isodow(date) = 5 AND day(date) BETWEEN 15 AND 21)::INT AS is_options_expiry, (month(date) IN (11, 12))::INT AS is_tax_loss_season FROM d""",
       SPINE | {"f": "SELECT make_date(y, mo, 15) AS e FROM (SELECT DISTINCT unnest([year(date), year(date) + 1]) AS y FROM d), (SELECT unnest([1, 3, 5, 6, 7, 9, 11, 12]) AS mo)"})
def _(spark, sf):
    d = _days(spark, sf)
    lo, hi = d.agg(F.year(F.min("date")), F.year(F.max("date"))).first()
    return calendar.market_events(d, lo, hi + 1).select("date", "is_earnings_season", "days_to_fomc", "is_options_expiry", "is_tax_loss_season")


@query("c6_cyclic", (), "SELECT date, " + ", ".join(f"round({f}({x} * 2 * pi() / {n}), 6) AS {k}_{f}" for k, x, n in (("dow", "(isodow(date) - 1)", 7), ("dom", "day(date)", 31), ("month", "month(date)", 12), ("week", "week(date)", 52)) for f in ("sin", "cos")) + " FROM d", SPINE)
def _(spark, sf):
    return rounded(calendar.cyclic(_days(spark, sf)), 6)


@query("c7_seasonality", (), """SELECT date, CASE WHEN month(date) IN (12, 1, 2) THEN 'winter' WHEN month(date) IN (3, 4, 5) THEN 'spring' WHEN month(date) IN (6, 7, 8) THEN 'summer' ELSE 'fall' END AS season, (month(date) = 1)::INT AS is_january_effect, (month(date) BETWEEN 5 AND 10)::INT AS is_sell_in_may,
 (month(date) = 12 AND day(date) >= 20)::INT AS is_santa_rally, (month(date) IN (3, 6, 9, 12) AND last_day(date) - date <= 5)::INT AS is_window_dressing, (month(date) IN (7, 8) OR (month(date) = 12 AND day(date) >= 20))::INT AS is_low_volume FROM d""", SPINE)
def _(spark, sf):
    return calendar.seasonality(_days(spark, sf))


FULL = HOLIDAYS | {
    "f": "SELECT make_date(y, mo, 15) AS e FROM (SELECT DISTINCT unnest([year(date), year(date) + 1]) AS y FROM d), (SELECT unnest([1, 3, 5, 6, 7, 9, 11, 12]) AS mo)",
    "td": """SELECT date, t AS is_trading_day, sum(t) OVER m::BIGINT AS trading_days_in_month, sum(t) OVER (PARTITION BY date_trunc('month', date) ORDER BY date)::BIGINT AS trading_day_of_month, sum(t) OVER q::BIGINT AS trading_days_in_quarter,
 sum(t) OVER (PARTITION BY date_trunc('quarter', date) ORDER BY date)::BIGINT AS trading_day_of_quarter FROM (SELECT date, (isodow(date) < 6 AND NOT is_h)::INT AS t FROM dist) WINDOW m AS (PARTITION BY date_trunc('month', date)), q AS (PARTITION BY date_trunc('quarter', date))""",
    "parts": f"""SELECT d.date, (isodow(d.date) - 1)::INT AS day_of_week, day(d.date)::INT AS day_of_month, week(d.date)::INT AS week_of_year, month(d.date)::INT AS month, quarter(d.date)::INT AS quarter, year(d.date)::INT AS year, dayname(d.date) AS day_name, monthname(d.date) AS month_name,
 (day(d.date) = 1)::INT AS is_month_start, (d.date = last_day(d.date))::INT AS is_month_end, (d.date = date_trunc('quarter', d.date))::INT AS is_quarter_start, (d.date = {QEND.replace('date)', 'd.date)')})::INT AS is_quarter_end, (dayofyear(d.date) = 1)::INT AS is_year_start, (month(d.date) = 12 AND day(d.date) = 31)::INT AS is_year_end,
 ({QEND.replace('date)', 'd.date)')} - d.date)::INT AS days_to_quarter_end FROM d""",
}
QE = "last_day((date_trunc('quarter', {0}) + INTERVAL 2 MONTH)::DATE)"
CYCLE = (("dow", "(isodow(date) - 1)", 7), ("dom", "day(date)", 31), ("month", "month(date)", 12), ("week", "week(date)", 52))


@query("c1_calendar_full", (), f"""SELECT parts.*, dist.is_h::INT AS is_holiday, least(coalesce(nxt, 365), 365)::INT AS days_to_next_holiday, least(coalesce(prv, 365), 365)::INT AS days_since_last_holiday, (month = 11 AND week(date) IN (47, 48))::INT AS is_thanksgiving_week,
 (month = 12 AND day(date) >= 15)::INT AS is_christmas_season, ((month = 12 AND day(date) >= 26) OR (month = 1 AND day(date) <= 7))::INT AS is_new_year_period, (month IN (6, 7, 8))::INT AS is_summer, td.* EXCLUDE (date), (is_trading_day = 1 AND trading_day_of_month = 1)::INT AS is_first_trading_day,
 (is_trading_day = 1 AND trading_day_of_month = trading_days_in_month)::INT AS is_last_trading_day, (isodow(date) = 5 AND day(date) BETWEEN 15 AND 21 AND month IN (3, 6, 9, 12))::INT AS is_triple_witching, coalesce((SELECT min(e) FROM f WHERE e > date) - date, 999)::INT AS days_to_fomc,
 (month IN (1, 4, 7, 10))::INT AS is_earnings_season, (coalesce((SELECT min(e) FROM f WHERE e > date) - date, 999) <= 7)::INT AS is_fomc_week, (isodow(date) = 5 AND day(date) BETWEEN 15 AND 21)::INT AS is_options_expiry,
 (date + 5 = {QE.format('date + 5')} OR date - 5 = {QE.format('date - 5')})::INT AS is_quarter_end_rebalance, (month IN (11, 12))::INT AS is_tax_loss_season, {", ".join(f"round({f}({x} * 2 * pi() / {n}), 6) AS {k}_{f}" for k, x, n in CYCLE for f in ("sin", "cos"))},
 CASE WHEN month IN (12, 1, 2) THEN 'winter' WHEN month IN (3, 4, 5) THEN 'spring' WHEN month IN (6, 7, 8) THEN 'summer' ELSE 'fall' END AS season, (month = 1)::INT AS is_january_effect, (month BETWEEN 5 AND 10)::INT AS is_sell_in_may,
 (month = 12 AND day(date) >= 20)::INT AS is_santa_rally, (month IN (3, 6, 9, 12) AND last_day(date) - date <= 5)::INT AS is_window_dressing, (month IN (7, 8) OR (month = 12 AND day(date) >= 20))::INT AS is_low_volume
 FROM parts JOIN dist USING (date) JOIN td USING (date)""", FULL)
def _(spark, sf):
    lo, hi = _days(spark, sf).agg(F.min("date"), F.max("date")).first()
    return rounded(calendar.calendar(spark, lo, hi, (lo.year, hi.year)), 6)


NUMBERS = {
    "day_of_week": "isodow(date) - 1", "day_of_month": "day(date)", "week_of_year": "week(date)", "month": "month(date)", "quarter": "quarter(date)", "year": "year(date)", "is_month_start": "(day(date) = 1)::INT", "is_month_end": "(date = last_day(date))::INT",
    "is_quarter_start": "(date = date_trunc('quarter', date))::INT", "is_quarter_end": f"(date = {QEND})::INT", "is_year_start": "(dayofyear(date) = 1)::INT", "is_year_end": "(month(date) = 12 AND day(date) = 31)::INT", "days_to_quarter_end": f"{QEND} - date",
}


@query("c9_feature_importance", ("bars_daily",), " UNION ALL ".join(f"SELECT '{k}' AS feature, " + ", ".join(f"round(CASE WHEN min(x) FILTER ({y} IS NOT NULL) < max(x) FILTER ({y} IS NOT NULL) THEN corr(x, {y}) END, 5) AS {n}" for y, n in (("r", "return_corr"), ("v", "volatility_corr"))) + f" FROM (SELECT *, ({x})::DOUBLE AS x FROM m)" for k, x in NUMBERS.items()),
       {"m": "SELECT date, avg((close - open) / open) AS r, stddev((close - open) / open) AS v FROM bars_daily WHERE ticker IN ('NATION_3', 'NATION_2', 'NATION_11') GROUP BY date"})
def _(spark, sf):
    """Every numeric and boolean feature, against the mean return and against its dispersion."""
    m = calendar.market_return(fx.bars_daily(spark, sf), ["NATION_3", "NATION_2", "NATION_11"])
    return rounded(calendar.feature_importance(calendar.basic(m.select("date")), m), 5)


@query("c8_expiry_dates", (), """SELECT date, 'options_expiry' AS kind FROM m WHERE isodow(date) = 5 AND day(date) BETWEEN 15 AND 21 UNION ALL SELECT date, 'quarter_end' FROM m WHERE date = last_day(date) AND month(date) IN (3, 6, 9, 12)""",
       SPINE | {"m": "SELECT unnest(generate_series(date_trunc('month', min(date)), last_day(max(date)), INTERVAL 1 DAY))::DATE AS date FROM d"})
def _(spark, sf):
    lo, hi = _days(spark, sf).agg(F.min("date"), F.max("date")).first()
    return calendar.third_fridays(spark, lo, hi)


# --- macro and sentiment ---

MW = "(PARTITION BY indicator ORDER BY date)"


@query("m1_macro_derived", ("macro_long",), f"""SELECT date, indicator, round(value, 4) AS value, round((value / nullif(b, 0) - 1) * 100, 5) AS yoy_change, round(value - b, 4) AS yoy_diff, round(m3, 4) AS ma3, round(m12, 4) AS ma12, coalesce(value > m3, false)::INT AS trend_up, round((value - m20) / nullif(s20, 0), 5) AS zscore
 FROM x""", {"x": f"SELECT *, CASE indicator WHEN 'gdp' THEN lag(value, 4) OVER {MW} WHEN 'treasury_10y' THEN NULL ELSE lag(value, 12) OVER {MW} END AS b, {roll('avg', 'value', 3, 'indicator')} AS m3, {roll('avg', 'value', 12, 'indicator')} AS m12, {roll('avg', 'value', 20, 'indicator')} AS m20, {roll('stddev_samp', 'value', 20, 'indicator')} AS s20 FROM macro_long"})
def _(spark, sf):
    return rounded(macro.derive(fx.macro_long(spark, sf)), {"value": 4, "yoy_change": 5, "yoy_diff": 4, "ma3": 4, "ma12": 4, "zscore": 5})


@query("m3_macro_wide", ("macro_long",), """SELECT s.date, round(last_value(g.value IGNORE NULLS) OVER (ORDER BY s.date ROWS BETWEEN 90 PRECEDING AND CURRENT ROW), 4) AS gdp, round(last_value(c.value IGNORE NULLS) OVER (ORDER BY s.date ROWS BETWEEN 30 PRECEDING AND CURRENT ROW), 4) AS cpi
 FROM (SELECT unnest(generate_series((SELECT min(date) FROM macro_long), (SELECT max(date) FROM macro_long), INTERVAL 1 DAY))::DATE AS date) s LEFT JOIN macro_long g ON g.date = s.date AND g.indicator = 'gdp' LEFT JOIN macro_long c ON c.date = s.date AND c.indicator = 'cpi'""")
def _(spark, sf):
    return rounded(macro.wide(macro.derive(fx.macro_long(spark, sf)), ["gdp", "cpi"]).select("date", "gdp", "cpi"), 4)


@query("m4_macro_composites", ("macro_long",), """SELECT date, round(list_avg(z), 5) AS economic_health FROM
 (SELECT date, [""" + ", ".join(f"{sg}({c} - avg({c}) OVER ()) / stddev({c}) OVER ()" for c, sg in (("gdp", ""), ("unemployment_rate", "-"), ("cpi", ""), ("consumer_confidence", ""))) + """] AS z
 FROM (SELECT date, max(value) FILTER (indicator = 'gdp') AS gdp, max(value) FILTER (indicator = 'unemployment_rate') AS unemployment_rate, max(value) FILTER (indicator = 'cpi') AS cpi, max(value) FILTER (indicator = 'consumer_confidence') AS consumer_confidence FROM macro_long WHERE (month(date) + length(indicator)) % 3 = 0 GROUP BY date))""")
def _(spark, sf):
    """Months in which some of the four indicators are missing, up to all but one."""
    some = fx.macro_long(spark, sf).filter((F.month("date") + F.length("indicator")) % 3 == 0)
    wide = some.groupBy("date").pivot("indicator", ["gdp", "unemployment_rate", "cpi", "consumer_confidence"]).agg(F.first("value"))
    return macro.composites(wide).select("date", F.round("economic_health", 5).alias("economic_health"))


@query("m5_latest_indicators", ("macro_long",), f"SELECT indicator, max(date) AS date, round(arg_max(value, date), 4) AS value FROM macro_long WHERE date BETWEEN DATE '{AS_OF}' - 90 AND DATE '{AS_OF}' GROUP BY indicator")
def _(spark, sf):
    return rounded(macro.latest(fx.macro_long(spark, sf), AS_OF), 4)


@query("m6_freshness", ("macro_long",), """SELECT indicator, latest_date, CASE indicator WHEN 'gdp' THEN 'quarterly' WHEN 'treasury_10y' THEN 'daily' ELSE 'monthly' END AS frequency, (DATE '2001-09-20' - latest_date)::INT AS days_old,
 (DATE '2001-09-20' - latest_date) > 1.5 * CASE indicator WHEN 'gdp' THEN 90 WHEN 'treasury_10y' THEN 1 ELSE 30 END AS needs_update FROM (SELECT indicator, max(date) AS latest_date FROM macro_long GROUP BY indicator)""")
def _(spark, sf):
    return macro.freshness(fx.macro_long(spark, sf), "2001-09-20")


CAT = "CASE WHEN s <= -1 THEN NULL WHEN s <= -0.35 THEN 0 WHEN s <= -0.15 THEN 1 WHEN s <= 0.15 THEN 2 WHEN s <= 0.35 THEN 3 WHEN s <= 1 THEN 4 END"


@query("n1_sentiment_category", ("sentiment",), f"SELECT event_id, {CAT} AS category_rank FROM (SELECT event_id, overall_sentiment_score AS s FROM sentiment)")
def _(spark, sf):
    return macro.categorise(fx.sentiment(spark, sf)).select("event_id", "category_rank")


@query("a16_n2_daily_sentiment", ("sentiment",), """SELECT symbol, date, round(m, 6) AS sentiment_mean, round(sd, 6) AS sentiment_std, n AS article_count, ['very_negative', 'negative', 'neutral', 'positive', 'very_positive'][r + 1] AS dominant_category, round(abs(m), 6) AS sentiment_strength,
 round(m - first_value(m) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS sentiment_trend FROM g JOIN t USING (symbol, date)""",
       {"x": f"SELECT symbol, timestamp::DATE AS date, overall_sentiment_score AS s, {CAT} AS c FROM (SELECT *, overall_sentiment_score AS s FROM sentiment)",
        "g": "SELECT symbol, date, avg(s) AS m, stddev(s) AS sd, count(s) AS n FROM x GROUP BY symbol, date",
        "t": "SELECT symbol, date, c AS r FROM (SELECT symbol, date, c, count(*) AS k FROM x GROUP BY symbol, date, c) QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY (c IS NULL), k DESC, c) = 1"})
def _(spark, sf):
    return rounded(macro.daily_sentiment(fx.sentiment(spark, sf)), 6)


@query("a17_sentiment_summary", ("sentiment",), """SELECT symbol, min(timestamp) AS first, max(timestamp) AS last, count(*) AS articles, round(avg(overall_sentiment_score), 6) AS mean, round(stddev(overall_sentiment_score), 6) AS std, min(overall_sentiment_score) AS lowest, max(overall_sentiment_score) AS highest,
 (max(timestamp)::DATE - min(timestamp)::DATE)::INT AS days, CASE WHEN avg(overall_sentiment_score) > 0.1 THEN 'bullish' WHEN avg(overall_sentiment_score) < -0.1 THEN 'bearish' ELSE 'neutral' END AS bias FROM sentiment GROUP BY symbol""")
def _(spark, sf):
    return rounded(macro.sentiment_summary(fx.sentiment(spark, sf)), 6)


BY_USER = {"u": "SELECT user_id::VARCHAR AS symbol, ts AS timestamp, ((event_id * 37) % 201 - 100) / 100 AS s FROM events", "m": "SELECT symbol, avg(s) AS mean, stddev(s) AS std FROM u GROUP BY symbol"}


def _by_user(spark, sf):
    e = fx.table(spark, sf, "events")
    return e.select(F.col("user_id").cast("string").alias("symbol"), F.col("ts").alias("timestamp"), ((F.col("event_id") * 37 % 201 - 100) / 100).alias("overall_sentiment_score"))


# scores in hundredths, so that means at 0.1 don't depend on the order of a sum of doubles
@query("a18_bias_distribution", (), "SELECT bias, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM (SELECT CASE WHEN total > 10 * n THEN 'bullish' WHEN total < -10 * n THEN 'bearish' ELSE 'neutral' END AS bias FROM m) GROUP BY bias",
       {"u": "SELECT user_id::VARCHAR AS symbol, (event_id * 37) % 201 - 100 AS hundredths FROM events", "m": "SELECT symbol, sum(hundredths) AS total, count(hundredths) AS n FROM u GROUP BY symbol"})
def _(spark, sf):
    return rounded(macro.bias_distribution(macro.sentiment_summary(_by_user(spark, sf))), 6)


@query("t5_top_sentiment", (), " UNION ALL ".join(f"(SELECT '{k}' AS kind, row_number() OVER (ORDER BY {o}, symbol)::INT AS rank, symbol, round({c}, 6) AS value FROM m ORDER BY {o}, symbol LIMIT 10)" for k, c, o in (("bullish", "mean", "mean DESC"), ("bearish", "mean", "mean"), ("volatile", "std", "std DESC"))), BY_USER)
def _(spark, sf):
    return rounded(macro.top_sentiment(macro.sentiment_summary(_by_user(spark, sf))), 6)


@query("t6_sentiment_trends", (), "(SELECT symbol, round(mean_score, 6) AS mean_score, round(last_trend, 6) AS last_trend, 'top' AS side FROM tr ORDER BY tr.last_trend DESC, symbol LIMIT 5) UNION ALL (SELECT symbol, round(mean_score, 6), round(last_trend, 6), 'bottom' FROM tr ORDER BY tr.last_trend, symbol LIMIT 5)", BY_USER | {
    "dd": "SELECT symbol, timestamp::DATE AS date, avg(s) AS m FROM u GROUP BY 1, 2",
    "dt": "SELECT *, m - first_value(m) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS trend FROM dd",
    "tr": f"SELECT symbol, avg(m) AS mean_score, arg_max(trend, date) AS last_trend FROM dt WHERE date BETWEEN DATE '{NEWS_AS_OF}' - 7 AND DATE '{NEWS_AS_OF}' GROUP BY symbol"})
def _(spark, sf):
    return rounded(macro.trends(macro.daily_sentiment(_by_user(spark, sf)), NEWS_AS_OF), 6)


@query("n3_lookback", ("sentiment",), f"SELECT symbol, timestamp, event_id FROM sentiment WHERE timestamp >= DATE '{NEWS_AS_OF}' - 7")
def _(spark, sf):
    return macro.lookback(fx.sentiment(spark, sf), NEWS_AS_OF, 7).select("symbol", "timestamp", "event_id")


@query("p6_sentiment_normalise", ("sentiment",), "SELECT symbol, timestamp, timestamp::DATE AS date, CASE WHEN event_id % 5 = 0 THEN 0 ELSE overall_sentiment_score END AS overall_sentiment_score, event_id FROM sentiment")
def _(spark, sf):
    s = fx.sentiment(spark, sf).withColumn("overall_sentiment_score", F.when(F.col("event_id") % 5 != 0, F.col("overall_sentiment_score")))
    return macro.normalise_news(s, "2024-02-01").select("symbol", "timestamp", "date", "overall_sentiment_score", "event_id")


# --- quality ---


@query("q2_price_consistency", ("bars_daily",), "SELECT unnest(['high_below_low', 'high_below_open', 'high_below_close', 'low_above_open', 'low_above_close']) AS rule, unnest([count(*) FILTER (high < low), count(*) FILTER (high < open), count(*) FILTER (high < close), count(*) FILTER (low > open), count(*) FILTER (low > close)]) AS broken FROM b",
       {"b": "SELECT ticker, date, open, CASE WHEN volume = 3 THEN high - 100000 ELSE high END AS high, low, close FROM bars_daily"})
def _(spark, sf):
    return quality.price_consistency(fx.bars_daily(spark, sf).withColumn("high", F.when(F.col("volume") == 3, F.col("high") - 100000).otherwise(F.col("high"))))


@query("q3_volume_validity", ("bars_daily",), "SELECT count(*) FILTER (v < 0) AS negative, round(avg((v = 0)::INT), 6) AS zero_share, count(*) FILTER (v < 0) = 0 AND avg((v = 0)::INT) <= 0.1 AS valid FROM (SELECT volume - 2 AS v FROM bars_daily)")
def _(spark, sf):
    return rounded(quality.volume_validity(fx.bars_daily(spark, sf).withColumn("volume", F.col("volume") - 2)), 6)


@query("q4_date_gaps", ("bars_daily",), f"SELECT * FROM (SELECT ticker, date, lag(date) OVER {W} AS previous_date, (date - lag(date) OVER {W})::INT AS gap_days FROM bars_daily) WHERE gap_days > 14")
def _(spark, sf):
    return quality.date_gaps(fx.bars_daily(spark, sf))


@query("q5_price_outliers", ("bars_daily",), """SELECT ticker, date, close FROM (SELECT ticker, date, close, avg(close) OVER w AS m, stddev_samp(close) OVER w AS s FROM bars_daily WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) WHERE abs(close - m) > 3 * s""")
def _(spark, sf):
    return quality.price_outliers(fx.bars_daily(spark, sf), k=3.0, include_self=False).select("ticker", "date", "close")


BROKEN = {"high_below_low": "high < low", "high_below_open": "high < open", "high_below_close": "high < close", "low_above_open": "low > open", "low_above_close": "low > close"}


@query("q1_validate_bars", ("bars_daily",), " UNION ALL ".join([f"SELECT * FROM (SELECT 'price: {k}' AS \"check\", (count(*) FILTER ({c}))::VARCHAR AS found FROM x) WHERE found <> '0'" for k, c in BROKEN.items()] + [
    "SELECT * FROM (SELECT 'volume', (count(*) FILTER (volume < 0))::VARCHAR || ' ' || avg((volume = 0)::INT)::VARCHAR AS found, count(*) FILTER (volume < 0) > 0 OR avg((volume = 0)::INT) > 0.1 AS bad FROM x) AS v(a, b, c) WHERE c".replace("SELECT * FROM (", "SELECT a, b FROM ("),
    f"SELECT 'date_gap', count(*)::VARCHAR FROM (SELECT date - lag(date) OVER {W} AS g FROM x) WHERE g > 14 HAVING count(*) > 0",
    "SELECT 'outlier', count(*)::VARCHAR FROM (SELECT close, avg(close) OVER w AS m, stddev_samp(close) OVER w AS s FROM x WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) WHERE abs(close - m) > 5 * s HAVING count(*) > 0"]),
    {"x": "SELECT ticker, date, open, CASE WHEN volume = 3 THEN high - 100000 ELSE high END AS high, low, close, volume - CASE WHEN volume > 3 THEN 9 ELSE 0 END AS volume FROM bars_daily"})
def _(spark, sf):
    """Bars with broken highs and volumes below zero."""
    b = fx.bars_daily(spark, sf)
    return quality.validate_bars(b.withColumns({"high": F.when(F.col("volume") == 3, F.col("high") - 100000).otherwise(F.col("high")), "volume": F.col("volume") - F.when(F.col("volume") > 3, 9).otherwise(0)}))


RANGES = ["open", "high", "low", "close", "volume", "adjusted_close", "rsi_14", "macd", "macd_signal", "macd_hist", "atr_14", "adx", "atr_14_percent"]


@query("q7_validate_indicators", ("bars_daily",), " UNION ALL ".join(f"SELECT '{c}' AS indicator, " + (f"count(*) FILTER ({c} < 0 OR {c} > 100)" if "rsi" in c else f"count(*) FILTER ({c} < -1 OR {c} > 1)" if "percent" in c else "0::BIGINT") + f" AS out_of_range, round(avg(({c} IS NULL)::INT), 6) AS null_ratio, " + (f"count(*) FILTER ({c} < 0 OR {c} > 100) = 0 AND " if "rsi" in c else f"count(*) FILTER ({c} < -1 OR {c} > 1) = 0 AND " if "percent" in c else "") + f"avg(({c} IS NULL)::INT) <= 0.3 AS valid FROM x" for c in RANGES),
       isql.recursion("bars_daily") | {"x": "SELECT b.*, r.* EXCLUDE (ticker, date), r.atr_14 / b.close * 100 AS atr_14_percent FROM bars_daily b JOIN rec r ON r.ticker = b.ticker AND r.date = b.date"}, recursive=True)
def _(spark, sf):
    return rounded(quality.validate_indicators(indicators.recursive_indicators(fx.bars_daily(spark, sf)).select(*RANGES)), 6)


@query("q6_type_check", ("bars_daily",), "SELECT 'volume' AS \"column\", 'string' AS type UNION ALL SELECT 'close', 'decimal'")
def _(spark, sf):
    b = fx.bars_daily(spark, sf)
    return quality.type_report(b.withColumns({"volume": F.col("volume").cast("string"), "close": F.col("close").cast("decimal(18,2)")}))


@query("p5_macro_normalise", (), "SELECT o_orderdate::DATE AS date, o_totalprice AS value, 'gdp' AS indicator FROM orders")
def _(spark, sf):
    o = fx.table(spark, sf, "orders").select(F.col("o_orderdate").cast("string").alias("date"), F.col("o_totalprice").cast("string").alias("value"))
    return macro.normalise(o, "gdp")


@query("m7_to_update", ("macro_long",), """SELECT indicator FROM (SELECT indicator, max(date) AS l FROM macro_long GROUP BY indicator) WHERE (DATE '2001-09-20' - l) > 1.5 * CASE indicator WHEN 'gdp' THEN 90 WHEN 'treasury_10y' THEN 1 ELSE 30 END""")
def _(spark, sf):
    return macro.to_update(fx.macro_long(spark, sf), "2001-09-20")


@query("p8_feature_columns", ("bars_daily", "metadata"), "SELECT open, high, low, close, volume, adjusted_close FROM bars_daily JOIN metadata USING (ticker)")
def _(spark, sf):
    b = fx.bars_daily(spark, sf).join(fx.metadata(spark, sf), "ticker")
    return b.select(*features.feature_columns(b))


@query("q8_column_report", ("bars_daily",), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS non_null, 0.0::DOUBLE AS null_pct, count(DISTINCT {c}) AS \"distinct\", min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 4) AS mean, round(stddev({c}), 3) AS std, {p} AS passed FROM bars_daily" for c, p in (("close", "min(close) > 0"), ("volume", "true"))))
def _(spark, sf):
    return rounded(quality.column_report(fx.bars_daily(spark, sf), ["close", "volume"]), {"mean": 4, "std": 3})


@query("q9_duplicate_keys", ("trades",), "SELECT ticker, date, count(*) AS n FROM trades GROUP BY ticker, date HAVING count(*) > 1")
def _(spark, sf):
    return quality.duplicate_keys(fx.trades(spark, sf), ["ticker", "date"])


@query("q10_null_counts", ("bars_daily",), f"SELECT unnest(['close', 'ret']) AS \"column\", unnest([count(*) FILTER (close IS NULL), count(*) FILTER (ret IS NULL)]) AS nulls FROM (SELECT close, close / lag(close) OVER {W} - 1 AS ret FROM bars_daily)")
def _(spark, sf):
    b = fx.bars_daily(spark, sf).withColumn("ret", F.try_divide(F.col("close"), F.lag("close").over(series())) - 1)
    return quality.null_counts(b, ["close", "ret"])


@query("q11_freshness", ("bars_daily",), f"SELECT max(date) AS latest, min(date) AS earliest, count(DISTINCT date) AS dates, (DATE '{AS_OF}' - max(date))::INT AS days_old FROM bars_daily")
def _(spark, sf):
    return quality.freshness(fx.bars_daily(spark, sf), AS_OF)


@query("q12_integrity", ("bars_daily",), "SELECT unnest(['high_not_below_low', 'close_positive', 'volume_not_negative', 'close_within_range']) AS rule, unnest([count(*) FILTER (NOT high >= low), count(*) FILTER (NOT close > 0), count(*) FILTER (NOT volume >= 0), count(*) FILTER (NOT close BETWEEN low AND high)]) AS broken FROM bars_daily")
def _(spark, sf):
    return quality.integrity(fx.bars_daily(spark, sf))


@query("q13_fingerprint", ("bars_daily",), """SELECT part, count(*) AS records, sum(h)::VARCHAR AS fingerprint FROM (SELECT year(date)::VARCHAR AS part, h FROM hashed UNION ALL SELECT 'all', h FROM hashed) GROUP BY part""",
       {"hashed": "SELECT date, ('0x' || substr(md5(round(close * 100)::BIGINT::VARCHAR || '|' || date::VARCHAR || '|' || ticker || '|' || volume::VARCHAR || '|' || year(date)::VARCHAR), 1, 15))::BIGINT AS h FROM bars_daily"})
def _(spark, sf):
    """Fingerprints of the years, and of the whole folded from them."""
    b = fx.bars_daily(spark, sf).select("ticker", "date", "volume", F.round(F.col("close") * 100).cast("bigint").alias("close"), F.year("date").alias("year"))
    parts = quality.fingerprint(b, ["year"])
    both = parts.select(F.col("year").cast("string").alias("part"), "records", "fingerprint").unionByName(quality.fold_fingerprints(parts).withColumn("part", F.lit("all")))
    return both.withColumn("fingerprint", F.col("fingerprint").cast("string"))


@query("q14_file_checksum")
def _(spark, sf):
    return quality.file_checksum(fx.table(spark, sf, "orders"))


@query("q15_table_check", ("bars_daily",), f"SELECT count(*) AS records, max(date) AS latest, (DATE '{AS_OF}' - max(date))::INT AS days_old, count(*) FILTER (close IS NULL) + count(*) FILTER (volume IS NULL) AS nulls, 0::BIGINT AS duplicate_keys FROM bars_daily")
def _(spark, sf):
    return quality.table_check(fx.bars_daily(spark, sf), ["ticker", "date"], ["close", "volume"], AS_OF)


# indicators that some tickers lack at the checked date, though they have them at others
LACKING = {"i": f"SELECT ticker, date FROM bars_daily WHERE NOT (date >= DATE '{AS_OF}' - 200 AND ticker LIKE '%1%')", "day_": "SELECT max(date) AS d FROM bars_daily WHERE date < (SELECT max(date) FROM bars_daily)",
           "cov": "SELECT count(DISTINCT b.ticker) AS tickers, count(DISTINCT i.ticker) AS with_indicators FROM bars_daily b LEFT JOIN i ON i.ticker = b.ticker AND i.date = b.date WHERE b.date = (SELECT d FROM day_)"}


def _lacking(spark, sf):
    b = fx.bars_daily(spark, sf)
    top = b.agg(F.max("date")).first()[0]
    at = b.filter(F.col("date") < F.lit(top)).agg(F.max("date")).first()[0]
    return b, b.filter(f"NOT (date >= date_sub(DATE '{AS_OF}', 200) AND ticker LIKE '%1%')").select("ticker", "date"), at


@query("q16_a12_daily_gate", ("bars_daily",), "SELECT count(DISTINCT ticker) AS tickers, count(*) AS records, ((SELECT d FROM day_) - max(date))::INT AS days_old, round((SELECT with_indicators / tickers FROM cov), 6) AS coverage, count(DISTINCT ticker) >= 10 AND (SELECT d FROM day_) - max(date) <= 2 AND (SELECT with_indicators / tickers FROM cov) >= 0.4 AS passed FROM bars_daily", LACKING)
def _(spark, sf):
    b, i, at = _lacking(spark, sf)
    return rounded(quality.daily_gate(b, i, at, coverage=0.4), 6)


@query("q17_training_gate", ("bars_daily",), f"SELECT count(DISTINCT ticker) AS tickers, count(DISTINCT date) AS dates, round(avg((s IS NOT NULL)::INT), 6) AS rsi_coverage, count(DISTINCT ticker) >= 20 AND count(DISTINCT date) >= 250 AS passed, avg((s IS NOT NULL)::INT) < 0.8 AS warning FROM (SELECT ticker, date, {roll('avg', 'close', 200)} AS s FROM bars_daily)")
def _(spark, sf):
    return rounded(quality.training_gate(indicators.sma(fx.bars_daily(spark, sf)), "sma_200"), 6)


@query("a13_indicator_coverage", ("bars_daily",), f"SELECT unnest(['sma_20', 'sma_200']) AS indicator, unnest([round(avg((a IS NOT NULL)::INT), 6), round(avg((b IS NOT NULL)::INT), 6)]) AS coverage FROM (SELECT {roll('avg', 'close', 20)} AS a, {roll('avg', 'close', 200)} AS b FROM bars_daily)")
def _(spark, sf):
    return rounded(quality.coverage_ratios(indicators.sma(fx.bars_daily(spark, sf)), ["sma_20", "sma_200"]), 6)


@query("j6_indicator_tickers", ("bars_daily",), "SELECT tickers, with_indicators, round(with_indicators / tickers, 6) AS coverage FROM cov", LACKING)
def _(spark, sf):
    return rounded(quality.indicator_coverage(*_lacking(spark, sf)), 6)


@query("a24_histogram", ("bars_daily",), "SELECT least(floor((close - 0) / 10000)::INT + 1, 50) AS bin, count(*) AS n FROM bars_daily WHERE close BETWEEN 0 AND 500000 GROUP BY 1")
def _(spark, sf):
    return quality.histogram(fx.bars_daily(spark, sf), "close", 0.0, 500000.0)


# --- features ---


@query("j1_feature_view", ("bars_daily", "metadata"), f"""SELECT b.ticker, b.date, b.close, round(i.sma_20, 6) AS sma_20, (isodow(b.date) - 1)::INT AS day_of_week, m.sector, s.score FROM bars_daily b LEFT JOIN (SELECT ticker, date, {roll('avg', 'close', 20)} AS sma_20 FROM bars_daily) i USING (ticker, date)
 LEFT JOIN (SELECT ticker, date, volume * 0.5::DOUBLE AS score FROM bars_daily WHERE volume > 1) s USING (ticker, date) LEFT JOIN metadata m USING (ticker) WHERE b.date >= DATE '{AS_OF}' - INTERVAL 2 YEAR""")
def _(spark, sf):
    b = fx.bars_daily(spark, sf)
    i = indicators.sma(b, (20,)).select("ticker", "date", F.round("sma_20", 6).alias("sma_20"))
    s = b.filter("volume > 1").select("ticker", "date", (F.col("volume") * F.lit(0.5)).alias("score"))
    c = calendar.basic(b.select("date").distinct()).select("date", "day_of_week")
    return features.feature_view(b.select("ticker", "date", "close"), i, s, c, fx.metadata(spark, sf).select("ticker", "sector"), AS_OF)


@query("e1_impute", ("bars_daily",), "SELECT ticker, date, round(coalesce(c, avg(c) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)), 4) AS c FROM (SELECT ticker, date, CASE WHEN volume > 1 THEN close END AS c FROM bars_daily)")
def _(spark, sf):
    b = fx.bars_daily(spark, sf).select("ticker", "date", F.when(F.col("volume") > 1, F.col("close")).alias("c"))
    return rounded(features.impute(b, ["c"]), 4)


@query("e2_e3_split_and_scale", ("bars_daily",), """SELECT ticker, date, split, round((close - (SELECT quantile_cont(close, 0.5) FROM x WHERE split = 'train')) / ((SELECT quantile_cont(close, 0.75) FROM x WHERE split = 'train') - (SELECT quantile_cont(close, 0.25) FROM x WHERE split = 'train')), 6) AS close FROM x""",
       {"dd": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars_daily)",
        "x": "SELECT ticker, date, close, CASE WHEN i <= floor(n * 0.7) THEN 'train' WHEN i <= floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'validation' ELSE 'test' END AS split FROM bars_daily JOIN dd USING (date)"})
def _(spark, sf):
    b = features.temporal_split(fx.bars_daily(spark, sf).select("ticker", "date", "close"))
    return rounded(features.robust_scale(b, features.robust_stats(b.filter("split = 'train'"), ["close"]), ["close"]), 6)


@query("e4_sequences", ("bars_daily",), """SELECT ticker, length, unnest(range(1, len(v) + 1)) AS place, unnest(v) AS value FROM (SELECT ticker, n AS length, list_concat(list_transform(range(2 * ((SELECT max(n) FROM g) - n)), lambda i: 0.0::DOUBLE), v, nodes) AS v FROM g)""",
       {"g": "SELECT ticker, count(*) AS n, flatten(list([close, volume::DOUBLE] ORDER BY date)) AS v, arg_max([close, volume::DOUBLE], date) AS nodes FROM bars_daily WHERE date > DATE '2001-07-25' - 60 AND date <= DATE '2001-07-25' GROUP BY ticker HAVING count(*) >= 0.1 * 60"})
def _(spark, sf):
    """Every value of the padded sequences, the node features after them."""
    s = features.sequences(fx.bars_daily(spark, sf), ["close", "volume"], "2001-07-25", 60, 0.1)
    v = F.concat(F.flatten("sequence"), "node_features")
    return s.select("ticker", F.col("length").cast("long").alias("length"), F.posexplode(v).alias("i", "value")).select("ticker", "length", (F.col("i") + 1).cast("long").alias("place"), "value")


@query("e6_targets", ("bars_daily",), "SELECT b.ticker, b.date, h.h AS horizon_days, round(t.close / b.close - 1, 6) AS target, (t.close IS NOT NULL)::INT AS mask FROM bars_daily b CROSS JOIN (SELECT unnest([1, 7, 30, 60]) AS h) h LEFT JOIN bars_daily t ON t.ticker = b.ticker AND t.date = b.date + h.h")
def _(spark, sf):
    return rounded(features.targets(fx.bars_daily(spark, sf)), 6)


@query("e7_neighbour_means", ("bars_daily", "metadata"), """SELECT a.ticker, b.date, round(sum(b.close) / count(b.close), 4) AS neighbour_close FROM metadata a JOIN metadata m ON m.sector = a.sector AND m.ticker <> a.ticker JOIN bars_daily b ON b.ticker = m.ticker GROUP BY a.ticker, b.date""")
def _(spark, sf):
    m = fx.metadata(spark, sf).select("ticker", "sector")
    e = m.withColumnRenamed("ticker", "src").join(m.withColumnRenamed("ticker", "dst"), "sector").filter("src != dst").select("src", "dst", F.lit(1.0).alias("weight"))
    return rounded(features.neighbour_means(fx.bars_daily(spark, sf).select("ticker", "date", "close"), e, ["close"]), 4)


RIDGE = {
    "own": f"SELECT ticker, date, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS r FROM bars_daily",
    "x": "SELECT o.ticker, o.date, o.r, n.m FROM own o JOIN (SELECT a.ticker, b.date, sum(b.r) / count(b.r) AS m FROM metadata a JOIN metadata q ON q.sector = a.sector AND q.ticker <> a.ticker JOIN own b ON b.ticker = q.ticker GROUP BY 1, 2) n ON n.ticker = o.ticker AND n.date = o.date WHERE o.r IS NOT NULL AND n.m IS NOT NULL",
    "dd": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM x)",
    "y": "SELECT x.*, h.h, t.close / b.close - 1 AS t, CASE WHEN i <= floor(n * 0.7) THEN 'train' WHEN i <= floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'validation' ELSE 'test' END AS split FROM x JOIN dd USING (date) CROSS JOIN (SELECT unnest([1, 7, 30, 60]) AS h) h JOIN bars_daily b ON b.ticker = x.ticker AND b.date = x.date JOIN bars_daily t ON t.ticker = x.ticker AND t.date = x.date + h.h",
    "c": "SELECT h, avg(r) AS ar, avg(m) AS am, avg(t) AS av, var_pop(r) + 0.01 AS rr, var_pop(m) + 0.01 AS mm, covar_pop(r, m) AS rm, covar_pop(r, t) AS rt, covar_pop(m, t) AS mt FROM y WHERE split = 'train' GROUP BY h",
    "w": "SELECT h, ar, am, av, (mm * rt - rm * mt) / (rr * mm - rm * rm) AS wr, (rr * mt - rm * rt) / (rr * mm - rm * rm) AS wm FROM c",
    "hits": "SELECT h, least(floor(abs(p) * 100), 9) AS bin, avg((sign(p) = sign(t))::INT) AS conf FROM (SELECT y.h, t, av + wr * (r - ar) + wm * (m - am) AS p FROM y JOIN w USING (h) WHERE split = 'validation') GROUP BY 1, 2",
}


@query("e8_return_model", ("bars_daily", "metadata"), "SELECT ticker, date AS prediction_date, h AS horizon_days, round(p, 4) AS predicted_return, round(coalesce(conf, 0.5), 4) AS confidence_score FROM (SELECT *, least(floor(abs(p) * 100), 9) AS bin FROM (SELECT x.ticker, x.date, w.h, av + wr * (r - ar) + wm * (m - am) AS p FROM x CROSS JOIN w)) LEFT JOIN hits USING (h, bin)", RIDGE)
def _(spark, sf):
    """Own and neighbours' returns of a day against the returns to come."""
    b, m = fx.bars_daily(spark, sf), fx.metadata(spark, sf).select("ticker", "sector")
    own = indicators.price_features(b).select("ticker", "date", "return_1")
    e = m.withColumnRenamed("ticker", "src").join(m.withColumnRenamed("ticker", "dst"), "sector").filter("src != dst").select("src", "dst", F.lit(1.0).alias("weight"))
    x = own.join(features.neighbour_means(own, e, ["return_1"]), ["ticker", "date"]).dropna()
    rows = features.temporal_split(x).join(features.targets(b), ["ticker", "date"])
    columns = ["return_1", "neighbour_return_1"]
    return rounded(features.predict_returns(x, features.fit_return_models(rows, columns, penalty=0.01), columns), 4)


@query("e5_edge_index", ("metadata",), "SELECT a.i AS src_index, b.i AS dst_index, 1.0::DOUBLE AS weight FROM t a JOIN t b ON a.sector = b.sector AND a.ticker <> b.ticker", {"t": "SELECT ticker, sector, row_number() OVER (ORDER BY ticker) - 1 AS i FROM metadata"})
def _(spark, sf):
    m = fx.metadata(spark, sf).select("ticker", "sector")
    e = m.withColumnRenamed("ticker", "src").join(m.withColumnRenamed("ticker", "dst"), "sector").filter("src != dst").select("src", "dst", F.lit(1.0).alias("weight"))
    return features.edge_index(e, m)


@query("g1_e7_graph_features", ("bars_daily", "metadata"), "SELECT w.src AS ticker, b.date, round(sum(w.weight * b.close) / sum(w.weight), 3) AS neighbour_close FROM w JOIN bars_daily b ON b.ticker = w.dst WHERE w.weight > 0.5 GROUP BY w.src, b.date", EDGES)
def _(spark, sf):
    b, m = fx.bars_daily(spark, sf), fx.metadata(spark, sf)
    e = graph.threshold(graph.edge_weights(m, graph.correlations(graph.padded_returns(b))), 0.5)
    return rounded(features.neighbour_means(b.select("ticker", "date", "close"), e, ["close"]), 3)
