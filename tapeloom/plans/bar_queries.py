"""Queries over bars: scans, roll-ups, filters, joins, windows and indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import corr_over, rounded, series
from tapeloom.operators import backfill, bars, indicators
from tapeloom.plans import fixtures as fx
from tapeloom.plans import indicator_sql as isql
from tapeloom.plans.registry import query

AS_OF, NEWS_AS_OF = "2001-08-01", "2024-01-30"
W = "(PARTITION BY ticker ORDER BY date)"


def roll(f: str, x: str, n: int, part: str = "ticker", order: str = "date") -> str:
    """SQL of a rolling aggregate with the null guard."""
    w = f"OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({x}) {w} >= {n} THEN {f}({x}) {w} END)"


A1 = "SELECT ticker, date, arg_min(open, datetime) AS open, max(high) AS high, min(low) AS low, arg_max(close, datetime) AS close, sum(volume)::BIGINT AS volume, arg_max(adjusted_close, datetime) AS adjusted_close, count(*) AS hours FROM bars_hourly WHERE hour BETWEEN 9 AND 15 GROUP BY ticker, date HAVING count(*) >= 6"


@query("flagship_daily_signal", ("bars_hourly",), f"""SELECT ticker, date, close, round(ret, 6) AS ret, round(sma_20, 6) AS sma_20, round(sma_20 + 2 * sd, 4) AS bb_upper, round(sma_20 - 2 * sd, 4) AS bb_lower,
 (CASE WHEN close > sma_20 + 2 * sd THEN 'SELL' WHEN close < sma_20 - 2 * sd THEN 'BUY' ELSE 'HOLD' END) AS flag
 FROM (SELECT *, close / nullif(lag(close) OVER {W}, 0) - 1 AS ret, {roll('avg', 'close', 20)} AS sma_20, {roll('stddev_pop', 'close', 20)} AS sd FROM daily)""", {"daily": A1})
def flagship(spark, sf, least_hours=6):
    """Ticks to hours to days, return, mean, bands and a flag."""
    b = indicators.bollinger(bars.hourly_to_daily(fx.bars_hourly(spark, sf), least_hours=least_hours))
    b = b.withColumn("ret", F.try_divide(F.col("close"), F.lag("close").over(series())) - 1)
    flag = F.when(F.col("bb_overbought") == 1, "SELL").when(F.col("bb_oversold") == 1, "BUY").otherwise("HOLD")
    return b.select("ticker", "date", "close", F.round("ret", 6).alias("ret"), F.round("bb_middle", 6).alias("sma_20"), F.round("bb_upper", 4).alias("bb_upper"), F.round("bb_lower", 4).alias("bb_lower"), flag.alias("flag"))


@query("a1_hourly_to_daily", ("bars_hourly",), A1)
def _(spark, sf):
    return bars.hourly_to_daily(fx.bars_hourly(spark, sf))


@query("a2_hourly_coverage", ("bars_hourly",), """SELECT ticker, count(DISTINCT date) AS days, count(DISTINCT hour) AS hours, count(*) AS records, round(avg(volume), 6) AS avg_volume, min(datetime) AS first_bar, max(datetime) AS last_bar,
 count(*) FILTER (hour BETWEEN 9 AND 15) AS regular_hours, count(*) FILTER (hour NOT BETWEEN 9 AND 15) AS extended_hours FROM bars_hourly GROUP BY ticker""")
def _(spark, sf):
    return rounded(bars.hourly_coverage(fx.bars_hourly(spark, sf)), 6)


@query("a3_quality_report", ("bars_daily",), """SELECT ticker, count(*) AS total_records, min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS unique_dates, count(*) FILTER (close IS NULL) AS null_close, count(*) FILTER (volume IS NULL) AS null_volume,
 count(*) FILTER (volume = 0) AS zero_volume, round(avg(high - low) / avg(close) * 100, 5) AS avg_range_pct, round(stddev(close) / avg(close) * 100, 5) AS price_cv_pct FROM bars_daily GROUP BY ticker""")
def _(spark, sf):
    return rounded(bars.quality_per_ticker(fx.bars_daily(spark, sf)), 5)


@query("a4_high_water", ("bars_daily",), "SELECT ticker, max(date) AS latest FROM bars_daily GROUP BY ticker")
def _(spark, sf):
    return bars.high_water(fx.bars_daily(spark, sf), "date", "ticker")


@query("a7_sector_performance", ("bars_daily", "metadata"), """SELECT sector, round(avg(ret) * 252, 6) AS annual_return, round(stddev(ret) * sqrt(252), 6) AS annual_volatility, count(DISTINCT ticker) AS tickers, round(avg(ret) * 252 / nullif(stddev(ret) * sqrt(252), 0), 6) AS sharpe
 FROM r JOIN metadata USING (ticker) GROUP BY sector""", {"r": f"SELECT ticker, close / nullif(lag(close) OVER {W}, 0) - 1 AS ret FROM bars_daily"})
def _(spark, sf):
    return rounded(bars.sector_returns(fx.bars_daily(spark, sf), fx.metadata(spark, sf)), 6)


@query("a8_sector_risk", ("bars_daily", "metadata"), """SELECT sector, round(stddev(ret) * sqrt(252), 6) AS volatility, round(quantile_cont(ret, 0.05), 6) AS var_95, round(quantile_cont(ret, 0.01), 6) AS var_99, round(min(ret), 6) AS worst_day, round(max(ret), 6) AS best_day
 FROM r JOIN metadata USING (ticker) GROUP BY sector""", {"r": f"SELECT ticker, close / nullif(lag(close) OVER {W}, 0) - 1 AS ret FROM bars_daily"})
def _(spark, sf):
    return rounded(bars.sector_risk(fx.bars_daily(spark, sf), fx.metadata(spark, sf)), 6)


@query("a9_coverage_by_month", ("bars_daily",), "SELECT ticker, date_trunc('month', date)::DATE AS month, count(*) AS bars FROM bars_daily GROUP BY 1, 2")
def _(spark, sf):
    return bars.coverage_by_month(fx.bars_daily(spark, sf))


@query("a10_symbol_summary", ("bars_daily",), "SELECT ticker, min(date) AS first, max(date) AS last, count(*) AS records, max(date) - min(date) AS days FROM bars_daily GROUP BY ticker")
def _(spark, sf):
    return bars.symbol_summary(fx.bars_daily(spark, sf))


@query("a11_overall_summary", ("bars_daily",), "SELECT count(*) AS symbols, sum(n)::BIGINT AS records, min(f) AS first, max(l) AS last FROM (SELECT ticker, count(*) AS n, min(date) AS f, max(date) AS l FROM bars_daily GROUP BY ticker)")
def _(spark, sf):
    return bars.overall_summary(bars.symbol_summary(fx.bars_daily(spark, sf)))


@query("a14_price_statistics", ("bars_daily",), "SELECT round(avg(close), 4) AS avg_close, min(close) AS min_close, max(close) AS max_close, round(stddev(close), 3) AS std_close, round(avg(volume), 6) AS avg_volume, max(volume) AS max_volume FROM bars_daily WHERE close > 0")
def _(spark, sf):
    return rounded(bars.price_statistics(fx.bars_daily(spark, sf)), {"avg_close": 4, "std_close": 3})


@query("a19_pivot_close", ("bars_daily",), "SELECT date, max(close) FILTER (ticker = 'NATION_3') AS NATION_3, max(close) FILTER (ticker = 'NATION_7') AS NATION_7, max(close) FILTER (ticker = 'NATION_11') AS NATION_11 FROM bars_daily GROUP BY date")
def _(spark, sf):
    return bars.return_matrix(fx.bars_daily(spark, sf), ["NATION_3", "NATION_7", "NATION_11"])


@query("a21_table_summary", ("bars_daily", "bars_hourly"), """SELECT 'bars_daily' AS table_name, count(DISTINCT ticker) AS tickers, count(DISTINCT date) AS dates, min(date) AS first, max(date) AS last, count(*) AS records FROM bars_daily
 UNION ALL SELECT 'bars_hourly', count(DISTINCT ticker), count(DISTINCT date), min(date), max(date), count(*) FROM bars_hourly""")
def _(spark, sf):
    return bars.table_summary({"bars_daily": fx.bars_daily(spark, sf), "bars_hourly": fx.bars_hourly(spark, sf)})


@query("a22_tickers", ("metadata",), "SELECT DISTINCT ticker, sector, name FROM metadata ORDER BY ticker")
def _(spark, sf):
    return fx.metadata(spark, sf).select("ticker", "sector", "name").distinct().orderBy("ticker")


# --- sources, preparation, filters, sets ---


@query("s1_parameter_query", (), "SELECT o_orderpriority, count(*) AS orders FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_totalprice > 100000 GROUP BY o_orderpriority")
def _(spark, sf):
    from tapeloom.sources.files import query as run

    fx.table(spark, sf, "orders").createOrReplaceTempView("orders_to_query")
    return run(spark, "SELECT o_orderpriority, count(*) AS orders FROM orders_to_query WHERE o_orderdate >= :start AND o_totalprice > :least GROUP BY o_orderpriority", start="1997-01-01", least=100000)


@query("s2_filtered_scan", (), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice >= 200000 AND o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def _(spark, sf):
    from tapeloom.sources.files import scan

    return scan(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_totalprice"], [("o_orderstatus", "in", ["F", "P"]), ("o_totalprice", ">=", 200000)], ("1996-01-01", "1996-12-31"), "o_orderdate")


@query("s3_latest_partition", ("bars_daily",), "SELECT ticker, date, close FROM bars_daily WHERE date = (SELECT max(date) FROM bars_daily)")
def _(spark, sf):
    return bars.at_latest(fx.bars_daily(spark, sf).select("ticker", "date", "close"), "date")


@query("s4_partitions", (), "SELECT DISTINCT o_orderpriority FROM orders ORDER BY 1")
def _(spark, sf):
    from tapeloom.sources.files import partitions

    return partitions(spark, f"{sf}/orders.parquet", "o_orderpriority")


@query("s5_dataset_info", (), "SELECT count(*) AS records, true AS has_files, true AS has_bytes FROM orders")
def _(spark, sf):
    from tapeloom.sources.files import dataset_info

    # SQL can't see files, so it tells rows alone
    return dataset_info(fx.table(spark, sf, "orders")).select("records", (F.col("files") > 0).alias("has_files"), (F.col("bytes") > 0).alias("has_bytes"))


@query("s6_daily_payload", ("bars_daily",), "SELECT ticker, date, open, high, low, close, adjusted_close, volume FROM bars_daily")
def _(spark, sf):
    from tapeloom.sources.payloads import daily

    raw = fx.payload_texts(fx.bars_daily(spark, sf), "date", "Time Series (Daily)", fx.DAILY, "year")
    return daily(raw).drop("dividend_amount", "split_coefficient")


@query("s7_hourly_payload", ("bars_hourly",), "SELECT ticker, datetime, date, hour, open, close, adjusted_close, volume FROM bars_hourly")
def _(spark, sf):
    from tapeloom.sources.payloads import hourly

    raw = fx.payload_texts(fx.bars_hourly(spark, sf), "datetime", "Time Series (60min)", fx.INTRADAY, "month")
    return hourly(raw).select("ticker", "datetime", "date", "hour", "open", "close", "adjusted_close", "volume")


@query("s9_economic_payload", ("macro_long",), "SELECT date, value, indicator FROM macro_long WHERE indicator = 'gdp'")
def _(spark, sf):
    from tapeloom.sources.payloads import economic

    m = fx.macro_long(spark, sf).filter("indicator = 'gdp'")
    raw = m.groupBy(F.year("date")).agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("date").cast("string").alias("date"), F.col("value").cast("string").alias("value"))).alias("data"))).alias("value"))
    return economic(raw, "gdp")


PAGE = 1000  # articles of a feed page, about


def _pages(news):
    """Page of each article; their number follows the table, so that no page grows with it."""
    return F.pmod(F.xxhash64("event_id", "title", "timestamp"), F.lit(news.count() // PAGE + 1))


@query("s10_news_payload", ("sentiment",), "SELECT symbol, count(*) AS articles, round(avg(overall_sentiment_score), 6) AS score FROM sentiment GROUP BY symbol")
def _(spark, sf):
    from tapeloom.sources.payloads import news

    n = fx.sentiment(spark, sf)
    own = F.array(F.struct(F.col("symbol").alias("ticker"), F.lit("0.5").alias("relevance_score"), F.col("overall_sentiment_score").cast("string").alias("ticker_sentiment_score")))
    a = n.withColumn("bucket", _pages(n)).groupBy(F.col("symbol").alias("ticker"), "bucket").agg(F.collect_list(F.struct("title", F.date_format("timestamp", "yyyyMMdd'T'HHmmss").alias("time_published"), F.lit("wire").alias("source"), "overall_sentiment_score", own.alias("ticker_sentiment"))).alias("feed"))
    got = news(a.select("ticker", F.to_json(F.struct("feed")).alias("value")))
    return got.groupBy("symbol").agg(F.count("*").alias("articles"), F.round(F.avg("overall_sentiment_score"), 6).alias("score"))


@query("s14_constituents", ("metadata",), "SELECT DISTINCT ticker FROM metadata WHERE ticker NOT LIKE '%.%' ORDER BY ticker")
def _(spark, sf):
    from tapeloom.sources.files import constituents

    return constituents(fx.metadata(spark, sf), "ticker")


RAW = "SELECT ticker, date::VARCHAR AS date, close::VARCHAR AS close, seq FROM (SELECT n_name AS ticker, o_orderdate::DATE AS date, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS close, o_orderkey AS seq FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"


@query("p1_daily_normalise", (), "SELECT ticker, date::DATE AS date, close::DOUBLE AS close FROM raw QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY seq DESC) = 1", {"raw": RAW})
def _(spark, sf):
    bad = F.when(F.col("seq") % 7 == 0, "n/a").otherwise(F.col("price").cast("string"))
    raw = fx.trades(spark, sf).select("ticker", F.col("date").cast("string").alias("date"), *[bad.alias(c) for c in bars.PRICES], F.lit("1").alias("volume"), "seq")
    return bars.normalise_daily(raw, "seq").select("ticker", "date", "close")


@query("p2_hourly_normalise", ("ticks",), "SELECT ticker, date_trunc('hour', ts) AS datetime, date_trunc('hour', ts)::DATE AS date, hour(ts)::INT AS hour, price AS close FROM ticks QUALIFY row_number() OVER (PARTITION BY ticker, date_trunc('hour', ts) ORDER BY seq DESC) = 1")
def _(spark, sf):
    t = fx.ticks(spark, sf)
    raw = t.select("ticker", F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("datetime"), *[F.col("price").cast("string").alias(c) for c in bars.PRICES], F.lit("1").alias("volume"), "seq")
    return bars.normalise_hourly(raw, "seq").select("ticker", "datetime", "date", "hour", "close")


@query("p3_map_columns", ("bars_hourly",), "SELECT ticker AS symbol, datetime AS timestamp, open, high, low, close, NULL::DOUBLE AS adjusted_close, volume, NULL::DOUBLE AS dividend_amount, NULL::DOUBLE AS split_coefficient, year(datetime)::INT AS year, month(datetime)::INT AS month FROM bars_hourly")
def _(spark, sf):
    names = {"open": "1. open", "high": "2. high", "low": "3. low", "close": "4. close", "volume": "5. volume", "ticker": "symbol", "datetime": "timestamp"}
    return bars.map_columns(fx.bars_hourly(spark, sf).drop("adjusted_close").withColumnsRenamed(names))


@query("p4_concat_months", ("ticks",), "SELECT ticker, date_trunc('hour', ts) AS hour, seq FROM ticks QUALIFY row_number() OVER (PARTITION BY ticker, date_trunc('hour', ts) ORDER BY seq) = 1")
def _(spark, sf):
    t = fx.ticks(spark, sf).select("ticker", F.date_trunc("hour", "ts").alias("hour"), "seq")
    return bars.concat_months([t.filter("seq % 2 = 0"), t.filter("seq % 2 = 1")], ["ticker", "hour"], "seq")


@query("p7_sector_enrichment", ("bars_daily", "metadata"), "SELECT ticker, date, close, sector FROM bars_daily LEFT JOIN metadata USING (ticker)")
def _(spark, sf):
    return fx.bars_daily(spark, sf).select("ticker", "date", "close").join(fx.metadata(spark, sf).select("ticker", "sector"), "ticker", "left")


@query("f1_date_range_tickers", ("bars_daily",), "SELECT ticker, date, close FROM bars_daily WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-06-30' AND ticker IN ('NATION_2', 'NATION_5')")
def _(spark, sf):
    b = fx.bars_daily(spark, sf).select("ticker", "date", "close")
    return bars.of_tickers(bars.between_dates(b, "1997-01-01", "1997-06-30"), ["NATION_2", "NATION_5"])


@query("f3_last_days", ("bars_daily",), f"SELECT ticker, date, close FROM bars_daily WHERE date >= DATE '{AS_OF}' - 90")
def _(spark, sf):
    return bars.last_days(fx.bars_daily(spark, sf).select("ticker", "date", "close"), AS_OF, 90)


@query("f5_newer_than_mark", ("bars_daily",), "SELECT b.ticker, b.date, b.close FROM bars_daily b LEFT JOIN (SELECT ticker, max(date) AS l FROM bars_daily WHERE date < DATE '2000-01-01' AND ticker <> 'NATION_2' GROUP BY ticker) m USING (ticker) WHERE m.l IS NULL OR b.date > m.l")
def _(spark, sf):
    b = fx.bars_daily(spark, sf).select("ticker", "date", "close")
    return bars.newer_than_mark(b, b.filter("date < '2000-01-01' AND ticker <> 'NATION_2'"), "ticker", "date")


@query("f6_trading_hours", ("bars_hourly",), "SELECT ticker, datetime, close FROM bars_hourly WHERE hour BETWEEN 9 AND 15")
def _(spark, sf):
    return fx.bars_hourly(spark, sf).filter(F.col("hour").between(9, 15)).select("ticker", "datetime", "close")


@query("f8_enough_history", ("bars_daily",), "SELECT ticker, count(*) AS n FROM bars_daily GROUP BY ticker HAVING count(*) >= 500")
def _(spark, sf):
    return bars.enough_history(fx.bars_daily(spark, sf), 500).groupBy("ticker").agg(F.count("*").alias("n"))


@query("f9_rule_violations", ("bars_daily",), "SELECT 'wide' AS rule, count(*) FILTER (NOT (high <= low * 1.5)) AS broken FROM bars_daily UNION ALL SELECT 'cheap', count(*) FILTER (NOT (close > 50000)) FROM bars_daily")
def _(spark, sf):
    return bars.violations(fx.bars_daily(spark, sf), {"wide": "high <= low * 1.5", "cheap": "close > 50000"})


@query("f10_sector_subset", ("bars_daily", "metadata"), "SELECT ticker, date, close FROM bars_daily WHERE ticker IN (SELECT ticker FROM metadata WHERE sector = 'ASIA')")
def _(spark, sf):
    return bars.of_group(fx.bars_daily(spark, sf).select("ticker", "date", "close"), fx.metadata(spark, sf), "ASIA")


@query("j5_anti_join", ("bars_daily",), "SELECT ticker, date FROM bars_daily b WHERE NOT EXISTS (SELECT 1 FROM bars_hourly h WHERE h.date = b.date) AND date >= DATE '2000-01-01'", {"bars_hourly": "SELECT DISTINCT o_orderdate::DATE AS date FROM orders WHERE o_orderkey % 3 = 0"})
def _(spark, sf):
    have = fx.table(spark, sf, "orders").filter("o_orderkey % 3 = 0").select(F.to_date("o_orderdate").alias("date")).distinct()
    return fx.bars_daily(spark, sf).filter("date >= '2000-01-01'").select("ticker", "date").join(have, "date", "left_anti")


@query("q19_missing_business_days", ("bars_daily",), """SELECT t.ticker, d.date FROM (SELECT DISTINCT ticker FROM bars_daily) t CROSS JOIN (SELECT unnest(generate_series(DATE '1998-01-01', DATE '1998-01-30', INTERVAL 1 DAY))::DATE AS date) d
 LEFT JOIN bars_daily b ON b.ticker = t.ticker AND b.date = d.date WHERE isodow(d.date) <= 5 AND b.ticker IS NULL""")
def _(spark, sf):
    return bars.missing_business_days(fx.bars_daily(spark, sf), "1998-01-01", "1998-01-30")


@query("t7_last_rows", ("bars_daily",), "SELECT ticker, date, close FROM bars_daily QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 5")
def _(spark, sf):
    return bars.last_per_key(fx.bars_daily(spark, sf).select("ticker", "date", "close"), 5)


@query("u1_union_distinct", ("bars_daily", "ticks"), "SELECT DISTINCT ticker FROM (SELECT ticker FROM bars_daily UNION ALL SELECT ticker FROM ticks)")
def _(spark, sf):
    return fx.bars_daily(spark, sf).select("ticker").unionByName(fx.ticks(spark, sf).select("ticker")).distinct()


# --- windows and indicators ---


@query("w3_lead_lag_returns", ("bars_daily",), f"SELECT ticker, date, " + ", ".join(f"round(lead(close, {n}) OVER {W} / close - 1, 6) AS fwd_{n}" for n in (1, 7, 30, 60)) + f", round(close / lag(close) OVER {W} - 1, 6) AS ret FROM bars_daily")
def _(spark, sf):
    w = series()
    x = F.col("close")
    return fx.bars_daily(spark, sf).select("ticker", "date", *[F.round(F.try_divide(F.lead(x, n).over(w), x) - 1, 6).alias(f"fwd_{n}") for n in (1, 7, 30, 60)], F.round(F.try_divide(x, F.lag(x).over(w)) - 1, 6).alias("ret"))


@query("w7_rolling_corr", ("bars_daily",), """SELECT ticker, date, CASE WHEN count(r) OVER w >= 20 AND count(v) OVER w >= 20 AND min(r) OVER w < max(r) OVER w AND min(v) OVER w < max(v) OVER w THEN round(corr(r, v) OVER w, 5) END AS pv_corr
 FROM r WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""", {"r": f"SELECT ticker, date, close / lag(close) OVER {W} - 1 AS r, volume / lag(volume) OVER {W} - 1 AS v FROM bars_daily"})
def _(spark, sf):
    w = series()
    b = fx.bars_daily(spark, sf).withColumns({"r": F.try_divide(F.col("close"), F.lag("close").over(w)) - 1, "v": F.try_divide(F.col("volume").cast("double"), F.lag("volume").over(w)) - 1})
    return b.select("ticker", "date", F.round(corr_over(F.col("r"), F.col("v"), w, 20), 5).alias("pv_corr"))


@query("w12_forward_fill", ("bars_daily",), "SELECT ticker, date, last_value(c IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS filled FROM (SELECT ticker, date, CASE WHEN volume > 1 THEN close END AS c FROM bars_daily)")
def _(spark, sf):
    b = fx.bars_daily(spark, sf).withColumn("c", F.when(F.col("volume") > 1, F.col("close")))
    return b.select("ticker", "date", F.last("c", True).over(series().rowsBetween(-3, 0)).alias("filled"))


CROSS = f"(sma_50 > sma_200) AS up FROM s"


@query("i4_sma", ("bars_daily",), f"""SELECT ticker, date, round(sma_20, 6) AS sma_20, round(sma_50, 6) AS sma_50, round(sma_200, 6) AS sma_200, round(close / sma_20 - 1, 6) AS close_to_sma_20,
 coalesce(up AND NOT lag(up) OVER {W}, false)::INT AS golden_cross, coalesce(NOT up AND lag(up) OVER {W}, false)::INT AS death_cross FROM (SELECT *, {CROSS})""", {"s": "SELECT *, " + ", ".join(f"{roll('avg', 'close', n)} AS sma_{n}" for n in (20, 50, 200)) + " FROM bars_daily"})
def _(spark, sf):
    return rounded(indicators.sma(fx.bars_daily(spark, sf)).select("ticker", "date", "sma_20", "sma_50", "sma_200", "close_to_sma_20", "golden_cross", "death_cross"), 6)


@query("i6_bollinger", ("bars_daily",), f"""SELECT ticker, date, round(m, 6) AS bb_middle, round(m + 2 * sd, 3) AS bb_upper, round(m - 2 * sd, 3) AS bb_lower, round(4 * sd / m * 100, 5) AS bb_width, round((close - m + 2 * sd) / nullif(4 * sd, 0), 5) AS bb_percent,
 coalesce(close > m + 2 * sd, false)::INT AS bb_overbought, coalesce(close < m - 2 * sd, false)::INT AS bb_oversold FROM s""", {"s": f"SELECT *, {roll('avg', 'close', 20)} AS m, {roll('stddev_pop', 'close', 20)} AS sd FROM bars_daily"})
def _(spark, sf):
    b = indicators.bollinger(fx.bars_daily(spark, sf)).select("ticker", "date", "bb_middle", "bb_upper", "bb_lower", "bb_width", "bb_percent", "bb_overbought", "bb_oversold")
    return rounded(b, {"bb_middle": 6, "bb_upper": 3, "bb_lower": 3, "bb_width": 5, "bb_percent": 5})


@query("i10_vwap", ("bars_hourly",), """SELECT ticker, datetime, round(v, 6) AS vwap, round((close - v) / nullif(v, 0) * 100, 6) AS vwap_deviation FROM
 (SELECT ticker, datetime, close, sum((high + low + close) / 3 * volume) OVER w / nullif(sum(volume) OVER w, 0) AS v FROM bars_hourly WINDOW w AS (PARTITION BY ticker, date ORDER BY datetime ROWS UNBOUNDED PRECEDING))""")
def _(spark, sf):
    return rounded(indicators.vwap(fx.bars_hourly(spark, sf), "datetime").select("ticker", "datetime", "vwap", "vwap_deviation"), 6)


@query("i11_price_features", ("bars_daily",), f"""SELECT ticker, date, round(return_1, 6) AS return_1, round(close / lag(close, 5) OVER {W} - 1, 6) AS return_5, round(close / lag(close, 20) OVER {W} - 1, 6) AS return_20, round(high / low, 6) AS high_low_ratio, round(close / high, 6) AS close_to_high, round(close / low, 6) AS close_to_low,
 h AS high_20, l AS low_20, round((close - l) / nullif(h - l, 0), 6) AS price_position, round({roll('stddev_samp', 'return_1', 20)}, 6) AS volatility_20, round({roll('stddev_samp', 'return_1', 60)}, 6) AS volatility_60,
 round(close - lag(close, 10) OVER {W}, 4) AS momentum_10, round(close - lag(close, 30) OVER {W}, 4) AS momentum_30 FROM s""", {"s": f"SELECT *, close / lag(close) OVER {W} - 1 AS return_1, {roll('max', 'high', 20)} AS h, {roll('min', 'low', 20)} AS l FROM bars_daily"})
def _(spark, sf):
    b = indicators.price_features(fx.bars_daily(spark, sf)).drop("open", "high", "low", "close", "volume", "adjusted_close")
    return rounded(b, {"momentum_10": 4, "momentum_30": 4})


@query("i12_volume_features", ("bars_daily",), f"""SELECT ticker, date, round(volume / lag(volume) OVER {W} - 1, 6) AS volume_change, round({roll('avg', 'volume', 10)}, 6) AS volume_ma_10, round(m, 6) AS volume_ma_20, round(volume / nullif(m, 0), 6) AS volume_ratio, coalesce(volume > m + 2 * sd, false)::INT AS volume_spike
 FROM s""", {"s": f"SELECT *, {roll('avg', 'volume', 20)} AS m, {roll('stddev_samp', 'volume', 20)} AS sd FROM bars_daily"})
def _(spark, sf):
    return rounded(indicators.volume_features(fx.bars_daily(spark, sf)).select("ticker", "date", "volume_change", "volume_ma_10", "volume_ma_20", "volume_ratio", "volume_spike"), 6)


@query("i13_lag_features", ("bars_daily",), f"""SELECT ticker, date, lag(close, 1) OVER {W} AS close_lag_1, lag(close, 5) OVER {W} AS close_lag_5, lag(close, 10) OVER {W} AS close_lag_10, lag(close, 20) OVER {W} AS close_lag_20,
 """ + ", ".join(f"round({roll('avg', 'close', n)}, 6) AS close_mean_{n}, round({roll('stddev_samp', 'close', n)}, 3) AS close_std_{n}" for n in (5, 10, 20)) + f", round(close - lag(close, 1) OVER {W}, 4) AS close_diff_1, round(close - lag(close, 5) OVER {W}, 4) AS close_diff_5 FROM bars_daily")
def _(spark, sf):
    b = indicators.lag_features(fx.bars_daily(spark, sf), ["close"]).drop("open", "high", "low", "close", "volume", "adjusted_close")
    return rounded(b, {"close_diff_1": 4, "close_diff_5": 4, "close_std_5": 3, "close_std_10": 3, "close_std_20": 3})


@query("i14_indicator_statistics", ("bars_daily",), " UNION ALL ".join(f"SELECT '{c}' AS indicator, count(*) AS records, count(*) FILTER ({c} IS NULL) AS null_count, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 4) AS mean, round(stddev({c}), 3) AS std, 0 AS infinite_count FROM bars_daily" for c in ("close", "volume")))
def _(spark, sf):
    return rounded(indicators.statistics(fx.bars_daily(spark, sf), ["close", "volume"]), {"mean": 4, "std": 3})


# recursions in SQL: one row of a series after the other
RECURSE = {
    "b": f"SELECT *, row_number() OVER {W} AS i, close - lag(close) OVER {W} AS d FROM bars_daily",
    "e": """SELECT ticker, date, i, close::DOUBLE AS e9, close::DOUBLE AS e12, close::DOUBLE AS e26 FROM b WHERE i = 1
 UNION ALL SELECT b.ticker, b.date, b.i, e.e9 + 0.2 * (b.close - e.e9), e.e12 + (2.0 / 13) * (b.close - e.e12), e.e26 + (2.0 / 27) * (b.close - e.e26) FROM e JOIN b ON b.ticker = e.ticker AND b.i = e.i + 1""",
    "w0": "SELECT ticker, avg(greatest(d, 0)) AS g, avg(greatest(-d, 0)) AS l FROM b WHERE i BETWEEN 2 AND 15 GROUP BY ticker HAVING count(*) = 14",
    "w": """SELECT ticker, 15::BIGINT AS i, g, l FROM w0
 UNION ALL SELECT b.ticker, b.i, w.g + (greatest(b.d, 0) - w.g) / 14, w.l + (greatest(-b.d, 0) - w.l) / 14 FROM w JOIN b ON b.ticker = w.ticker AND b.i = w.i + 1""",
}


@query("i2_i3_i5_recursions", ("bars_daily",), """SELECT e.ticker, e.date, round(CASE WHEN e.i >= 9 THEN e9 END, 3) AS ema_9, round(CASE WHEN e.i >= 26 THEN e12 - e26 END, 3) AS macd, round(100 * CASE WHEN w.g + w.l > 0 THEN w.g / (w.g + w.l) WHEN w.g IS NOT NULL THEN 0.5 END, 5) AS rsi_14
 FROM e LEFT JOIN w ON w.ticker = e.ticker AND w.i = e.i""", RECURSE, recursive=True)
def _(spark, sf):
    b = indicators.recursive_indicators(fx.bars_daily(spark, sf)).select("ticker", "date", "ema_9", "macd", "rsi_14")
    return rounded(b, {"ema_9": 3, "macd": 3, "rsi_14": 5})


def _exact(df):
    """All but the bars as doubles, in decimals in which Spark and SQL agree."""
    own = (*isql.BARS, "datetime", "hour")
    return df.select(*[F.col(c) if c in own else F.round(F.col(c).cast("double"), isql.digits(c)).alias(c) for c in df.columns])


DAILY = [*isql.BARS, "rsi_14", "ema_9", "ema_20", "ema_50", "macd", "macd_signal", "macd_hist", "atr_14", "adx", "adx_plus", "adx_minus", "obv", "obv_ema", "rsi_oversold", "rsi_overbought", "close_to_ema_9", "close_to_ema_20", "close_to_ema_50", "atr_14_percent", "ema_9_20_cross", "macd_cross_above", "macd_cross_below", "adx_strong", "adx_weak", "obv_trend"]
MORE = ["sma_20", "sma_50", "sma_200", "close_to_sma_20", "close_to_sma_50", "close_to_sma_200", "golden_cross", "death_cross", "bb_middle", "bb_upper", "bb_lower", "bb_width", "bb_percent", "bb_squeeze", "bb_overbought", "bb_oversold", "vwap", "vwap_deviation", "return_1", "return_5", "return_20", "high_low_ratio", "close_to_high", "close_to_low", "high_20", "low_20", "momentum_10", "momentum_30", "price_position", "volatility_20", "volatility_60", "volume_change", "volume_ma_10", "volume_ma_20", "volume_ratio", "price_volume_corr", "volume_spike"]


@query("i1_all_indicators", ("bars_daily",), isql.final(DAILY + MORE), isql.daily("bars_daily"), recursive=True)
def _(spark, sf):
    return _exact(indicators.all_indicators(fx.bars_daily(spark, sf)))


@query("i7_i8_ranges", ("bars_daily",), isql.final(["ticker", "date", "atr_14", "adx", "adx_plus", "adx_minus"], "rec"), isql.recursion("bars_daily"), recursive=True)
def _(spark, sf):
    return _exact(indicators.recursive_indicators(fx.bars_daily(spark, sf)).select("ticker", "date", "atr_14", "adx", "adx_plus", "adx_minus"))


@query("i9_obv", ("bars_daily",), f"SELECT ticker, date, sum(coalesce(sign(d), 0) * volume) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)::DOUBLE AS obv FROM (SELECT *, close - lag(close) OVER {W} AS d FROM bars_daily)")
def _(spark, sf):
    return indicators.recursive_indicators(fx.bars_daily(spark, sf)).select("ticker", "date", "obv")


HOURLY = ["ticker", "datetime", "date", "hour", "open", "high", "low", "close", "volume", "adjusted_close", "rsi_14h", "rsi_98h", "ema_12h", "ema_84h", "ema_182h", "macd", "macd_signal", "macd_hist", "atr_14h", "atr_98h", "adx", "adx_plus", "adx_minus", "obv", "obv_ema", "rsi_oversold", "rsi_overbought", "rsi_oversold_98", "rsi_overbought_98", "close_to_ema_12", "close_to_ema_84", "close_to_ema_182", "atr_14_percent", "atr_98_percent", "macd_cross_above", "macd_cross_below", "adx_strong", "adx_weak", "obv_trend", "sma_20h", "sma_140h", "sma_350h", "close_to_sma_20h", "close_to_sma_140h", "close_to_sma_350h", "golden_cross", "death_cross", "bb_upper_20h", "bb_middle_20h", "bb_lower_20h", "bb_upper_140h", "bb_middle_140h", "bb_lower_140h", "hour_of_day", "is_market_open", "is_first_hour", "is_last_hour", "high_of_day", "low_of_day", "pct_from_high", "pct_from_low"]


@query("i15_hourly_indicators", ("bars_hourly",), isql.final(HOURLY), isql.hourly("bars_hourly"), recursive=True)
def _(spark, sf):
    return _exact(indicators.hourly_indicators(fx.bars_hourly(spark, sf)))


@query("i16_intraday_position", ("bars_hourly",), """SELECT ticker, datetime, hour AS hour_of_day, (hour BETWEEN 9 AND 15)::INT AS is_market_open, (row_number() OVER w = 1)::INT AS is_first_hour, (lead(datetime) OVER w IS NULL)::INT AS is_last_hour, max(high) OVER s AS high_of_day, min(low) OVER s AS low_of_day,
 round((close - max(high) OVER s) / max(high) OVER s * 100, 6) AS pct_from_high, round((close - min(low) OVER s) / nullif(min(low) OVER s, 0) * 100, 6) AS pct_from_low
 FROM bars_hourly WINDOW w AS (PARTITION BY ticker, date ORDER BY datetime), s AS (PARTITION BY ticker, date ORDER BY datetime ROWS UNBOUNDED PRECEDING)""")
def _(spark, sf):
    return rounded(indicators.intraday_position(fx.bars_hourly(spark, sf)).drop("date", "hour", "open", "high", "low", "close", "volume", "adjusted_close"), 6)


@query("i17_indicator_refresh", ("bars_daily",), isql.final(DAILY + MORE) + " QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 5",
       {"late": f"SELECT * FROM bars_daily WHERE date >= DATE '{AS_OF}' - 200 AND ticker IN (SELECT ticker FROM bars_daily WHERE date >= DATE '2001-07-25')", "many": "SELECT * FROM late QUALIFY count(*) OVER (PARTITION BY ticker) >= 20"} | isql.daily("many"), recursive=True)
def _(spark, sf):
    b = fx.bars_daily(spark, sf)
    return _exact(indicators.refresh(b, b.filter("date >= '2001-07-25'"), AS_OF))


@query("b3_b4_pending_months", (), """SELECT s.symbol, year(m)::INT AS year, month(m)::INT AS month, 'daily' AS data_type FROM (SELECT DISTINCT n_name AS symbol FROM nation) s CROSS JOIN (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 MONTH)) AS m)
 ANTI JOIN (SELECT DISTINCT n_name AS symbol, year(o_orderdate) AS y, month(o_orderdate) AS mo FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey % 11 = 0) d ON d.symbol = s.symbol AND d.y = year(m) AND d.mo = month(m)""")
def _(spark, sf):
    t = fx.trades(spark, sf)
    done = t.filter("seq % 11 = 0").select(F.col("ticker").alias("symbol"), F.year("date").alias("year"), F.month("date").alias("month"), F.lit("daily").alias("data_type"), F.lit("completed").alias("status"))
    return backfill.pending(fx.table(spark, sf, "nation").select(F.col("n_name").alias("symbol")), done, "1995-01-01", "2001-08-01", "daily")


@query("b5_progress_eta", (), """SELECT backfill_id, round(100.0 * d / n, 6) AS percent, round(d / nullif(h, 0), 6) AS months_per_hour, round((n - d) / nullif(d / nullif(h, 0), 0), 4) AS hours_left
 FROM (SELECT o_orderpriority AS backfill_id, count(*) FILTER (o_orderkey % 3 = 0) AS d, count(*) AS n, date_diff('day', min(o_orderdate), max(o_orderdate)) * 24.0 AS h FROM orders GROUP BY 1)""")
def _(spark, sf):
    o = fx.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("backfill_id")).agg(F.count_if(F.col("o_orderkey") % 3 == 0).alias("months_done"), F.count("*").alias("months_total"), F.min("o_orderdate").alias("started_at"), F.max("o_orderdate").alias("updated_at"))
    return rounded(backfill.progress_eta(o.withColumns({c: F.col(c).cast("timestamp") for c in ("started_at", "updated_at")})).select("backfill_id", "percent", "months_per_hour", "hours_left"), {"percent": 6, "months_per_hour": 6, "hours_left": 4})


@query("b8_batches", ("metadata",), "SELECT ticker, (row_number() OVER (ORDER BY ticker) - 1) // 10 AS batch FROM metadata")
def _(spark, sf):
    return backfill.batches(fx.metadata(spark, sf), 10)
