"""Market inputs derived from the given tables, in Spark and as SQL.

Each fixture is a function of (spark, folder) and a named piece of SQL; `with_sql` puts the pieces that a
query needs before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions import series


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ticks(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("ticker"), "ts", F.col("value").alias("price"), F.col("event_id").alias("seq"))


def bars_hourly(spark, sf) -> DataFrame:
    from tapeloom.operators.bars import ticks_to_bars

    b = ticks_to_bars(ticks(spark, sf), ["ticker", F.date_trunc("hour", "ts").alias("datetime")], ["ts", "seq"])
    return b.select("ticker", "datetime", F.to_date("datetime").alias("date"), F.hour("datetime").alias("hour"), "open", "high", "low", "close", "volume", F.col("close").alias("adjusted_close"))


def trades(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joined.select(F.col("n_name").alias("ticker"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("seq"))


def bars_daily(spark, sf) -> DataFrame:
    from tapeloom.operators.bars import ticks_to_bars

    return ticks_to_bars(trades(spark, sf), ["ticker", "date"], ["seq"]).withColumn("adjusted_close", F.col("close"))


def metadata(spark, sf) -> DataFrame:
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    cap = F.element_at(F.array(*map(F.lit, ("large", "mid", "etf"))), (F.col("n_nationkey") % 3 + 1).cast("int"))
    sub = F.concat(F.lit("sub_"), (F.col("n_nationkey") % 2).cast("string"))
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("ticker"), F.concat(F.lit("Fund "), "n_name").alias("name"), F.col("r_name").alias("sector"), cap.alias("market_cap"), sub.alias("sub_industry"))


def sentiment(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").alias("timestamp"), F.col("props").alias("title"), ((F.col("event_id") * 37 % 201 - 100) / 100).alias("overall_sentiment_score"), "event_id")


INDICATORS = {"1-URGENT": "gdp", "2-HIGH": "unemployment_rate", "3-MEDIUM": "cpi", "4-NOT SPECIFIED": "consumer_confidence", "5-LOW": "treasury_10y"}


def macro_long(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    name = F.create_map(*[F.lit(x) for kv in INDICATORS.items() for x in kv])
    month = F.to_date(F.date_trunc("month", "o_orderdate"))
    return o.groupBy(month.alias("date"), "o_orderpriority").agg(F.avg("o_totalprice").alias("value")).select("date", F.coalesce(name[F.col("o_orderpriority")], F.col("o_orderpriority")).alias("indicator"), "value")


def predictions(spark, sf) -> DataFrame:
    """Trailing returns over h rows as predictions; long, one row a ticker, date and horizon."""
    w = series()
    b = bars_daily(spark, sf).select("ticker", F.col("date").alias("prediction_date"), *[(F.try_divide(F.col("close"), F.lag("close", h).over(w)) - 1).alias(f"h{h}") for h in (1, 7, 30, 60)])
    long = b.unpivot(["ticker", "prediction_date"], [f"h{h}" for h in (1, 7, 30, 60)], "h", "predicted_return").filter("predicted_return is not null")
    return long.select("ticker", "prediction_date", F.substring("h", 2, 3).cast("int").alias("horizon_days"), "predicted_return", (1 / (1 + 20 * F.abs("predicted_return"))).alias("confidence_score"))


DAILY = {"1. open": "open", "2. high": "high", "3. low": "low", "4. close": "close", "5. adjusted close": "adjusted_close", "6. volume": "volume"}
INTRADAY = {"1. open": "open", "2. high": "high", "3. low": "low", "4. close": "close", "5. volume": "volume"}


def payload_texts(bars: DataFrame, time: str, key: str, names: dict[str, str], period: str) -> DataFrame:
    """Bars as the nested JSON that a vendor sends: ticker, value. A text holds one ticker and period, so none grows with the table."""
    at = F.col(time).cast("string") if dict(bars.dtypes)[time] == "date" else F.date_format(time, "yyyy-MM-dd HH:mm:ss")
    point = F.create_map(*[x for k, c in names.items() for x in (F.lit(k), F.col(c).cast("string"))])
    texts = bars.groupBy("ticker", F.date_trunc(period, time).alias("period")).agg(F.map_from_entries(F.collect_list(F.struct(at.alias("at"), point.alias("x")))).alias("s"))
    return texts.select("ticker", F.to_json(F.create_map(F.lit(key), F.col("s"))).alias("value"))


SQL = {
    "ticks": "SELECT event_type AS ticker, ts, value AS price, event_id AS seq FROM events",
    "bars_hourly": """SELECT ticker, date_trunc('hour', ts) AS datetime, date_trunc('hour', ts)::DATE AS date, hour(date_trunc('hour', ts))::INT AS hour,
  arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close, count(*) AS volume, arg_max(price, (ts, seq)) AS adjusted_close FROM ticks GROUP BY ALL""",
    "trades": "SELECT n_name AS ticker, o_orderdate::DATE AS date, o_totalprice AS price, o_orderkey AS seq FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "bars_daily": "SELECT ticker, date, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, count(*) AS volume, arg_max(price, seq) AS adjusted_close FROM trades GROUP BY ticker, date",
    "metadata": "SELECT n_name AS ticker, 'Fund ' || n_name AS name, r_name AS sector, ['large', 'mid', 'etf'][n_nationkey % 3 + 1] AS market_cap, 'sub_' || (n_nationkey % 2) AS sub_industry FROM nation JOIN region ON n_regionkey = r_regionkey",
    "sentiment": "SELECT event_type AS symbol, ts AS timestamp, props AS title, ((event_id * 37) % 201 - 100) / 100 AS overall_sentiment_score, event_id FROM events",
    "macro_long": "SELECT date_trunc('month', o_orderdate)::DATE AS date, CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in INDICATORS.items()) + " ELSE o_orderpriority END AS indicator, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2",
    "predictions": " UNION ALL ".join(f"SELECT ticker, date AS prediction_date, {h} AS horizon_days, r AS predicted_return, 1 / (1 + 20 * abs(r)) AS confidence_score FROM (SELECT ticker, date, close / nullif(lag(close, {h}) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS r FROM bars_daily) WHERE r IS NOT NULL" for h in (1, 7, 30, 60)),
}
NEEDS = {"bars_hourly": ["ticks"], "bars_daily": ["trades"], "predictions": ["trades", "bars_daily"]}


def with_sql(*names: str, also: dict[str, str] | None = None, recursive: bool = False) -> str:
    """WITH clause that defines the named fixtures, what they need, and more pieces."""
    order: list[str] = []
    for n in names:
        order += [x for x in [*NEEDS.get(n, []), n] if x not in order]
    kept = "MATERIALIZED "  # a piece that begins so is worked out once
    parts = [f"{n} AS ({SQL[n]})" for n in order] + [f"{n} AS {kept}({q.removeprefix(kept)})" if q.startswith(kept) else f"{n} AS ({q})" for n, q in (also or {}).items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"
