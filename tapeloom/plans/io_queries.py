"""Queries that write to the shared scratch folder and read back: upserts, deletes, appends, retention, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tapeloom import schemas
from tapeloom.functions import rounded
from tapeloom.operators import backfill, bars, quality
from tapeloom.plans import fixtures as fx
from tapeloom.plans.bar_queries import AS_OF, _pages
from tapeloom.plans.registry import query
from tapeloom.plans.signal_queries import SIG
from tapeloom.scratch import arrange, cut
from tapeloom.scratch import folder as _folder
from tapeloom.sources import files, payloads, sinks
from tapeloom.streaming import streams


def _bars(spark, sf):
    return fx.bars_daily(spark, sf).select("ticker", "date", "close", F.year("date").alias("year"))


@query("k1_insert", ("bars_daily",), "SELECT ticker, date, close, TIMESTAMP '2001-08-02' AS inserted_at FROM bars_daily")
def _(spark, sf):
    path = _folder(spark, "bars")
    sinks.insert(_bars(spark, sf).drop("year").filter("close < 0"), path, at="2001-08-01")
    sinks.insert(_bars(spark, sf).drop("year"), path, replace=True, at="2001-08-02")
    return spark.read.parquet(path).withColumn("inserted_at", F.col("inserted_at").cast("timestamp_ntz"))


@query("k2_upsert", ("bars_daily",), "SELECT ticker, date, round(CASE WHEN date >= DATE '1999-07-01' THEN close * 2 ELSE close END, 2) AS close, (CASE WHEN date >= DATE '1999-07-01' AND volume > 1 THEN year(date) + 10 ELSE year(date) END)::INT AS year FROM bars_daily")
def _(spark, sf):
    """The second write brings known keys in other partitions, and each of its keys twice."""
    path, b = _folder(spark, "bars"), fx.bars_daily(spark, sf).select("ticker", "date", "close", "volume", F.year("date").alias("year"))
    sinks.upsert(b.filter("date < '2000-01-01'").drop("volume"), path, ["ticker", "date"], ["year"])
    new = b.filter("date >= '1999-07-01'").withColumns({"close": F.col("close") * 2, "year": F.when(F.col("volume") > 1, F.col("year") + 10).otherwise(F.col("year"))}).drop("volume")
    sinks.upsert(new.unionByName(new.withColumn("close", F.lit(-1.0))), path, ["ticker", "date"], ["year"], latest="close")
    return rounded(spark.read.parquet(path), 2)


@query("k3_batch_insert", ("metadata",), "SELECT ticker, sector, market_cap FROM metadata")
def _(spark, sf):
    path = _folder(spark, "metadata")
    records = [r.asDict() for r in fx.metadata(spark, sf).select("ticker", "sector", "market_cap").collect()]  # a dimension
    sinks.batch_insert(spark, records, "ticker string, sector string, market_cap string", path)
    return spark.read.parquet(path)


@query("k4_stream_insert", ("sentiment",), "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'symbol is missing' END AS error, overall_sentiment_score FROM sentiment")
def _(spark, sf):
    path, n = _folder(spark, "news"), fx.sentiment(spark, sf)
    n.withColumn("symbol", F.when(F.col("event_id") % 7 != 0, F.col("symbol"))).write.parquet(path)
    out, bad = _folder(spark, "out"), _folder(spark, "rejected")
    streams.insert_checked(streams.watch(spark, path, n.schema, files=2), "sentiment", out, bad, _folder(spark, "state")).awaitTermination()
    good = spark.read.parquet(out).withColumn("error", F.lit(None).cast("string"))
    columns = ("event_id", "error", "overall_sentiment_score")
    return good.select(*columns).unionByName(spark.read.parquet(bad).select(*columns))


@query("k5_k8_delete", ("bars_daily",), "SELECT ticker, date, close, year(date)::INT AS year FROM bars_daily WHERE NOT (close > 300000 OR year(date) = 1997)")
def _(spark, sf):
    path = _folder(spark, "bars")
    sinks.write_partitioned(_bars(spark, sf), path, ["year"])
    sinks.delete(spark, path, "close > 300000 OR year = 1997", ["year"])
    return spark.read.parquet(path)


@query("k6_s2_partitioned_files", ("bars_daily",), "SELECT ticker, date, close FROM bars_daily WHERE year(date) IN (1996, 1998) AND close >= 250000")
def _(spark, sf):
    path = _folder(spark, "bars")
    sinks.write_partitioned(_bars(spark, sf), path, ["year"], compression="zstd")
    return files.scan(spark, path, ["ticker", "date", "close"], [("year", "in", [1996, 1998]), ("close", ">=", 250000)])


@query("k7_n4_append_new", ("bars_daily",), "SELECT CASE WHEN ticker <> 'NATION_2' THEN ticker END AS ticker, date, close, year(date)::INT AS year FROM bars_daily")
def _(spark, sf):
    """Keys with a null are keys: one ticker has no name."""
    path, b = _folder(spark, "bars"), _bars(spark, sf).withColumn("ticker", F.when(F.col("ticker") != "NATION_2", F.col("ticker")))
    sinks.append_new(b.filter("date < '1998-06-01'"), path, ["ticker", "date"], ["year"])
    sinks.append_new(b, path, ["ticker", "date"], ["year"])
    sinks.append_new(b, path, ["ticker", "date"], ["year"])
    return spark.read.parquet(path)


@query("k9_write_many", ("bars_daily", "metadata"), "SELECT 'bars' AS dataset, ticker FROM bars_daily UNION ALL SELECT 'metadata', ticker FROM metadata")
def _(spark, sf):
    path = _folder(spark, "many")
    sinks.write_many({"bars": fx.bars_daily(spark, sf).select("ticker"), "metadata": fx.metadata(spark, sf).select("ticker")}, path)
    return spark.read.parquet(path).select("dataset", "ticker")


@query("k13_retention", ("bars_daily",), f"SELECT ticker, date, close, year(date)::INT AS year FROM bars_daily WHERE date >= DATE '{AS_OF}' - 365")
def _(spark, sf):
    path = _folder(spark, "bars")
    sinks.write_partitioned(_bars(spark, sf), path, ["year"])
    sinks.retain(spark, path, AS_OF, 365, by=["year"])
    return spark.read.parquet(path)


def _landed(spark, ticks, again: str | None = None) -> str:
    """Ticks as a folder of files a day, of which each three days land in reverse; then one tick long after the
    last, which moves the watermark past all others. `again` names rows that land a second time, after their day."""
    path, day = _folder(spark, "ticks"), F.datediff(F.to_date("ts"), F.lit("2020-01-01").cast("date"))
    turned = day - F.pmod(day, F.lit(3)) + 2 - F.pmod(day, F.lit(3))
    ticks.withColumn("land", 2 * turned).write.partitionBy("land").parquet(path)
    if again:
        ticks.filter(again).withColumn("land", 2 * turned + 1).write.mode("append").partitionBy("land").parquet(path)
    last = ticks.agg(F.lit(CLOSING).alias("ticker"), (F.max("ts") + F.expr("interval 90 days")).alias("ts"), F.lit(0.0).alias("price"), F.lit(-1).cast("long").alias("seq"))
    last.select(*[F.col(f.name).cast(f.dataType) for f in ticks.schema]).withColumn("land", F.lit(50_000)).write.mode("append").partitionBy("land").parquet(path)
    arrange(spark, path, "land")
    return f"{path}/*"


CLOSING = "~"
LATE = "4 days"


@query("v1_stream_deduplicated", ("ticks",), "SELECT ticker, ts, price, seq FROM ticks")
def _(spark, sf):
    """Files land out of order and a part of the rows twice, over several batches."""
    t = fx.ticks(spark, sf)
    path, out = _landed(spark, t, "seq % 10 = 0"), _folder(spark, "out")
    stream = streams.deduplicated(streams.watch(spark, path, t.schema, "ts", LATE, files=12), ["ticker", "seq"])
    streams.append_to(stream, out, _folder(spark, "state")).awaitTermination()
    return spark.read.parquet(out).filter(F.col("ticker") != CLOSING).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("v2_stream_news", ("sentiment",), "SELECT symbol, timestamp, title, overall_sentiment_score FROM sentiment QUALIFY row_number() OVER (PARTITION BY symbol, timestamp, title ORDER BY event_id) = 1")
def _(spark, sf):
    """News of which a part lands twice."""
    path, n = _folder(spark, "news"), fx.sentiment(spark, sf)
    n = n.join(n.groupBy("symbol", "timestamp", "title").agg(F.min("event_id").alias("event_id")), ["symbol", "timestamp", "title", "event_id"])
    n.write.parquet(path)
    n.filter("event_id % 5 = 0").write.mode("append").parquet(path)
    out = _folder(spark, "out")
    streams.ingest_news(streams.watch(spark, path, n.schema, "timestamp", "60 days"), out, _folder(spark, "state")).awaitTermination()
    return spark.read.parquet(out).select("symbol", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "title", "overall_sentiment_score")


@query("v3_stream_signals", ("bars_daily", "predictions"), "SELECT ticker, prediction_date, horizon_days, signal, rank FROM sig", SIG)
def _(spark, sf):
    """Predictions of one date come in several batches, a part of them first with another value, and are revised."""
    path, out, p = _folder(spark, "predictions"), _folder(spark, "out"), fx.predictions(spark, sf)
    kind = F.pmod(F.xxhash64("ticker", "prediction_date"), F.lit(5))
    early = p.filter(kind < 2).withColumns({"predicted_return": F.when(kind == 0, 0.5).otherwise(-F.col("predicted_return")), "confidence_score": F.lit(0.9)})
    # revisions land last, in no batch with what they revise
    early.withColumn("land", F.lit(0)).unionByName(p.withColumn("land", F.when(kind < 2, 4 + kind).otherwise(kind - 1).cast("int"))).write.partitionBy("land").parquet(path)
    arrange(spark, path, "land")
    streams.write_signal_changes(streams.watch(spark, f"{path}/*", p.schema, files=2), out, _folder(spark, "state"), least_confidence=0.3, least_return=0.02).awaitTermination()
    return streams.current_signals(spark, out).select("ticker", "prediction_date", "horizon_days", "signal", "rank")


@query("v4_stream_daily_bars", ("ticks",), """SELECT ticker, ts::DATE AS date, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close, count(*) AS volume FROM ticks
 WHERE ts::DATE + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM ticks) GROUP BY ticker, ts::DATE""")
def _(spark, sf):
    """Days that the watermark has passed, in append mode; one batch of all files, as their order isn't that of ts."""
    path, out, t = _folder(spark, "ticks"), _folder(spark, "out"), fx.ticks(spark, sf)
    t.write.parquet(path)
    bars = streams.daily_bars(streams.watch(spark, path, t.schema, "ts", "1 day", files=None))
    streams.append_to(bars, out, _folder(spark, "state")).awaitTermination()
    return spark.read.parquet(out)


LIVE = {
    "b": "MATERIALIZED SELECT *, row_number() OVER w AS i, price - lag(price) OVER w AS d FROM ticks WINDOW w AS (PARTITION BY ticker ORDER BY ts, seq)",
    "z": """SELECT ticker, seq, i, price::DOUBLE AS ema, 0::DOUBLE AS g, 0::DOUBLE AS l FROM b WHERE i = 1
 UNION ALL SELECT b.ticker, b.seq, b.i, z.ema + (2.0::DOUBLE / 21) * (b.price - z.ema), z.g + (greatest(b.d, 0) - z.g) / least(b.i - 1, 14), z.l + (greatest(-b.d, 0) - z.l) / least(b.i - 1, 14) FROM z JOIN b ON b.ticker = z.ticker AND b.i = z.i + 1""",
}


@query("v5_live_indicators", ("ticks",), "SELECT ticker, seq, round(ema, 6) AS ema, round(CASE WHEN i > 14 THEN 100 * g / nullif(g + l, 0) END, 6) AS rsi FROM z", LIVE, recursive=True)
def _(spark, sf):
    """Files land out of order over several batches; rows leave in the order of their time."""
    t = fx.ticks(spark, sf)
    path, out = _landed(spark, t), _folder(spark, "out")
    live = streams.ordered_indicators(streams.watch(spark, path, t.schema, "ts", LATE, files=8))
    streams.append_to(live, out, _folder(spark, "state")).awaitTermination()
    return rounded(spark.read.parquet(out).select("ticker", "seq", "ema", "rsi"), 6)


# --- tables, files and bookkeeping ---


@query("k10_k11_table_and_view", ("macro_long",), "SELECT date, indicator, value FROM macro_long WHERE value > 150000")
def _(spark, sf):
    """A declared table with its partitions and clusters, filled, and a view over it."""
    name = f"macro_{uuid.uuid4().hex}"
    sinks.create_table(spark, name, "macro")
    sinks.insert_clustered(schemas.conform(fx.macro_long(spark, sf), schemas.table("macro")), name)
    sinks.create_view(spark, f"{name}_view", f"SELECT date, indicator, value FROM {name} WHERE value > 150000")
    return _kept(spark, spark.table(f"{name}_view"), name, f"{name}_view")


def _kept(spark, df, *tables: str):
    """The rows of a table or view, written to the shared folder; the tables themselves go."""
    rows = cut(df, "rows")
    for t in tables:
        sinks.drop_table(spark, t)
    return rows


@query("k10_cluster_filter", ("bars_daily",), "SELECT ticker, date, close FROM bars_daily WHERE ticker = 'NATION_3' AND date >= DATE '2000-01-01'")
def _(spark, sf):
    """One cluster of a partitioned table: a filter on the cluster column reads its bucket alone."""
    name = f"bars_{uuid.uuid4().hex}"
    sinks.create_table(spark, name, "bars_daily", partition="year int")
    sinks.insert_clustered(schemas.conform(fx.bars_daily(spark, sf), schemas.table("bars_daily")).withColumn("year", F.year("date")), name)
    return _kept(spark, spark.table(name).filter("ticker = 'NATION_3' AND date >= DATE '2000-01-01'").select("ticker", "date", "close"), name)


@query("k12_copy_table", ("metadata",), "SELECT ticker, sector, NULL::INT AS rating FROM metadata")
def _(spark, sf):
    """A table is copied, the copy gets a column, and the first one goes."""
    name = f"metadata_{uuid.uuid4().hex}"
    fx.metadata(spark, sf).select("ticker", "sector").write.saveAsTable(name)
    sinks.copy_table(spark, name, f"{name}_copy")
    sinks.add_columns(spark, f"{name}_copy", "rating int")
    sinks.drop_table(spark, name)
    if sinks.describe(spark, f"{name}_copy").filter("col_name = 'rating'").count() != 1:
        raise AssertionError("the copy lacks its new column")
    return _kept(spark, spark.table(f"{name}_copy"), f"{name}_copy")


@query("s3_latest_of_files", ("bars_daily",), "SELECT ticker, date, close FROM bars_daily WHERE year(date) = (SELECT max(year(date)) FROM bars_daily)")
def _(spark, sf):
    """The greatest partition of a folder; its files alone are read."""
    path = _folder(spark, "bars")
    sinks.write_partitioned(fx.bars_daily(spark, sf).select("ticker", "date", "close", F.year("date").alias("year")), path, ["year"])
    return files.latest_partition(spark, path, "year").select("ticker", "date", "close")


@query("s4_partition_folders", ("bars_daily",), "SELECT DISTINCT year(date)::INT AS year FROM bars_daily")
def _(spark, sf):
    """Partitions by the names of their folders."""
    path = _folder(spark, "bars")
    sinks.write_partitioned(fx.bars_daily(spark, sf).select("ticker", "close", F.year("date").alias("year")), path, ["year"])
    return files.partitions(spark, path, "year")


@query("k14_retention_policy", ("bars_daily", "macro_long"), f"SELECT 'bars_daily' AS dataset, date FROM bars_daily WHERE date >= DATE '{AS_OF}' - 365 UNION ALL SELECT 'macro', date FROM macro_long")
def _(spark, sf):
    out = None
    for name, df in (("bars_daily", fx.bars_daily(spark, sf)), ("macro", fx.macro_long(spark, sf))):
        path = _folder(spark, name)
        df.select(F.lit(name).alias("dataset"), "date").write.parquet(path)
        sinks.retain(spark, path, AS_OF, sinks.retention_policy()[name])
        kept = spark.read.parquet(path)
        out = kept if out is None else out.unionByName(kept)
    return out


@query("q18_table_statistics", ("bars_daily",), "SELECT count(*) AS records, true AS has_files, true AS has_bytes, round(avg(close), 4) AS avg_close, min(close) AS min_close, max(close) AS max_close, round(stddev(close), 3) AS std_close, round(avg(volume), 6) AS avg_volume, max(volume) AS max_volume FROM bars_daily")
def _(spark, sf):
    path = _folder(spark, "bars")
    fx.bars_daily(spark, sf).write.parquet(path)
    s = quality.table_statistics(spark.read.parquet(path)).withColumns({"has_files": F.col("files") > 0, "has_bytes": F.col("bytes") > 0}).drop("files", "bytes")
    return rounded(s, {"avg_close": 4, "std_close": 3, "avg_volume": 6})


@query("b1_backfill_progress", (), """SELECT backfill_id, CASE backfill_id WHEN 'b' THEN 'failed' ELSE 'running' END AS status, n * (date_diff('month', lo, hi) + 1) AS months_total, CASE backfill_id WHEN 'a' THEN n ELSE 0 END AS months_done, CASE backfill_id WHEN 'b' THEN 'no rows' END AS error
 FROM (SELECT unnest(['a', 'b', 'c']) AS backfill_id, (SELECT count(*) FROM nation) AS n, (SELECT min(o_orderdate)::DATE FROM orders) AS lo, (SELECT max(o_orderdate)::DATE FROM orders) AS hi)""")
def _(spark, sf):
    """Three backfills start, one goes on, one fails; the table is upserted at each step."""
    path, symbols = _folder(spark, "progress"), [r[0] for r in fx.table(spark, sf, "nation").select("n_name").collect()]  # a dimension
    lo, hi = fx.table(spark, sf, "orders").agg(F.to_date(F.min("o_orderdate")), F.to_date(F.max("o_orderdate"))).first()
    for x in "abc":
        sinks.upsert(backfill.start(spark, x, symbols, lo, hi, "2024-01-01"), path, ["backfill_id"])
    sinks.upsert(backfill.status(spark.read.parquet(path), "a").withColumn("months_done", F.lit(len(symbols)).cast("bigint")), path, ["backfill_id"])
    sinks.upsert(backfill.fail(backfill.active(spark.read.parquet(path)).filter("backfill_id = 'b'"), "b", "no rows", "2024-01-02"), path, ["backfill_id"])
    return spark.read.parquet(path).select("backfill_id", "status", "months_total", "months_done", "error")


@query("b2_month_checkpoints", ("trades",), """SELECT ticker AS symbol, year(date)::INT AS year, month(date)::INT AS month, CASE WHEN count(*) < 3 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN count(*) >= 3 THEN count(*) END AS rows_fetched, CASE WHEN count(*) < 3 THEN 'too few rows' END AS error FROM trades GROUP BY 1, 2, 3""")
def _(spark, sf):
    path = _folder(spark, "checkpoints")
    got = fx.trades(spark, sf).groupBy(F.col("ticker").alias("symbol"), F.year("date").alias("year"), F.month("date").alias("month")).agg(F.count("*").alias("rows_fetched"))
    rows = backfill.checkpoint(got.withColumn("error", F.when(F.col("rows_fetched") < 3, "too few rows")), "x", "daily", "2024-01-01")
    sinks.write_partitioned(rows, path)
    return spark.read.parquet(path).select("symbol", "year", "month", "status", "rows_fetched", "error")


@query("b6_presets", ("bars_daily",), " UNION ALL ".join(f"SELECT '{k}' AS preset, ticker, date FROM bars_daily WHERE date BETWEEN DATE '{AS_OF}' - {n} AND DATE '{AS_OF}'" for k, n in backfill.PRESETS.items()))
def _(spark, sf):
    b, out = fx.bars_daily(spark, sf).select("ticker", "date"), None
    for k in backfill.PRESETS:
        one = backfill.preset_rows(b, k, AS_OF).select(F.lit(k).alias("preset"), "ticker", "date")
        out = one if out is None else out.unionByName(one)
    return out


@query("b7_job_log", (), "SELECT o_orderpriority AS job_name, date_diff('second', min(o_orderdate), max(o_orderdate))::DOUBLE AS duration_seconds, count(*) > 2000 AS success, count(*)::VARCHAR || ' rows' AS detail FROM orders GROUP BY 1")
def _(spark, sf):
    path = _folder(spark, "jobs")
    runs = fx.table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.min("o_orderdate"), F.max("o_orderdate"), F.count("*")).collect()  # five jobs
    for name, lo, hi, n in runs:
        sinks.write_partitioned(backfill.job_log(spark, name, lo, hi, n > 2000, f"{n} rows"), path)
    return spark.read.parquet(path).select("job_name", "duration_seconds", "success", "detail")


@query("s12_s13_universe", ("metadata",), "SELECT ticker, sector, market_cap, sub_industry, count(*) OVER () AS tickers FROM metadata")
def _(spark, sf):
    groups: dict[str, list[dict]] = {}
    for r in fx.metadata(spark, sf).collect():  # a dimension, as the configuration has it
        groups.setdefault(r["sector"], []).append(r.asDict())
    u = files.universe(spark, groups)
    return u.select("ticker", "sector", "market_cap", "sub_industry").crossJoin(files.all_tickers(u).agg(F.count("*").alias("tickers")))


@query("s8_intraday_payload", ("ticks",), "SELECT ticker, time_bucket(INTERVAL '30 minutes', ts) AS datetime, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close, count(*) AS volume FROM ticks GROUP BY 1, 2")
def _(spark, sf):
    b = bars.ticks_to_bars(fx.ticks(spark, sf), ["ticker", F.window("ts", "30 minutes")["start"].alias("datetime")], ["ts", "seq"])
    return payloads.intraday(fx.payload_texts(b, "datetime", "Time Series (30min)", fx.INTRADAY, "month"), "30min")


@query("s11_sector_payload", (), "SELECT o_orderpriority AS period, r_name AS sector, round(count(*) / 100, 6) AS performance FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def _(spark, sf):
    t, n = fx.table, fx.table(spark, sf, "nation")
    o = t(spark, sf, "orders").join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    g = o.groupBy("o_orderpriority", "r_name").agg(F.concat(F.count("*").cast("string"), F.lit("%")).alias("t")).groupBy("o_orderpriority").agg(F.map_from_entries(F.collect_list(F.struct("r_name", "t"))).alias("s"))
    raw = g.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "s")))).alias("value"))
    return rounded(payloads.sector_performance(raw), 6)


@query("s15_landed_files", ("bars_daily", "bars_hourly", "sentiment"), """SELECT 'daily' AS kind, ticker, date::TIMESTAMP AS at, close FROM bars_daily UNION ALL SELECT 'hourly', ticker, datetime, close FROM bars_hourly
 UNION ALL SELECT 'sentiment', symbol, date_trunc('second', timestamp), overall_sentiment_score FROM sentiment""")
def _(spark, sf):
    """Payload files of every ticker, one folder a ticker, of three kinds; a file holds one payload."""
    n = fx.sentiment(spark, sf)
    own = F.array(F.struct(F.col("symbol").alias("ticker"), F.lit("0.5").alias("relevance_score"), F.col("overall_sentiment_score").cast("string").alias("ticker_sentiment_score")))
    page = n.groupBy(F.col("symbol").alias("ticker"), _pages(n).alias("page")).agg(F.collect_list(F.struct("title", F.date_format("timestamp", "yyyyMMdd'T'HHmmss").alias("time_published"), F.lit("wire").alias("source"), "overall_sentiment_score", own.alias("ticker_sentiment"))).alias("feed"))
    landed = {
        "daily": fx.payload_texts(fx.bars_daily(spark, sf), "date", "Time Series (Daily)", {"4. close": "close", "6. volume": "volume"}, "year"),
        "hourly": fx.payload_texts(fx.bars_hourly(spark, sf), "datetime", "Time Series (60min)", fx.INTRADAY, "month"), "sentiment": page.select("ticker", F.to_json(F.struct("feed")).alias("value")),
    }
    time, out = {"daily": F.col("date").cast("timestamp_ntz"), "hourly": F.col("datetime"), "sentiment": F.col("timestamp")}, None
    for kind, raw in landed.items():
        path = _folder(spark, kind)
        raw.write.partitionBy("ticker").option("maxRecordsPerFile", 1).text(path)
        got = files.scan_landed(spark, path, kind).withColumnsRenamed({"symbol": "ticker", "overall_sentiment_score": "close"} if kind == "sentiment" else {})
        one = got.select(F.lit(kind).alias("kind"), "ticker", time[kind].alias("at"), "close")
        out = one if out is None else out.unionByName(one)
    return out
