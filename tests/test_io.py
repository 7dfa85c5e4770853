"""Files, tables, upserts and streams."""

import datetime as dt
import os
import re
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from tapeloom import schemas
from tapeloom.operators import backfill, calendar
from tapeloom.plans import fixtures
from tapeloom.plans.catalog import QUERIES
from tapeloom.sources import files, sinks
from tapeloom.streaming import streams


def frame(spark, rows):
    return spark.createDataFrame(rows, "k int, d string, v double")


def test_append_new_is_idempotent(spark, tmp_path):
    p = str(tmp_path / "t")
    df = frame(spark, [(1, "a", 1.0), (2, "b", 2.0), (2, "b", 2.0)])
    assert sinks.append_new(df, p, ["k"], ["d"]) == 2 and sinks.append_new(df, p, ["k"], ["d"]) == 0
    assert spark.read.parquet(p).count() == 2


@pytest.mark.parametrize("by", [[], ["d"]])
def test_upsert_and_delete(spark, tmp_path, by):
    p = str(tmp_path / "t")
    sinks.upsert(frame(spark, [(1, "a", 1.0), (2, "b", 2.0)]), p, ["k"], by)
    sinks.upsert(frame(spark, [(2, "b", 5.0), (3, "b", 3.0)]), p, ["k"], by)
    assert {r["k"]: r["v"] for r in spark.read.parquet(p).collect()} == {1: 1.0, 2: 5.0, 3: 3.0}
    assert sinks.delete(spark, p, "v > 4", by) == 1
    assert {r["k"] for r in spark.read.parquet(p).collect()} == {1, 3}
    assert sinks.delete(spark, str(tmp_path / "none"), "true") == 0


def test_retention(spark, tmp_path):
    p = str(tmp_path / "t")
    sinks.insert(spark.createDataFrame([(dt.date(2024, 1, d), d) for d in (1, 10, 20)], "date date, x int"), p, at="2024-01-21")
    assert sinks.retain(spark, p, "2024-01-21", -1) == 0 and sinks.retain(spark, p, "2024-01-21", 15) == 1
    assert spark.read.parquet(p).count() == 2 and sinks.retention_policy()["macro"] == -1


def test_partitions_and_latest(spark, tmp_path):
    p = str(tmp_path / "t")
    sinks.write_partitioned(frame(spark, [(1, "a", 1.0), (2, "b", 2.0), (3, "b", 3.0)]), p, ["d"], compression="zstd")
    assert [r["d"] for r in files.partitions(spark, p, "d").collect()] == ["a", "b"]
    assert files.latest_partition(spark, p, "d").count() == 2
    assert files.dataset_info(spark.read.parquet(p)).first()["records"] == 3
    assert files.scan(spark, p, ["k"], [("d", "in", ["b"]), ("v", ">", 2.5)]).collect()[0]["k"] == 3


def test_tables_and_schemas(spark):
    t = schemas.table("bars_daily")
    assert not t.schema["ticker"].nullable and t.partition == "date"
    got = schemas.conform(spark.createDataFrame([("A", dt.date(2024, 1, 1), 1.0)], "ticker string, date date, close double"), t)
    assert got.columns == t.schema.names
    with pytest.raises(ValueError):
        schemas.conform(spark.createDataFrame([(1.0,)], "close double"), t)
    sinks.create_table(spark, "made_bars", "bars_daily")
    sinks.add_columns(spark, "made_bars", "extra int")
    assert "extra" in spark.table("made_bars").columns
    sinks.create_view(spark, "made_view", "SELECT ticker FROM made_bars")
    assert spark.table("made_view").count() == 0 and sinks.describe(spark, "made_bars").count() > 5
    sinks.drop_table(spark, "made_bars")


def test_universe(spark):
    u = files.universe(spark, {"tech": [{"ticker": "A", "name": "a", "market_cap": "large"}], "fin": [{"ticker": "B.C"}]})
    assert files.all_tickers(u).count() == 2 and [r["ticker"] for r in files.constituents(u, "ticker").collect()] == ["A"]


def test_payload_texts_are_bounded(spark, tmp_path):
    """A long series is many texts of one period each, in files of one text each, and comes back whole."""
    days = spark.range(3000).select(F.lit("A").alias("ticker"), F.date_add(F.lit("2010-01-01").cast("date"), F.col("id").cast("int")).alias("date"), (F.col("id") + 0.5).alias("close"), F.col("id").alias("volume"))
    texts = fixtures.payload_texts(days, "date", "Time Series (Daily)", {"4. close": "close", "6. volume": "volume"}, "year")
    assert texts.count() == 9 and texts.agg(F.max(F.length("value"))).first()[0] < 366 * 80
    path = str(tmp_path / "landed")
    texts.write.partitionBy("ticker").option("maxRecordsPerFile", 1).text(path)
    assert len([f for f in os.listdir(os.path.join(path, "ticker=A")) if f.endswith(".txt")]) == 9
    got = files.scan_landed(spark, path, "daily").select("date", "close", "volume")
    assert got.count() == 3000 and got.exceptAll(days.select("date", "close", "volume")).count() == 0


def test_landed_files(spark, tmp_path):
    (tmp_path / "AAA.json").write_text('{"Time Series (60min)": {"2024-01-02 10:00:00": {"1. open": "1", "4. close": "2", "5. volume": "3"}}}')
    (tmp_path / "BBB.json").write_text('{"Error Message": "x"}')
    got = files.scan_landed(spark, str(tmp_path), "hourly").collect()
    assert [(r["ticker"], r["hour"], r["adjusted_close"]) for r in got] == [("AAA", 10, 2.0)]


def test_calendar_rules(spark):
    h = {(r["date"], r["holiday"]) for r in calendar.holidays(spark, 2021, 2021).collect()}
    assert {(dt.date(2021, 11, 25), "Thanksgiving"), (dt.date(2021, 7, 5), "Independence Day"), (dt.date(2021, 5, 31), "Memorial Day"), (dt.date(2021, 6, 18), "Juneteenth"), (dt.date(2021, 9, 6), "Labor Day")} <= h
    c = {r["date"]: r for r in calendar.calendar(spark, "2024-01-01", "2024-12-31", (2024, 2024)).collect()}
    assert len(c) == 366 and c[dt.date(2024, 3, 15)]["is_triple_witching"] == 1 and c[dt.date(2024, 1, 2)]["is_first_trading_day"] == 1
    assert c[dt.date(2024, 12, 24)]["days_to_next_holiday"] == 1 and c[dt.date(2024, 1, 10)]["days_to_fomc"] == 5
    q = {r["date"] for r in calendar.third_fridays(spark, "2024-01-01", "2024-04-30").filter("kind = 'quarter_end'").collect()}
    assert q == {dt.date(2024, 3, 31)}


def test_backfill_processes_every_month(spark):
    s = spark.createDataFrame([("A",), ("B",)], "symbol string")
    done = spark.createDataFrame([("A", 2024, 2, "daily", "completed"), ("B", 2024, 2, "daily", "failed")], "symbol string, year int, month int, data_type string, status string")
    got = [(r["symbol"], r["year"], r["month"]) for r in backfill.pending(s, done, "2023-12-10", "2024-02-20", "daily").collect()]
    assert got == [("B", 2024, 2), ("A", 2024, 1), ("B", 2024, 1), ("A", 2023, 12), ("B", 2023, 12)]
    p = backfill.start(spark, "x", ["A", "B"], "2023-12-01", "2024-02-01", "2024-03-01")
    assert p.first()["months_total"] == 6 and backfill.active(p).count() == 1
    assert backfill.fail(p, "x", "boom", "2024-03-02").first()["status"] == "failed"
    assert backfill.progress_eta(p).first()["months_per_hour"] is None


def ticks(spark, path):
    rows = [("A", dt.datetime(2024, 1, 1 + i // 10, i % 10), 10.0 + i % 4, i) for i in range(40)]
    df = spark.createDataFrame(rows, "ticker string, ts timestamp_ntz, price double, seq long")
    for d in range(4):
        df.filter(F.dayofmonth("ts") == d + 1).coalesce(1).write.mode("append").parquet(path)
    df.filter("seq < 5").coalesce(1).write.mode("append").parquet(path)  # a file that comes twice
    return df


def test_streams_match_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = ticks(spark, src)
    s = streams.deduplicated(streams.watch(spark, src, df.schema, "ts", "10 days"), ["ticker", "seq"])
    streams.append_to(s, out, str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(out).count() == 40
    q = streams.daily_bars(streams.watch(spark, out, spark.read.parquet(out).schema, "ts", "1 day"))
    q = q.writeStream.outputMode("complete").format("memory").queryName("daily_out").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["date"].day: (r["open"], r["close"], r["volume"]) for r in spark.table("daily_out").collect()}
    assert got[1] == (10.0, 11.0, 10) and len(got) == 4


def test_news_pages_are_bounded(spark, tmp_path, monkeypatch):
    """One hot symbol: the largest payload handed to the parser stays a page, however many rows there are."""
    from tapeloom.sources import payloads

    sizes, parse = [], payloads.news
    monkeypatch.setattr(payloads, "news", lambda raw, *a, **k: sizes.append(raw.select(F.max(F.size(F.split("value", '"title"')) - 1)).first()[0]) or parse(raw, *a, **k))
    e = spark.range(100_000).select(F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id)").alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("A").alias("event_type"), F.lit(1.0).alias("value"), F.lit("p").alias("props"))
    e.write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["s10_news_payload"](spark, str(tmp_path)).collect()
    assert [r["articles"] for r in got] == [100_000] and 0 < sizes[0] < 1500


def test_backfilled_days_need_no_order_of_files(spark, tmp_path):
    """More landed files than two triggers take by default (the third one drops late rows), the latest ticks first."""
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), 1, "A", float(i), "p") for i in range(480)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.repartitionByRange(240, F.desc("ts")).write.parquet(str(tmp_path / "events.parquet"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4194304")  # one file a task
    try:
        assert spark.read.parquet(str(tmp_path / "events.parquet")).rdd.getNumPartitions() > 200
        got = QUERIES["v4_stream_daily_bars"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r["date"].day: r["volume"] for r in got} == dict.fromkeys(range(1, 19), 24)


def plain_live(prices, span, n):
    alpha, ema, last, gain, loss, out = 2 / (span + 1), None, None, 0.0, 0.0, []
    for seen, p in enumerate(prices):
        ema = p if ema is None else ema + alpha * (p - ema)
        if last is not None:
            k = min(seen, n)
            gain, loss = gain + (max(p - last, 0) - gain) / k, loss + (max(last - p, 0) - loss) / k
        last = p
        out.append((round(ema, 9), round(100 * gain / (gain + loss), 9) if seen >= n and gain + loss > 0 else None))
    return out


def test_live_indicators_keep_state(spark, tmp_path):
    """Four days of ticks in four batches give what one pass over all of them gives."""
    src = str(tmp_path / "in")
    rows = [("A", dt.datetime(2024, 1, 1 + i // 10, i % 10), 10.0 + i * 7 % 11, i) for i in range(40)]
    df = spark.createDataFrame(rows, "ticker string, ts timestamp_ntz, price double, seq long")
    for d in range(4):
        df.filter(F.dayofmonth("ts") == d + 1).coalesce(1).write.mode("append").parquet(src)
    q = streams.live_indicators(streams.watch(spark, src, df.schema, "ts", files=1), 3, 3)
    q = q.writeStream.outputMode("append").format("memory").queryName("live_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p.numInputRows]) == 4
    got = [(round(r["ema"], 9), None if r["rsi"] is None else round(r["rsi"], 9)) for r in spark.table("live_out").orderBy("seq").collect()]
    assert got == plain_live([r[2] for r in rows], 3, 3)


def test_signals_of_a_date_in_two_batches(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    p = spark.createDataFrame([(t, dt.date(2024, 1, d), 7, r, 0.9) for t, d, r in (("A", 1, 0.1), ("B", 1, 0.001), ("C", 1, 0.3), ("A", 40 % 31, 0.2))], "ticker string, prediction_date date, horizon_days int, predicted_return double, confidence_score double")
    for t in "ABC":
        p.filter(F.col("ticker") == t).coalesce(1).write.mode("append").parquet(src)
    streams.signal_batches(streams.watch(spark, src, p.schema, files=1), out, str(tmp_path / "c")).awaitTermination()
    got = {(r["ticker"], r["prediction_date"].day): r["rank"] for r in spark.read.parquet(f"{out}/signals").collect()}
    assert got == {("C", 1): 1, ("A", 1): 2, ("A", 9): 1}


def test_rejected_rows_say_why(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.createDataFrame([("A", dt.date(2024, 1, 1), 1.0), (None, dt.date(2024, 1, 1), 2.0), (None, None, 3.0)], "indicator string, date date, value double")
    df.write.parquet(src)
    streams.insert_checked(streams.watch(spark, src, df.schema), "macro", str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "c")).awaitTermination()
    assert [r["value"] for r in spark.read.parquet(str(tmp_path / "ok")).collect()] == [1.0]
    assert {r["value"]: r["error"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()} == {2.0: "indicator is missing", 3.0: "date is missing; indicator is missing"}


def test_upsert_moves_a_key_between_partitions(spark, tmp_path):
    p = str(tmp_path / "t")
    rows = lambda x: spark.createDataFrame(x, "k int, y int, v double")
    sinks.upsert(rows([(1, 2000, 1.0), (2, 2001, 2.0), (None, 2001, 3.0), (4, 2003, 4.0)]), p, ["k"], ["y"])
    sinks.upsert(rows([(1, 2001, 5.0), (None, 2002, 6.0), (3, 2002, 7.0), (3, 2002, 8.0)]), p, ["k"], ["y"], latest="v")
    assert sorted(((r["k"], r["y"], r["v"]) for r in spark.read.parquet(p).collect()), key=str) == sorted([(1, 2001, 5.0), (2, 2001, 2.0), (None, 2002, 6.0), (3, 2002, 8.0), (4, 2003, 4.0)], key=str)
    assert [r["y"] for r in files.partitions(spark, p, "y").collect()] == [2001, 2002, 2003]


def test_partitions_named_like_numbers_stay_texts(spark, tmp_path):
    p = str(tmp_path / "t")
    rows = lambda x: spark.createDataFrame(x, "k int, d string, v double")
    sinks.upsert(rows([(1, "001", 1.0), (2, "1", 2.0), (3, "002", 3.0)]), p, ["k"], ["d"])
    sinks.upsert(rows([(1, "001", 5.0), (3, "1", 6.0)]), p, ["k"], ["d"])
    assert sorted(f.name for f in (tmp_path / "t").iterdir() if f.name.startswith("d=")) == ["d=001", "d=1"]
    assert sorted(tuple(r) for r in sinks.stored(spark, p, rows([]), ["d"]).select("k", "d", "v").collect()) == [(1, "001", 5.0), (2, "1", 2.0), (3, "1", 6.0)]


def test_null_keys_are_appended_once(spark, tmp_path):
    p = str(tmp_path / "t")
    df = spark.createDataFrame([(None, "a"), (1, "a"), (1, None)], "k int, d string")
    assert sinks.append_new(df, p, ["k", "d"]) == 3 and sinks.append_new(df, p, ["k", "d"]) == 0


def test_delete_leaves_other_partitions_alone(spark, tmp_path):
    p = str(tmp_path / "t")
    sinks.write_partitioned(spark.createDataFrame([(1, "a b:c"), (2, "a b:c"), (3, "d"), (4, "e")], "k int, d string"), p, ["d"])
    named = lambda: {r["f"] for r in spark.read.parquet(p).select(F.col("_metadata.file_path").alias("f")).distinct().collect()}
    before = named()
    assert sinks.delete(spark, p, "k = 1 or k = 4", ["d"]) == 2
    assert {r["k"] for r in spark.read.parquet(p).collect()} == {2, 3} and len(before & named()) == 1
    assert [r["d"] for r in files.partitions(spark, p, "d").collect()] == ["a b:c", "d"] and files.latest_partition(spark, p, "d").first()["k"] == 3


def test_long_paths_are_followed_to_their_end(spark):
    """A chain of 54 nodes: no bound on hops cuts it."""
    from tapeloom.operators import graph

    pairs = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}", 1.0) for i in range(53)], "u string, v string, weight double")
    h = graph.hops(pairs, spark.createDataFrame([("n00",)], "node string"))
    assert h.agg(F.max("hop"), F.count("*")).first()[:] == (53, 54)


def test_clusters_are_declared_and_prune(spark):
    """A table of bars by ticker: DESCRIBE shows the clusters, and a filter on a ticker reads one bucket of each partition."""
    sinks.drop_table(spark, "clustered_bars")
    sinks.create_table(spark, "clustered_bars", "bars_daily", partition="year int", buckets=8)
    rows = spark.range(400).selectExpr("concat('T', id % 20) AS ticker", "date_add(date'2023-01-01', cast(id AS int)) AS date", "1.0D AS close")
    sinks.insert_clustered(rows.withColumn("year", F.year("date")), "clustered_bars")
    shown = {r["col_name"]: r["data_type"] for r in sinks.describe(spark, "clustered_bars").collect()}
    assert shown["Num Buckets"] == "8" and shown["Bucket Columns"] == "[`ticker`]" and shown["Sort Columns"] == "[`ticker`]"
    one = spark.table("clustered_bars").filter("ticker = 'T3'")
    rows_of = one.select("_metadata.file_path").distinct().collect()
    own = {re.search(r"_(\d{5})\.", r[0]).group(1) for r in rows_of}
    every = spark.table("clustered_bars").inputFiles()
    others = [f for f in every if re.search(r"_(\d{5})\.", f).group(1) not in own]
    assert len(own) == 1 and len(others) > len(every) / 2 and spark.table("clustered_bars").count() == 400
    for f in others:  # a scan of them would fail now
        os.remove(unquote(f.removeprefix("file:")).replace("//", "/"))
    assert one.count() == 20
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        spark.table("clustered_bars").agg(F.sum("close")).collect()
    sinks.drop_table(spark, "clustered_bars")


def test_fingerprints_name_what_differs(spark):
    from tapeloom.operators import quality

    a = spark.createDataFrame([(1, "x", 1.5), (1, "x", 1.5), (2, "y|z", None), (3, None, 2.0), (None, "n", 0.0)], "p int, s string, v double")
    b = spark.createDataFrame([(1, "x", 1.5), (1, "x", 1.5), (2, "y|z", 7.0), (4, None, 2.0), (None, "n", 0.0)], "p int, s string, v double")
    assert quality.fold_fingerprints(quality.fingerprint(a, ["p"])).collect() == quality.fingerprint(a).collect()
    assert sorted(r["p"] for r in quality.differing_partitions(a, b, ["p"]).collect()) == [2, 3, 4]
    assert quality.differing_partitions(a, a.repartition(5), ["p"]).count() == 0
    spelled = [quality.fingerprint(spark.createDataFrame([r], "a string, b string")).first()[1] for r in (("x", None), ("x", "n"), ("x|", "n"), ("x", "|n"), (None, "x"))]
    assert len(set(spelled)) == 5
