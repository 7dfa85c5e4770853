"""Streams whose rows come late, twice or revised."""

import datetime as dt
import random

from pyspark.sql import functions as F
from test_io import plain_live

from tapeloom.scratch import arrange
from tapeloom.streaming import streams

TICKS = "ticker string, ts timestamp_ntz, price double, seq long"


def land(spark, rows, schema, path):
    """Rows (land, ...) as files that a stream takes in the order of `land`."""
    spark.createDataFrame(rows, f"land int, {schema}").repartition("land").write.partitionBy("land").parquet(path)
    arrange(spark, path, "land")
    return f"{path}/*"


def test_rows_leave_in_the_order_of_their_time(spark, tmp_path):
    """Days of two tickers land in a shuffled order, one file a batch; a tick without a price and one too late are among them."""
    g, start = random.Random(1), dt.datetime(2024, 1, 1)
    rows, prices = [], {"A": [], "B": []}
    for i in range(90):
        for t in ("A", "B"):
            price = None if i == 40 else 10.0 + (i * 7 + len(t) + ord(t)) % 11
            prices[t].append(price)
            day = i // 10
            rows.append((day - day % 3 + (2, 0, 1)[day % 3], t, start + dt.timedelta(days=day, hours=i % 10, minutes=g.randrange(2)), price, i))
    rows += [(60, "A", start, 5.0, -5), (50, "~", start + dt.timedelta(days=60), 0.0, -1), (1, None, start, 1.0, 7), (1, "A", None, 1.0, 7)]
    path = land(spark, rows, TICKS, str(tmp_path / "in"))
    s = streams.ordered_indicators(streams.watch(spark, path, spark.createDataFrame([], TICKS).schema, "ts", "4 days", files=1), 3, 3)
    q = streams.append_to(s, str(tmp_path / "out"), str(tmp_path / "c"))
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p.numInputRows]) == 11
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()
    assert {r["ticker"] for r in got} == {"A", "B"}
    for t in ("A", "B"):
        own = [r for r in got if r["ticker"] == t]
        assert [r["price"] for r in own] == prices[t]
        want = plain_live([p for p in prices[t] if p is not None], 3, 3)
        want.insert(40, want[39])  # nothing changes without a price
        assert [(round(r["ema"], 9), None if r["rsi"] is None else round(r["rsi"], 9)) for r in own] == want


PREDICTIONS = "ticker string, prediction_date date, horizon_days int, predicted_return double, confidence_score double"


def test_a_revised_prediction_withdraws_its_signal(spark, tmp_path):
    day = dt.date(2024, 1, 1)
    rows = [(0, "A", day, 7, 0.5, 0.9), (0, "B", day, 7, 0.1, 0.9), (0, "D", day, 7, 0.1, 0.9), (0, "C", day, 30, 0.2, 0.9), (1, "A", day, 7, 0.001, 0.9), (1, "C", day, 30, -0.4, 0.8), (1, "C", day, 30, 0.3, 0.7), (2, "B", day, 7, None, 0.9), (2, None, day, 7, 0.3, 0.9), (3, "E", day, 7, -0.3, 0.9)]
    path, out = land(spark, rows, PREDICTIONS, str(tmp_path / "in")), str(tmp_path / "out")
    s = streams.watch(spark, path, spark.createDataFrame([], PREDICTIONS).schema, files=1)
    streams.write_signal_changes(s, out, str(tmp_path / "c")).awaitTermination()
    log = sorted((r["horizon_days"], r["version"], r["ticker"], r["signal"], r["rank"]) for r in spark.read.parquet(out).collect())
    assert log == sorted([
        (7, 1, "A", "BUY", 1), (7, 1, "B", "BUY", 2), (7, 1, "D", "BUY", 2), (30, 1, "C", "BUY", 1), (30, 2, "C", "SELL", 1),
        (7, 2, "A", None, None), (7, 2, "B", "BUY", 1), (7, 2, "D", "BUY", 1), (7, 3, "B", None, None), (7, 4, "E", "SELL", 1), (7, 4, "D", "BUY", 2),
    ], key=lambda x: x[:3])
    assert sorted((r["horizon_days"], r["ticker"], r["signal"], r["rank"]) for r in streams.current_signals(spark, out).collect()) == [(7, "D", "BUY", 2), (7, "E", "SELL", 1), (30, "C", "SELL", 1)]


def test_only_the_best_are_said(spark, tmp_path):
    day = dt.date(2024, 1, 1)
    rows = [(0, t, day, 7, r, 1.0) for t, r in (("A", 0.1), ("B", 0.2), ("C", 0.3))] + [(1, "D", day, 7, 0.4, 1.0), (2, "C", day, 7, 0.0, 1.0)]
    path, out = land(spark, rows, PREDICTIONS, str(tmp_path / "in")), str(tmp_path / "out")
    streams.write_signal_changes(streams.watch(spark, path, spark.createDataFrame([], PREDICTIONS).schema, files=1), out, str(tmp_path / "c"), most=2).awaitTermination()
    log = sorted((r["version"], r["ticker"], r["rank"] or 0) for r in spark.read.parquet(out).collect())
    assert log == [(1, "B", 2), (1, "C", 1), (2, "B", 0), (2, "C", 2), (2, "D", 1), (3, "B", 2), (3, "C", 0)]


def test_a_month_may_lose_its_last_signal(spark, tmp_path):
    """The table by month: a revision leaves no signal behind."""
    rows = [(0, "A", dt.date(2024, 1, 1), 7, 0.5, 0.9), (0, "B", dt.date(2024, 2, 1), 7, 0.5, 0.9), (1, "A", dt.date(2024, 1, 1), 7, 0.001, 0.9)]
    path, out = land(spark, rows, PREDICTIONS, str(tmp_path / "in")), str(tmp_path / "out")
    streams.signal_batches(streams.watch(spark, path, spark.createDataFrame([], PREDICTIONS).schema, files=1), out, str(tmp_path / "c")).awaitTermination()
    assert [r["ticker"] for r in spark.read.parquet(f"{out}/signals").collect()] == ["B"]
    assert spark.read.parquet(f"{out}/predictions").filter(F.col("ticker") == "A").count() == 1
