"""Structured Streaming counterparts of the polling loops: deduplicated ingestion, rolling up, live indicators."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeloom import schemas
from tapeloom.operators import signals
from tapeloom.sources import sinks


def watch(spark: SparkSession, path: str, schema, time: str | None = None, delay: str = "1 day", files: int | None = 100) -> DataFrame:
    """Parquet files of a folder as a stream; a time column without zone is taken as the session's zone.

    Beyond `files` landed files there are several batches, and rows older than the watermark of an earlier batch are
    late, in whatever order files were written. A backfill of landed files takes them all as one batch: None.
    """
    reader = spark.readStream.schema(schema)
    s = (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(path)
    return s.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay) if time else s


def deduplicated(stream: DataFrame, keys: list[str]) -> DataFrame:
    """First row of each key within the watermark; state is dropped once it has passed."""
    return stream.dropDuplicatesWithinWatermark(keys)


def append_to(stream: DataFrame, path: str, checkpoint: str, by: list[str] = ()):
    """Append each batch to a partitioned dataset, exactly once: the file sink logs its batches."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (w.partitionBy(*by) if by else w).start()


def ingest_bars(stream: DataFrame, path: str, checkpoint: str):
    return append_to(deduplicated(stream, ["symbol", "timestamp"]), path, checkpoint)


def ingest_news(stream: DataFrame, path: str, checkpoint: str):
    return append_to(deduplicated(stream, ["symbol", "timestamp", "title"]), path, checkpoint)


def signal_batches(stream: DataFrame, path: str, checkpoint: str, **limits):
    """Signals below `path`/signals from predictions as they come, kept below `path`/predictions, both by month.

    A batch adds its predictions (or replaces ones of the same ticker, date and horizon) and ranks the months it
    touches anew together with what is stored of them, so a date may come in several batches, and a batch twice.
    """
    month = F.date_format("prediction_date", "yyyy-MM")

    def one(batch: DataFrame, number: int) -> None:
        new = batch.withColumn("month", month)
        sinks.upsert(new, f"{path}/predictions", ["ticker", "prediction_date", "horizon_days"], ["month"])
        touched = new.select("month").distinct()
        known = sinks.stored(batch.sparkSession, f"{path}/predictions")
        found = signals.signals(known.join(touched, known["month"].eqNullSafe(touched["month"]), "left_semi"), **limits)
        if sinks.stored(batch.sparkSession, f"{path}/signals") is None:
            sinks.write_partitioned(found, f"{path}/signals", ["month"])
        else:  # a month may have lost its last signal
            sinks.replace_partitions(sinks.staged(found), f"{path}/signals", ["month"], sinks.staged(touched))

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def insert_checked(stream: DataFrame, table: str, path: str, rejected: str, checkpoint: str):
    """Append rows that fit a declared table; the others go to `rejected` with the reason in `error`.

    A row fits if each required column is there and not null. A batch that is run again replaces its own folder.
    """
    t = schemas.table(table)
    missing = F.array(*[F.when(F.col(f.name).isNull() if f.name in stream.columns else F.lit(True), F.lit(f"{f.name} is missing")) for f in t.schema if not f.nullable])

    def one(batch: DataFrame, number: int) -> None:
        marked = batch.withColumn("error", F.array_join(F.array_compact(missing), "; "))
        good = marked.filter("error = ''").drop("error")
        full = good.withColumns({f.name: F.lit(None) for f in t.schema if not f.nullable and f.name not in good.columns})
        schemas.conform(full, t).write.mode("overwrite").parquet(f"{path}/batch={number}")
        marked.filter("error != ''").write.mode("overwrite").parquet(f"{rejected}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_bars(ticks: DataFrame, time: str = "ts", order: str = "seq") -> DataFrame:
    """Tumbling daily bars of a tick stream with a watermark; rows later than that are dropped."""
    at = F.struct(time, order)
    g = ticks.groupBy("ticker", F.window(time, "1 day").alias("w")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").alias("volume"))
    return g.select("ticker", F.to_date("w.start").alias("date"), "open", "high", "low", "close", "volume")


LIVE = "ticker string, ts timestamp, seq long, price double, ema double, rsi double"
STATE = "last double, ema double, gain double, loss double, seen bigint"
START = (None, None, 0.0, 0.0, 0)


def advance(state: tuple, prices: list[float], alpha: float, n: int) -> tuple[tuple, list, list]:
    """State, EMA and RSI after each price; a missing price (null or NaN) changes nothing and repeats what was there."""
    last, ema, gain, loss, seen = state
    emas, rsis = [], []
    for price in prices:
        if price is not None and price == price:
            ema = price if ema is None else ema + alpha * (price - ema)
            if last is not None:
                d, seen = price - last, seen + 1
                k = min(seen, n)
                gain, loss = gain + (max(d, 0.0) - gain) / k, loss + (max(-d, 0.0) - loss) / k
            last = price
        emas.append(ema)
        rsis.append(100 * gain / (gain + loss) if seen >= n and gain + loss > 0 else None)
    return (last, ema, gain, loss, seen), emas, rsis


def _kept(state: tuple) -> tuple:
    return (*[None if x is None else float(x) for x in state[:4]], int(state[4]))


class LiveIndicators(StatefulProcessor):
    """EMA and Wilder RSI of one ticker as rows come; the state is the last value of each recurrence."""

    def __init__(self, span: int, n: int):
        self.alpha, self.n = 2 / (span + 1), n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("recurrences", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["ts", "seq"])
        state, emas, rsis = advance(self.state.get() if self.state.exists() else START, pdf["price"].tolist(), self.alpha, self.n)
        if emas:
            self.state.update(_kept(state))
        yield pdf[["ticker", "ts", "seq", "price"]].assign(ema=pd.array(emas, "Float64"), rsi=pd.array(rsis, "Float64"))

    def close(self) -> None:
        pass


HELD = np.dtype([("us", "<i8"), ("seq", "<i8"), ("price", "<f8")])


class OrderedIndicators(StatefulProcessor):
    """EMA and Wilder RSI of one ticker in the order of event time, whatever the order of arrival.

    Rows wait in a map of time slices. A slice has a timer at its end; when the watermark has passed it, no row of the
    slice can come any more, so its rows are put in order, run through the recurrences and leave. Timers fire in
    the order of time, and a call holds the rows of one slice.
    """

    def __init__(self, span: int, n: int, slice_ms: int):
        self.alpha, self.n, self.slice_ms = 2 / (span + 1), n, slice_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("recurrences", STATE)
        self.held = handle.getMapState("held", "slice bigint", "data binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            got = np.empty(len(pdf), HELD)
            for c in HELD.names:
                got[c] = pdf[c].to_numpy()
            of = got["us"] // (1000 * self.slice_ms)
            for number in np.unique(of).tolist():
                before = self.held.getValue((number,))
                if before is None:
                    self.handle.registerTimer((number + 1) * self.slice_ms)
                self.held.updateValue((number,), ((bytes(before[0]) if before else b"") + got[of == number].tobytes(),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        number = expiredTimerInfo.getExpiryTimeInMs() // self.slice_ms - 1
        rows = np.sort(np.frombuffer(bytes(self.held.getValue((number,))[0]), HELD), order=["us", "seq", "price"])
        self.held.removeKey((number,))
        state, emas, rsis = advance(self.state.get() if self.state.exists() else START, rows["price"].tolist(), self.alpha, self.n)
        self.state.update(_kept(state))
        price = pd.array(rows["price"], "Float64")
        price[np.isnan(rows["price"])] = pd.NA
        yield pd.DataFrame({"ticker": key[0], "us": rows["us"], "seq": rows["seq"], "price": price, "ema": pd.array(emas, "Float64"), "rsi": pd.array(rsis, "Float64")})

    def close(self) -> None:
        pass


def _rocksdb(spark: SparkSession) -> None:
    """Stateful processors need this state store, which is set for the session's streams."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def ordered_indicators(ticks: DataFrame, span: int = 20, n: int = 14, slice_seconds: int = 3600) -> DataFrame:
    """EMA and Wilder RSI of each ticker in the order of (ts, seq): ticker, ts, seq, price, ema, rsi.

    `ticks` has a watermark on ts. Rows may come in any order within its delay, over any number of batches, and
    leave when the watermark has passed the end of their slice of `slice_seconds`; later ones are dropped by the
    watermark. Results are those of one pass over all rows. Rows without a time or a ticker are left out, a null
    price changes nothing, repeated rows count as often as they come. A slice of a ticker's rows is held at once.
    """
    _rocksdb(ticks.sparkSession)
    timed = ticks.filter("ts is not null and ticker is not null").select("ticker", "ts", F.unix_micros("ts").alias("us"), F.col("seq").cast("long").alias("seq"), F.col("price").cast("double").alias("price"))
    out = timed.groupBy("ticker").transformWithStateInPandas(OrderedIndicators(span, n, 1000 * slice_seconds), outputStructType="ticker string, us long, seq long, price double, ema double, rsi double", outputMode="Append", timeMode="EventTime")
    return out.select("ticker", F.timestamp_micros("us").alias("ts"), "seq", "price", "ema", "rsi")


NOTHING = (float("-inf"), 0.0)
CHANGE = "prediction_date date, horizon_days int, ticker string, version long, signal string, strength double, rank int"


class RankedSignals(StatefulProcessor):
    """Signals of one date and horizon: what is known of each ticker, and what has been said of it."""

    def __init__(self, least_confidence: float, least_return: float, most: int | None):
        self.least_confidence, self.least_return, self.most = least_confidence, least_return, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        # one value: a date and horizon is read and written as a whole
        self.state = handle.getValueState("signals", "known string, said string, version bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, said, number = self.state.get() if self.state.exists() else ("{}", "{}", 0)
        known, said = json.loads(known), {t: tuple(x) for t, x in json.loads(said).items()}
        new: dict[str, tuple[float, float]] = {}
        for pdf in rows:
            for ticker, r, c in zip(pdf["ticker"].tolist(), pdf["predicted_return"].tolist(), pdf["confidence_score"].tolist(), strict=True):
                fine = r is not None and c is not None and r == r and c == c
                new[ticker] = max(new.get(ticker, NOTHING), (c, r) if fine else NOTHING)
        for ticker, (c, r) in new.items():
            if c >= self.least_confidence and abs(r) >= self.least_return:
                known[ticker] = (r, c)
            else:
                known.pop(ticker, None)
        now = {}
        rank, last = 0, None
        for weakness, ticker, r in sorted((-abs(r) * c, t, r) for t, (r, c) in known.items())[: self.most]:
            rank, last = rank + (weakness != last), weakness
            now[ticker] = ("BUY" if r > 0 else "SELL", -weakness, rank)
        changed = {t: x for t, x in now.items() if said.get(t) != x} | {t: (None, None, None) for t in said if t not in now}
        number += bool(changed)
        self.state.update((json.dumps(known), json.dumps(now), number))
        if not changed:
            return
        yield pd.DataFrame({
            "prediction_date": key[0], "horizon_days": key[1], "ticker": list(changed), "version": number,
            "signal": [x[0] for x in changed.values()], "strength": pd.array([x[1] for x in changed.values()], "Float64"), "rank": pd.array([x[2] for x in changed.values()], "Int32"),
        })

    def close(self) -> None:
        pass


def signal_changes(predictions: DataFrame, least_confidence: float = 0.6, least_return: float = 0.02, most: int | None = None) -> DataFrame:
    """Changes of the signals of each date and horizon as predictions come and are revised, one row a changed ticker.

    prediction_date, horizon_days, ticker, version (rising within date and horizon), signal, strength, rank; a
    withdrawn signal has nulls in the last three. A prediction replaces the one before it for its ticker, date and
    horizon (of one batch the one of greatest confidence, then return); a null return or confidence withdraws it. Ranks
    are dense, by strength; `most` keeps that many of the best, equal ones by ticker. A call holds the tickers of
    one date and horizon that have a signal. Rows without a ticker, date or horizon are left out.
    """
    _rocksdb(predictions.sparkSession)
    fine = predictions.filter("ticker is not null and prediction_date is not null and horizon_days is not null")
    rows = fine.select("prediction_date", F.col("horizon_days").cast("int").alias("horizon_days"), "ticker", F.col("predicted_return").cast("double").alias("predicted_return"), F.col("confidence_score").cast("double").alias("confidence_score"))
    return rows.groupBy("prediction_date", "horizon_days").transformWithStateInPandas(RankedSignals(least_confidence, least_return, most), outputStructType=CHANGE, outputMode="Append", timeMode="None")


def write_signal_changes(predictions: DataFrame, path: str, checkpoint: str, **limits):
    """Append the changes of a stream of predictions to a log, exactly once; nothing stored is read or rewritten."""
    return append_to(signal_changes(predictions, **limits), path, checkpoint)


def current_signals(spark: SparkSession, path: str) -> DataFrame:
    """The signals that hold by a log of changes: the last version of each, unless it was withdrawn."""
    key = ["prediction_date", "horizon_days", "ticker"]
    last = spark.read.parquet(path).groupBy(*key).agg(F.max_by(F.struct("signal", "strength", "rank"), "version").alias("x"))
    return last.select(*key, "x.*").filter("signal is not null")


def live_indicators(ticks: DataFrame, span: int = 20, n: int = 14) -> DataFrame:
    """EMA and Wilder RSI of each ticker as rows arrive: ticker, ts, seq, price, ema, rsi.

    Rows are put in (ts, seq) order within a batch; rows older than ones of an earlier batch are taken as they
    come (`ordered_indicators` waits for them). Averages of gains and losses are plain means until n steps are there.
    """
    _rocksdb(ticks.sparkSession)
    return ticks.groupBy("ticker").transformWithStateInPandas(LiveIndicators(span, n), outputStructType=LIVE, outputMode="Append", timeMode="None")
