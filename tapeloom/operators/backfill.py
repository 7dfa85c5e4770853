"""Bookkeeping of resumable backfills: progress, checkpoints of months, pending work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def start(spark: SparkSession, backfill_id: str, symbols: list[str], first, last, at) -> DataFrame:
    """One progress row; months_total is months times symbols."""
    months = F.floor(F.months_between(F.trunc(F.lit(last).cast("date"), "month"), F.trunc(F.lit(first).cast("date"), "month"))) + 1
    return spark.range(1).select(
        F.lit(backfill_id).alias("backfill_id"), F.lit("running").alias("status"), F.array(*map(F.lit, symbols)).alias("symbols"), F.lit(first).cast("date").alias("start_date"), F.lit(last).cast("date").alias("end_date"),
        (months * len(symbols)).cast("bigint").alias("months_total"), F.lit(0).cast("bigint").alias("months_done"), F.lit(at).cast("timestamp").alias("started_at"), F.lit(at).cast("timestamp").alias("updated_at"), F.lit(None).cast("string").alias("error"),
    )


def status(progress: DataFrame, backfill_id: str | None = None) -> DataFrame:
    p = progress.filter(F.col("backfill_id") == backfill_id) if backfill_id else progress
    return p.orderBy(F.desc("updated_at"))


def active(progress: DataFrame) -> DataFrame:
    return progress.filter(F.col("status").isin("pending", "running")).orderBy(F.desc("updated_at"))


def fail(progress: DataFrame, backfill_id: str, error: str, at) -> DataFrame:
    mine = F.col("backfill_id") == backfill_id
    return progress.withColumns({"status": F.when(mine, "failed").otherwise(F.col("status")), "error": F.when(mine, error).otherwise(F.col("error")), "updated_at": F.when(mine, F.lit(at).cast("timestamp")).otherwise(F.col("updated_at"))})


def checkpoint(fetched: DataFrame, backfill_id: str, data_type: str, at) -> DataFrame:
    """Checkpoint rows of symbol-months, ready to append: `fetched` has symbol, year, month, rows_fetched and error.

    A month with an error failed and has no count of rows.
    """
    failed = F.col("error").isNotNull()
    return fetched.select(
        F.lit(backfill_id).alias("backfill_id"), "symbol", F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month"), F.lit(data_type).alias("data_type"), F.when(failed, "failed").otherwise("completed").alias("status"),
        F.when(~failed, F.col("rows_fetched").cast("bigint")).alias("rows_fetched"), F.col("error").cast("string").alias("error"), F.lit(at).cast("timestamp").alias("created_at"),
    )


def job_log(spark: SparkSession, job_name: str, started, finished, success: bool, detail: str | None = None) -> DataFrame:
    """The record of one run, ready to append to the job log."""
    began, ended = F.lit(started).cast("timestamp"), F.lit(finished).cast("timestamp")
    return spark.range(1).select(F.lit(job_name).alias("job_name"), began.alias("started_at"), ended.alias("finished_at"), (F.unix_micros(ended) - F.unix_micros(began)).cast("double").alias("_us"), F.lit(success).alias("success"), F.lit(detail).cast("string").alias("detail")).select(
        "job_name", "started_at", "finished_at", (F.col("_us") / 1e6).alias("duration_seconds"), "success", "detail"
    )


def completed_months(checkpoints: DataFrame, symbol: str | None = None) -> DataFrame:
    c = checkpoints.filter("status = 'completed'")
    c = c.filter(F.col("symbol") == symbol) if symbol else c
    return c.select("symbol", "year", "month", "data_type").distinct()


def months(first, last):
    return F.sequence(F.trunc(F.lit(first).cast("date"), "month"), F.trunc(F.lit(last).cast("date"), "month"), F.expr("interval 1 month"))


def pending(symbols: DataFrame, checkpoints: DataFrame, first, last, data_type: str) -> DataFrame:
    """Months of each symbol without a completed checkpoint, newest first; every month of the range counts."""
    due = symbols.select("symbol").distinct().withColumn("m", F.explode(months(first, last)))
    due = due.select("symbol", F.year("m").alias("year"), F.month("m").alias("month"), F.lit(data_type).alias("data_type"))
    return due.join(completed_months(checkpoints), ["symbol", "year", "month", "data_type"], "left_anti").orderBy(F.desc("year"), F.desc("month"), "symbol")


def progress_eta(progress: DataFrame) -> DataFrame:
    """Percent, months an hour and hours left."""
    hours = (F.unix_timestamp("updated_at") - F.unix_timestamp("started_at")) / 3600
    p = progress.withColumns({"percent": F.try_divide(F.col("months_done") * 100.0, "months_total"), "months_per_hour": F.try_divide(F.col("months_done").cast("double"), hours)})
    return p.withColumn("hours_left", F.try_divide(F.col("months_total") - F.col("months_done"), "months_per_hour"))


# Days of the preset windows.
PRESETS = {"recent": 2, "week": 7, "month": 30}


def preset(name: str, as_of):
    """First and last day of a preset window, as columns."""
    end = F.lit(as_of).cast("date")
    return F.date_sub(end, PRESETS[name]), end


def preset_rows(df: DataFrame, name: str, as_of, col: str = "date") -> DataFrame:
    first, last = preset(name, as_of)
    return df.filter(F.col(col).between(first, last))


def batches(tickers: DataFrame, size: int) -> DataFrame:
    """Batch number of each ticker in name order."""
    return tickers.select("ticker").distinct().withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ticker")) - 1) / size))  # a dimension
