"""Reading partitioned Parquet datasets, SQL scans, and facts about the files behind them."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def query(spark: SparkSession, sql: str, **params) -> DataFrame:
    """A statement with named parameters (:name)."""
    return spark.sql(sql, args=params)


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, filters: list[tuple] = (), dates: tuple | None = None, date_col: str = "date") -> DataFrame:
    """Projection, filters (column, operator, value) that all hold, and an inclusive date range; all reach the scan."""
    df = spark.read.parquet(path)
    ops = {"=": "__eq__", "==": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
    for c, op, value in filters:
        df = df.filter(F.col(c).isin(list(value)) if op == "in" else ~F.col(c).isin(list(value)) if op == "not in" else getattr(F.col(c), ops[op])(value))
    if dates:
        df = df.filter(F.col(date_col).between(*[F.lit(d) for d in dates]))
    return df.select(*columns) if columns else df


def partitions(spark: SparkSession, path: str, col: str = "date") -> DataFrame:
    """Distinct values of a column in order: of a partition column from the names of folders, without opening a file."""
    df = spark.read.parquet(path)
    # a path is a URL of a name in which Spark escapes some characters itself
    names = [unquote(unquote(x)) for f in df.inputFiles() for x in f.split("/") if x.startswith(f"{col}=")]
    if not names:
        return df.select(col).distinct().orderBy(col)
    values = sorted({None if x == "__HIVE_DEFAULT_PARTITION__" else x for n in names for x in [n.split("=", 1)[1]]}, key=lambda x: (x is not None, x))
    listed = spark.createDataFrame([(x,) for x in values], f"`{col}` string")
    return listed.select(F.col(col).cast(df.schema[col].dataType).alias(col)).orderBy(col)


def latest_partition(spark: SparkSession, path: str, col: str = "date", filters: list[tuple] = ()) -> DataFrame:
    """Rows of the greatest partition, whose value is looked up first, so that the scan reads its files alone.

    With filters it is the greatest partition with a row that meets them.
    """
    df = scan(spark, path, filters=filters)
    top = (df.agg(F.max(col)) if filters else partitions(spark, path, col).agg(F.max(col))).first()[0]
    return df.filter(F.col(col) == F.lit(top)) if top is not None else df.filter(F.lit(False))


def dataset_info(df: DataFrame) -> DataFrame:
    """Rows, files and bytes of what a frame reads."""
    files = df.select("_metadata.file_path", "_metadata.file_size").groupBy("file_path").agg(F.count("*").alias("n"), F.first("file_size").alias("size"))
    return files.agg(F.sum("n").alias("records"), F.count("*").alias("files"), F.sum("size").alias("bytes"))


def universe(spark: SparkSession, groups: dict[str, list[dict]]) -> DataFrame:
    """Instrument groups of a configuration as rows: sector, ticker, name, market_cap, sub_industry."""
    rows = [(g, x.get("ticker"), x.get("name"), x.get("market_cap"), x.get("sub_industry")) for g, xs in groups.items() for x in xs]
    return spark.createDataFrame(rows, "sector string, ticker string, name string, market_cap string, sub_industry string")


def all_tickers(universe_df: DataFrame) -> DataFrame:
    return universe_df.select("ticker").distinct()


def constituents(df: DataFrame, col: str = "symbol") -> DataFrame:
    """Distinct symbols without a dot, in order."""
    return df.select(col).distinct().filter(~F.col(col).like("%.%")).orderBy(col)


def scan_landed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Payload files of many tickers in one read, parsed by kind; the ticker is that of the folder (ticker=...), or the
    file's name before its first dot."""
    from tapeloom.sources import payloads

    raw = spark.read.text(path, wholetext=True)
    if "ticker" not in raw.columns:
        raw = raw.withColumn("ticker", F.regexp_extract("_metadata.file_name", r"^([^.]+)", 1))
    return {"daily": payloads.daily, "hourly": payloads.hourly, "sentiment": payloads.news}[kind](raw)
