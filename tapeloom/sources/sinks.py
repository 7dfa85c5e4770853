"""Writing: append, overwrite, upsert, delete, partitioned files, tables, views, retention.

A write that reads its own target goes through a table in the shared checkpoint folder first, so that a lost
executor never leaves the target half read. Then the partitions it touches are replaced, or, without partitions, the
new table takes the place of the old one by a change of names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom import schemas
from tapeloom.operators.bars import keep_one
from tapeloom.scratch import cut as staged
from tapeloom.scratch import remove, swap


def stored(spark: SparkSession, path: str, like: DataFrame | None = None, by: list[str] = ()) -> DataFrame | None:
    """The dataset at a path, or None if there is none yet. Partition columns `by` are of the types that `like` has, so
    that a text in the name of a folder (as "001") isn't read as a number."""
    try:
        df = spark.read.parquet(path)
        if like is None:
            return df
        kinds = {f.name: f.dataType for f in like.schema if f.name in by}
        wanted = T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in df.schema])
        return df if [f.dataType for f in wanted] == [f.dataType for f in df.schema] else spark.read.schema(wanted).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def write_partitioned(df: DataFrame, path: str, by: list[str] = (), mode: str = "append", compression: str = "snappy", replace_touched: bool = False) -> None:
    """Hive-style files; with `replace_touched` only the partitions that the frame holds are replaced.

    Rows are dealt out by partition, with further splits of large ones, so that files are few and none is huge.
    """
    dealt = df.hint("rebalance", *by) if by else df
    w = dealt.write.option("compression", compression).mode("overwrite" if replace_touched else mode)
    w = w.option("partitionOverwriteMode", "dynamic") if replace_touched else w
    (w.partitionBy(*by) if by else w).parquet(path)


def insert(df: DataFrame, path: str, by: list[str] = (), replace: bool = False, at=None) -> None:
    """Append, or overwrite once, with the time of insertion (a parameter; the clock if not given)."""
    stamp = F.lit(at).cast("timestamp") if at else F.current_timestamp()
    write_partitioned(df.withColumn("inserted_at", stamp), path, by, "overwrite" if replace else "append")


def _matching(df: DataFrame, other: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys of which a null equals a null; `other` gives its keys alone."""
    right = other.select(*[F.col(k).alias(f"_key_{k}") for k in keys]).distinct()
    return df.join(right, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]), how)


def replace_partitions(rows: DataFrame, path: str, by: list[str], touched: DataFrame) -> None:
    """Make `rows` the content of the partitions in `touched` and leave the others alone.

    Partitions that have no row any more lose their folders, after the others are written.
    """
    spark = rows.sparkSession
    folders = stored(spark, path, rows, by).select(*by, F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("_folder"))
    emptied = _matching(_matching(folders, touched, by, "left_semi"), rows, by, "left_anti").select("_folder").distinct().collect()  # as many as partitions are touched
    write_partitioned(rows, path, by, replace_touched=True)
    for r in emptied:
        remove(spark, r["_folder"])


def upsert(df: DataFrame, path: str, keys: list[str], by: list[str] = (), latest: str | None = None) -> None:
    """Rows with a known key are replaced, others added; a null key equals a null key.

    Of incoming rows with one key the greatest in `latest` counts (or one that a hash of the row picks). Only the
    partitions that hold a known key, or get a row, are rewritten, so a key may move from one to another.
    """
    order = [F.col(latest).desc_nulls_last()] if latest else []
    df = staged(keep_one(df, keys, [*order, F.xxhash64(*df.columns)]))
    old = stored(df.sparkSession, path, df, by)
    if old is None:
        return write_partitioned(df, path, by)
    if not by:
        return swap(staged(_matching(old, df, keys, "left_anti").unionByName(df, allowMissingColumns=True)), path)
    touched = staged(_matching(old, df, keys, "left_semi").select(*by).unionByName(df.select(*by)).distinct())
    kept = _matching(_matching(old, touched, by, "left_semi"), df, keys, "left_anti")
    replace_partitions(staged(kept.unionByName(df, allowMissingColumns=True)), path, by, touched)


def append_new(df: DataFrame, path: str, keys: list[str], by: list[str] = ()) -> int:
    """Append the rows whose key isn't there yet (and once each); how many were appended. A null key is a key."""
    old = stored(df.sparkSession, path, df, by)
    new = df.dropDuplicates(keys)
    new = staged(_matching(new, old, keys, "left_anti") if old is not None else new)
    n = new.count()
    if n:
        write_partitioned(new, path, by)
    return n


def batch_insert(spark: SparkSession, records: list[dict], schema: str, path: str) -> None:
    write_partitioned(spark.createDataFrame(records, schema), path)


def delete(spark: SparkSession, path: str, where: str | Column, by: list[str] = ()) -> int:
    """Remove the rows for which the condition holds; how many they were. Partitions without such rows stay as they are."""
    old = stored(spark, path)
    if old is None:
        return 0
    c = F.expr(where) if isinstance(where, str) else where
    gone = old.filter(c).count()
    if not gone:
        return 0
    kept = ~F.coalesce(c, F.lit(False))
    if not by:
        swap(staged(old.filter(kept)), path)
        return gone
    touched = staged(old.filter(c).select(*by).distinct())
    replace_partitions(staged(_matching(old, touched, by, "left_semi").filter(kept)), path, by, touched)
    return gone


def retain(spark: SparkSession, path: str, as_of, days: int, col: str = "date", by: list[str] = ()) -> int:
    """Remove rows older than `days` before the as-of date; -1 keeps all."""
    return 0 if days < 0 else delete(spark, path, F.col(col) < F.date_sub(F.lit(as_of).cast("date"), days), by)


def retention_policy() -> dict[str, int]:
    return {name: schemas.table(name).days for name in schemas.TABLES}


def write_many(frames: dict[str, DataFrame], path: str) -> None:
    """Frames under a folder each, in one write if they have one schema."""
    it = iter(frames.items())
    name, df = next(it)
    all_rows = df.withColumn("dataset", F.lit(name))
    for name, df in it:
        all_rows = all_rows.unionByName(df.withColumn("dataset", F.lit(name)), allowMissingColumns=True)
    write_partitioned(all_rows, path, ["dataset"])


BUCKETS = 16


def create_table(spark: SparkSession, name: str, table: str, database: str = "default", partition: str | None = None, buckets: int = BUCKETS) -> None:
    """A declared table with its partition and its clusters: rows lie in buckets by the first cluster column, sorted by all.

    A filter on the first cluster column reads one bucket, and joins and aggregates on it need no exchange. `partition`
    (name and type) takes the place of the declared one, which has a folder a day.
    """
    t = schemas.table(table)
    more = [f"`{partition.split()[0]}` {partition.split()[1]}"] if partition else []
    columns = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in t.schema], *more])
    by = partition.split()[0] if partition else t.partition
    cluster = f" CLUSTERED BY ({t.cluster[0]}) SORTED BY ({', '.join(t.cluster)}) INTO {buckets} BUCKETS" if t.cluster and t.cluster[0] != by else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet" + (f" PARTITIONED BY ({by})" if by else "") + cluster)


def insert_clustered(df: DataFrame, name: str) -> None:
    """Append rows to a table by name of column; where it has buckets, a task writes few of them and one file each."""
    spark = df.sparkSession
    target = spark.table(name)
    found = describe(spark, name).filter("col_name in ('Num Buckets', 'Bucket Columns')").collect()
    facts = {r["col_name"]: r["data_type"] for r in found}
    rows = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema])
    if "Num Buckets" in facts:
        rows = rows.repartition(int(facts["Num Buckets"]), facts["Bucket Columns"].strip("[]`"))
    rows.write.insertInto(name)


def create_view(spark: SparkSession, name: str, sql: str) -> None:
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS {sql}")


def copy_table(spark: SparkSession, source: str, target: str) -> None:
    spark.table(source).write.saveAsTable(target)


def drop_table(spark: SparkSession, name: str) -> None:
    """Drop a table or a view."""
    kind = "VIEW" if spark.catalog.tableExists(name) and spark.catalog.getTable(name).tableType == "VIEW" else "TABLE"
    spark.sql(f"DROP {kind} IF EXISTS {name}")


def add_columns(spark: SparkSession, name: str, ddl: str) -> None:
    spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({ddl})")


def describe(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql(f"DESCRIBE EXTENDED {name}")
