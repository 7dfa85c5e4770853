"""Helpers that several operators share: scratch tables, table reading, hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.scratch import Rounds, cut, folder  # noqa: F401

# Words are runs of bytes outside space and the five ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_caches: list[dict] = []


def worker_cache() -> dict:
    """A dict that an operator keeps in a Python worker between tasks, to save time alone."""
    _caches.append({})
    return _caches[-1]


def drop_caches() -> None:
    """Free what earlier stages keep in this worker; a stage that needs memory for whole texts begins so."""
    for c in _caches:
        c.clear()


def text_batches(spark: SparkSession, rows: int = 500) -> None:
    """Hand Python whole texts in batches of fewer rows than Spark's default of 10,000, in this session.

    A batch lives several times over in a worker (Arrow, strings, arrays), so its size bounds the memory.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unit_hash(*cols: Column | str) -> Column:
    """A number in [0, 1) that depends on the values alone, so that reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Hint a broadcast only for a row count that was checked; a shuffle join serves beyond it."""
    return F.broadcast(df) if rows <= limit else df


def named_apart(df: DataFrame, id_col: str, value: Column, twice: DataFrame, limit: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """Rows whose id is in `twice` go by a name for their id and value; also the names themselves (name, of).

    Names are numbers above all ids, fixed by a written table, so the smallest of some ids and names is an id.
    """
    top = df.agg(F.max(id_col)).first()[0]
    valued = df.withColumn("_value", value)
    ids = small(twice.select(F.col(id_col).alias("_id")), twice.count(), limit)
    several = valued.join(ids, F.col(id_col) == F.col("_id"), "left_semi").select(F.col(id_col).alias("of"), F.col("_value").alias("_of_value")).distinct()
    names = cut(several.withColumn("name", F.lit(top + 1) + F.monotonically_increasing_id()), "names")
    named = valued.join(small(names, names.count(), limit), (F.col(id_col) == F.col("of")) & (F.col("_value") == F.col("_of_value")), "left")
    return named.withColumn(id_col, F.coalesce("name", id_col)).select(df.columns), names.select("name", "of")


def whole_groups(batches, key: list[str]):
    """Frames of whole groups from batches that are sorted by `key`: the last group of a batch may go on in the next."""
    import pandas as pd

    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        last = (pdf[key] == pdf[key].iloc[-1]).all(axis=1).to_numpy()
        rest = pdf[last]
        if not last.all():
            yield pdf[~last].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True)
