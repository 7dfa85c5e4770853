"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to `bits` bits, the curve index of the cell orders the rows, and runs of that
order become shards and files. Rows that are near in all dimensions land in one run, so a reader that filters
on any of the dimensions prunes whole files by their minima and maxima.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.llm.common import cut, shuffle_partitions, small, table

DIMENSION_LIMIT = 20_000


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of integer points, one row a point; works on all points at once.

    The coordinates are turned into the transposed index from the top bit down (reflections and swaps of the
    first axis), then Gray decoded, then their bits are interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(n):
            high = (x[i] >> bit) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap if i else 0
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= flip
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> bit) & 1)
    return out


def hilbert(bits: int, *dims: Column) -> Column:
    """Column of the curve index of quantised dimensions."""
    @F.pandas_udf("long")
    def index(*cols: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in cols], 1), bits))

    return index(*dims)


def placed(df: DataFrame, order: list) -> DataFrame:
    """Rows sorted over all tasks and written once, with `_task` and the place `_at` within it, both from 0."""
    parts = shuffle_partitions(df.sparkSession)
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kept = cut(dealt.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    return kept.withColumns({"_task": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})


def starts(kept: DataFrame, value: Column) -> DataFrame:
    """Sum of a value over all tasks before each task: _task, _start. One row a task."""
    sums = kept.groupBy(F.col("_task").alias("_t")).agg(F.sum(value).alias("_n"))
    return F.broadcast(sums.select("_t", (F.sum("_n").over(Window.orderBy("_t")) - F.col("_n")).alias("_start")))


def ranked(df: DataFrame, col: str, bits: int, out: str, n_rows: int) -> DataFrame:
    """Quantise a column of any sortable type by the share of rows below its value; null sorts first.

    Cells hold near equal numbers of rows where values allow. Distinct values are sorted over all tasks, which add up.
    """
    values = df.groupBy(F.col(col).alias("_v")).agg(F.count("*").alias("_n"))
    kept = placed(values, [F.col("_v").asc_nulls_first()])
    inside = F.sum("_n").over(Window.partitionBy("_task").orderBy("_at")) - F.col("_n")
    below = kept.withColumn("_below", inside).join(starts(kept, F.col("_n")), F.col("_task") == F.col("_t"))
    cells = cut(below.select("_v", F.floor((F.col("_start") + F.col("_below")) / max(1, n_rows) * (1 << bits)).cast("int").alias(out)), "cells")
    return df.join(small(cells, cells.count(), DIMENSION_LIMIT), F.col(col).eqNullSafe(F.col("_v")), "left").drop("_v")


def positions(df: DataFrame, order: list[str]) -> DataFrame:
    """Add `rank` from 0 in the given total order, without a task that holds all rows."""
    kept = placed(df, order)
    return kept.join(starts(kept, F.lit(1)), F.col("_task") == F.col("_t")).withColumn("rank", F.col("_start") + F.col("_at")).drop("_at", "_task", "_start", "_t")


def hilbert_shards(docs: DataFrame, shards: int = 8, dims: tuple[str, ...] = ("source", "lang"), id_col: str = "doc_id", text_col: str = "text", bits: int = 8, whole: bool = False) -> DataFrame:
    """Deal documents into runs of the Hilbert curve over `dims` and the logarithm of their size.

    Law `rows`: shards hold the same number of rows, give or take one. Returns doc_id, size (UTF-8 bytes plus
    one; null text: 1), text_crc32 (null text: 0, as the empty text), hilbert, shard, slot (gapless from 0); with
    `whole` also `row`, a struct of all columns of the input, of whatever names, which then move with it.
    Nulls in a dimension sort first. Ties on the curve are ordered by text hash and id, so equal texts of one
    cell are neighbours; rows that repeat in everything may change places. With fewer rows than shards, some
    shards are empty. An empty table gives an empty result. A long text moves only as its size and checksums.
    """
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []
    rows = docs.select(F.col(id_col).alias("doc_id"), *[F.col(d).alias(f"d{i}") for i, d in enumerate(dims)], (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.xxhash64(data).alias("text_hash"), *row)
    rows = cut(rows.withColumn("grade", F.floor(F.log2("size") * 4).cast("int")), "meta")
    n = rows.count()
    names = [f"d{i}" for i in range(len(dims))] + ["grade"]
    for i, d in enumerate(names):
        rows = ranked(rows, d, bits, f"q{i}", n)
    rows = rows.withColumn("hilbert", hilbert(bits, *[F.col(f"q{i}") for i in range(len(names))])).drop(*names, *[f"q{i}" for i in range(len(names))])
    rows = positions(rows, ["hilbert", "text_hash", "doc_id"])
    base, more = divmod(n, shards)
    # the first `more` shards hold base + 1 rows
    edge = more * (base + 1)
    r = F.col("rank")
    first = F.when(r < edge, F.floor(r / (base + 1))).otherwise(more + F.floor((r - edge) / max(base, 1)))
    start = F.when(F.col("shard") <= more, F.col("shard") * (base + 1)).otherwise(edge + (F.col("shard") - more) * base)
    return rows.withColumn("shard", first.cast("int")).withColumn("slot", (r - start).cast("long")).drop("rank", "text_hash")


def write_shards(docs: DataFrame, path: str, rows_a_file: int = 200_000, **how) -> None:
    """Write whole rows as one folder a shard, each file a run of the curve, for pruning by file statistics.

    Takes the parameters of hilbert_shards. Each row moves with its place, so null ids and repeated rows are written
    as often as they occur. Slots cut a shard into files of equal rows, so no task writes a whole shard.
    """
    rows = hilbert_shards(docs, whole=True, **how).withColumn("_run", F.floor(F.col("slot") / rows_a_file))
    rows = rows.repartition("shard", "_run").sortWithinPartitions("shard", "slot")
    rows.select(F.col("row.*"), F.col("shard").alias("_shard")).write.partitionBy("_shard").option("maxRecordsPerFile", rows_a_file).parquet(path)


def op3(spark, sf_dir):
    """All documents in eight shards along the curve over source, language and size, by the law `rows`."""
    placed = hilbert_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
