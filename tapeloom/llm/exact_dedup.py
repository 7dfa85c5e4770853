"""Exact deduplication over an extendible-hash index that is kept in shared files.

Every row gets a 64-bit key of its text. A directory of 2**depth slots, taken by a key's leading bits, points to
buckets, and it doubles while a bucket holds more entries than its capacity. The index lies in one file a range of
buckets, the range of an owner task, with one entry a key. Keys that one row has are settled by their entry. For the
others the rows look up their bucket and the texts go to its owner, summed up before they travel, so that a hot text
comes SPREAD times at most. The owner compares their bytes: texts that share a key by chance are entries of one
chain. The chains are written beside the index and the rows find their class in them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.llm.common import cut, shuffle_partitions, small, table

MAX_DEPTH = 40
MOST_SLOTS = 1 << 14
KEY_LIMIT = 1_000_000  # shared keys that are broadcast, of 16 bytes each
SPREAD = 16  # tasks that sum up the copies of one text


def slot(depth: int):
    """The directory slot of a key: its leading bits."""
    return F.shiftrightunsigned(F.col("key"), 64 - depth) if depth else F.lit(0).cast("long")


def directory(entries: DataFrame, n_entries: int, capacity: int) -> tuple[int, dict[int, tuple[int, int]]]:
    """Global depth, and for each slot of that depth (bucket prefix, local depth).

    The number of buckets is at most twice n_entries / capacity for hashed keys, and capacity keeps it below
    MOST_SLOTS, so the driver holds a table of bounded size. Keys that are no hashes and crowd into few buckets
    would need more slots than that, which is an error.
    """
    depth = max(0, math.ceil(math.log2(max(1, n_entries) / capacity)))
    done: dict[tuple[int, int], int] = {}
    counts = {r["s"]: r["n"] for r in entries.groupBy(slot(depth).alias("s")).agg(F.count("*").alias("n")).collect()}
    while True:
        over = [s for s, n in counts.items() if n > capacity]
        done |= {(s, depth): n for s, n in counts.items() if n <= capacity}
        if not over:
            break
        if depth >= MAX_DEPTH or (1 << (depth + 1)) > MOST_SLOTS:
            raise ValueError(f"{len(over)} buckets hold more than {capacity} keys at {1 << depth} slots: raise the capacity")
        # doubling: only the overfull buckets split, the others are reached from two slots
        parents = entries.filter(slot(depth).isin(over))
        depth += 1
        counts = {r["s"]: r["n"] for r in parents.groupBy(slot(depth).alias("s")).agg(F.count("*").alias("n")).collect()}
    slots: dict[int, tuple[int, int]] = {}
    for prefix, local in done:
        for low in range(1 << (depth - local)):
            slots[(prefix << (depth - local)) | low] = (prefix << (depth - local), local)
    return depth, slots


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None) -> DataFrame:
    """Mark every row of `docs` with the row that stays for its text.

    Returns doc_id, keep_id, group_size, kept, text_sha256, chain (place among the texts of one key). Null text
    counts as the empty text; all empty texts are equal. Of equal texts the largest id stays; null ids lose to any id.
    Rows that repeat both id and text are one document written twice: they share keep_id, count in group_size, and
    the flag `kept` is true for each of them. Texts of any length are compared as a whole. An empty table gives an
    empty result; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("key", F.xxhash64("t"))
    index = cut(rows.select("doc_id", "key", F.sha2("t", 256).alias("sha")), "rows")
    entries = cut(index.groupBy("key").agg(F.count("*").alias("n_rows")), "entries")
    n_entries = entries.count()
    capacity = capacity or max(1024, math.ceil(n_entries / (MOST_SLOTS // 8)))
    depth, slots = directory(entries, n_entries, capacity)
    # the directory has MOST_SLOTS rows at most, whatever the input
    pointers = F.broadcast(spark.createDataFrame([(s, b) for s, (b, _) in slots.items()] or [(0, 0)], "slot long, bucket long"))
    look_up = lambda df: df.withColumn("slot", slot(depth)).join(pointers, "slot").drop("slot")
    # an owner has a range of keys, and so of buckets
    owned = lambda df: df.repartitionByRange(shuffle_partitions(spark), "bucket", "key").sortWithinPartitions("bucket", "key")
    buckets = cut(owned(look_up(entries)), "buckets")

    shared = buckets.filter("n_rows > 1").select("bucket", "key")
    n_shared = shared.count()
    texts = look_up(rows).join(small(shared, n_shared, KEY_LIMIT), ["bucket", "key"])
    # copies are summed up where they lie and then in SPREAD tasks, so that a hot text reaches its owner a few times
    sums = [F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")]
    parts = texts.groupBy("bucket", "key", "t", (F.spark_partition_id() % SPREAD).alias("part")).agg(*sums)
    # the ranges of the owners serve both the comparison of bytes and the chains: nothing moves between them
    compared = owned(parts).groupBy("bucket", "key", "t").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    place = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("sha")) - 1
    classes = cut(compared.select("bucket", "key", F.sha2("t", 256).alias("sha"), "keep_id", "group_size").withColumn("chain", place), "chains")
    n_classes = classes.count()
    found = look_up(index).join(small(classes, n_classes, KEY_LIMIT // 4), ["bucket", "key", "sha"], "left")  # a hundred bytes each
    return found.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        F.coalesce("chain", F.lit(0)).alias("chain"),
    )


def op5(spark, sf_dir):
    """Exact duplicates of all documents; the largest id of equal texts stays."""
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
