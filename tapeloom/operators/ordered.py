"""Running values along an order that spreads over tasks.

Rows are sorted over all tasks and written once. Each task works out running values of its own rows and one summary;
the summaries, a row a task and key, are folded in order, and the fold of all tasks before completes each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.scratch import cut

SMALL = 500_000


def dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with the number of their task, `_task`, that rises with keys and order; rows alike in these stay together."""
    return cut(df.repartitionByRange(*keys, *order).withColumn("_task", F.spark_partition_id()), "dealt")


def joined(rows: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the columns of their task's part, broadcast below a checked number of parts."""
    parts = cut(parts, "parts")
    names = {k: f"_{k}_" for k in ["_task", *keys]}
    p = parts.withColumnsRenamed(names)
    on = F.col("_task") == F.col("__task_")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}_"))
    return rows.join(F.broadcast(p) if parts.count() <= SMALL else p, on).drop(*names.values())


def running_product(df: DataFrame, keys: list[str], order: list[str], factor: Column) -> DataFrame:
    """Add `running`, the product of the factors so far, and `highest`, its maximum so far, of each key in order.

    The fold of the tasks before gives the product that a task starts with and the highest one so far; a product may
    fall below zero, so both ends of a task's own products count. Null factors change nothing; rows alike in keys
    and order follow each other in any order.
    """
    rows = dealt(df.withColumn("_f", factor), keys, order)
    here = Window.partitionBy("_task", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("_own", F.coalesce(F.product("_f").over(here), F.lit(1.0)))
    parts = own.groupBy("_task", *keys).agg(F.coalesce(F.product("_f"), F.lit(1.0)).alias("_p"), F.max("_own").alias("_high"), F.min("_own").alias("_low"))
    before = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    parts = parts.withColumn("_start", F.coalesce(F.product("_p").over(before), F.lit(1.0)))
    parts = parts.withColumn("_top", F.max(F.greatest(F.col("_start") * F.col("_high"), F.col("_start") * F.col("_low"))).over(before))
    full = joined(own, parts.select("_task", *keys, "_start", "_top"), keys).withColumn("running", F.col("_start") * F.col("_own"))
    highest = F.greatest(F.max("running").over(here), F.col("_top"))
    return full.withColumn("highest", highest).drop("_f", "_own", "_start", "_top", "_task")
