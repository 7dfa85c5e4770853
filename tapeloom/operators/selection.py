"""Exact quantiles by distributed selection.

A first round counts values by their order of magnitude, which is at most some 20,000 classes whatever the rows, and
finds the class that holds each rank. Further rounds look at the values of these classes alone, in WIDTH equal parts
between their least and greatest value, until a class holds one value or few rows. No task gathers a group's
values: a round moves one count a class and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.scratch import Rounds, cut

WIDTH = 4096
FEW = 10_000
SMALL = 100_000
STEPS = 4  # classes for a factor of two


def magnitude(x: Column) -> Column:
    """A whole number that never falls as x rises: sign and order of magnitude, 0 for 0."""
    return (F.signum(x) * F.when(x == 0, 0).otherwise(F.floor(STEPS * F.log2(F.abs(x))) + STEPS * 1100)).cast("long")


def _picked(classes: DataFrame, by: list[str], targets: DataFrame) -> DataFrame:
    """Of each target the class that holds its rank, and its rank there; classes are few for each of `by`."""
    up_to = F.sum("n").over(Window.partitionBy(*by).orderBy("class").rowsBetween(Window.unboundedPreceding, 0))
    j = targets.join(classes.withColumn("_to", up_to).withColumn("_from", F.col("_to") - F.col("n")), by)
    return j.filter((F.col("_from") <= F.col("rank")) & (F.col("rank") < F.col("_to"))).withColumn("rank", F.col("rank") - F.col("_from")).drop("_from", "_to", "class")


def quantiles(df: DataFrame, keys: list[str], columns: list[str], qs: list[float], rounds: int = 40) -> DataFrame:
    """The quantiles `qs` of each column as an array, one row a key (without keys one row in all).

    They are exact and interpolated between neighbours, as `percentile` has them; nulls don't count, and a column without
    values has null. Doubles hold no NaN. `rounds` are met by an error alone, and raised.
    """
    spark = df.sparkSession
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns)]))
    group = F.struct(*keys) if keys else F.lit(0)
    long = df.select(group.alias("g"), each.alias("e")).select(F.xxhash64("g", "e.c").alias("k"), "g", "e.c", "e.x").filter("x is not null")
    first = cut(long.withColumn("class", magnitude(F.col("x"))).groupBy("k", "g", "c", "class").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")), "classes")
    sizes = first.groupBy("k", "g", "c").agg(F.sum("n").alias("rows"))
    ranks = F.explode(F.array(*[F.struct(F.lit(i).alias("q"), ((F.col("rows") - 1) * q).alias("at")) for i, q in enumerate(qs)]))
    both = F.explode(F.array_distinct(F.array(F.floor("r.at"), F.ceil("r.at")))).alias("rank")
    wanted = sizes.select("k", "g", "c", ranks.alias("r")).select("k", "g", "c", "r.q", "r.at", both).withColumn("order", F.col("rank"))
    tables = Rounds(spark, "ranks")
    state = tables.cut(_picked(first.select("k", "g", "c", "class", "n", "lo", "hi"), ["k", "g", "c"], wanted))
    found = []
    of = ["k", "g", "c", "lo", "hi"]
    for _ in range(rounds):
        found.append(cut(state.filter("lo = hi or n <= " + str(FEW)), "found"))
        state = tables.cut(state.filter(f"lo < hi and n > {FEW}"))
        if state.isEmpty():
            break
        open_ = state.select(*of).distinct()
        inside = _inside(long, open_, of)
        part = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * WIDTH), F.lit(WIDTH - 1)).alias("class")
        classes = inside.select(*of, part, "x").groupBy(*of, "class").agg(F.count("*").alias("n"), F.min("x").alias("lo2"), F.max("x").alias("hi2"))
        state = tables.cut(_picked(classes, of, state.drop("n")).drop("lo", "hi").withColumnsRenamed({"lo2": "lo", "hi2": "hi"}))
    else:
        raise RuntimeError(f"quantiles are not found after {rounds} rounds")
    done = found[0]
    for f in found[1:]:
        done = done.unionByName(f)
    # few rows of a class are sorted in one group; one value needs none
    few = done.filter("lo < hi").select(*of).distinct()
    values = _inside(long, few, of).groupBy(*of).agg(F.sort_array(F.collect_list("x")).alias("xs"))
    done = done.join(values, of, "left").withColumn("value", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.get("xs", F.col("rank").cast("int"))))
    low, high = F.min_by("value", "order"), F.max_by("value", "order")
    share = F.first("at") - F.min("order")
    one = done.groupBy("g", "c", "q").agg((low * (1 - share) + high * share).alias("value"))
    lists = one.groupBy("g", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("q", "value"))), lambda v: v["value"]).alias("v"))
    wide = lists.groupBy("g").agg(*[F.max(F.when(F.col("c") == i, F.col("v"))).alias(f"_v{i}") for i in range(len(columns))])
    named = [F.col(f"_v{i}").alias(c) for i, c in enumerate(columns)]
    if not keys:
        return spark.range(1).select(F.lit(0).alias("z")).join(wide, F.col("z") == F.col("g"), "left").select(*named)
    every = df.select(F.struct(*keys).alias("_g")).distinct()
    return every.join(wide, F.col("_g").eqNullSafe(F.col("g")), "left").select(*[F.col(f"_g.{k}").alias(k) for k in keys], *named)


def _inside(long: DataFrame, classes: DataFrame, of: list[str]) -> DataFrame:
    """The values of classes; these are as many as targets at most."""
    classes = cut(classes, "open")
    c = classes.select(F.col("k").alias("_k"), F.col("g").alias("_g"), F.col("c").alias("_c"), "lo", "hi")
    on = (F.col("k") == F.col("_k")) & F.col("g").eqNullSafe(F.col("_g")) & (F.col("c") == F.col("_c")) & F.col("x").between(F.col("lo"), F.col("hi"))
    return long.join(F.broadcast(c) if classes.count() <= SMALL else c, on).select(*of, "x")
