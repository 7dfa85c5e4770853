"""Mixing sources to target weights by entropy balancing.

Every document d of source s gets a rate r_d (expected copies). Among all rates between 0 and a cap whose
words meet the target of the source, the balanced ones are closest in relative entropy to one copy each;
the dual of that convex problem has one multiplier a source, and r_d = min(cap, exp(lambda_s * size_d / mean_s)).
Newton steps on the dual run as Spark aggregates over the histogram (source, size, documents), safeguarded
by a bracket. Rates then become whole copies by systematic rounding along sizes, and what is still missing
from or above a target is settled with small documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.llm.common import WORD, Rounds, cut, small, table, unit_hash

CAP = 3
SOURCE_LIMIT = 2000


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """Source table: source, source_size, target; `sizes` has source, source_size (one row a source).

    Sources in code point order, null last, take the weights in turn. Filling water: sources whose cap times
    size lies below the common level per weight stay at their cap, and the level rises for the others. The
    windows without a key run over one row a source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ws = F.array(*[F.lit(float(w)) for w in weights])
    x = sizes.withColumn("w", F.element_at(ws, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))).withColumn("most", F.col("source_size") * float(cap))
    by_ratio = Window.orderBy(F.col("most") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = x.withColumn("all_size", F.sum("source_size").over(everything)).withColumn("all_w", F.sum("w").over(everything))
    x = x.withColumn("left_size", F.col("all_size") - F.coalesce(F.sum("most").over(before), F.lit(0.0))).withColumn("left_w", F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    x = x.withColumn("level", F.col("left_size") / F.col("left_w"))
    # the first source in this order that its share at the current level fits into ends the capped ones
    x = x.withColumn("final", F.first(F.when(F.col("most") / F.col("w") >= F.col("level"), F.col("level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return x.select("source", "source_size", F.least(F.col("most"), F.coalesce(F.col("final"), F.lit(float("inf"))) * F.col("w")).alias("target"))


def exact_sum(whole: Column, part: Column) -> Column:
    """Sum of products of a whole number and a fraction in fixed point, which is the same in whatever order rows are added."""
    fixed = F.round(part * float(1 << 40)).cast("decimal(28,0)")
    return F.sum((whole.cast("decimal(20,0)") * fixed).cast("decimal(38,0)")).cast("double") / float(1 << 40)


def balance(hist: DataFrame, goals: DataFrame, cap: int = CAP, rounds: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """Multiplier of each source: source, source_size, target, mean, lam, full (cap for every document).

    `hist` has source, size, n; `goals` has one row a source. Safeguarded Newton on the dual, one Spark
    aggregate in fixed point a round, until every source meets its target. The bracket halves where Newton leaves it, so
    `rounds` without an end are an error and raised.
    """
    n_sources = goals.count()
    means = hist.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    x = goals.join(small(means, n_sources, SOURCE_LIMIT), goals["source"].eqNullSafe(means["source"])).select(goals["source"], "source_size", "target", "mean")
    x = x.withColumn("full", F.col("target") >= F.col("source_size") * float(cap) * (1 - 1e-12))
    tables = Rounds(goals.sparkSession, "dual")
    x = tables.cut(x.withColumns({"lam": F.lit(0.0), "lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double"), "miss": F.lit(1.0)}))
    for _ in range(rounds):
        s = small(x.filter("not full and target > 0").select(F.col("source").alias("k"), "lam", "mean"), n_sources, SOURCE_LIMIT)
        z = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("lam") * z, F.lit(50.0)))
        words = F.col("size") * F.col("n")
        sums = (
            hist.join(s, F.col("source").eqNullSafe(F.col("k")))
            .groupBy("k")
            .agg(exact_sum(words, F.least(rate, F.lit(float(cap)))).alias("got"), exact_sum(words, F.when(rate < cap, z * rate).otherwise(0.0)).alias("slope"))
        )
        x = x.join(small(sums, n_sources, SOURCE_LIMIT), F.col("source").eqNullSafe(F.col("k")), "left")
        f = F.col("got") - F.col("target")
        x = x.withColumns({"lo": F.when(f < 0, F.col("lam")).otherwise(F.col("lo")), "hi": F.when(f > 0, F.col("lam")).otherwise(F.col("hi")), "miss": F.coalesce(F.abs(f) / F.col("target"), F.lit(0.0))})
        step = F.when(F.col("slope") > 0, F.col("lam") - f / F.col("slope"))
        inside = (F.col("lo").isNull() | (step > F.col("lo"))) & (F.col("hi").isNull() | (step < F.col("hi")))
        middle = F.when(F.col("hi").isNull(), 2 * F.abs(F.col("lo")) + 1).when(F.col("lo").isNull(), -2 * F.abs(F.col("hi")) - 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        x = tables.cut(x.withColumn("lam", F.when(F.col("miss") <= tolerance, F.col("lam")).when(inside, step).otherwise(middle)).drop("k", "got", "slope"))
        if (x.agg(F.max("miss")).first()[0] or 0.0) <= tolerance:
            break
    else:
        raise RuntimeError(f"targets are not met after {rounds} rounds")
    return x.select("source", "source_size", "target", "mean", "lam", "full")


def running(df: DataFrame, by: list[str], value: str, out: str, order: list) -> DataFrame:
    """Running sum of `value` within a source over the groups `by` (in their order) and `order` inside a group.

    Two levels, so that no task holds a whole source: sums of groups first, then rows within a group.
    """
    groups = df.groupBy("source", *by).agg(F.sum(value).alias("_g"))
    offset = F.sum("_g").over(Window.partitionBy("source").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.select(F.col("source").alias("_s"), *[F.col(b).alias(f"_{b}") for b in by], F.coalesce(offset, F.lit(0)).alias("_o"))
    on = F.col("source").eqNullSafe(F.col("_s"))
    for b in by:
        on = on & (F.col(b) == F.col(f"_{b}"))
    inner = F.sum(value).over(Window.partitionBy("source", *by).orderBy(*order))
    return df.withColumn("_i", inner).join(groups, on).withColumn(out, F.col("_i") + F.col("_o")).drop("_i", "_o", "_s", *[f"_{b}" for b in by])


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """Copies that each document gets in the mix: doc_id, text_hash, size, source_size, target, rate, copies, taken.

    size counts words ([^\\x20\\x09-\\x0D]+; null text: 0) of whole texts, however long; documents of size 0 get
    no copy. A null source is a source of its own. Rows that repeat an id are documents of their own; those that
    repeat id and text may change places, which leaves the same rows. Documents of equal size are taken in the
    order of a hash of id and text. An empty table gives an empty mix; other columns aren't read.
    The words taken of a source differ from its target by less than a small document, unless all its documents
    are at the cap or no document is small. Results depend on the rows alone and not on how Spark deals them.
    """
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h")), "sizes")
    hist = cut(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    sources = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    dual = balance(hist.filter("size > 0"), cut(targets(sources, weights, cap), "targets"), cap)
    n_sources = sources.count()

    # groups of like sizes, large ones first, split by hash until a group is a small part of one task's rows
    # the root of the rows bounds both the rows of a group and the groups of a source
    parts = 1 + math.isqrt(sized.count()) // 8
    rows = sized.filter("size > 0").withColumns({
        "u": unit_hash("doc_id", "h"), "level": -F.floor(F.log2("size") * 8).cast("int"),
    }).withColumn("part", F.floor(F.col("u") * parts).cast("int"))
    d = small(dual.withColumnRenamed("source", "k"), n_sources, SOURCE_LIMIT)
    rows = rows.join(d, F.col("source").eqNullSafe(F.col("k"))).drop("k")
    # copies are counted in fixed point, so that sums don't depend on the order of adding
    unit = 1 << 24
    tilt = F.least(F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0))), F.lit(float(cap)))
    rows = rows.withColumn("rate", F.when(F.col("full"), float(cap)).when(F.col("target") <= 0, 0.0).otherwise(tilt)).withColumn("fixed", F.round(F.col("rate") * unit).cast("long"))
    order = [F.col("size").desc(), F.col("u"), F.col("doc_id")]
    rows = running(rows, ["level", "part"], "fixed", "upto", order)
    whole = lambda c: F.floor((c + unit // 2) / F.lit(unit))
    rows = rows.withColumn("copies", F.least(F.greatest(whole(F.col("upto")) - whole(F.col("upto") - F.col("fixed")), F.lit(0)), F.lit(cap)).cast("long"))
    rows = cut(rows.drop("upto", "fixed", "lam", "mean"), "copies")

    # what is missing (or too much) is settled by one copy more (or less) of small documents, smallest first
    short = rows.groupBy("source").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("short"))
    short = small(short.withColumnRenamed("source", "k"), n_sources, SOURCE_LIMIT)
    able = rows.join(short, F.col("source").eqNullSafe(F.col("k"))).drop("k").withColumn("move", F.when((F.col("short") > 0) & (F.col("copies") < cap), 1).when((F.col("short") < 0) & (F.col("copies") > 0), -1).otherwise(0))
    able = able.withColumn("moves", F.when((F.col("move") != 0) & (F.col("size") <= F.abs("short")), F.col("size")).otherwise(F.lit(0).cast("long"))).withColumn("rise", -F.col("level"))
    able = running(able, ["rise", "part"], "moves", "moved", [F.col("size"), F.col("u"), F.col("doc_id")])
    fits = (F.col("moves") > 0) & (F.col("moved") <= F.abs("short"))
    done = able.withColumn("copies", F.col("copies") + F.when(fits, F.col("move")).otherwise(0)).select("doc_id", F.col("h").alias("text_hash"), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    zero = F.lit(0).cast("long")
    none = sized.filter("size = 0").join(d, F.col("source").eqNullSafe(F.col("k"))).select("doc_id", F.col("h").alias("text_hash"), "size", "source_size", "target", F.lit(0.0).alias("rate"), zero.alias("copies"), zero.alias("taken"))
    return done.unionByName(none)


def op1(spark, sf_dir):
    """The mix of all documents with weights 1, 2, 3 by source and at most three copies of each."""
    return mix(table(spark, sf_dir, "documents")).drop("text_hash")
