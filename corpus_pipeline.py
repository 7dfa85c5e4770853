"""The corpus pipeline: from raw documents to a mixed, tokenised training set, one Parquet table a stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import exact_dedup, language_id, minhash_dedup, mixing, pieces
from tapeloom.llm.common import cut, small, table

ID_LIMIT = 500_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language (null, or without a letter) go; a missing `lang` is filled by the prediction."""
    named = docs.select("doc_id", "text", "lang")
    model = language_id.fit(*language_id.training_sample(named))
    found = docs.withColumn("_p", language_id.predicted(spark, model, F.col("text"))).filter("_p.lang_pred != 'und'")
    return found.withColumn("lang", F.coalesce("lang", "_p.lang_pred")).select(docs.columns)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays, and one row of those that repeat its id too."""
    found = cut(exact_dedup.exact_dedup(docs), "exact")
    dropped = found.filter("not kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    stay = docs.withColumn("_sha256", sha).join(small(dropped, dropped.count(), ID_LIMIT), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_sha256") == F.col("_sha")), "left_anti")
    # rows that repeat id and text
    again = found.filter("kept and group_size > 1").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    return (stay.dropDuplicates(["doc_id", "_sha256"]) if again else stay).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-equal documents stays (five words a shingle, similarity 0.8)."""
    found = minhash_dedup.near_dedup(docs)
    dropped = cut(found.filter("not kept and doc_id is not null").select("doc_id").distinct(), "near")
    return docs.join(small(dropped, dropped.count(), ID_LIMIT), "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as many times as the mix takes it."""
    copies = mixing.mix(docs).filter("copies > 0").groupBy(F.col("doc_id").alias("_id"), "text_hash").agg(F.max("copies").alias("_copies"))
    hashed = docs.withColumn("_h", F.xxhash64(F.coalesce("text", F.lit(""))))
    taken = hashed.join(copies, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("text_hash")))
    return taken.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    return pieces.encode(docs, pieces.model_bytes())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", tokenise),
]

# SQL can't express the trained language model, the mix or the pieces; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
