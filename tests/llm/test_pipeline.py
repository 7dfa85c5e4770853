import corpus_pipeline
import pytest
from helpers import awkward, documents, sentence
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    near = sentence(77, 200).split()
    rows = awkward() + [(100 + i, sentence(i, 80), "en", "abc"[i % 3]) for i in range(30)] + [(200, " ".join(near), "en", "a"), (201, " ".join([*near[:-2], "x", "y"]), "en", "b"), (202, sentence(3, 80), "en", "c"), (None, sentence(500, 70), None, "a")]
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages_decide_and_keep_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        before, docs = docs, spark.read.parquet(f"{folder}/{name}")
        seen[name] = ({r["doc_id"] for r in before.collect()}, [r["doc_id"] for r in docs.collect()])
    before, after = seen["language_id"]
    assert before - set(after) == {1, 2, 3, 11}
    before, after = seen["exact_dedup"]
    assert before - set(after) == {4, 103} and after.count(7) == 1 and None in after
    before, after = seen["near_dedup"]
    assert before - set(after) == {6, 9, 201}  # 5 and 6 differ in case alone, and the smallest id stays
    assert None in after
    assert set(seen["mixing"][1]) <= seen["mixing"][0]
    assert len(seen["sentencepiece"][1]) == len(seen["mixing"][1]) and docs.filter("not round_trip").count() == 0


def test_run_gives_the_same(spark, folder):
    one = corpus_pipeline.run(spark, folder)
    assert one.count() == spark.read.parquet(f"{folder}/sentencepiece").count()


def test_empty_table_and_clashing_columns(spark, tmp_path):
    for name, rows in (("none", []), ("some", awkward()[3:9] + [(50 + i, sentence(i, 30), "en", "a") for i in range(6)])):
        documents(spark, rows, extra=True).withColumns({c: F.lit(1) for c in ("slot", "bucket", "chain", "digest", "component_id")}).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert {r["doc_id"] for r in out.collect()} <= {i for i, *_ in rows} and (out.count() > 0) == bool(rows)
