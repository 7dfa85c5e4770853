"""Benchmark decontamination by winnowing.

A span of `span` words is shared if it occurs in both a document and a benchmark item. Of each run of `span` words
both sides keep the smallest hash of its k-grams (the first of equal ones), so a shared run keeps the same one on
both sides: every shared span of `span` words or more meets at a kept fingerprint, and no shorter k-gram needs to be
looked at. One pass over the documents keeps the surroundings of the fingerprints that the benchmark may hold too,
by a bitmap of fixed size. Each run of `span` words in these surroundings then meets the benchmark's runs, word for
word; that extends a hit to all of the shared span, for adjoining runs overlap.

Items of fewer words have one run, the whole item, and the same is done for each of their lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import cut, small, table, text_batches
from tapeloom.llm.shingles import mix, word_hashes_between

SPAN = 10
BITS = 1 << 24  # of the bitmap of fingerprints: 2 MB, whatever the benchmark
BATCH_BYTES = 1 << 20
RUN_LIMIT = 200_000  # runs that are broadcast
_STEP = np.uint64(0xD6E8FEB86659FD93)
# Digits, letters in lower case, and all bytes of characters beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def words_of(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one, lower-cased (A-Z): the data, starts and ends of its words, and the text of each."""
    data = b" ".join(texts).lower()
    a = np.frombuffer(data, np.uint8)
    word = np.concatenate([[False], _WORD[a], [False]])
    turns = np.flatnonzero(word[1:] != word[:-1])
    edges = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return data, turns[::2], turns[1::2], np.searchsorted(edges, turns[::2], "right") - 1


def winnow(words: np.ndarray, text: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the kept k-grams of word hashes: in each `span` words of a text the smallest, of equal
    ones the first. k is half the span, which leaves as many k-grams to choose from."""
    k = (span + 1) // 2
    n = len(words) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = words[: len(words) - k + 1] + np.uint64(span)
    for j in range(1, k):
        grams *= _STEP
        grams += words[j : j + len(grams)]
    mix(grams)
    least, at = grams[:n].copy(), np.arange(n)
    for j in range(1, span - k + 1):
        less = grams[j : j + n] < least
        least[less] = grams[j : j + n][less]
        at[less] = np.flatnonzero(less) + j
    at = at[text[:n] == text[span - 1 :]]
    at = at[np.concatenate([[True], at[1:] != at[:-1]])[: len(at)]]  # places rise
    return at, grams[at]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Ids and texts of about BATCH_BYTES."""
    for batch in batches:
        at, column = 0, batch.column(1)
        while at < batch.num_rows:
            first, texts, size = at, [], 0
            while at < batch.num_rows and size < BATCH_BYTES:
                texts.append(column[at].as_py() or b"")
                size += len(texts[-1])
                at += 1
            yield batch.column(0).slice(first, at - first), texts


def _lists(values: pa.Array, of: np.ndarray, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32)), values)


def _raw(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))


def item_words(items: DataFrame, span: int) -> DataFrame:
    """item_id, words, span (at most the item's words) and fingerprints of items with words."""
    def run(batches):
        for ids, texts in _batches(batches):
            data, starts, ends, text = words_of(texts)
            hashes = word_hashes_between(np.frombuffer(data, np.uint8), starts, ends)
            n = np.bincount(text, minlength=len(texts))
            spans = np.minimum(n, span)
            keys, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for s in np.unique(spans[spans > 0]).tolist():
                at, found = winnow(hashes, text, s)
                own = spans[text[at]] == s
                keys.append(found[own])
                of.append(text[at][own])
            keys, of = np.concatenate(keys), np.concatenate(of)
            order = np.argsort(of, kind="stable")
            words = pa.array([data[lo:hi].decode("utf-8", "replace") for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([ids, _lists(words, text, len(texts)), pa.array(spans.astype(np.int32)), _lists(pa.array(keys[order].view(np.int64)), of[order], len(texts))], ["item_id", "words", "span", "keys"])

    kind = items.schema["id"].dataType.simpleString()
    return items.mapInArrow(run, f"item_id {kind}, words array<string>, span int, keys array<bigint>").filter("span > 0")


def bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """Which of `bits` classes the keys fall into; a row of 4 kB for every 32,768 classes reaches the driver."""
    place = keys.select((F.pmod("key", F.lit(bits)) + 1).alias("p")).select(F.expr("bitmap_bucket_number(p)").alias("bucket"), F.expr("bitmap_bit_position(p)").alias("bit"))
    held = np.zeros(bits // 8, np.uint8)
    for r in place.groupBy("bucket").agg(F.expr("bitmap_construct_agg(bit)").alias("map")).collect():
        size = len(r["map"])
        held[size * (r["bucket"] - 1) :][:size] = np.frombuffer(r["map"], np.uint8)
    return held


def runs_near(docs: DataFrame, held: np.ndarray, spans: list[int]) -> DataFrame:
    """id, n_words and near: stretches (span, at, words) of words around fingerprints that the bitmap holds.

    A stretch reaches as far as a run of `span` words through its fingerprints can; stretches that touch are one, so
    no word is kept twice for a span.
    """
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        bits = np.uint64(8 * len(shared.value))
        for ids, texts in _batches(batches):
            data, starts, ends, text = words_of(texts)
            hashes = word_hashes_between(np.frombuffer(data, np.uint8), starts, ends)
            first = np.searchsorted(text, np.arange(len(texts) + 1))
            out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
            for span in spans:
                at, keys = winnow(hashes, text, span)
                place = keys.view(np.int64) % np.int64(bits)
                at = at[(shared.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1]
                of = text[at]
                k = (span + 1) // 2
                lo, hi = np.maximum(at - (span - k), first[of]), np.minimum(at + span, first[of + 1])
                new = np.concatenate([[True], (lo[1:] > hi[:-1]) | (of[1:] != of[:-1])])[: len(at)]
                for t, s, e in zip(of[new].tolist(), lo[new].tolist(), hi[np.concatenate([new[1:], [True]])[: len(at)]].tolist(), strict=True):
                    words = b" ".join([data[a:b] for a, b in zip(starts[s:e].tolist(), ends[s:e].tolist(), strict=True)])
                    out[t].append((span, s - int(first[t]), words.decode("utf-8", "replace")))
            near = pa.array([[{"span": s, "at": a, "words": w} for s, a, w in x] for x in out], pa.list_(pa.struct([("span", pa.int32()), ("at", pa.int32()), ("words", pa.string())])))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(first).astype(np.int64)), near], ["id", "n_words", "near"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n_words long, near array<struct<span:int,at:int,words:string>>")


def _runs(words: Column, span: Column) -> Column:
    """All runs of `span` words of a list, spelled with single spaces; a list holds at least one."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - span + 1), lambda i: F.array_join(F.slice(words, i, span), " "))


def _set_of(value: str) -> list[Column]:
    """A name of a set that sums make, whatever the order: how many, and two sums of hashes of its distinct values."""
    return [F.count(value).alias("s0"), *[F.sum(F.xxhash64(F.lit(seed), value).cast("decimal(20,0)")).alias(f"s{seed}") for seed in (1, 2)]]


SET = ["s0", "s1", "s2"]


def contaminated(docs: DataFrame, items: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Words of documents inside a shared span, and the items that share it.

    Returns two frames. Rows: doc_id, row (a number of its own), n_words, n_hit, s0, s1, s2 (a name of the set of its
    items, null without hits), one row a row of `docs`. Sets: s0, s1, s2, item_id, the items of each name. Words are
    runs of ASCII letters and digits and of characters beyond ASCII, with A-Z lower-cased. An item of fewer than
    `span` words is one run. Null and wordless texts have no words and hit nothing. Repeated rows count by
    themselves, items that repeat an id are one item; an item with a null id marks words but is in no set. Texts are
    taken whole; empty tables give empty or clean results. Other columns aren't read.
    """
    spark = docs.sparkSession
    text_batches(spark)
    bench = cut(item_words(_raw(items, item_col, item_text_col), span), "items")
    spans = sorted(r["span"] for r in bench.select("span").distinct().collect())  # at most `span` of them
    held = bitmap(bench.select(F.explode("keys").alias("key")), BITS)
    rows = cut(runs_near(_raw(docs, id_col, text_col), held, spans).withColumn("row", F.monotonically_increasing_id()), "near")

    # a run of the benchmark, with a name for the set of its items
    listed = cut(bench.select("item_id", F.explode(_runs(F.col("words"), F.col("span"))).alias("run")).distinct(), "listed")
    runs = cut(listed.groupBy("run").agg(*_set_of("item_id")), "runs")
    near = rows.select("row", F.explode("near").alias("x")).select("row", "x.span", "x.at", F.posexplode(_runs(F.split("x.words", " "), F.col("x.span"))).alias("i", "run"))
    hits = cut(near.join(small(runs, runs.count(), RUN_LIMIT), "run").select("row", (F.col("at") + F.col("i")).alias("lo"), (F.col("at") + F.col("i") + F.col("span")).alias("hi"), *SET), "hits")

    before = Window.partitionBy("row").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", F.coalesce(F.max("hi").over(before), F.col("lo"))))
    words = hits.select("row", "lo", "hi").distinct().withColumn("new", new).groupBy("row").agg(F.sum("new").alias("n_hit"))

    # rows that meet the same sets of items are one class, so items are looked up once a class
    met = hits.select("row", *SET).distinct()
    classes = cut(met.groupBy("row").agg(F.count("*").alias("c0"), *[F.sum(F.xxhash64(F.lit(seed), *SET).cast("decimal(20,0)")).alias(f"c{seed}") for seed in (1, 2)]), "classes")
    chosen = classes.groupBy("c0", "c1", "c2").agg(F.min("row").alias("row"))
    of_set = runs.groupBy(*SET).agg(F.min("run").alias("run")).join(listed, "run").select(*SET, "item_id")
    named = chosen.join(met, "row").join(of_set, SET).filter("item_id is not null").select("c0", "c1", "c2", "item_id").distinct()
    found = classes.join(words, "row").select("row", "n_hit", *[F.col(f"c{i}").alias(f"s{i}") for i in range(3)])
    out = rows.join(found, "row", "left").select(F.col("id").alias("doc_id"), "row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), *SET)
    return out, named.select(*[F.col(f"c{i}").alias(f"s{i}") for i in range(3)], "item_id")


def op12(spark, sf_dir):
    """Documents that share ten words in a row, or all of a shorter item, with the benchmark."""
    rows, sets = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = sets.groupBy(*SET).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ","), 256).alias("sha"))
    j = rows.join(names, SET, "left")
    return j.select("doc_id", "n_words", "n_hit", F.coalesce("n", F.lit(0)).cast("long").alias("n_items"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
r AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS run FROM b WHERE len(w) > 0),
s AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM r)),
h AS (SELECT s.doc_id, s.i, s.n, r.item_id FROM s JOIN r ON r.run = array_to_string(s.w[s.i:s.i + s.n - 1], ' ')),
p AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(p.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
