"""Cross-entropy difference: how much better a target model than a background model predicts a document.

Both are word bigram models over one vocabulary, every word of all documents (or, if `vocabulary` is given, the
words seen most often plus one class for the others). The models are matched: same order, vocabulary and smoothing,
and the background's counts are scaled to the number of target words. A document's score is its loss per word under
the target model less that under the background model, so low scores mark documents like the target.

Counts grow with the corpus and never meet on the driver. Documents are taken in chunks; a chunk adds up its words
and bigrams first and sends the sorted keys with their counts, cut by ranges of keys (buckets). A bucket adds up all
chunks and answers each with the totals in the order of its keys, which a chunk derives again from its texts, so keys
travel once. A frequent word is one entry a chunk, so no key is hot. Keys are 63-bit hashes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.llm.common import cut, small, table, text_batches, whole_groups
from tapeloom.llm.shingles import mix, word_hashes

PRIOR = 50.0  # words of unigram prior behind each bigram context
ID_LIMIT = 500_000
CHUNK = 4_000_000
CHUNK_BYTES = 8_000_000  # text of a chunk of documents
WIDEST = 1.5  # chunks of so many times CHUNK_BYTES are cut by their bytes
BUCKET_BYTES = 16_000_000  # text behind a bucket of keys
START = np.uint64(0x2545F4914F6CDD1C)  # context of a text's first word; even, as words' keys are odd
OTHER = np.int64(0x5851F42D4C957F2D)  # stands for all words outside a bounded vocabulary


def tokens(texts, chunk: int = CHUNK):
    """(first text, word hashes, text of each word) of runs of whole texts of about `chunk` bytes."""
    part: list[bytes] = []
    size, first = 0, 0
    for i, t in enumerate(texts):
        part.append((t or "").encode("utf-8", "surrogatepass").lower())
        size += len(part[-1])
        if size >= chunk or i == len(texts) - 1:
            starts, words = word_hashes(b" ".join(part))
            edges = np.cumsum([0, *[len(x) + 1 for x in part]])
            yield first, words.view(np.int64), np.searchsorted(edges, starts, side="right") - 1
            part, size, first = [], 0, i + 1


def _summed(keys: np.ndarray, target: np.ndarray) -> pd.DataFrame:
    found, at = np.unique(keys, return_inverse=True)
    return pd.DataFrame({"key": found, "target": np.bincount(at, target, len(found)).astype(np.int64), "background": np.bincount(at, 1 - target, len(found)).astype(np.int64)})


def word_counts(docs: DataFrame) -> DataFrame:
    """Counts of words in target and background documents: key, target, background. Each batch adds up first."""
    def run(batches):
        for pdf in batches:
            mark = pdf["is_target"].to_numpy(np.int64)
            for first, words, doc in tokens(pdf["text"].tolist()):
                yield _summed(words, mark[first + doc])

    return docs.mapInPandas(run, "key long, target long, background long").groupBy("key").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


def ids_of(words: np.ndarray, vocabulary: np.ndarray | None) -> np.ndarray:
    """Words outside the vocabulary, a sorted array of hashes, become OTHER; without one all words stay."""
    if vocabulary is None:
        return words
    if not len(vocabulary):
        return np.full(len(words), OTHER)
    at = np.searchsorted(vocabulary, words)
    at[at == len(vocabulary)] = 0
    return np.where(vocabulary[at] == words, words, OTHER)


def keys_of(words: np.ndarray, doc: np.ndarray, vocabulary: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of each word (odd), of its context (a word's, or START) and of both (even)."""
    word = ids_of(words, vocabulary).view(np.uint64) | np.uint64(1)
    before = np.concatenate([[START], word[:-1]]).astype(np.uint64)[: len(word)]
    before[np.concatenate([[True], doc[1:] != doc[:-1]])[: len(word)]] = START
    return word, before, mix(before * np.uint64(0x9E3779B97F4A7C15) + word) & ~np.uint64(1)


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, counts of shape (4, keys) added up, and the place of each key."""
    found, at = np.unique(keys, return_inverse=True)
    return found, np.stack([np.bincount(at, c, len(found)).astype(np.int64) for c in counts]), at


def chunk_counts(texts: list, mark: np.ndarray, vocabulary: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of a chunk and four counts of each: in target and background documents, and of both how often
    the word ends a text, so that no word has it as context (START's is less the number of texts)."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros((4, 0), np.int64)]
    for first, words, doc in tokens(texts):
        if not len(words):
            continue
        word, _, pair = keys_of(words, doc, vocabulary)
        good = mark[first + doc]
        last = np.concatenate([doc[1:] != doc[:-1], [True]])
        for k, sign, rows in ((word, 1, slice(0, 2)), (pair, 1, slice(0, 2)), (word[last], 1, slice(2, 4)), (np.full(last.sum(), START), -1, slice(2, 4))):
            g = good if rows.start == 0 else good[last]
            found, n = np.unique(k, return_counts=True)
            c = np.zeros((4, len(found)), np.int64)
            in_target, t = np.unique(k[g], return_counts=True)
            c[rows.start, np.searchsorted(found, in_target)] = t
            c[rows.start + 1] = n - c[rows.start]
            keys.append(found)
            counts.append(sign * c)
    return _added(np.concatenate(keys), np.concatenate(counts, axis=1))[:2]


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal place side by side: the high ones of small numbers are zeros in a row."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _unplanes(data: bytes, kind, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, n).T).view(kind).ravel()


def _pack(counts: np.ndarray) -> bytes:
    return zlib.compress(_planes(counts), 1)


def _unpack(data: bytes, n: int) -> np.ndarray:
    return _unplanes(zlib.decompress(data), np.int64, 4 * n).reshape(4, n)


def _bounds(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the buckets that sorted keys fall into, and where each begins."""
    b = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    found, at = np.unique(b, return_index=True)
    return found.astype(np.int64), np.concatenate([at, [len(keys)]])


def total_counts(docs: DataFrame, buckets: int, shared) -> DataFrame:
    """Answers to each chunk: totals of its keys by bucket, with the words and the counts of words of each bucket.

    Parts of one chunk from several tasks are joined first, so results don't depend on how rows are dealt.
    """
    def ask(batches):
        vocabulary = shared.value
        for pdf in whole_groups(batches, ["chunk"]):
            for chunk, part in pdf.groupby("chunk", sort=False):
                keys, counts = chunk_counts(part["text"].tolist(), part["is_target"].to_numpy(bool), vocabulary)
                found, at = _bounds(keys, buckets)
                cuts = [(int(b), slice(at[i], at[i + 1])) for i, b in enumerate(found)]
                yield pd.DataFrame({
                    "chunk": np.full(len(cuts), chunk, np.int64), "bucket": np.array([b for b, _ in cuts], np.int64), "n": np.array([s.stop - s.start for _, s in cuts], np.int64),
                    "keys": [_planes(np.diff(keys[s], prepend=np.uint64(0))) for _, s in cuts], "counts": [_pack(counts[:, s]) for _, s in cuts],
                })

    def answer(pdf):
        keys = np.concatenate([np.cumsum(_unplanes(k, np.uint64, n), dtype=np.uint64) for k, n in zip(pdf["keys"], pdf["n"], strict=True)])
        found, sums, at = _added(keys, np.concatenate([_unpack(c, n) for c, n in zip(pdf["counts"], pdf["n"], strict=True)], axis=1))
        ends = np.cumsum(pdf["n"].to_numpy())
        mine: dict[int, list[np.ndarray]] = {}
        for chunk, n, end in zip(pdf["chunk"], pdf["n"], ends, strict=True):
            mine.setdefault(chunk, []).append(at[end - n : end])
        word = (found & np.uint64(1)).astype(bool)
        rows = []
        for chunk, places in mine.items():
            own = places[0] if len(places) == 1 else np.unique(np.concatenate(places))
            rows.append((chunk, pdf["bucket"].iloc[0], len(own), _pack(sums[:, own]), 0, 0, 0))
        rows[0] = (*rows[0][:4], word.sum(), sums[0, word].sum(), sums[1, word].sum())
        return pd.DataFrame(rows, columns=["chunk", "bucket", "n", "counts", "words", "target", "background"])

    asked = docs.select("text", "is_target", "chunk").mapInPandas(ask, "chunk long, bucket long, n long, keys binary, counts binary")
    return asked.groupBy("bucket").applyInPandas(answer, "chunk long, bucket long, n long, counts binary, words long, target long, background long")


def cut_points(docs: DataFrame, each: int) -> DataFrame:
    """Runs of `each` rows that lie together and hold far more bytes than others: name, run, starts.

    `starts` has the first row of each part but the first, so that a part holds at most WIDEST times CHUNK_BYTES and
    one text. Only names, rows and lengths move.
    """
    rows = Window.partitionBy("name", "run").orderBy("row")
    sized = docs.select(F.col("place.name").alias("name"), F.col("place.row").alias("row"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")).withColumn("run", F.floor(F.col("row") / each))
    before = F.coalesce(F.sum("bytes").over(rows.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = sized.select("name", "run", "row", before.alias("before"), F.sum("bytes").over(Window.partitionBy("name", "run")).alias("total")).filter(F.col("total") > WIDEST * CHUNK_BYTES)
    part = F.floor(F.col("before") / int(WIDEST * CHUNK_BYTES))
    return runs.groupBy("name", "run", part.alias("part")).agg(F.min("row").alias("start")).filter("part > 0").groupBy("name", "run").agg(F.sort_array(F.collect_list("start")).alias("starts"))


def score(docs: DataFrame, target_col: str = "is_target", id_col: str = "doc_id", text_col: str = "text", vocabulary: int | None = None, near: Column | None = None) -> DataFrame:
    """Losses of every document: doc_id, n_words, loss_target, loss_background (bits a word), score.

    `target_col` is boolean, null counts as background. Null and wordless texts have no losses and no score.
    Every word has counts of its own unless `vocabulary` bounds their number; words equally frequent at its end are
    taken by hash. Without a target (or background) word its model is the smoothed uniform one. Repeated rows count
    as often as they occur. `near` is a pair of a column that rows lying together share and of a row's number within
    it: chunks of such rows send fewer keys than hashed ones. Results don't depend on it. Runs of long texts are cut by
    their bytes, so that a chunk holds 1.5 times CHUNK_BYTES and one text at most.
    """
    spark = docs.sparkSession
    text_batches(spark)
    place = [F.lit(None).cast("struct<name:string,row:long>") if near is None else near]
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(target_col), F.lit(False)).alias("is_target"), *[c.alias("place") for c in place])
    known = None
    if vocabulary is not None:
        top = word_counts(docs.select("text", F.col("is_target"))).orderBy((F.col("target") + F.col("background")).desc(), "key").limit(vocabulary).select("key").collect()
        known = np.sort(np.array([r["key"] for r in top], np.int64))
    shared = spark.sparkContext.broadcast(known)
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    chunks, buckets = -(-size // CHUNK_BYTES) or 1, -(-size // BUCKET_BYTES) or 1
    each = -(-rows // chunks) or 1
    if near is None:
        docs = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    else:
        points = cut(cut_points(docs, each), "points")
        run, name = F.floor(F.col("place.row") / each), F.col("place.name")
        found = docs.join(small(points, points.count(), ID_LIMIT // 8), (name == F.col("name")) & (run == F.col("run")), "left")
        part = F.coalesce(F.size(F.filter("starts", lambda x: x <= F.col("place.row"))), F.lit(0))
        docs = found.withColumn("chunk", F.when(F.col("starts").isNull(), F.xxhash64(name, run)).otherwise(F.xxhash64(name, run, part)))
    docs = docs.select("doc_id", "text", "is_target", "chunk")
    totals = cut(total_counts(docs, buckets, shared), "totals")
    words, n_target, n_background = totals.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "target", "background")]).first()
    match = n_target / n_background if n_target and n_background else 1.0
    classes = (words if known is None else len(known)) + 1  # the words and the class of all others

    def run(texts, answers):
        answers = answers.sort_values("bucket")
        counts = np.concatenate([np.zeros((4, 0), np.int64), *[_unpack(c, k) for c, k in zip(answers["counts"], answers["n"], strict=True)]], axis=1)
        own = [np.zeros(0, np.uint64)]
        for _, words, doc in tokens(texts["text"].tolist()):
            word, _, pair = keys_of(words, doc, shared.value)
            own += [np.unique(word), np.unique(pair)] + ([np.array([START])] if len(word) else [])
        own = np.unique(np.concatenate(own))
        if len(own) != counts.shape[1]:
            raise ValueError(f"a chunk has {len(own)} keys and answers to {counts.shape[1]}: its rows changed between two reads")
        n, a, b = (np.zeros(len(texts)) for _ in range(3))
        for first, words, doc in tokens(texts["text"].tolist()):
            word, before, pair = (np.searchsorted(own, k) for k in keys_of(words, doc, shared.value))
            n += np.bincount(first + doc, minlength=len(texts))
            for out, row, scale, total in ((a, 0, 1.0, n_target), (b, 1, match, n_background)):
                seen = counts[row] * scale
                one = (seen[word] + 1) / (total * scale + classes)
                p = (seen[pair] + PRIOR * one) / ((counts[row] - counts[row + 2])[before] * scale + PRIOR)
                out += np.bincount(first + doc, -np.log2(p), len(texts))
        some = np.where(n > 0, n, np.nan)
        return pd.DataFrame({"doc_id": texts["doc_id"], "n_words": n.astype(np.int64), "loss_target": a / some, "loss_background": b / some, "score": (a - b) / some})

    kind = docs.schema["doc_id"].dataType.simpleString()
    both = docs.select("doc_id", "text", "chunk").groupBy("chunk").cogroup(totals.select("chunk", "bucket", "n", "counts").groupBy("chunk"))
    out = both.applyInPandas(run, f"doc_id {kind}, n_words long, loss_target double, loss_background double, score double")
    return out.select("doc_id", "n_words", *[F.when(F.col("n_words") > 0, F.col(c)).alias(c) for c in ("loss_target", "loss_background", "score")])


def op7(spark, sf_dir):
    """The target: documents that a label calls good."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id").distinct().withColumn("is_target", F.lit(True))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.struct(F.col("_metadata.file_path").alias("name"), F.col("_metadata.row_index").alias("row")).alias("place"))
    return score(docs.join(small(good, good.count(), ID_LIMIT), "doc_id", "left"), near=F.col("place"))
