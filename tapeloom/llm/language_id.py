"""Language of each document from a linear-chain conditional random field over its words.

Words (lower-cased runs of letters) are labelled with languages. A word's emission scores add the weights of
its hashed features: the word itself (lexicon), prefixes and suffixes of one to four bytes, and all byte
bigrams and trigrams with the word's edges. Transition scores are learned too, so a text may switch languages
but does so at a price. Forward-backward gives each word its posterior; a document's language is the one with
the greatest mean posterior, which is its score.

Training maximises the likelihood of a bounded sample of labelled documents on the driver (SAMPLE documents a
language, evenly hashed, whole texts unless all of a language are over-long), with the exact gradient. Prediction runs over all words of all documents in numpy: chains are
cut into segments whose transfer matrices are multiplied, so that all segments of a batch advance together and
the result is that of one pass over each chain.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.llm.common import cut, drop_caches, table, text_batches, unit_hash
from tapeloom.llm.shingles import mix, word_hashes_between

SAMPLE = 120  # documents a language
SAMPLE_CHARS = 1_500_000  # characters of the sample in all
EPOCHS = 12
SLOTS = 1 << 17
SEGMENT = 64
AFFIX = (1, 2, 3, 4)

_LETTER = np.zeros(256, bool)
_LETTER[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)] = True
_LETTER[128:] = True


@dataclass
class Words:
    """Features of the words of a batch: slots of shape (words, kinds), slots of n-grams with their word."""

    starts: np.ndarray
    ends: np.ndarray
    fixed: np.ndarray
    grams: np.ndarray
    gram_at: np.ndarray


def _slot(x: np.ndarray, kind: int) -> np.ndarray:
    return (mix(x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(kind)) & np.uint64(SLOTS - 1)).astype(np.int32)


def words_of(data: bytes) -> Words:
    """Words of lower-cased text; bytes above 127 count as letters, so accented letters stay within words."""
    a = np.frombuffer(data, np.uint8)
    on = np.concatenate(([False], _LETTER[a], [False]))
    turns = np.flatnonzero(on[1:] != on[:-1])
    starts, ends = turns[::2], turns[1::2]
    n = ends - starts
    padded = np.concatenate([np.where(_LETTER[a], a, 0), np.zeros(4, np.uint8)]).astype(np.uint64)
    fixed = []
    power = np.uint64(1099511628211)
    # the word: a sum of byte * power**place, from running sums
    fixed.append(_slot(word_hashes_between(a, starts, ends), 1))
    h = np.zeros(len(starts), np.uint64)
    for k in AFFIX:
        h = h * power + padded[starts + k - 1] * (n >= k)
        fixed.append(_slot(h.copy(), 10 + k))
    h = np.zeros(len(starts), np.uint64)
    for k in AFFIX:
        h = h * power + padded[np.maximum(ends - k, 0)] * (n >= k)
        fixed.append(_slot(h.copy(), 20 + k))
    # bigrams and trigrams from each letter on; the edge after a word is a letter of its own, 0
    at = np.flatnonzero(on[1:-1])
    pair = padded[at] * np.uint64(256) + padded[at + 1]
    triple = pair * np.uint64(256) + padded[at + 2] * (padded[at + 1] > 0)
    return Words(starts, ends, np.stack(fixed, 1) if len(starts) else np.zeros((0, 9), np.int32), np.stack([_slot(pair, 32), _slot(triple, 33)], 1), at)


def emissions(w: Words, weights: np.ndarray) -> np.ndarray:
    """Scores of shape (words, labels). Mean over a word's n-grams, so that long words don't shout."""
    labels = weights.shape[1]
    out = np.zeros((len(w.starts), labels), np.float32)
    for k in range(w.fixed.shape[1]):
        out += weights[w.fixed[:, k]]
    if len(w.starts):
        grams = weights[w.grams[:, 0]] + weights[w.grams[:, 1]]
        first = np.searchsorted(w.gram_at, w.starts)
        out += np.add.reduceat(grams, first, axis=0) / (w.ends - w.starts)[:, None]
    return out


def _chunks(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of chains: first word, number of words, chain; in the order of the words."""
    per = -(-count // SEGMENT)
    chain = np.repeat(np.arange(len(count)), per)
    nth = np.arange(len(chain)) - np.repeat(np.cumsum(per) - per, per)
    return first[chain] + nth * SEGMENT, np.minimum(SEGMENT, count[chain] - nth * SEGMENT), chain


def posteriors(scores: np.ndarray, first: np.ndarray, count: np.ndarray, trans: np.ndarray, both: bool = False):
    """Label probabilities of each word by forward-backward over chains (first word, number of words > 0).

    With `both` also, for each word, the probabilities of the pair of the label before it and its own, of shape
    (words, labels, labels): the share of all paths that take this transition. Before a chain's first word all labels
    are alike.
    """
    labels = scores.shape[1]
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    a = np.exp(trans - trans.max()).astype(np.float32)
    lo, n, chain = _chunks(first, count)
    order = np.argsort(-n, kind="stable")  # longest first: the segments that still go on are a prefix
    lo_s, n_s = lo[order], n[order]
    going = [int(np.searchsorted(-n_s, -t, side="left")) for t in range(int(n.max()))] if len(n) else []
    scale = lambda x: x / np.maximum(x.sum(axis=-1, keepdims=True), 1e-30)

    # transfer matrices of all segments, each step entered by a transition
    m = np.tile(np.eye(labels, dtype=np.float32), (len(lo), 1, 1))
    for t, k in enumerate(going):
        x = (m[:k].reshape(-1, labels) @ a).reshape(k, labels, labels) * e[lo_s[:k] + t][:, None, :]
        m[:k] = x / np.maximum(x.max(axis=(1, 2), keepdims=True), 1e-30)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    m = m[back]
    # states at the segment borders, along each chain
    starts = np.concatenate(([True], chain[1:] != chain[:-1])) if len(chain) else np.zeros(0, bool)
    enter = np.full((len(lo), labels), 1 / labels, np.float32)
    leave = np.full((len(lo), labels), 1 / labels, np.float32)
    nth = np.arange(len(lo)) - np.maximum.accumulate(np.where(starts, np.arange(len(lo)), 0))
    by = np.argsort(nth, kind="stable")
    bounds = np.searchsorted(nth[by], np.arange(nth.max() + 2)) if len(nth) else [0]
    for d in range(1, len(bounds) - 1):
        i = by[bounds[d] : bounds[d + 1]]
        enter[i] = scale(np.einsum("ij,ijk->ik", enter[i - 1], m[i - 1]))
    for d in range(len(bounds) - 2, 0, -1):
        i = by[bounds[d] : bounds[d + 1]]
        leave[i - 1] = scale(np.einsum("ijk,ik->ij", m[i], leave[i]))
    # forward and backward inside all segments at once; the first word of a chain is entered from all alike
    alpha = np.empty_like(e)
    pairs = np.empty((len(e), labels, labels), np.float32) if both else None
    f = enter[order]
    for t, k in enumerate(going):
        if both:
            pairs[lo_s[:k] + t] = f[:k, :, None] * a  # what comes before, and the transition
        f[:k] = scale((f[:k] @ a) * e[lo_s[:k] + t])
        alpha[lo_s[:k] + t] = f[:k]
    b = leave[order]
    for t in range(len(going) - 1, -1, -1):
        k = going[t]
        at = lo_s[:k] + t
        if both:
            pairs[at] *= (e[at] * b[:k])[:, None, :]  # the word, and what comes after
        alpha[at] = scale(alpha[at] * b[:k])
        b[:k] = scale((b[:k] * e[at]) @ a.T)
    if both:
        pairs /= np.maximum(pairs.sum(axis=(1, 2), keepdims=True), 1e-30)
        return alpha, pairs
    return alpha


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    trans: np.ndarray


def _batch(texts: list[str]) -> tuple[Words, np.ndarray, np.ndarray]:
    data = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    w = words_of(b" ".join(data))
    edges = np.searchsorted(w.starts, np.cumsum([0, *[len(x) + 1 for x in data]]))
    return w, edges[:-1], np.diff(edges)


def gradient(w: Words, first: np.ndarray, count: np.ndarray, y: np.ndarray, weights: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the log-likelihood of labels `y` of the words of chains, by feature weights and by transitions:
    what is there less what the model expects, by posteriors of words and of neighbouring pairs."""
    labels = weights.shape[1]
    p, pairs = posteriors(emissions(w, weights), first, count, trans, both=True)
    g = -p
    g[np.arange(len(y)), y] += 1
    by_weight = np.zeros(weights.shape)
    owner = np.searchsorted(w.starts, w.gram_at, side="right") - 1
    share = (g / (w.ends - w.starts)[:, None])[owner]
    for c in range(labels):
        for f in range(w.fixed.shape[1]):
            by_weight[:, c] += np.bincount(w.fixed[:, f], g[:, c], len(weights))
        by_weight[:, c] += np.bincount(w.grams[:, 0], share[:, c], len(weights)) + np.bincount(w.grams[:, 1], share[:, c], len(weights))
    inside = np.ones(len(y), bool)
    inside[first] = False
    at = np.flatnonzero(inside)
    seen = np.bincount(y[at - 1] * labels + y[at], minlength=labels * labels).reshape(labels, labels).astype(np.float64)
    # a chain's first label may have followed any label, each as far as its transition goes
    enter = np.exp(trans - trans.max()).astype(np.float64)
    seen += enter / enter.sum(axis=0) * np.bincount(y[first], minlength=labels)
    return by_weight, seen - pairs.sum(axis=0, dtype=np.float64)


def fit(texts: list[str], labels: list[str], epochs: int = EPOCHS, rate: float = 0.5, seed: int = 5) -> Model:
    """Gradient ascent with per-weight step sizes on the log-likelihood of the label sequences.

    A document's label holds for each of its words. An empty sample gives a model without labels.
    """
    names = sorted(set(labels))
    code = {x: i for i, x in enumerate(names)}
    k = len(names)
    weights, trans = np.zeros((SLOTS, max(k, 1)), np.float32), np.zeros((max(k, 1), max(k, 1)), np.float32)
    model = Model(names, weights, trans)
    if k < 2:
        return model
    grad_w, grad_t = np.full_like(weights, 1e-2), np.full_like(trans, 1e-2)
    order = np.random.Generator(np.random.PCG64(seed)).permutation(len(texts))
    for _ in range(epochs):
        for lo in range(0, len(order), 16):
            part = [int(i) for i in order[lo : lo + 16]]
            w, first, count = _batch([texts[i] for i in part])
            if not len(w.starts):
                continue
            full = count > 0
            y = np.repeat(np.array([code[labels[i]] for i in part]), count)
            by_weight, by_pair = gradient(w, first[full], count[full], y, weights, trans)
            step = (by_weight / len(y) - 1e-6 * weights).astype(np.float32)
            grad_w += step * step
            weights += rate * step / np.sqrt(grad_w)
            move = (by_pair / len(y) - 1e-3 * trans).astype(np.float32)
            grad_t += move * move
            trans += rate * move / np.sqrt(grad_t)
    return model


def predict(texts: list[str | None], model: Model, chunk: int = 1 << 19) -> Iterator[tuple[np.ndarray, int]]:
    """For each text the mean posterior of its words and the number of words."""
    part: list[str] = []
    size = 0
    for i, t in enumerate(texts):
        part.append(t or "")
        size += len(part[-1])
        if size >= chunk or i == len(texts) - 1:
            w, first, count = _batch(part)
            k = max(1, len(model.labels))
            sums = np.zeros((len(part), k))
            full = count > 0
            if full.any():
                p = posteriors(emissions(w, model.weights), first[full], count[full], model.trans)
                sums[full] = np.add.reduceat(p, first[full], axis=0, dtype=np.float64)
            for s, n in zip(sums, count.tolist(), strict=True):
                yield s / max(1, n), n
            part, size = [], 0


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def training_sample(docs: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[str]]:
    """At most `sample` labelled texts a language and `chars` characters in all, evenly hashed over the rows.

    `docs` has doc_id, text, lang. Rows are thinned by hash to twice the bound before any are ranked, so
    ranking never gathers a language's rows. Each language has an equal share of the characters; a text that
    doesn't fit into what is left of it is passed over. If none fits, the shortest gives its beginning, from its
    first letter on, so every language is learned from.
    """
    spark = docs.sparkSession
    rows = docs.filter((remainder(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("text", "lang", F.length("text").alias("n"), unit_hash("text", "doc_id").alias("u"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("all"), F.min("u").alias("least")).collect()
    if not counts:
        return [], []
    # a language whose rows repeat few texts may have no hash below its share: its smallest stays
    shares = spark.createDataFrame([(r["lang"], max(r["least"], min(1.0, 2 * sample / r["all"]))) for r in counts], "lang string, share double")
    most = max(1, chars // len(counts))
    w = Window.partitionBy("lang").orderBy("u")
    ranked = rows.join(F.broadcast(shares), "lang").filter(F.col("u") <= F.col("share")).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= 2 * sample)
    ranked = cut(ranked.select("text", "lang", "n", "u", "r"), "candidates")
    take = fitting([tuple(r) for r in ranked.select("lang", "r", "n").collect()], sample, most)
    chosen = spark.createDataFrame(take, "lang string, r int, whole boolean")
    beginning = F.substring(F.regexp_replace("text", r"^[^\p{L}]+", ""), 1, most)
    got = ranked.join(F.broadcast(chosen), ["lang", "r"]).select(F.when(F.col("whole"), F.col("text")).otherwise(beginning).alias("text"), "lang", "u").collect()
    got.sort(key=lambda r: (r["lang"], r["u"]))
    if missing := {r["lang"] for r in counts} - {r["lang"] for r in got}:
        raise ValueError(f"no training row for {len(missing)} of {len(counts)} languages: {sorted(missing)[:10]}")
    return [r["text"] for r in got], [r["lang"] for r in got]


def fitting(rows: list[tuple[str, int, int]], sample: int, most: int) -> list[tuple[str, int, bool]]:
    """Of rows (language, rank, length) those taken by rank while they fit, and whether as a whole."""
    taken: dict[str, list[int]] = {}
    left: dict[str, int] = {}
    shortest: dict[str, tuple[int, int]] = {}
    for lang, r, n in sorted(rows):
        mine = taken.setdefault(lang, [])
        if len(mine) < sample and n <= left.setdefault(lang, most):
            mine.append(r)
            left[lang] -= n
        shortest[lang] = min(shortest.get(lang, (n, r)), (n, r))
    return [(lang, r, True) for lang, mine in taken.items() for r in mine] + [(lang, shortest[lang][1], False) for lang, mine in taken.items() if not mine]


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """Predict the language of every whole text: doc_id, held_out, lang_pred, score, n_words.

    Learns from rows whose crc32(doc_id) modulo 4 isn't 2 and whose language isn't null; a prediction reads
    the text alone. Texts that are null or have no letter get `und` with score 0, as does every text if no
    row can be learned from. A null id is never learned from and is not held out. Repeated rows get equal
    results. Of equally likely languages the first by name is taken. An empty table gives an empty result; texts of
    any length are read as a whole; other columns aren't read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = fit(*training_sample(docs, sample))
    found = docs.select("doc_id", predicted(spark, model, F.col("text")).alias("p"))
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "p.lang_pred", "p.score", "p.n_words")


def predicted(spark, model: Model, text: Column) -> Column:
    """Struct of lang_pred, score and n_words for a text column; needs no shuffle."""
    text_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, n_words long")
    def run(texts: pd.Series, letters: pd.Series) -> pd.DataFrame:
        drop_caches()
        m = shared.value
        found = list(predict(texts.where(letters, "").tolist(), m))
        best = [int(s.argmax()) if n and ok and m.labels else -1 for (s, n), ok in zip(found, letters, strict=True)]
        score = [float(min(1.0, s[i])) if i >= 0 else 0.0 for (s, _), i in zip(found, best, strict=True)]
        return pd.DataFrame({"lang_pred": [m.labels[i] if i >= 0 else "und" for i in best], "score": score, "n_words": [n for _, n in found]})

    # said to be nondeterministic so that a filter on one of its fields doesn't run it once more
    return run.asNondeterministic()(text, F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))


def op6(spark, sf_dir):
    """Languages of all documents, learned from those whose crc32 of the id leaves another remainder than 2."""
    return identify(table(spark, sf_dir, "documents"))
