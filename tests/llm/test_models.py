import itertools
import zlib

import numpy as np
import pytest
from helpers import awkward, documents, sentence
from pyspark.sql import functions as F

from tapeloom.llm import language_id, lm_scoring, pieces

LANGS = {"en": "the of and with this from have not are was", "de": "der die und mit nicht ist ein auf für über", "fr": "le la et avec pas est une sur pour être"}


def chain_brute_force(scores, trans):
    n, k = scores.shape
    total, each = 0.0, np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        # the first word is entered from all labels alike
        s = np.log(np.exp(trans[:, path[0]]).mean()) + scores[0, path[0]] + sum(scores[t, path[t]] + trans[path[t - 1], path[t]] for t in range(1, n))
        total += np.exp(s)
        for t in range(n):
            each[t, path[t]] += np.exp(s)
    return each / total


def test_forward_backward_matches_all_paths(monkeypatch):
    monkeypatch.setattr(language_id, "SEGMENT", 2)
    g = np.random.default_rng(0)
    scores, trans = g.normal(size=(10, 3)).astype(np.float32), g.normal(size=(3, 3)).astype(np.float32)
    got = language_id.posteriors(scores, np.array([0, 7, 8]), np.array([7, 1, 2]), trans)
    for lo, n in ((0, 7), (7, 1), (8, 2)):
        assert np.allclose(got[lo : lo + n], chain_brute_force(scores[lo : lo + n].astype(float), trans.astype(float)), atol=1e-5)


def log_likelihood(w, first, count, y, weights, trans):
    """Of label sequences, by the forward sums of each chain in plain numpy."""
    x, t = language_id.emissions(w, weights).astype(np.float64), trans.astype(np.float64)
    total = 0.0
    for lo, n in zip(first, count, strict=True):
        own = np.log(np.exp(t[:, y[lo]]).mean()) + x[lo, y[lo]] + sum(t[y[i - 1], y[i]] + x[i, y[i]] for i in range(lo + 1, lo + n))
        alpha = np.log(np.exp(t).mean(axis=0)) + x[lo]
        for i in range(lo + 1, lo + n):
            alpha = np.log(np.exp(alpha[:, None] + t).sum(axis=0)) + x[i]
        total += own - np.log(np.exp(alpha).sum())
    return total


def test_gradient_matches_finite_differences(monkeypatch):
    monkeypatch.setattr(language_id, "SEGMENT", 2)
    monkeypatch.setattr(language_id, "SLOTS", 64)
    g = np.random.default_rng(1)
    w, first, count = language_id._batch(["der die und mit", "the of", "le la et avec est"])
    y = g.integers(0, 3, len(w.starts))
    weights, trans = g.normal(size=(64, 3)) * 0.3, g.normal(size=(3, 3))
    by_weight, by_pair = language_id.gradient(w, first, count, y, weights, trans.astype(np.float32))
    f = lambda a, b: log_likelihood(w, first, count, y, a, b)
    for i, j in [*itertools.product(range(3), range(3))]:
        d = np.zeros((3, 3))
        d[i, j] = 1e-4
        assert abs((f(weights, trans + d) - f(weights, trans - d)) / 2e-4 - by_pair[i, j]) < 1e-2
    for i in sorted(set(w.fixed[0]) | set(w.grams[0])):
        d = np.zeros((64, 3))
        d[i, i % 3] = 1e-2
        assert abs((f(weights + d, trans) - f(weights - d, trans)) / 2e-2 - by_weight[i, i % 3]) < 2e-2


def plain_words(text):
    """Words and the slots of their features, one by one: the word, its prefixes and suffixes, its bigrams and trigrams."""
    import re

    slot = lambda x, kind: int(language_id._slot(np.array([x % (1 << 64)], np.uint64), kind)[0])
    power, out = 1099511628211, []
    for m in re.finditer(rb"[a-z\x80-\xff]+", text.lower().encode()):
        word = m[0]
        own = [int(language_id._slot(language_id.word_hashes_between(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)])), 1)[0])]
        for side, kind in ((word, 10), (word[::-1], 20)):
            h = 0
            for k in range(1, 5):
                h = (h * power + (side[k - 1] if len(word) >= k else 0)) % (1 << 64)
                own.append(slot(h, kind + k))
        grams = []
        for i in range(len(word)):
            two = word[i] * 256 + (word[i + 1] if i + 1 < len(word) else 0)
            grams += [slot(two, 32), slot(two * 256 + (word[i + 2] if i + 2 < len(word) else 0), 33)]
        out.append((own, grams, len(word)))
    return out


def test_prediction_matches_plain_code():
    rows = language_rows()
    m = language_id.fit([t for _, t, *_ in rows], [x for _, _, x, _ in rows], epochs=2)
    for text in ("der hund und the dog", "sur le pont", "a", "Über 12 die-nicht?", "mit von est la and"):
        words = plain_words(text)
        scores = np.array([sum(m.weights[i].astype(float) for i in own) + sum(m.weights[i].astype(float) for i in grams) / n for own, grams, n in words])
        want = chain_brute_force(scores, m.trans.astype(float)).mean(axis=0)
        got, n = next(iter(language_id.predict([text], m)))
        assert n == len(words) and np.allclose(got, want, atol=1e-4)


def language_rows(n=240):
    g = np.random.default_rng(5)
    return [(i, " ".join(g.choice(LANGS[x].split(), 12)), x, "s") for i in range(n) for x in [list(LANGS)[i % 3]]]


@pytest.mark.parametrize("extra", [False, True])
def test_held_out_accuracy_and_awkward_rows(spark, extra):
    rows = language_rows() + [(1000 + i, t, None, s) for i, t, _, s in awkward()]
    got = {r["doc_id"]: r for r in language_id.identify(documents(spark, rows, extra), sample=50).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(got[i]["lang_pred"], lang) for i, _, lang, _ in rows[:240] if got[i]["held_out"]]
    assert len(held) > 30 and sum(a == b for a, b in held) / len(held) > 0.95
    assert all(got[1000 + i]["lang_pred"] == "und" for i in (1, 2, 3, 11)) and all(0 <= r["score"] <= 1 for r in got.values())


def test_every_language_has_a_training_row(spark):
    """More than 200 languages, over-long texts first or only, and one whose rows repeat a single text."""
    rows = [(i, f"word{i} x", f"l{i % 230:03}", "s") for i in range(1200)] + [(5000 + i, "1 " * 300 + f"lang {i} " * 400, "long", "s") for i in range(8)]
    rows += [(9002, "same text", "same", "s")] * 900
    rows += [(6000 + i, f"short {i}" if i % 5 else "over long " * 500, "mixed", "s") for i in range(60)]
    texts, labels = language_id.training_sample(documents(spark, rows).select("doc_id", "text", "lang"), 20, 233 * 400)
    assert set(labels) == {x for i, _, x, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    size = {x: sum(len(t) for t, y in zip(texts, labels, strict=True) if x == y) for x in labels}
    assert max(size.values()) <= 400 and labels.count("mixed") == 20 and labels.count("long") == 1
    assert next(t for t, y in zip(texts, labels, strict=True) if y == "long").startswith("lang")


def test_code_switched_words_get_their_language():
    rows = language_rows()
    m = language_id.fit([t for _, t, *_ in rows], [x for _, _, x, _ in rows], epochs=6)
    text = LANGS["de"] + " " + LANGS["fr"]
    w, first, count = language_id._batch([text])
    p = language_id.posteriors(language_id.emissions(w, m.weights), first, count, m.trans).argmax(axis=1)
    assert [m.labels[i] for i in p] == ["de"] * 10 + ["fr"] * 10


def test_nothing_to_learn_from(spark):
    got = language_id.identify(documents(spark, [(1, "some text", None, "s")])).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)]
    assert language_id.identify(documents(spark, [])).count() == 0


def plain_scores(rows, vocabulary, prior=lm_scoring.PRIOR):
    words = {i: (t or "").encode().lower().split() for i, (t, _) in enumerate(rows)}
    hashes = {w: int(lm_scoring.word_hashes(w)[1].view(np.int64)[0]) for ws in words.values() for w in ws}
    count: dict[bytes, int] = {}
    for ws in words.values():
        for w in ws:
            count[w] = count.get(w, 0) + 1
    top = sorted(sorted(count, key=lambda w: (-count[w], hashes[w]))[:vocabulary], key=lambda w: hashes[w])
    ids = {w: i + 1 for i, w in enumerate(top)}
    size = len(top) + 2
    tables = np.zeros((2, size, size))
    for i, ws in words.items():
        last = size - 1
        for w in ws:
            tables[0 if rows[i][1] else 1, last, ids.get(w, 0)] += 1
            last = ids.get(w, 0)
    if tables[0].sum() and tables[1].sum():
        tables[1] *= tables[0].sum() / tables[1].sum()
    one = tables.sum(axis=1) + 1
    one[:, size - 1] = 0
    one /= one.sum(axis=1, keepdims=True)
    p = (tables + prior * one[:, None, :]) / (tables.sum(axis=2, keepdims=True) + prior)
    out = []
    for i in range(len(rows)):
        last, s = size - 1, 0.0
        for w in words[i]:
            k = ids.get(w, 0)
            s += np.log2(p[1, last, k]) - np.log2(p[0, last, k])
            last = k
        out.append(s / len(words[i]) if words[i] else None)
    return out


@pytest.mark.parametrize("vocabulary", [5, 1000])
def test_scores_match_plain_counts(spark, vocabulary):
    rows = [(t, i % 3 == 0) for i, (_, t, *_) in enumerate(awkward())] + [(sentence(i, 30), i < 10) for i in range(25)]
    df = spark.createDataFrame([(i, t, m, 1) for i, (t, m) in enumerate(rows)], "doc_id long, text string, is_target boolean, key int").repartition(3)
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(df, vocabulary=vocabulary).collect()}
    for i, want in enumerate(plain_scores(rows, vocabulary)):
        assert (got[i] is None) == (want is None) and (want is None or abs(got[i] - want) < 1e-4), (i, got[i], want)


def test_every_word_keeps_its_counts(spark, monkeypatch):
    """More words than the 1,023 of a former bound; chunks and buckets of few bytes, parts of a chunk in several tasks."""
    rows = [(" ".join(f"w{(i * 37 + j * j) % 1700}" for j in range(60)), i < 40) for i in range(120)] + [(f"w{1690 + i} w{1600 + i}", False) for i in range(6)]
    assert len({w for t, _ in rows for w in t.split()}) > 1300
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(lm_scoring, "BUCKET_BYTES", 9000)
    monkeypatch.setattr(lm_scoring, "CHUNK", 1000)
    df = spark.createDataFrame([(i, t, m) for i, (t, m) in enumerate(rows)], "doc_id long, text string, is_target boolean").repartition(3)
    want = plain_scores(rows, 10**6)
    near = F.struct(F.lit("x").alias("name"), F.col("doc_id").alias("row"))
    for got in (lm_scoring.score(df), lm_scoring.score(df, near=near)):
        found = {r["doc_id"]: r["score"] for r in got.collect()}
        assert len(found) == len(rows) and all(abs(found[i] - x) < 1e-4 for i, x in enumerate(want))


def test_chunks_are_cut_by_bytes(spark, monkeypatch):
    """Two files of equal numbers of rows, one of short and one of long texts: no chunk outgrows its bytes by more than a text."""
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 4000)
    rows = [(i, sentence(i, 2 if i < 300 else 100), i % 5 == 0) for i in range(600)] + [(600, None, True), (601, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, is_target boolean").repartition(5)
    near = F.struct(F.when(F.col("doc_id") < 300, "short").otherwise("long").alias("name"), F.col("doc_id").alias("row"))
    chunks, total = [], lm_scoring.total_counts
    monkeypatch.setattr(lm_scoring, "total_counts", lambda docs, *a: chunks.extend(docs.groupBy("chunk").agg(F.sum(F.octet_length("text")).alias("n")).collect()) or total(docs, *a))
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(df, near=near).collect()}
    longest = max(len(t or "") for _, t, _ in rows)
    assert len(chunks) > 20 and max(r["n"] or 0 for r in chunks) <= 6000 + longest
    want = plain_scores([(t, bool(m)) for _, t, m in rows], 10**6)
    assert all((got[i] is None) == (w is None) and (w is None or abs(got[i] - w) < 1e-4) for i, w in enumerate(want))


def test_no_target_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b", None), (2, "a", False)], "doc_id long, text string, is_target boolean")
    assert all(r["score"] is not None for r in lm_scoring.score(df).collect())
    assert lm_scoring.score(df.filter("false")).count() == 0


@pytest.fixture(scope="module")
def model():
    return pieces.model_bytes()


def test_ids_are_the_models_own(model):
    from sentencepiece import SentencePieceProcessor

    sp, own = SentencePieceProcessor(model_proto=model), pieces.Pieces(model)
    g = np.random.default_rng(3)
    alphabet = list("aeinrst thel\n\t  1.é漢ﬁ①") + ["the", "   ", "ing"]
    texts = [" ".join(["x"] * 5), "  lead", "tail  ", " " * 500 + "a" + " " * 77, "abcdefthe" * 3000, "é" * 100, "\x00a\x00", "<s></s><0x0A>", "▁a ▁"]
    texts += ["".join(g.choice(alphabet, g.integers(1, 80))) for _ in range(1500)] + [t for _, t, *_ in awkward() if t]
    for t in texts:
        ids = np.frombuffer(own.encode(t), np.int32)
        assert ids.tolist() == sp.encode(t), t[:80]
        assert own.decode(ids) == t.replace("▁", " ")


@pytest.mark.parametrize("extra", [False, True])
def test_encode_and_decode_frames(spark, model, extra):
    rows = awkward()
    got = pieces.encode(documents(spark, rows, extra), model)
    assert got.filter("not round_trip").count() == 0 and got.count() == len(rows) and got.filter("n_tokens != size(ids)").count() == 0
    back = sorted((r["doc_id"], r["text"]) for r in pieces.decode(got, model).collect())
    assert back == sorted((i, t or "") for i, t, *_ in rows)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [10**6, -1, None])], "doc_id long, ids array<int>")
    assert [r["text"] for r in pieces.decode(odd, model).orderBy("doc_id").collect()] == [None, "", ""]
    assert pieces.encode(documents(spark, []), model).agg(F.count("*")).first()[0] == 0


def test_models_of_another_kind_are_refused(spark):
    """The public model as a unigram one, and without the space put before the text."""
    data = pieces.model_bytes()
    at = data.rindex(b"\x18\x02")
    unigram = data[:at] + b"\x18\x01" + data[at + 2 :]
    at = data.rindex(b"identity\x12\x00\x18\x01")
    bare = data[: at + 11] + b"\x00" + data[at + 12 :]
    for model in (unigram, bare):
        with pytest.raises(ValueError, match="not a BPE model"):
            pieces.encode(documents(spark, [(1, "a", None, None)]), model)
    assert pieces.loaded(data).text
