import random

import numpy as np
import pytest
from helpers import awkward, documents, sentence

from tapeloom.llm import components, embedding_dedup, minhash_dedup, shingles


def plain_components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components_of_paths_stars_and_cycles(spark):
    g = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(40)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(g.randrange(300, 400), g.randrange(300, 400)) for _ in range(60)]
    want = plain_components(400, links)
    got = components.components(spark.createDataFrame(links + [(5, 5)], "u long, v long")).collect()
    assert {r["node"]: r["component"] for r in got} == {x: want[x] for x in {x for a, b in links if a != b for x in (a, b)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_set(text, width):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    if not words:
        return set()
    return {tuple(words)} if len(words) < width else {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def variants(seed, n, edits):
    g = random.Random(seed)
    base = sentence(seed, 120).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(g.randrange(edits)):
            w[g.randrange(len(w))] = f"new{g.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("big", [16, 1])
@pytest.mark.parametrize("width", [2, 5])
def test_components_match_all_pairs(spark, monkeypatch, big, width):
    monkeypatch.setattr(minhash_dedup, "BIG", big)
    monkeypatch.setattr(minhash_dedup, "PIVOTS", 1)
    monkeypatch.setattr(minhash_dedup, "QUERIES", 3)
    monkeypatch.setattr(minhash_dedup, "MEMBERS", 4)
    texts = [t for _, t, *_ in awkward()] + variants(1, 25, 14) + variants(2, 6, 4) + [sentence(50 + i, 30) for i in range(10)]
    sets = [plain_set(t, width) for t in texts]
    links = [(a, b) for b in range(len(sets)) for a in range(b) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = plain_components(len(sets), links)
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)], extra=True)
    got = {r["doc_id"]: r for r in minhash_dedup.near_dedup(docs, width=width).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), want[i], want[i] == i)


def test_words_whose_bytes_cancel_in_a_polynomial_stay_apart(spark):
    """A Thue-Morse word and its complement: equal under any polynomial hash modulo 2**64 with an odd base."""
    turn = lambda k, x, y: x if not k else turn(k - 1, x, y) + turn(k - 1, y, x)
    texts = [f"one {turn(10, *ab)} two three four five" for ab in ("ab", "ba")]
    assert len({int(h) for k in (4, 6, 10, 12) for ab in ("ab", "ba") for h in shingles.word_hashes(turn(k, *ab).encode())[1]}) == 8
    got = minhash_dedup.near_dedup(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), width=2).collect()
    assert all(r["kept"] for r in got)


def test_sets_are_those_of_the_words():
    texts = [t for _, t, *_ in awkward()] + variants(3, 8, 6) + ["a b", "a b c", "b a", "a"]
    for width in (1, 2, 5):
        plain = [plain_set(t, width) for t in texts]
        for sets in (shingles.exact_sets(texts, width), list(shingles.shingle_sets(texts, width))):
            for x, p in zip(sets, plain, strict=True):
                assert len(x) == len(p)
                assert [len(np.intersect1d(x, y)) for y in sets] == [len(p & q) for q in plain]


@pytest.mark.parametrize("size", [1, 16, 200])
def test_buckets_of_any_size(spark, size):
    """Chains of edits, of which many are near the threshold: one bucket of the given size and some others."""
    texts = variants(9, size, 22) + [sentence(300 + i, 40) for i in range(4)]
    sets = [plain_set(t, 2) for t in texts]
    links = [(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = minhash_dedup.near_dedup(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), width=2).collect()
    want = plain_components(len(sets), links)
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(want))


def test_null_ids_and_empty_tables(spark):
    rows = [(None, sentence(1, 20), "en", "s"), (3, sentence(1, 20), "en", "s"), (2, sentence(1, 20), "en", "s"), (2, sentence(1, 20), "en", "s")]
    got = minhash_dedup.near_dedup(documents(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in got), key=str) == sorted([(None, None, False), (3, 2, False), (2, 2, True), (2, 2, True)], key=str)
    assert minhash_dedup.near_dedup(documents(spark, [])).count() == 0


def test_ids_of_several_texts(spark):
    """The texts of an id are linked, each with its own near copies; a smaller id elsewhere is found through them."""
    a, b, c = (sentence(k, 80) for k in (1, 2, 3))
    rows = [(5, a, "en", "s"), (5, b, "en", "s"), (5, None, "en", "s"), (3, a + " more", "en", "s"), (9, b + " end", "en", "s"), (9, b + " end", "en", "s"), (7, c, "en", "s"), (8, b, "en", "s"), (None, a, "en", "s")]
    got = minhash_dedup.near_dedup(documents(spark, rows, extra=True)).collect()
    found = sorted((r["doc_id"], r["n_shingles"] > 0, r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None)
    assert found == [(3, True, 3, True), (5, False, 5, True), (5, True, 3, False), (5, True, 3, False), (7, True, 7, True), (8, True, 3, False), (9, True, 3, False), (9, True, 3, False)]
    assert len(got) == len(rows)


def test_pruning_bounds():
    steps = minhash_dedup.needed(0.8, 1e-6)
    assert [n for n, _ in steps] == list(range(20, 141, 20)) and all(m < 0.8 * n for n, m in steps)
    assert minhash_dedup.needed(0.8, 1e-2)[-1][1] > steps[-1][1]


def test_signatures_estimate_similarity():
    a, b = list(shingles.shingle_sets([" ".join(f"w{i}" for i in range(3000)), " ".join(f"w{i}" for i in range(1000, 3000))], 1))
    s, t = minhash_dedup.signature(a), minhash_dedup.signature(b)
    assert abs((s == t).mean() - 2 / 3) < 0.13


def plain_links(rows, threshold):
    fine = []
    for k, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            fine.append((k, np.array(v, np.float64), label))
    out = []
    for i, (a, x, p) in enumerate(fine):
        out += [(a, b) for b, y, q in fine[:i] if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold]
    return out


@pytest.mark.parametrize("block", [1024, 8])
def test_vectors_match_all_pairs(spark, block):
    g = np.random.default_rng(2)
    rows = []
    for c in range(8):
        center = g.normal(size=16)
        for _ in range(20 if c else 90):
            rows.append([len(rows), (center + g.normal(size=16) * g.choice([0.02, 0.1])).astype(np.float32).tolist(), c % 3])
    rows += [[len(rows) + i, rows[0][1], 0] for i in range(5)] + [[len(rows) + 5, None, 0]]
    for v, label in (([0.0] * 16, 0), ([float("nan")] * 16, 0), ([1.0, None], 0), ([float("inf"), 1.0], 1), ([1.0, 2.0], 1), ([1.0, 2.0], 1), ([1.0, 2.0], None), ([], 1)):
        rows.append([len(rows), v, label])
    links = plain_links(rows, 0.98)
    want = plain_components(len(rows), links)
    n = [0] * len(rows)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    df = spark.createDataFrame([tuple(r) for r in rows], "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS node", "2 AS bits", "3 AS keys", "4 AS n_links")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_vectors(df, block=block).collect()}
    assert got == {i: (n[i], want[i], want[i] == i) for i in range(len(rows))}


def test_ids_of_several_vectors(spark):
    rows = [(5, [1.0, 0.0], 0), (5, [0.0, 1.0], 0), (5, [0.0, 1.0], 1), (3, [1.0, 0.0], 0), (9, [0.01, 1.0], 0), (9, [0.01, 1.0], 0), (7, [-1.0, 0.0], 0), (7, None, 0)]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    want = [(3, 1, 3, True), (5, 0, 3, False), (5, 1, 3, False), (5, 2, 3, False), (7, 0, 7, True), (7, 0, 7, True), (9, 2, 3, False), (9, 2, 3, False)]
    assert sorted(tuple(r) for r in got) == want


def test_no_vectors(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_tables_keep_the_miss_rate():
    for n in (10, 10**4, 10**6, 10**9):
        bits, tables = embedding_dedup.plan(n, 0.98)
        assert (1 - (1 - np.arccos(0.98) / np.pi) ** bits) ** tables <= 1e-6


def test_words_of_equal_hashes_stay_apart(spark):
    """The word hash can be inverted step by step, so two words of equal hashes can be made; the words themselves decide."""
    texts = ["q1bbwh0m4alxlrsi", "4tw4hj99t426c05e", "Q1BBWH0M4alxlrsi ", "b a b a b", "a b a b a"]
    assert len({s.tobytes() for s in shingles.shingle_sets(texts[:2], 5)}) == 1
    for width in (1, 5):
        want = plain_components(5, [(0, 2), (3, 4)] if width < 5 else [(0, 2)])
        got = minhash_dedup.near_dedup(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), width=width).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(want))


def test_vectors_of_any_scale(spark):
    """Squares of these components leave the range of doubles."""
    rows = [(1, [1e-200, 2e-200]), (2, [3e-200, 1e-200]), (3, [1e200, 2e200]), (4, [1.0, 2.001]), (5, [5e-324, 0.0]), (6, [1.7e308, 1e300]), (7, [1e-310, 2e-310])]
    got = embedding_dedup.near_vectors(spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 3, 1), (2, 0, 2), (3, 3, 1), (4, 3, 1), (5, 1, 5), (6, 1, 5), (7, 3, 1)]
