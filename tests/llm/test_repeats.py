import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, documents, sentence

from tapeloom.llm import induced_sort, repeats


def plain(rows, span=200):
    data = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(b[p : p + span] for b in data for p in range(len(b) - span + 1))
    out = []
    for (i, *_), b in zip(rows, data, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - span + 1):
            if seen[b[p : p + span]] > 1:
                gone[p : p + span] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(seed, n):
    g = random.Random(seed)
    shared = [sentence(1000 + k, 60) for k in range(5)]
    rows = []
    for i in range(n):
        parts = [sentence(g.randrange(10**6), g.randrange(1, 40)) for _ in range(3)]
        for _ in range(g.randrange(3)):
            s = g.choice(shared)
            lo = g.randrange(100)
            parts.insert(g.randrange(len(parts)), s[lo : lo + g.randrange(150, 500)])
        rows.append((i, " ".join(parts), "en", "s"))
    return rows


@pytest.mark.parametrize("most", [50_000, 1])
def test_removed_bytes_match_brute_force(spark, most):
    rows = [r for r in awkward() if r[0] not in (8, 9)] + passages(1, 60) + [(900, "a" * 700, "en", "s"), (901, "ab" * 300, "en", "s"), (902, sentence(1000, 60) * 2, "en", "s"), (903, "é" * 250, "en", "s"), (None, sentence(1001, 60), "en", "s")]
    got = repeats.remove_repeats(documents(spark, rows, extra=True), most=most, shard=500).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str) == plain(rows)


def test_long_texts_are_cut_into_slices(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 1000)
    rows = [(1, sentence(5, 900), "en", "s"), (2, sentence(6, 50) + sentence(5, 900)[2000:3500] + sentence(7, 50), "en", "s"), (3, sentence(5, 900)[2500:2900], "en", "s")]
    pieces = list(repeats.runs(pa.array([t.encode() for _, t, *_ in rows], "binary"), 200))
    assert len(pieces) > 5
    got = repeats.remove_repeats(documents(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str) == plain(rows)


def test_no_documents(spark):
    assert repeats.remove_repeats(documents(spark, [])).count() == 0


def test_another_span_across_slices(spark):
    """One long text of which nothing repeats but what was put there, at a span that isn't the default one."""
    g = random.Random(8)
    base = "".join(g.choice("abcdefghij") for _ in range(400_000))
    rows = [(1, base, "en", "s"), (2, base[1000:1150] + "x" * 50 + base[179_900:180_030], "en", "s"), (3, base[5000:5099], "en", "s")]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in repeats.remove_repeats(documents(spark, rows), span=100, k=40).collect()}
    assert got == {1: (280, 2), 2: (280, 2), 3: (0, 0)}
    with pytest.raises(ValueError):
        repeats.remove_repeats(documents(spark, rows), span=70)


def test_hot_anchors_and_queues_in_files(spark, monkeypatch):
    """Every anchor with two segments is hot, and every shard's queue lies in files: results stay the same."""
    monkeypatch.setattr(repeats, "HOT", 1)
    monkeypatch.setattr(repeats, "QUEUE_MEMORY", 100)
    rows = [r for r in awkward() if r[0] not in (8, 9)] + passages(2, 40)
    got = repeats.remove_repeats(documents(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str) == plain(rows)


@pytest.mark.parametrize("cap", [255, 7])
@pytest.mark.parametrize("small", [False, True])
def test_suffix_order_and_common_prefixes(monkeypatch, tmp_path, small, cap):
    """Against plain sorting; with `small` in blocks of 5 and with arrays of more than 8 entries in files."""
    if small:
        monkeypatch.setattr(induced_sort, "BLOCK", 5)
    g = np.random.default_rng(1)
    texts = [g.integers(0, g.integers(1, 6), g.integers(0, 70)) for _ in range(150)] + [[3] * 300, [1, 2] * 150, list(range(200)), list(range(200))[::-1], [1, 2, 3, 1, 2] * 40, g.integers(0, 400, 600)]
    for t in texts:
        x = np.append(np.asarray(t, np.int64) + 1, 0).astype(np.int32)
        with induced_sort.Store(str(tmp_path), 8 if small else None) as store:
            order, prefix = induced_sort.suffix_order(store.keep(x), int(x.max()) + 1, cap, store)
            want = sorted(range(len(x)), key=lambda i: x[i:].tolist())
            assert np.asarray(order).tolist() == want
            plain_prefix = [next((k for k in range(cap) if x[a + k] != x[b + k]), cap) for a, b in zip(want, want[1:], strict=False)]
            assert np.asarray(prefix).tolist() == [0, *plain_prefix]
    assert not list(tmp_path.iterdir())  # files go with the store


def test_a_shard_far_larger_than_its_memory(tmp_path, monkeypatch):
    """300,000 symbols with blocks of 4,096: no array of the sort is as long as the text."""
    monkeypatch.setattr(induced_sort, "BLOCK", 4096)
    g = np.random.default_rng(4)
    half = g.integers(1, 5, 150_000)
    x = np.append(np.concatenate([half, half]), 0).astype(np.int32)
    made = []
    array = induced_sort.Store.array
    monkeypatch.setattr(induced_sort.Store, "array", lambda self, n, *a: made.append((n, type(out := array(self, n, *a)))) or out)
    with induced_sort.Store(str(tmp_path), 10_000) as store:
        order, prefix = induced_sort.suffix_order(store.keep(x), 5, 200, store)
        assert (np.asarray(prefix) == 200).sum() == 150_000 - 199
        assert all((kind is np.memmap) == (n > 10_000) for n, kind in made)
        at = np.asarray(order)[:: 10_007].tolist()
        assert all(x[a : a + 400].tolist() <= x[b : b + 400].tolist() for a, b in zip(at, at[1:], strict=False))


@pytest.mark.parametrize("cap", [1, 5, 16, 40])
@pytest.mark.parametrize("small", [False, True])
def test_order_of_the_first_symbols(monkeypatch, tmp_path, small, cap):
    """As many symbols as count are in order, with right common prefixes, and names are ranked where few decide."""
    if small:
        monkeypatch.setattr(induced_sort, "BLOCK", 5)
    ranked, induce, sorts, inductions = induced_sort.ranked, induced_sort.induce, [], []
    monkeypatch.setattr(induced_sort, "ranked", lambda *a: sorts.append(a[-1]) or ranked(*a))
    monkeypatch.setattr(induced_sort, "induce", lambda *a: inductions.append(a[-1]) or induce(*a))
    g = np.random.default_rng(3)
    texts = [g.integers(0, g.integers(1, 6), g.integers(0, 70)) for _ in range(80)] + [[3] * 300, [1, 2] * 150, list(range(200)), [1, 2, 3, 1, 2] * 40, g.integers(0, 400, 600), np.tile(g.integers(0, 9, 90), 4)]
    for t in texts:
        x = np.append(np.asarray(t, np.int64) + 1, 0).astype(np.int32)
        with induced_sort.Store(str(tmp_path), 8 if small else None) as store:
            order, prefix = (np.asarray(a).tolist() for a in induced_sort.suffix_order(store.keep(x), int(x.max()) + 1, cap, store, whole=False))
            assert sorted(order) == list(range(len(x)))
            seen = [x[i : i + cap].tolist() for i in order]
            assert seen == sorted(seen)
            assert prefix[1:] == [next((k for k in range(cap) if x[a + k] != x[b + k]), cap) for a, b in zip(order, order[1:], strict=False)]
    assert sorts and max(sorts) <= induced_sort.FEW and (inductions or cap <= induced_sort.FEW)
    assert cap != 16 or set(inductions) == {16}  # one level of induction for parts, the rest is ranked
    assert not list(tmp_path.iterdir())


@pytest.mark.parametrize("seed", range(3))
def test_segments_against_a_plain_search(seed):
    """The leftmost smallest hash of each window, for texts with empty and short ones between them."""
    g = np.random.default_rng(seed)
    texts = [g.integers(97, 97 + g.integers(1, 9), n).astype(np.uint8) for n in [0, 30, *g.integers(0, 300, 12), 0, 19, 20, 21, 0]]
    data, edges = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    text, lo, count, off, h = repeats.segments(data, edges, 20, 8)
    assert [(t, p) for t, a, n in zip(text, lo, count, strict=True) for p in range(a, a + n)] == [(t, p) for t in range(len(texts)) for p in range(edges[t], edges[t + 1] - 19)]
    anchors = {p: (a + o, v) for a, n, o, v in zip(lo, count, off, h, strict=True) for p in range(a, a + n)}
    values = {}
    for at, v in anchors.values():
        assert values.setdefault(data[at : at + 8].tobytes(), v) == v
    assert all(p <= at <= p + 12 for p, (at, _) in anchors.items())
    assert (np.diff(lo) > 0).all() and all(t != u or a + o != b + q for t, u, a, b, o, q in zip(text, text[1:], lo, lo[1:], off, off[1:], strict=False))


def test_a_repeat_across_slices(spark):
    g = random.Random(9)
    base = "".join(g.choice("abcdefghij") for _ in range(3 * repeats.SLICE))
    at = repeats.SLICE - 100
    rows = [(1, base, "en", "s"), (2, base[at : at + 230] + "x" * 50, "en", "s"), (3, base[2 * at : 2 * at + 199], "en", "s")]
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(documents(spark, rows)).collect()), key=str)
    assert [(r[0], r[2], r[3]) for r in got] == [(1, 230, 1), (2, 230, 1), (3, 0, 0)]
