import hashlib
import random
import re

import numpy as np
import pytest
from helpers import WORDS, awkward, documents, sentence

from tapeloom.llm import decontamination as dc
from tapeloom.llm.shingles import word_hashes_between

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(t):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))


def plain(docs, items, span=10):
    runs = {}
    for i, t in items:
        w = plain_words(t)
        n = min(span, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            runs.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, met = plain_words(t), set(), set()
        for n in {len(r) for r in runs}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in runs:
                    hit.update(range(k, k + n))
                    met |= runs[tuple(w[k : k + n])]
        ids = sorted(str(x) for x in met if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def cases():
    g = random.Random(3)
    items = [(i, sentence(500 + i, 25)) for i in range(12)] + [(20, "Short item here"), (21, "two words"), (22, "one"), (23, None), (24, " ... "), (25, "É́ 日本 nine word ITEM with é q7 x y"), (None, sentence(700, 14)), (3, sentence(701, 12)), (30, sentence(500, 25))]
    items += [(40 + i, f"{sentence(800, 15)} and then {sentence(900 + i, 5)}") for i in range(20)]  # a passage that many items share
    items += [(60, "same " * 30), (61, "a b " * 12)]
    docs = [(i, t) for i, t, *_ in awkward()]
    for i in range(60):
        w = sentence(1000 + i, 80).split()
        src = plain_words(items[g.randrange(12)][1])
        for _ in range(g.randrange(4)):
            n, a, b = g.randrange(3, 20), g.randrange(len(w)), g.randrange(20)
            w[a:a] = [x.upper() if g.random() < 0.3 else x + g.choice(["", ",", "!"]) for x in src[b : b + n]]
        docs.append((100 + i, g.choice([" ", "\n", " - "]).join(w)))
    docs += [(200, "the short, ITEM here!"), (201, "one"), (202, "two--words and two words"), (203, f"x {sentence(800, 15)} y"), (204, sentence(700, 14)), (205, "same " * 9), (206, "Same same " * 8), (207, "b a " * 9), (208, "é́ 日本 nine word item with é q7 x y"), (209, "É́ 日本 nine word item with é q7 x y"), (210, sentence(800, 9))]
    docs += [(210 + i % 3, f"x {sentence(800, 15)} y") for i in range(30)] + [(None, sentence(505, 25)), (None, "none")]
    return docs, items


@pytest.mark.parametrize("limit, bits", [(200_000, 1 << 24), (0, 1 << 15)])
def test_rows_match_brute_force(spark, monkeypatch, limit, bits):
    monkeypatch.setattr(dc, "RUN_LIMIT", limit)
    monkeypatch.setattr(dc, "BITS", bits)
    docs, items = cases()
    monkeypatch.setattr(dc, "table", lambda s, d, name: documents(s, [(i, t, None, None) for i, t in docs], extra=True) if name == "documents" else s.createDataFrame(items, "item_id long, text string"))
    got = dc.op12(spark, "")
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain(docs, items)))


def test_long_text_and_empty_tables(spark):
    long = " ".join(WORDS[i % 7] + str(i % 1000) for i in range(200_000))
    docs = documents(spark, [(1, long, None, None), (2, None, None, None)])
    items = spark.createDataFrame([(1, " ".join(long.split()[150_000:150_030]))], "item_id long, text string")
    want = plain([(1, long), (2, None)], [(1, " ".join(long.split()[150_000:150_030]))])
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"]) for r in dc.contaminated(docs, items)[0].collect())
    assert got == [w[:3] for w in want]
    assert [r["n_hit"] for r in dc.contaminated(docs, items.limit(0))[0].collect()] == [0, 0]
    rows, sets = dc.contaminated(documents(spark, []), items)
    assert rows.count() == 0 and sets.count() == 0


@pytest.mark.parametrize("span", [1, 2, 3, 9, 10])
def test_every_shared_span_keeps_a_common_fingerprint(span):
    g = np.random.default_rng(span)
    words = g.integers(0, 5, 400).astype(np.uint64)
    both = np.concatenate([words[:200], g.integers(9, 99, 30).astype(np.uint64), words[50:120]])
    text = np.repeat([0, 1], [230, 70])
    at, keys = dc.winnow(both, text, span)
    assert (np.diff(at) > 0).all()
    kept = set(zip(at.tolist(), keys.tolist(), strict=True))
    for k in range(70 - span + 1):
        assert any((50 + k + j, h) in kept for j in range(span) for p, h in kept if p == 230 + k + j)


def test_words_are_those_of_the_pattern():
    texts = ["Ab-c9 é_x\x00y", "", "ÀÉ straße 日本語。", "A" * 100]
    data, starts, ends, text = dc.words_of([t.encode() for t in texts])
    assert [data[a:b].decode() for a, b in zip(starts, ends, strict=True)] == [w for t in texts for w in plain_words(t)]
    assert text.tolist() == [i for i, t in enumerate(texts) for _ in plain_words(t)]
    assert len(set(word_hashes_between(np.frombuffer(data, np.uint8), starts, ends).tolist())) == len({w for t in texts for w in plain_words(t)})
