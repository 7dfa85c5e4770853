import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, documents

from tapeloom.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, drop=199):
    counts = Counter()
    for i, t in rows:
        for w in RUN.findall(t or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % drop == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    best, number = {}, {}
    for w, n in words.items():
        close = [(-words[x], x) for x in words if near(w, x)]
        number[w] = len(close)
        if close and -min(close)[0] >= 5 * n:
            best[w] = min(close)[1]
    out = []
    for w, n in words.items():
        root = w
        while root in best:
            root = best[root]
        out.append((w, best.get(w), root, n, number[w], words.get(best.get(w))))
    return out


def texts():
    g = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzéàÿÀ×"
    base = ["".join(g.choice(letters) for _ in range(g.randrange(6, 10))) for _ in range(60)] + ["aaaaaa", "aaaaaab", "listen", "silent", "enlist", "tinsel"]
    lines = []
    for w in base:
        lines += [w] * g.choice([5, 40, 300])
        for _ in range(4):
            i, c = g.randrange(len(w)), g.choice(letters)
            lines += [g.choice([w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :]]).upper()] * g.choice([5, 6, 30])
    g.shuffle(lines)
    rows = [(i, t) for i, t, *_ in awkward() if i not in (8, 9)]
    rows += [(1000 + i, " ".join(lines[i : i + 40])) for i in range(0, len(lines), 40)]
    return rows + [(None, "nullid nullid " * 4), (1000, rows[-1][1]), (5, "long" * 5000), (6, " ".join(["long" * 60, "long" * 59 + "lng"] * 5))]


@pytest.mark.parametrize("cell, leaf, queries, drop", [(2048, 32, 1 << 15, 199), (8, 2, 5, 3)])
def test_variants_match_all_pairs(spark, monkeypatch, cell, leaf, queries, drop):
    monkeypatch.setattr(spelling, "CELL", cell)
    monkeypatch.setattr(spelling, "LEAF", leaf)
    monkeypatch.setattr(spelling, "QUERIES", queries)
    rows = texts()
    got = spelling.variants(documents(spark, [(i, t, None, None) for i, t in rows], extra=True), drop=drop)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain(rows, drop)))
    assert spelling.variants(documents(spark, [])).count() == 0


def test_trees_reach_every_vector_in_reach():
    g = np.random.default_rng(2)
    v = g.integers(0, 4, (700, 12))
    tree = spelling.Tree(v, 12, 5)
    assert sorted(np.concatenate(tree.members).tolist()) == list(range(700))
    q = g.integers(0, 4, (40, 12))
    for reach in (0, 1, 2):
        met = [set() for _ in q]
        for leaf, rows in tree.search(q, np.full(len(q), reach)):
            for r in rows.tolist():
                met[r].update(tree.members[leaf].tolist())
        for i, x in enumerate(q):
            assert {int(k) for k in np.flatnonzero(np.abs(v - x).sum(axis=1) <= reach)} <= met[i]
        assert reach > 0 or max(map(len, met)) < 700


def test_words_of_like_letters_stay_in_one_leaf():
    tree = spelling.Tree(np.ones((100, 3), np.int64), 3, 5)
    assert len(tree.members) == 1 and len(tree.members[0]) == 100
