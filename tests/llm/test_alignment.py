import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import awkward, documents, sentence

from tapeloom.llm import alignment


@pytest.fixture(scope="module")
def files():
    return alignment.tokenizer_bytes("byte_bpe_50k.json"), alignment.tokenizer_bytes("piece_bpe_32k.model")


ODD = [
    "<|endoftext|> x <s> </s>", "  lead", " ", "   ", "a ", "a  ", "\n\n x", "日本語 é́ 🙂", "a▁b", "x" * 3000, " " * 3000, "it's 'll 't", "\x00\x01\x7f", "ﬁ Ａ", "\t tab\r\n", "word " * 50 + "  ", "³ ½ १२ ٣",
    "a" + " " * 700 + "b", "é‍﻿", "▁", "A" * 50 + "1" * 50, "  x",
]


def plain(rows, files):
    """The contract row by row, with the libraries' own encoders."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    tk = Tokenizer.from_str(files[0].decode())
    tk.encode_special_tokens = True
    sp = SentencePieceProcessor(model_proto=files[1])
    letters = alignment._byte_letters()
    found, counts = [], Counter()
    for i, t in rows:
        a = tk.encode(" " + t, add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        bytes_a = [bytes(letters[c] for c in tk.id_to_token(x)) for x in a]
        bytes_b = [bytes([int(sp.id_to_piece(x)[3:5], 16)]) if sp.is_byte(x) else sp.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not t or b"".join(bytes_a) != f" {t}".encode() or b"".join(bytes_b) != f" {t}".encode():
            a, b, bytes_a, bytes_b = [], [], [], []
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        groups, links = [], []
        at_a, at_b = ({end: k + 1 for k, end in enumerate(ends)} for ends in (ends_a, ends_b))
        lo_a = lo_b = 0
        for end in sorted(set(ends_a) & set(ends_b)):
            hi_a, hi_b = at_a[end], at_b[end]
            groups.append(f"{','.join(map(str, a[lo_a:hi_a]))}|{','.join(map(str, b[lo_b:hi_b]))}")
            links.append((a[hi_a - 1], b[hi_b - 1]))
            lo_a, lo_b = hi_a, hi_b
        counts.update(links)
        found.append((i, len(a), len(b), groups, links))
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [
        (i, n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for i, n_a, n_b, groups, links in found
    ]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_alignment_matches_the_libraries(spark, monkeypatch, files, limit):
    monkeypatch.setattr(alignment, "PAIR_LIMIT", limit)
    rows = [(i, t) for i, t, *_ in awkward() if i != 9] + [(100 + i, t) for i, t in enumerate(ODD)] + [(200, "the same words"), (200, "other words"), (None, "no id")]
    df = documents(spark, [(i, t, None, None) for i, t in rows], extra=True)
    got = alignment.with_counts(alignment.digests(df, *files), 32_000)
    assert got.columns == COLUMNS
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain(rows, files)))


def test_outputs_give_back_both_encodings(spark, files):
    texts = dict(enumerate([t for t in ODD if "▁" not in t] + [sentence(3, 40)]))
    one, two = alignment.sides(*files)
    for r in alignment.align(documents(spark, [(i, t, None, None) for i, t in texts.items()]), *files).collect():
        want = f" {texts[r['doc_id']]}".encode()
        assert b"".join(one.bytes[i] for i in r["a_ids"]) == want == b"".join(two.bytes[i] for i in r["b_ids"])
        at_a, at_b = np.cumsum(one.size[r["a_ids"]]), np.cumsum(two.size[r["b_ids"]])
        assert at_a[np.array(r["a_cuts"]) - 1].tolist() == at_b[np.array(r["b_cuts"]) - 1].tolist() == sorted({*at_a.tolist()} & {*at_b.tolist()})


def test_lanes_merge_alike_at_any_width(monkeypatch, files):
    g = np.random.default_rng(5)
    a, b = (np.cumsum(g.integers(1, 5, n)) for n in (4000, 3000))
    for width in (1, 7, 5000):
        lo = np.arange(0, len(a), width)
        cut_a, cut_b = alignment.lockstep(a, b, lo, np.minimum(lo + width, len(a)))
        both = np.intersect1d(a, b)
        assert a[cut_a].tolist() == b[cut_b].tolist() == both.tolist()


def test_models_of_another_kind(spark, files):
    with pytest.raises(ValueError):
        alignment.ByteLevel(alignment.tokenizer_bytes("word_bpe_49k.json"))
    two = alignment.PieceLevel(files[1])
    texts = ODD + [sentence(i, 30) for i in range(5)]
    by_stretch = two.encode(texts)
    two.local = False
    whole = two.encode(texts)
    assert [x.tolist() for x in by_stretch[0]] == [x.tolist() for x in whole[0]]
    assert [f for f, t in zip(by_stretch[1], texts, strict=True) if t] == [f for f, t in zip(whole[1], texts, strict=True) if t]


def test_empty_table(spark, files):
    assert alignment.with_counts(alignment.digests(documents(spark, []), *files), 32_000).count() == 0
