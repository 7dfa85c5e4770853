"""Alignment of two tokenizers' tokens over the same bytes by lockstep vectorised merging.

Both token sequences of a text spell the same bytes, so each is a rising list of end offsets. The merge of the two
lists walks a pointer in each. All texts of a batch move at once: one state vector holds the pointers of every lane,
a step compares the two ends of each lane, marks a cut where they are equal, and advances the pointer of the
smaller end (both if equal). Finished lanes leave the vector. A text is a lane for every LANE tokens, which makes
the steps of a batch few however long one text is: the lists are merged between any two offsets alike.

Cuts divide both sequences into groups, and the last tokens of a group's two sides end together: these are linked.
How often the whole corpus links a pair of ids is a table that grows with the corpus, joined back to the texts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import cut, small, table, text_batches, worker_cache

LANE = 256  # tokens of the first side
BATCH_CHARS = 1_000_000
REMEMBERED = 300_000  # stretches of the second side
LONGEST_REMEMBERED = 48
PAIR_LIMIT = 1_000_000
SPACE = "▁"
PROBES = ["a  b ", "  a", "a", " ", "ﬁ Ａ\tb"]  # a model that changes one of these isn't encoded by stretches
# Fixed value: how the byte-level tokenizer splits texts before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes: visible ones for themselves, the others for numbers from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """Side A: byte-level BPE from a tokenizer file. Its ids below the special ones number the bytes and then the
    merges in their order, which is checked, so that ranks alone encode."""

    def __init__(self, data: bytes):
        from tiktoken import Encoding

        form = json.loads(data)
        model, split = form["model"], form["pre_tokenizer"] or {}
        whole = model["type"] == "BPE" and not model.get("byte_fallback") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and not form["normalizer"]
        if not whole or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError("not a byte-level BPE file without a normaliser and without a space put before")
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        if any(model["vocab"].get(m) != 256 + i for i, m in enumerate(merges)):
            raise ValueError("ids don't follow the order of the merges")
        self.data = data
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if i < 256 + len(merges)}
        self.bytes = [b""] * (1 + max(model["vocab"].values()))
        for b, i in ranks.items():
            self.bytes[i] = b
        self.encoding = Encoding("byte level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.size = np.array([len(b) for b in self.bytes], np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text with a space before it; strings of special tokens are plain text."""
        return [self.one(f" {t}") for t in texts]

    def one(self, t: str) -> np.ndarray:
        try:
            return self.encoding.encode_to_numpy(t, disallowed_special=())
        except ValueError:  # the fast splitter gives up on very long runs of white space
            from tokenizers import Tokenizer

            slow = Tokenizer.from_str(self.data.decode())
            slow.encode_special_tokens = True
            return np.array(slow.encode(t, add_special_tokens=False).ids, np.int32)


class PieceLevel:
    """Side B: a SentencePiece BPE model, which adds the space itself.

    No piece holds a space after another character, so merges stop at those edges, and stretches between them are
    encoded once and remembered in a table of bounded size. Models without that property take whole texts.
    """

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.sp = sp = SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        self.opens, self.closes = (np.array([side(b, b" ") for b in self.bytes]) for side in (bytes.startswith, bytes.endswith))
        inside = re.compile(f"[^{SPACE}]{SPACE}")
        self.local = SPACE in pieces and not any(inside.search(p) for p in pieces) and self.spelled(PROBES, self.whole(PROBES)).all()
        self.stretch = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.known: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int32) for x in self.sp.encode(texts, num_threads=1)]

    def spelled(self, texts: list[str], ids: list[np.ndarray]) -> np.ndarray:
        """Whether the tokens of each text spell a space and the text."""
        return np.array([b"".join(map(self.bytes.__getitem__, x.tolist())) == f" {t}".encode("utf-8", "surrogatepass") for t, x in zip(texts, ids, strict=True)], bool)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of each text, and whether they spell a space and the text."""
        if self.local:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            parts = [self.stretch.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
            fresh = [*set().union(*parts).difference(self.known)]
            found = self.apart(fresh)
            if found is not None:
                self.known.update(zip(fresh, found, strict=True))
                ids = [np.frombuffer(b"".join(map(self.known.__getitem__, p)), np.int32) for p in parts]
                for s in fresh:
                    if len(s) > LONGEST_REMEMBERED:
                        del self.known[s]
                return ids, np.array([SPACE not in t for t in texts], bool)  # stretches are spelled, with spaces for U+2581
        ids = self.whole(texts)
        return ids, self.spelled(texts, ids)

    def apart(self, stretches: list[str]) -> list[bytes] | None:
        """Ids of each stretch, None if some aren't spelled by theirs.

        Many are encoded in one string: one begins where a piece opens with a space after a piece that doesn't close with one.
        """
        spaces = [s for s in stretches if s[-1] == SPACE]  # would grow into the next stretch
        # the model puts the first space, and nothing else for an empty text
        runs = dict(zip(spaces, (x.tobytes() if len(x) else np.array([self.sp.piece_to_id(SPACE)], np.int32).tobytes() for x in self.whole([s[1:] for s in spaces])), strict=True)) if spaces else {}
        text = "".join([s for s in stretches if s[-1] != SPACE])[1:]
        ids = self.whole([text])[0] if text else np.zeros(0, np.int32)
        if text and not self.spelled([text.replace(SPACE, " ")], [ids])[0]:
            return None
        at = 4 * np.append(np.flatnonzero(self.opens[ids] & ~np.concatenate([[False], self.closes[ids[:-1]]])[: len(ids)]), len(ids))
        data, at = ids.tobytes(), at.tolist()
        plain = iter([data[lo:hi] for lo, hi in zip(at[:-1], at[1:], strict=True)])
        out = [runs[s] if s[-1] == SPACE else next(plain, None) for s in stretches]
        return None if None in out or next(plain, None) is not None else out


_sides: dict[bytes, tuple[ByteLevel, PieceLevel]] = worker_cache()


def sides(a: bytes, b: bytes) -> tuple[ByteLevel, PieceLevel]:
    """Both tokenizers, kept while the worker lives."""
    key = hashlib.sha256(a).digest() + hashlib.sha256(b).digest()
    if key not in _sides:
        _sides.clear()
        _sides[key] = ByteLevel(a), PieceLevel(b)
    return _sides[key]


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, from_a: np.ndarray, to_a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which ends of each list occur in the other. Both rise over the whole batch; lanes are ranges of `ends_a`."""
    cut_a, cut_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    after = np.searchsorted(ends_b, np.concatenate([[-1], ends_a])[from_a], "right")  # the first end past the lane's start
    a, b, stop = from_a.copy(), after, to_a.copy()
    alive = (a < stop) & (b < len(ends_b))
    a, b, stop = a[alive], b[alive], stop[alive]
    while len(a):
        x, y = ends_a[a], ends_b[b]
        same = x == y
        cut_a[a[same]] = True
        cut_b[b[same]] = True
        b += y <= x
        a += x <= y
        alive = (a < stop) & (b < len(ends_b))
        if not alive.all():
            a, b, stop = a[alive], b[alive], stop[alive]
    return cut_a, cut_b


@dataclass
class Batch:
    """Tokens of a batch of texts, side by side: ids, the text of each token, and whether a cut follows it."""

    texts: int
    a: np.ndarray
    b: np.ndarray
    text_a: np.ndarray
    text_b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray

    def split(self, values: np.ndarray, text: np.ndarray) -> pa.ListArray:
        """Values as a list a text."""
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.texts))]).astype(np.int32)), pa.array(values))


def merged(texts: list[str | None], one: ByteLevel, two: PieceLevel) -> Batch:
    """Both encodings of each text and their cuts; texts whose tokens don't spell a space and the text have none."""
    plain = [t or "" for t in texts]
    ids_a = one.encode(plain)
    ids_b, fine = two.encode(plain)
    for i, t in enumerate(plain):
        # every byte of a text is in the first side's tokens; the count of bytes is looked at all the same
        if not t or not fine[i] or one.size[ids_a[i]].sum() != len(t.encode("utf-8", "surrogatepass")) + 1:
            ids_a[i] = ids_b[i] = np.zeros(0, np.int32)
    n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
    none = [np.zeros(0, np.int32)]
    a, b = (np.concatenate([*ids, *none]).astype(np.int32) for ids in (ids_a, ids_b))
    first = np.concatenate([[0], np.cumsum(n_a)])
    lanes = [(lo, min(lo + LANE, hi)) for s, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True) for lo in range(s, hi, LANE)]
    bounds = np.array(lanes, np.int64).reshape(-1, 2)
    cut_a, cut_b = lockstep(np.cumsum(one.size[a]), np.cumsum(two.size[b]), bounds[:, 0], bounds[:, 1])
    where = np.arange(len(texts))
    return Batch(len(texts), a, b, np.repeat(where, n_a), np.repeat(where, n_b), cut_a, cut_b)


def _mapped(docs: DataFrame, a: bytes, b: bytes, columns, schema: str) -> DataFrame:
    """doc_id and what `columns(batch)` makes of each batch of about BATCH_CHARS characters."""
    text_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((a, b))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = sides(*shared.value)
        make = columns(one, two)
        for batch in batches:
            at, column = 0, batch.column(1)
            while at < batch.num_rows:
                first, texts, size = at, [], 0
                while at < batch.num_rows and size < BATCH_CHARS:
                    texts.append(column[at].as_py())
                    size += len(texts[-1] or "")
                    at += 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, at - first), *make(merged(texts, one, two))], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {schema}")


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def align(docs: DataFrame, a: bytes, b: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of both tokenizers with the cuts between them: doc_id, a_ids, b_ids, a_cuts, b_cuts, one row a row.

    `a` is a byte-level BPE file, `b` a SentencePiece model, as bytes. `a_cuts[k]` and `b_cuts[k]` are how many tokens
    lie before the end of group k, so token a_cuts[k] - 1 and token b_cuts[k] - 1 (from 0) are linked. Null and empty
    texts, and those whose tokens don't spell a space and the text (as with U+2581, which the model takes for a
    space), have no tokens. Texts are taken whole, repeated rows alike; an empty table gives an empty result.
    Other columns aren't read.
    """
    def columns(one, two):
        def make(x: Batch):
            out = [x.split(x.a, x.text_a), x.split(x.b, x.text_b)]
            for ends, text in ((x.cut_a, x.text_a), (x.cut_b, x.text_b)):
                at = np.flatnonzero(ends)
                start = np.searchsorted(text, text[at])
                out.append(x.split((at - start + 1).astype(np.int32), text[at]))
            return out

        return make

    return _mapped(_named(docs, id_col, text_col), a, b, columns, "a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>")


def spelled_groups(x: Batch, names_a: list[np.ndarray], names_b: list[np.ndarray]) -> list[bytes]:
    """Groups of each text as `a1,a2|b1;a3|b2`: decimal ids, sides and groups. Names are ids with each separator."""
    group_a, group_b = np.cumsum(x.cut_a) - x.cut_a, np.cumsum(x.cut_b) - x.cut_b
    ends_a, ends_b = np.flatnonzero(x.cut_a) + 1, np.flatnonzero(x.cut_b) + 1
    out = np.empty(len(x.a) + len(x.b), object)
    # a token stands behind those of its own side and, of the other side, those of the groups before (of B: also its own)
    out[np.arange(len(x.a)) + np.concatenate([[0], ends_b])[group_a]] = np.where(x.cut_a, names_a[1][x.a], names_a[0][x.a])
    out[np.arange(len(x.b)) + ends_a[group_b]] = np.where(x.cut_b, names_b[2][x.b], names_b[0][x.b])
    ends = np.concatenate([[0], np.cumsum(np.bincount(x.text_a, minlength=x.texts) + np.bincount(x.text_b, minlength=x.texts))]).tolist()
    return [b"".join(out[lo:hi].tolist())[:-1] for lo, hi in zip(ends[:-1], ends[1:], strict=True)]


def digests(docs: DataFrame, a: bytes, b: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What the cuts of each text come to, in one pass: doc_id, n_a, n_b, n_groups, groups_sha256, and the linked
    pairs of ids (id of A times the number of B's ids, plus id of B) with how often the text links them."""
    def columns(one, two):
        names_a, names_b = ([np.array([b"%d%s" % (i, s) for i in range(len(side.bytes))], object) for s in (b",", b"|", b";")] for side in (one, two))
        width = len(two.bytes)
        every = len(one.bytes) * width

        def make(x: Batch):
            linked, text = x.a[x.cut_a].astype(np.int64) * width + x.b[x.cut_b], x.text_a[x.cut_a]
            found, times = np.unique(text * every + linked, return_counts=True)
            of = found // every
            count = lambda t: pa.array(np.bincount(t, minlength=x.texts).astype(np.int64))
            sha = [hashlib.sha256(g).hexdigest() if g else "" for g in spelled_groups(x, names_a, names_b)]
            return [count(x.text_a), count(x.text_b), count(text), pa.array(sha, pa.string()), x.split(found % every, of), x.split(times.astype(np.int32), of)]

        return make

    return _mapped(_named(docs, id_col, text_col), a, b, columns, "n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<bigint>, times array<int>")


def with_counts(found: DataFrame, width: int) -> DataFrame:
    """Add n_links, n_best and count_sum to rows of `digests`; `width` is the number of B's ids.

    A pair's count is the sum of its links over all rows. Counts are summed within tasks before they move, and come
    back to the rows by a join, a broadcast up to PAIR_LIMIT pairs. The most linked count of each id of B has a row
    an id, whose number the vocabulary bounds.
    """
    rows = cut(found.withColumn("row", F.monotonically_increasing_id()), "aligned")
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").cast("long").alias("times"))
    counts = cut(each.groupBy("pair").agg(F.sum("times").alias("n")), "pairs")
    best = counts.groupBy((F.col("pair") % width).alias("b")).agg(F.max("n").alias("most"))
    told = counts.join(small(best, width, PAIR_LIMIT), F.col("pair") % width == F.col("b")).select(F.col("pair").alias("of"), "n", (F.col("n") == F.col("most")).alias("is_best"))
    told = cut(told, "told")
    j = each.join(small(told, counts.count(), PAIR_LIMIT), F.col("pair") == F.col("of"))
    sums = j.groupBy("row").agg(F.sum("times").alias("links"), F.sum(F.when(F.col("is_best"), F.col("times"))).alias("best"), F.sum(F.col("times") * F.col("n")).alias("total"))
    zero = lambda c, n: F.coalesce(c, F.lit(0).cast("long")).alias(n)
    return rows.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", zero("links", "n_links"), zero("best", "n_best"), zero("total", "count_sum"), "groups_sha256")


def tokenizer_bytes(name: str) -> bytes:
    """A file of the public tokenizers, read on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op11(spark, sf_dir):
    """Alignment of all documents between the byte-level and the piece tokenizer."""
    a, b = tokenizer_bytes("byte_bpe_50k.json"), tokenizer_bytes("piece_bpe_32k.model")
    return with_counts(digests(table(spark, sf_dir, "documents"), a, b), len(PieceLevel(b).bytes))
