"""Spelling variants: k-d trees over letter-count vectors.

A replaced letter changes the counts of two letters by one, an inserted or deleted one those of one letter: near
words have count vectors at an L1 distance of 2 at equal lengths and of 1 at neighbouring ones. For each length a
k-d tree cuts the vectors into cells. A word goes to its own cell as a point, and as a query to every cell of its
length, and of the length above, whose box lies within that distance. Inside a cell another k-d tree is searched
for all queries at once, which drops the boxes too far from each; pairs left are verified letter by letter.

The upper trees are fitted to a bounded sample of words, which only decides how even cells are: all words are points
and queries. Cells that can't be cut further (words of the same letters), and cells with many queries, are dealt
out in blocks of points times blocks of queries.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import Rounds, cut, shuffle_partitions, small, table, text_batches, unit_hash

# Letters a to z and those from U+00C0 to U+00FF; their code points fit a byte each.
LETTERS = [*range(0x61, 0x7B), *range(0xC0, 0x100)]
RUN = re.compile("[A-Za-zÀ-ÿ]+")
CELL = 16_384  # points of a cell
LEAF = 64  # points at a leaf of a cell's own tree
QUERIES = 2 * CELL  # queries that meet a block of points in one group
SAMPLE = 200_000  # words that the upper trees are fitted to
HELD = 300_000  # words counted in a task before they move on
AT_ONCE = 20_000  # rows handed on at once
COMPARED = 1 << 22  # letters, or pairs of words, compared at once
CELL_LIMIT = 500_000
_DIM = np.zeros(256, np.int64)
_DIM[LETTERS] = np.arange(len(LETTERS))


def word_counts(docs: DataFrame, letters: int, drop: int) -> DataFrame:
    """word, n: how often each word of at least `letters` letters occurs, after one run in `drop` has lost a letter.

    Rows are (id as text, text as bytes). A run loses a letter if the checksum of `<id>:<run>` is a multiple of
    `drop`; all runs of one text that are equal do so alike, so they are counted first.
    """
    def rows(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for i, t in zip(*batch.columns, strict=True):
                t = t.as_py()
                if not t:
                    continue
                start = zlib.crc32(f"{i.as_py() or ''}:".encode())
                for w, n in Counter(RUN.findall(t.lower().decode("utf-8", "replace"))).items():  # bytes: only A-Z change
                    if len(w) >= letters:
                        h = zlib.crc32(w.encode(), start)
                        if h % drop == 0:
                            w = w[: h % len(w)] + w[h % len(w) + 1 :]
                            if len(w) < letters:
                                continue
                        total[w] += n
                if len(total) >= HELD:
                    yield rows(total)
                    total = Counter()
        yield rows(total)

    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def codes(words: list[str]) -> np.ndarray:
    """Letters of words of one length, a row a word."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def letter_counts(c: np.ndarray) -> np.ndarray:
    """How often each letter occurs in each word of `codes`."""
    at = np.arange(len(c))[:, None] * len(LETTERS) + _DIM[c]
    return np.bincount(at.ravel(), minlength=len(c) * len(LETTERS)).reshape(len(c), -1).astype(np.int32)


class Tree:
    """A k-d tree: nodes (dim, most, low, high) with vectors of at most `most` in `dim` below `low`; leaves have dim -1
    and their number in `most`. `members` are the rows at each leaf."""

    def __init__(self, vectors: np.ndarray, size: int, leaf: float):
        self.nodes: list[tuple[int, int, int, int]] = []
        self.members: list[np.ndarray] = []
        self.leaf, self.width = leaf, size
        self.grow(vectors, np.arange(len(vectors)))

    def grow(self, v: np.ndarray, rows: np.ndarray) -> int:
        here = len(self.nodes)
        self.nodes.append((-1, len(self.members), 0, 0))
        split = self.split(v[rows]) if len(rows) > self.leaf else None
        if split is None:
            self.members.append(rows)
            return here
        dim, most = split
        below = v[rows, dim] <= most
        low = self.grow(v, rows[below])
        self.nodes[here] = (dim, most, low, self.grow(v, rows[~below]))
        return here

    def split(self, v: np.ndarray) -> tuple[int, int] | None:
        """Dimension and value that part the vectors most evenly, None if they are all alike. Of evenly parting dimensions
        the first, so a tree depends on its vectors alone."""
        best, found = 0, None
        for dim in np.flatnonzero(v.min(axis=0) < v.max(axis=0)).tolist():
            least = int(v[:, dim].min())
            below = np.cumsum(np.bincount(v[:, dim] - least))[:-1]
            part = np.minimum(below, len(v) - below)
            k = int(part.argmax())
            if part[k] > best:
                best, found = int(part[k]), (dim, least + k)
        return found

    def search(self, queries: np.ndarray, reach: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves and the queries whose distance to the leaf's box is at most their reach, all queries at once."""
        far = 1 << 30
        stack = [(0, np.arange(len(queries)), np.zeros(len(queries), np.int64), {})]
        while stack:
            node, rows, dist, box = stack.pop()
            dim, most, low, high = self.nodes[node]
            if dim < 0:
                yield most, rows
                continue
            x = queries[rows, dim]
            lo, hi = box.get(dim, (-far, far))
            without = dist - np.maximum(0, np.maximum(lo - x, x - hi))
            for child, side in ((low, (lo, most)), (high, (most + 1, hi))):
                d = without + np.maximum(0, np.maximum(side[0] - x, x - side[1]))
                near = d <= reach[rows]
                if near.any():
                    stack.append((child, rows[near], d[near], box | {dim: side}))


def thermometer(v: np.ndarray) -> np.ndarray:
    """Counts as 128 bits: of each letter one bit a level that the count passes. The bits in which two words differ are
    their L1 distance, or fewer where counts go beyond the levels."""
    levels = 128 // v.shape[1]
    on = np.zeros((len(v), 128), bool)
    on[:, : levels * v.shape[1]] = (v[:, :, None] > np.arange(levels)).reshape(len(v), -1)
    return np.packbits(on, axis=1).view(np.uint64)


def verified(short: np.ndarray, long: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which pairs of rows of codes differ by exactly one edit; `long` has the same length or a letter more."""
    out = np.zeros(len(one), bool)
    width = short.shape[1]
    step = max(1, COMPARED // width)
    for i in range(0, len(one), step):
        x, y = short[one[i : i + step]], long[two[i : i + step]]
        if y.shape[1] == width:
            out[i : i + step] = (x != y).sum(axis=1) == 1
        else:  # equal letters from the left and from the right meet
            left = np.logical_and.accumulate(x == y[:, :-1], axis=1).sum(axis=1)
            right = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], axis=1).sum(axis=1)
            out[i : i + step] = left + right >= width
    return out


def near_in(points: list[str], queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, point) of near words; points have one length, queries all that length or all one letter less."""
    if not points or not queries:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p, q = codes(points), codes(queries)
    vp, vq = letter_counts(p), letter_counts(q)
    used = np.flatnonzero(vp.any(axis=0) | vq.any(axis=0))
    vp, vq = vp[:, used], vq[:, used]
    distance = 2 if p.shape[1] == q.shape[1] else 1
    tree = Tree(vp, len(used), LEAF)
    (p0, p1), (q0, q1) = thermometer(vp).T, thermometer(vq).T
    one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for leaf, rows in tree.search(vq, np.full(len(vq), distance)):
        members = tree.members[leaf]
        step = max(1, COMPARED // len(members))  # a leaf of like words may be large
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            apart = np.bitwise_count(q0[part][:, None] ^ p0[members][None, :])
            apart += np.bitwise_count(q1[part][:, None] ^ p1[members][None, :])
            a, b = np.nonzero(apart <= distance)
            one.append(part[a])
            two.append(members[b])
    one, two = np.concatenate(one), np.concatenate(two)
    fine = verified(q, p, one, two)
    return one[fine], two[fine]


def upper_trees(words: DataFrame, total: int) -> dict[int, Tree]:
    """A tree for each length with more than a cell's words, fitted to some SAMPLE words in all."""
    share = min(1.0, SAMPLE / max(1, total))
    many = words.groupBy(F.length("word").alias("of")).agg(F.count("*").alias("m")).filter(F.col("m") > CELL)
    sample = words.filter(unit_hash("word") < share).join(F.broadcast(many), F.length("word") == F.col("of")).select("word").orderBy("word").toPandas()["word"]
    by_length: dict[int, list[str]] = {}
    for w in sample:
        by_length.setdefault(len(w), []).append(w)
    trees = {n: Tree(letter_counts(codes(ws)), len(LETTERS), max(8.0, CELL * share)) for n, ws in by_length.items()}
    for t in trees.values():
        t.members = []
    return trees


def _gathered(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Batches put together to some `rows` at a time."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        held.append(pdf)
        if sum(map(len, held)) >= rows:
            yield pd.concat(held, ignore_index=True)
            held = []
    if any(map(len, held)):
        yield pd.concat(held, ignore_index=True)


def _groups(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of one group each, from batches sorted by `key`; a group over many batches is put together once."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        k = pdf[key].to_numpy()
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(pdf)]
        if held and tuple(held[-1][key].iloc[-1]) != tuple(k[0]):
            yield pd.concat(held, ignore_index=True)
            held = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(pdf.iloc[lo:hi])
            if hi < len(pdf):
                yield pd.concat(held, ignore_index=True)
                held = []
    if held:
        yield pd.concat(held, ignore_index=True)


PLACED = "size int, leaf int, kind int, word string, n long"


def placed(words: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """Words as points (kind 0) of their cell and as queries of cells of their length (1) and the one above (2)."""
    shared = words.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for pdf in _gathered(batches, SAMPLE):
            word, n = pdf["word"].to_numpy(object), pdf["n"].to_numpy()
            sizes, found = np.array([len(w) for w in word]), []
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                v = letter_counts(codes(word[own].tolist()))
                for kind, length, reach in ((0, size, 0), (1, size, 2), (2, size + 1, 1)):
                    leaves = shared.value[length].search(v, np.full(len(v), reach)) if length in shared.value else [(0, np.arange(len(v)))]
                    found += [(length, leaf, kind, own[rows]) for leaf, rows in leaves]
            for length, leaf, kind, rows in found:
                for i in range(0, len(rows), AT_ONCE):
                    part = rows[i : i + AT_ONCE]
                    yield pd.DataFrame({"size": np.int32(length), "leaf": np.int32(leaf), "kind": np.int32(kind), "word": word[part], "n": n[part]})

    return words.mapInPandas(run, PLACED)


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, near (n, word): how many near words each has, and the most frequent one, of equals the first."""
    spark = words.sparkSession
    total = words.count()
    all_placed = cut(placed(words, upper_trees(words, total)), "placed")
    cells = all_placed.groupBy("size", "leaf").agg(F.ceil(F.count_if(F.col("kind") == 0) / (2 * CELL)).cast("int").alias("ps"), F.ceil(F.count_if(F.col("kind") > 0) / QUERIES).cast("int").alias("qs")).filter("ps > 0 and qs > 0")
    cells = cut(cells, "cells")
    j = all_placed.join(small(cells, cells.count(), CELL_LIMIT), ["size", "leaf"])
    spot = lambda n: F.pmod(F.xxhash64("word"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    point = F.col("kind") == 0
    key = ["size", "leaf", "p", "q"]
    dealt = j.withColumn("p", F.explode(F.when(point, F.array(spot("ps"))).otherwise(every("ps")))).withColumn("q", F.explode(F.when(point, every("qs")).otherwise(F.array(spot("qs")))))

    def run(batches):
        for g in _groups(batches, key):
            yield _answers(g)

    ordered = dealt.select(*key, "kind", "word", "n").repartition(shuffle_partitions(spark), *key).sortWithinPartitions(*key)
    found = ordered.mapInPandas(run, "word string, n_near long, n long, near string")
    # of equal counts the first word in code point order, which is that of the bytes
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "near")).alias("near"))


def _answers(g: pd.DataFrame) -> pd.DataFrame:
    """For each word of a group with near words there: their number and the best of them."""
    points = g[g["kind"] == 0]
    parts = []
    for kind in (1, 2):
        queries = g[g["kind"] == kind]
        a, b = near_in(points["word"].tolist(), queries["word"].tolist())
        q, p = queries.iloc[a], points.iloc[b]
        parts.append((q, p))
        if kind == 2:  # the longer word is no query of the shorter one's cell
            parts.append((p, q))
    found = pd.DataFrame({
        "word": np.concatenate([x["word"].to_numpy(object) for x, _ in parts]), "n": np.concatenate([y["n"].to_numpy(np.int64) for _, y in parts]), "near": np.concatenate([y["word"].to_numpy(object) for _, y in parts]),
    })
    if not len(found):
        return pd.DataFrame({"word": pd.Series(dtype=object), "n_near": pd.Series(dtype=np.int64), "n": pd.Series(dtype=np.int64), "near": pd.Series(dtype=object)})
    number = found.groupby("word").size()
    best = found.sort_values(["n", "near"], ascending=[False, True]).drop_duplicates("word").set_index("word")
    return pd.DataFrame({"word": number.index, "n_near": number.to_numpy(), "n": best["n"].reindex(number.index).to_numpy(), "near": best["near"].reindex(number.index).to_numpy()})


def last_forms(forms: DataFrame, rounds: int = 40) -> DataFrame:
    """word, root: forms followed to the last. Each round doubles the way that has been gone, until all have arrived.

    Counts rise along the way by a factor, so there is no circle and `rounds` are met by an error alone, and raised.
    """
    tables = Rounds(forms.sparkSession, "roots")
    x = tables.cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(rounds):
        on = x.select(F.col("word").alias("at"), F.col("root").alias("next"))
        y = tables.cut(x.join(on, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if y.filter("moved").isEmpty():
            return y.select("word", "root")
        x = y.select("word", "root")
    raise RuntimeError(f"forms have no end after {rounds} rounds")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = 6, least: int = 5, ratio: int = 5, drop: int = 199) -> DataFrame:
    """Words with their more frequent spelling: word, form, root, n, n_near, form_n.

    Words are runs of the letters A-Z, a-z and U+00C0 to U+00FF in whole texts, A-Z lower-cased, of at least
    `letters` letters and `least` occurrences; one run in `drop`, chosen by a checksum of id and run, loses a letter
    first. Words are near if one inserted, deleted or replaced letter makes one the other. The form is the near word of
    largest n (of equal ones the first by code points) if its n reaches `ratio` times the word's, else null; the root
    is the last of the forms of forms, the word itself without a form. Null texts have no words; a null id counts as
    the empty text. Repeated rows count as often as they occur. Empty tables give empty results; other columns aren't
    read. Ids may be of any type that has a text.
    """
    text_batches(docs.sparkSession)
    raw = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    words = cut(word_counts(raw, letters, drop).filter(F.col("n") >= least), "words")
    near = near_words(words).select(F.col("word").alias("of"), "n_near", (-F.col("near.n")).alias("near_n"), F.col("near.near").alias("near"))
    fits = F.col("near_n") >= ratio * F.col("n")
    found = words.join(near, F.col("word") == F.col("of"), "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n"))
    found = cut(found, "forms")
    roots = last_forms(found.filter("form is not null")).withColumnRenamed("word", "of")
    return found.join(roots, F.col("word") == F.col("of"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13(spark, sf_dir):
    """Spelling variants among the words of all documents."""
    return variants(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) x(i)),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c)::BIGINT >> 6), 128 + (unicode(c)::BIGINT & 63)] END)) AS b FROM runs),
sums AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, tab),
edited AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM sums),
words AS (SELECT word, sum(n)::BIGINT AS n FROM edited WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS most FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.most >= 5 * w.n THEN b.other END AS form, CASE WHEN b.most >= 5 * w.n THEN b.most END AS form_n FROM words w LEFT JOIN best b USING (word)),
ways AS (SELECT word, word AS root, 0 AS steps FROM forms UNION ALL SELECT w.word, f.form, steps + 1 FROM ways w JOIN forms f ON f.word = w.root WHERE f.form IS NOT NULL),
roots AS (SELECT word, max_by(root, steps) AS root FROM ways GROUP BY word)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN roots r USING (word)
"""
