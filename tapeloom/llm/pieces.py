"""SentencePiece encoding and decoding by streaming Viterbi over the pieces of a given model.

The lattice of a text has an edge for every piece of the vocabulary. The model at hand is a BPE model, whose
right segmentation isn't the one of greatest score sum, so transitions carry its merges: piece b may follow
piece a only if merging the characters of a and b by the model's rules gives back a and b. Of all paths that
obey this, exactly one reaches each position, and the one that reaches the end is the model's own encoding.

The search keeps a window of positions no longer than the longest piece. Ids are committed as soon as the
backpointer paths of all positions in the window meet in one boundary; at the edge before a space they always
do, as no piece holds a space after another character. Stretches between such edges are encoded once and
remembered (in a table of bounded size). Runs of spaces hold pieces of equal score, which merge from the left;
there the merges are carried out as they are defined.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import table, text_batches, worker_cache

SPACE = "▁"
REMEMBERED = 300_000  # stretches in each of two tables
LONGEST_REMEMBERED = 48
BATCH_CHARS = 4_000_000
START, NONE = -2, -1
PROBES = ("a  b ", "  a", "a", " ", "ﬁ Ａ\tb", "İ ß", "\r\n\n x", "🙂é́", "Hello worlds, of tokens")
_STRETCH = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Pieces(dict):
    """Vocabulary with its encoder; as a dict it maps a stretch of text to the bytes of its ids."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        super().__init__()
        sp = SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.text = {i: sp.id_to_piece(i) for i in plain}
        self.id = {p: i for i, p in self.text.items()}
        self.score = {p: -sp.get_score(i) for p, i in self.id.items()}  # the lowest merges first
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.size = {i: len(p) for i, p in self.text.items()}
        self.longest = max(map(len, self.id))
        self.before: dict[str, bytes] = {}
        self.grown: dict[int, tuple[list[str], list[str]]] = {}
        self.fits: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.out = [b""] * n
        for i, p in self.text.items():
            self.out[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            self.out[i] = bytes([b])
        self.check(sp)

    def check(self, sp) -> None:
        """Raise unless the library encodes alike: a unigram or word model, a normaliser, other rules for spaces, and pieces
        that hold a space inside are models of another kind."""
        plain = [p.replace(SPACE, " ") for p in self.text.values()]
        probes = [*PROBES, *["".join(plain[i::97])[:2000] for i in range(0, 97, 8)]]
        if any(SPACE in p.lstrip(SPACE) for p in self.id) or any(list(np.frombuffer(self.encode(t), np.int32)) != sp.encode(t) for t in probes):
            raise ValueError("not a BPE model with the identity normaliser, byte fallback and a space put before the text")

    def merge(self, s: str) -> list[str]:
        """The model's merges as they are defined: the best pair first, of equal ones the leftmost."""
        parts = list(s)
        while len(parts) > 1 and (at := self.best(parts)) >= 0:
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def best(self, parts: list[str]) -> int:
        best, at, score = None, -1, self.score
        for i in range(len(parts) - 1):
            x = score.get(parts[i] + parts[i + 1])
            if x is not None and (best is None or x < best):
                best, at = x, i
        return at

    def edges(self, a: int) -> tuple[list[str], list[str]]:
        """What stands at the first and at the last place of a piece while its characters merge."""
        known = self.grown.get(a)
        if known is None:
            parts = list(self.text[a])
            first, last = [parts[0]], [parts[-1]]
            while len(parts) > 1 and (at := self.best(parts)) >= 0:
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                if parts[0] != first[-1]:
                    first.append(parts[0])
                if parts[-1] != last[-1]:
                    last.append(parts[-1])
            known = self.grown[a] = (first, last)
        return known

    def follows(self, a: int, b: int) -> bool:
        """Whether merging the characters of both pieces gives just these two.

        Each side merges by itself until a merge across the boundary is the best one, which must never be.
        """
        left, right, score, never = self.edges(a)[1], self.edges(b)[0], self.score, float("inf")
        i = j = 0
        while True:
            across = score.get(left[i] + right[j])
            mine = score[left[i + 1]] if i + 1 < len(left) else never
            other = score[right[j + 1]] if j + 1 < len(right) else never
            if across is not None and across < mine and across <= other:
                fit = False
                break
            if mine == other == never:
                fit = True
                break
            i, j = (i + 1, j) if mine <= other else (i, j + 1)
        self.fits[a << 20 | b] = fit
        return fit

    def stands(self, a: int) -> bool:
        known = self.whole.get(a)
        if known is None:
            known = self.whole[a] = self.merge(self.text[a]) == [self.text[a]]
        return known

    def viterbi(self, s: str) -> list[int]:
        """Ids of a stretch without runs of spaces.

        `last` holds, for each boundary from `base` on, the piece that ends there on the one path that reaches
        it: START where a path begins, NONE where no path ends. It is cut whenever paths have met.
        """
        longest, get, fits, size = self.longest, self.id.get, self.fits, self.size
        done: list[int] = []
        base, last = 0, [START]
        for end in range(1, len(s) + 1):
            found = NONE
            for start in range(end - 1, max(base, end - longest) - 1, -1):
                piece = get(s[start:end])
                if piece is None:
                    continue
                before = last[start - base]
                if before >= 0:
                    ok = fits.get(before << 20 | piece)
                    if ok is None:
                        ok = self.follows(before, piece)
                elif before == START:
                    ok = self.stands(piece)
                else:
                    continue
                if ok:
                    found = piece
                    break
            if found == NONE and s[end - 1] not in self.id:
                # a character outside the vocabulary merges with nothing: all paths meet before and after it
                done += self._path(last, len(last) - 1) + self._bytes(s[end - 1])
                base, last = end, [START]
                continue
            last.append(found)
            if len(last) > 8 * longest:
                live = {b for b in range(len(last) - longest, len(last)) if last[b] >= 0}
                while len(live) > 1:
                    b = max(live)
                    live.discard(b)
                    live.add(b - size[last[b]])
                meet = live.pop()
                if meet > 0:
                    done += self._path(last, meet)
                    base += meet
                    last = last[meet:]
        return done + self._path(last, len(last) - 1)

    def _path(self, last: list[int], end: int) -> list[int]:
        path = []
        while end > 0:
            path.append(last[end])
            end -= self.size[last[end]]
        return path[::-1]

    def _bytes(self, c: str) -> list[int]:
        return [self.byte.get(b, self.unknown) for b in c.encode("utf-8", "surrogatepass")]

    def spaced(self, s: str) -> list[int]:
        """Ids of a stretch that begins with a run of spaces.

        Pieces of spaces alone score below all others, so the last space goes with the word if it can. The
        others merge among themselves: always the leftmost pair that gives a piece.
        """
        word = s.lstrip(SPACE)
        run, rest = len(s) - len(word), []
        if word:
            rest = self.viterbi(SPACE + word)
            run -= rest[0] != self.id.get(SPACE)
            rest = rest[1:] if rest[0] == self.id.get(SPACE) else rest
        parts: list[str] = []
        for _ in range(run):
            if not parts or parts[-1] + SPACE not in self.id:
                parts.append(SPACE)
                continue
            parts[-1] += SPACE
            while len(parts) > 1 and parts[-2] + parts[-1] in self.id:
                parts[-2:] = [parts[-2] + parts[-1]]
        return [self.id[p] for p in parts] + rest

    def __missing__(self, s: str) -> bytes:
        out = self.before.get(s)
        if out is None:
            out = np.array(self.spaced(s) if s[:2] == SPACE * 2 else self.viterbi(s), np.int32).tobytes()
        if len(s) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:  # what is used again moves on to the new table, the rest is forgotten
                self.before = dict(self)
                self.clear()
            self[s] = out
        return out

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        s = SPACE + text.replace(" ", SPACE)
        return b"".join([self[x] for x in _STRETCH.findall(s)])

    def decode(self, ids: np.ndarray) -> str:
        out = self.out
        return b"".join([out[i] for i in ids.tolist()]).decode("utf-8", "replace")[1:]


_loaded: dict[bytes, Pieces] = worker_cache()


def loaded(model: bytes) -> Pieces:
    """The encoder of a model, kept with what it remembers while the worker lives."""
    if model not in _loaded:
        _loaded.clear()
        _loaded[model] = Pieces(model)
    return _loaded[model]


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text: doc_id, n_tokens, ids, round_trip (decoding gives back the text).

    Null and empty texts have no ids. The character U+2581 stands for a space in the model, so a text that
    holds it comes back with spaces there, and counts as a round trip then. Repeated rows are encoded alike. Texts
    of any length are encoded as a whole. An empty table gives an empty result; other columns aren't read. A model of
    another kind than BPE with the identity normaliser is an error, which is raised here.
    """
    loaded(model)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        pieces = loaded(shared.value)
        for batch in batches:
            at = 0
            texts = batch.column(1)
            while at < batch.num_rows:
                first, ids, good, size = at, [], [], 0
                while at < batch.num_rows and size < BATCH_CHARS:
                    t = texts[at].as_py() or ""
                    x = np.frombuffer(pieces.encode(t), np.int32)
                    ids.append(x)
                    good.append(pieces.decode(x) == t.replace(SPACE, " "))
                    size += len(t)
                    at += 1
                n = np.array([len(x) for x in ids], np.int64)
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, at - first), pa.array(n), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))), pa.array(good)], ["doc_id", "n_tokens", "ids", "round_trip"])

    return docs.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, round_trip boolean")


def decode(rows: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of id lists: doc_id, text. A null list gives null, an empty one the empty text; unknown ids nothing."""
    rows = rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        pieces = loaded(shared.value)
        for pdf in batches:
            fine = [None if x is None else np.array([i for i in x if i is not None and 0 <= i < len(pieces.out)], np.int32) for x in pdf["ids"]]
            yield pdf[["doc_id"]].assign(text=[None if x is None else pieces.decode(x) for x in fine])

    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def model_bytes(path: str | None = None) -> bytes:
    """A model file, read on the driver; by default the one of the public tokenizers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def op8(spark, sf_dir):
    """Ids of all documents by the public BPE model, each decoded again."""
    return encode(table(spark, sf_dir, "documents"), model_bytes())
