"""Sets of word shingles as sorted 64-bit hashes, computed for many texts at once in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WEIGHT = np.random.Generator(np.random.PCG64(20240501)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEED = np.uint64(0xA0761D6478BD642F)
LONG = 64  # bytes of a word
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 18)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x)
    return _powers["up"], _powers["down"]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word (run of bytes outside space and 9 to 13)."""
    a = np.frombuffer(data, np.uint8)
    word = np.concatenate(([False], ~_SPACE[a], [False]))
    turns = np.flatnonzero(word[1:] != word[:-1])
    return turns[::2], word_hashes_between(a, turns[::2], turns[1::2])


def word_hashes_between(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each range: eight bytes a step, mixed before the next, so that no sum of bytes cancels.

    Ranges of more than LONG bytes are few; a cryptographic hash takes them one by one.
    """
    n = ends - starts
    h = mix(n.astype(np.uint64) + _SEED)
    padded = np.concatenate([a, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(a) + 1,), np.uint64, padded, strides=(1,))
    going = np.flatnonzero((n > 0) & (n <= LONG))
    for at in range(0, LONG, 8):
        going = going[n[going] > at]
        if not len(going):
            break
        unused = np.maximum(0, at + 8 - n[going]).astype(np.uint64) * np.uint64(8)
        x = (eight[starts[going] + at] << unused) >> unused  # bytes of the next range don't count
        h[going] = mix((h[going] ^ x) + _SEED)
    for i in np.flatnonzero(n > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(a[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def shingle_sets(texts: Iterable[str | None], width: int, chunk: int = 1 << 18) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its `width`-word shingles, letters A-Z lower-cased.

    Texts with fewer words have one element, their whole sequence; texts without words have none.
    """
    batch: list[bytes] = []
    size = 0
    for t in texts:
        batch.append((t or "").encode("utf-8", "surrogatepass").lower())
        size += len(batch[-1])
        if size >= chunk:
            yield from _sets(batch, width)
            batch, size = [], 0
    yield from _sets(batch, width)


def _sets(batch: list[bytes], width: int) -> Iterator[np.ndarray]:
    if not batch:
        return
    starts, words = word_hashes(b" ".join(batch))
    edges = np.cumsum([0, *[len(b) + 1 for b in batch]])
    at = np.searchsorted(starts, edges)
    step = np.uint64(0xD6E8FEB86659FD93)
    full = max(0, len(words) - width + 1)
    grams = np.zeros(full, np.uint64)
    for j in range(width):
        grams *= step
        grams += words[j : j + full]
    mix(grams)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= width:
            yield np.unique(grams[lo : hi - width + 1])
        elif hi > lo:
            h = hi - lo
            for w in words[lo:hi].tolist():
                h = (h * int(step) + w) & _MASK
            yield mix(np.array([h], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def exact_sets(texts: Iterable[str | None], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct numbers of its shingles, which are equal only for equal words.

    Words get their numbers by their bytes and longer and longer runs of words by pairs of numbers, so nothing is
    hashed down; numbers hold among these texts only. Texts of fewer than `width` words are filled up with a word
    that no text has.
    """
    number: dict[bytes, int] = {b" ": 0}
    runs, sizes = [], []
    for t in texts:
        words = [number.setdefault(w, len(number)) for w in (t or "").encode("utf-8", "surrogatepass").lower().split()]
        if 0 < len(words) < width:
            words += [0] * (width - len(words))
        runs.append(np.array(words, np.int64))
        sizes.append(len(words))
    flat = np.concatenate([*runs, np.zeros(0, np.int64)])
    grams = flat
    for j in range(1, width):
        _, grams = np.unique(grams[: max(0, len(flat) - j)] * len(number) + flat[j:], return_inverse=True)
    ends = np.cumsum([0, *sizes])
    return [np.unique(grams[lo : max(lo, hi - width + 1)]) for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
