"""External induced suffix sorting of one shard of text, with the common prefixes of neighbours.

The suffixes that are smaller than their left neighbour's (S*-suffixes) are sorted first: their substrings are named
by rank, through sorted runs, and the text of names, at most half as long, is sorted by recursion; where only some
symbols of each suffix decide, the recursion ends with names of which a few decide, ranked through sorted runs. Then a priority
queue ordered by (first symbol, rank of the rest) yields all suffixes: popping a suffix pushes the one that starts a
symbol before it, first for the suffixes that are larger than their rest, then, from the other end, for those that are
smaller. As pushes of one symbol arrive in rank order, the queue keeps one file with a bucket a symbol and a head in
each: a push appends to its bucket and popping reads on.

Queue entries are tuples of a suffix and its common prefix with the entry before it. If two suffixes of one symbol are
pushed one after the other, theirs is one more than the least common prefix of what was popped between, so prefixes go
through the induction with the tuples; the recursion gives those of S*-suffixes. They count up to `cap`.

Beyond `memory` entries all arrays of a shard (text, kinds, names, queue) lie in files of the given folder and are
read in blocks, so a shard may be far larger than memory, which holds some blocks and what is kept for each symbol.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np

IN_MEMORY = 1 << 24
BLOCK = 1 << 20
FEW = 8  # symbols by which suffixes are ranked without induction


class Store:
    """Arrays of a shard: in memory up to `memory` entries, else in files of a folder, which go with the store."""

    def __init__(self, folder: str | None = None, memory: int | None = None):
        self.folder, self.memory, self.files = folder, IN_MEMORY if memory is None else memory, []

    def array(self, n: int, dtype, fill: int | None = None) -> np.ndarray:
        if n <= self.memory:
            return np.empty(n, dtype) if fill is None else np.full(n, fill, dtype)
        if self.folder is None:
            raise ValueError(f"{n} entries need a folder")
        os.makedirs(self.folder, exist_ok=True)
        path = os.path.join(self.folder, uuid.uuid4().hex)
        self.files.append(path)
        a = np.memmap(path, dtype, mode="w+", shape=(n,))
        if fill:
            for at in range(0, n, BLOCK):
                a[at : at + BLOCK] = fill
        return a

    def keep(self, values: np.ndarray) -> np.ndarray:
        a = self.array(len(values), values.dtype)
        a[:] = values
        return a

    def __enter__(self):
        return self

    def __exit__(self, *_):
        for path in self.files:
            if os.path.exists(path):
                os.remove(path)


class Runs:
    """A priority queue of (key, value) that is filled first and then emptied: sorted runs, merged block by block."""

    def __init__(self, store: Store):
        self.store, self.runs = store, []

    def push(self, key: np.ndarray, value: np.ndarray) -> None:
        order = np.argsort(key, kind="stable")
        self.runs.append((self.store.keep(key[order]), self.store.keep(value[order])))

    def pop(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All entries in the order of keys, in blocks; equal keys come in one block."""
        at = [0] * len(self.runs)
        step = max(1, BLOCK // max(1, len(self.runs)))
        while any(a < len(k) for a, (k, _) in zip(at, self.runs, strict=True)):
            edge = min(k[min(a + step, len(k)) - 1] for a, (k, _) in zip(at, self.runs, strict=True) if a < len(k))
            ends = [int(np.searchsorted(k, edge, side="right")) for k, _ in self.runs]
            keys = np.concatenate([np.asarray(k[a:e]) for a, e, (k, _) in zip(at, ends, self.runs, strict=True)])
            values = np.concatenate([np.asarray(v[a:e]) for a, e, (_, v) in zip(at, ends, self.runs, strict=True)])
            at = [max(a, e) for a, e in zip(at, ends, strict=True)]
            order = np.argsort(keys, kind="stable")
            yield keys[order], values[order]


class Minima:
    """Least values of stretches of a growing list, from minima over powers of two."""

    def __init__(self):
        self.table, self.n = np.zeros((32, 64), np.uint8), 0

    def append(self, value: int) -> None:
        if self.n == self.table.shape[1]:
            self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
        t, n = self.table, self.n
        t[0, n] = value
        for k in range(1, (n + 1).bit_length()):
            i, half = n + 1 - (1 << k), 1 << (k - 1)
            t[k, i] = min(t[k - 1, i], t[k - 1, i + half])
        self.n = n + 1

    def least(self, lo: np.ndarray, hi: np.ndarray, none: int) -> np.ndarray:
        """Minima over [lo, hi), `none` where that is empty."""
        n = hi - lo
        k = np.frexp(np.maximum(n, 1))[1] - 1
        found = np.minimum(self.table[k, np.where(n > 0, lo, 0)], self.table[k, np.where(n > 0, hi - (1 << k), 0)])
        return np.where(n > 0, found, none)


def least_between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minima of values[lo:hi + 1] for lo <= hi."""
    out = np.empty(len(lo), values.dtype)
    k = np.frexp(hi - lo + 1)[1] - 1
    table = values
    for j in range(int(k.max()) + 1 if len(k) else 0):
        at = np.flatnonzero(k == j)
        out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << j) + 1])
        table = np.minimum(table[: -(1 << j) or None], table[1 << j :]) if len(table) > 1 << j else table
    return out


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Common prefixes of pairs of different suffixes, compared symbol by symbol up to `most`."""
    out = np.zeros(len(a), np.int64)
    alive, last = np.flatnonzero(most > 0), len(text) - 1
    while len(alive):
        k = out[alive]
        same = text[np.minimum(a[alive] + k, last)] == text[np.minimum(b[alive] + k, last)]
        alive = alive[same]
        out[alive] += 1
        alive = alive[out[alive] < most[alive]]
    return out


class Queue:
    """Suffixes by first symbol and rank of the rest, each with its common prefix with the one before it.

    Seeds wait at the end of their buckets and pushes fill them from the head.
    """

    def __init__(self, store: Store, text: np.ndarray, symbols: int, seeds: np.ndarray, prefixes: np.ndarray, cap: int):
        self.text, self.cap, self.narrow = text, cap, symbols < 1 << 15  # 16-bit keys are sorted by radix
        n = len(text)
        sizes, waiting = np.zeros(symbols, np.int64), np.zeros(symbols, np.int64)
        for at in range(0, n, BLOCK):
            sizes += np.bincount(text[at : at + BLOCK], minlength=symbols)
        for at in range(0, len(seeds), BLOCK):
            waiting += np.bincount(text[seeds[at : at + BLOCK]], minlength=symbols)
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self.head = self.start[:-1].copy()
        self.seeds_from = self.start[1:] - waiting
        self.data, self.prefix = store.array(n, np.int32, -1), store.array(n, np.uint8, 0)
        # seeds come in order, so those of a symbol are a stretch of them
        before = np.concatenate([[0], np.cumsum(waiting)])
        for at in range(0, len(seeds), BLOCK):
            part = np.asarray(seeds[at : at + BLOCK])
            s = text[part]
            place = self.seeds_from[s] + np.arange(at, at + len(part)) - before[s]
            self.data[place], self.prefix[place] = part, prefixes[at : at + BLOCK]
        self.last, self.since, self.batches = np.full(symbols, -1), np.full(symbols, cap, np.uint8), Minima()

    def pushed(self, prefixes: np.ndarray, at: np.ndarray, suffixes: np.ndarray, symbol: np.ndarray) -> None:
        """After a batch with these common prefixes was popped: the entries `at` push suffixes of the given symbols."""
        if len(at):
            order = np.argsort(symbol.astype(np.int16) if self.narrow else symbol, kind="stable")
            s, at = symbol[order], at[order]
            first = np.concatenate([[True], s[1:] != s[:-1]])
            edge = np.flatnonzero(first)
            count = np.diff(np.concatenate([edge, [len(s)]]))
            value = np.empty(len(s), np.uint8)
            inner = np.flatnonzero(~first)
            value[inner] = least_between(prefixes, at[inner - 1] + 1, at[inner])
            # the first of each symbol: what was popped since its last push, in that batch, in those between and in this
            c, now = s[edge], self.batches.n
            so_far = np.minimum.accumulate(prefixes)[at[edge]]
            between = self.batches.least(self.last[c] + 1, np.full(len(c), now), self.cap)
            value[edge] = np.minimum(np.minimum(so_far, between), self.since[c])
            value = np.minimum(value.astype(np.int64) + 1, self.cap)
            value[edge[self.last[c] < 0]] = 0  # nothing is before it in its bucket
            within = np.arange(len(s)) - np.repeat(edge, count)
            place = self.head[s] + within
            self.data[place], self.prefix[place] = suffixes[order], value
            self.head[c] += count
            ends = at[edge + count - 1]
            after = np.concatenate([np.minimum.accumulate(prefixes[::-1])[::-1], [self.cap]])
            self.last[c], self.since[c] = now, after[ends + 1]
        self.batches.append(int(prefixes.min()) if len(prefixes) else self.cap)


def induce(store: Store, text: np.ndarray, symbols: int, kind, seeds: np.ndarray, prefixes: np.ndarray, cap: int) -> Queue:
    """Push the suffix before every popped one if it is of the given kind; all seeds are there from the start.

    Buckets are popped in order of their symbols. Neighbouring buckets go together while none of their pushes
    lands among them; a bucket whose pushes land in itself is read on until it is empty.
    """
    q = Queue(store, text, symbols, seeds, prefixes, cap)

    def seams(lo: int, hi: int) -> None:
        """Where pushes and seeds of a bucket meet, they are compared."""
        c = np.arange(lo, hi)
        c = c[(q.head[c] > q.start[c]) & (q.seeds_from[c] < q.start[c + 1])]
        if len(c):
            a, b = q.data[q.head[c] - 1].astype(np.int64), q.data[q.seeds_from[c]].astype(np.int64)
            q.prefix[q.seeds_from[c]] = common(text, a, b, np.full(len(c), cap))

    def before(popped: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(popped > 0)
        p = popped[at] - 1
        fits = kind(p)
        return at[fits], p[fits], text[p[fits]]

    def read(lo: int, hi: int) -> None:
        popped = np.asarray(q.data[lo:hi])
        at, p, s = before(popped)
        q.pushed(np.asarray(q.prefix[lo:hi]), at, p, s)

    c, step = 0, 1
    while c < symbols:
        end = min(symbols, c + step)
        lo, hi = q.start[c], q.start[end]
        if hi - lo > BLOCK and end > c + 1:
            step = max(1, step // 2)
            continue
        if end > c + 1:
            got = np.asarray(q.data[lo:hi])
            filled = np.flatnonzero(got >= 0)
            at, p, s = before(got[filled])
            inside = s[s < end]
            if not len(inside):
                seams(c, end)
                q.pushed(np.asarray(q.prefix[lo:hi])[filled], at, p, s)
                c, step = end, min(step * 2, 1 << 16)
                continue
            cut = int(inside.min())
            if cut > c + 1:
                step = cut - c
                continue
        at = lo  # one bucket: what it pushes to itself is read after what is there, and seeds come last
        while at < q.head[c]:
            upto = min(q.head[c], at + BLOCK)
            read(at, upto)
            at = upto
        seams(c, c + 1)
        for at in range(q.seeds_from[c], q.start[c + 1], BLOCK):
            read(at, min(at + BLOCK, q.start[c + 1]))
        c, step = c + 1, 2
    return q


def kinds(store: Store, text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that follows, from the end on, block by block."""
    n = len(text)
    smaller = store.array(n, np.bool_)
    smaller[n - 1] = carry = True
    for hi in range(n - 1, 0, -BLOCK):
        lo = max(0, hi - BLOCK)
        x = np.asarray(text[lo : hi + 1]).astype(np.int64)
        rise = np.sign(np.diff(x))
        at = np.where(rise != 0, np.arange(hi - lo), hi - lo)
        at = np.minimum.accumulate(at[::-1])[::-1]  # the next place where symbols differ, or the block's end
        smaller[lo:hi] = np.where(at < hi - lo, np.append(rise, 0)[at] > 0, carry)
        carry = bool(smaller[lo])
    return smaller


def starts(store: Store, smaller: np.ndarray) -> np.ndarray:
    """The S*-suffixes, in the order of the text."""
    parts = [np.flatnonzero(np.asarray(smaller[at + 1 : at + BLOCK + 1]) & ~np.asarray(smaller[at : at + BLOCK])[: len(smaller) - at - 1]) + at + 1 for at in range(0, len(smaller) - 1, BLOCK)]
    star = store.array(sum(map(len, parts)), np.int32)
    at = 0
    for p in parts:
        star[at : at + len(p)] = p
        at += len(p)
    return star


def substring_names(store: Store, text: np.ndarray, symbols: int, smaller: np.ndarray, star: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the substrings from each S*-suffix to the next, in the order of the induction: equal ones share one.

    A symbol counts with its kind, by which a substring that ends differs from one that goes on. As many symbols
    as fit a machine word are compared a round, in runs; later rounds concern the few substrings that are longer.
    """
    m, bits = len(star), (2 * symbols + 1).bit_length()
    per = 63 // bits
    rank, distinct = store.array(m, np.int32, 0), 1
    r, going = 0, True
    while going:
        # a key a round: the symbols of this round, then the rank so far, as both decide
        runs, going = Runs(store), False
        for lo in range(0, m, BLOCK):
            own = np.asarray(star[lo : lo + BLOCK]).astype(np.int64)
            then = np.asarray(star[lo + 1 : lo + BLOCK + 1]).astype(np.int64)
            length = np.append(then, len(text) - 1)[: len(own)] - own + 1
            going |= bool((length > r + per).any())
            key = np.zeros(len(own), np.int64)
            alive = np.flatnonzero(length > r)
            for j in range(r, r + per):
                p = np.minimum(own[alive] + j, len(text) - 1)
                key[alive] = (key[alive] << bits) | np.where(j < length[alive], text[p].astype(np.int64) * 2 + smaller[p] + 1, 0)
            runs.push(key, np.arange(lo, lo + len(own), dtype=np.int32))
        if r == 0:
            distinct = _number(runs, rank)
        else:
            part = store.array(m, np.int32, 0)
            finer = _number(runs, part)
            runs = Runs(store)
            for lo in range(0, m, BLOCK):
                runs.push(np.asarray(rank[lo : lo + BLOCK]).astype(np.int64) * finer + part[lo : lo + BLOCK], np.arange(lo, min(m, lo + BLOCK), dtype=np.int32))
            distinct = _number(runs, rank)
        r += per
    return rank, distinct


def _number(runs: Runs, out: np.ndarray) -> int:
    """Dense ranks of the keys at the places their values name; how many there are."""
    n = 0
    for keys, places in runs.pop():
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        number = np.cumsum(new)
        out[places] = n + number - 1
        n += int(number[-1])
    return n


def ranked(store: Store, text: np.ndarray, symbols: int, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """suffix_order for few symbols: ranks of one symbol, then of twice as many a round, through sorted runs."""
    n = len(text)
    rank, d = text, 1  # below `symbols`
    while d < cap and (d == 1 or symbols < n):
        pairs = Runs(store)
        for lo in range(0, n, BLOCK):
            # what ends before the second half is told apart by the end, which occurs once
            then = np.minimum(np.arange(lo + d, min(n, lo + BLOCK) + d), n - 1)
            pairs.push(np.asarray(rank[lo : lo + BLOCK]).astype(np.int64) * symbols + rank[then], np.arange(lo, min(n, lo + BLOCK), dtype=np.int32))
        rank, d = store.array(n, np.int32, 0), 2 * d
        symbols = _number(pairs, rank)
    last, order, equal = Runs(store), store.array(n, np.int32), store.array(n, np.uint8, 0)
    for lo in range(0, n, BLOCK):
        last.push(np.asarray(rank[lo : lo + BLOCK]), np.arange(lo, min(n, lo + BLOCK), dtype=np.int32))
    at = 0
    for _, places in last.pop():
        order[at : at + len(places)] = places
        at += len(places)
    for lo in range(1, n, BLOCK):
        a, b = np.asarray(order[lo : lo + BLOCK]).astype(np.int64), np.asarray(order[lo - 1 : min(n, lo + BLOCK) - 1]).astype(np.int64)
        equal[lo : lo + BLOCK] = common(text, a, b, np.full(len(a), cap))
    return order, equal


def suffix_order(text: np.ndarray, symbols: int, cap: int = 255, store: Store | None = None, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all suffixes in order, and the common prefix of each with the one before it, up to `cap`.

    The last symbol must be 0 and occur there only. Unless the `whole` suffixes are to be in order, those that share
    `cap` symbols stand together in any order, and the recursion ends where FEW symbols decide.
    """
    store = store or Store()
    n = len(text)
    if n <= 2:
        return np.arange(n - 1, -1, -1, dtype=np.int32), np.zeros(n, np.uint8)
    if not whole and cap <= FEW:
        return ranked(store, text, symbols, cap)
    smaller = kinds(store, text)
    star = starts(store, smaller)
    m = len(star)
    if m > 1:
        names, distinct = substring_names(store, text, symbols, smaller, star)
        if distinct < m:
            # a name stands for two symbols or more, so half as many names decide
            order, equal = suffix_order(names, distinct, cap if whole else (cap + 1) // 2, store, whole)
        else:
            order, equal = store.array(m, np.int32), store.array(m, np.uint8, 0)
            for at in range(0, m, BLOCK):
                order[names[at : at + BLOCK]] = np.arange(at, min(m, at + BLOCK), dtype=np.int32)
        seeds, prefixes = store.array(m, np.int32), store.array(m, np.uint8, 0)
        for at in range(0, m, BLOCK):
            i = np.asarray(order[at : at + BLOCK]).astype(np.int64)
            seeds[at : at + BLOCK] = star[i]
            j = np.asarray(order[max(0, at - 1) : at + BLOCK - 1]).astype(np.int64)  # the one before each
            i, h = (i, np.asarray(equal[at : at + BLOCK]).astype(np.int64)) if at else (i[1:], np.asarray(equal[1 : at + BLOCK]).astype(np.int64))
            j = j[: len(i)]
            # h names are alike and cover as much text; the next one is compared
            a, b = star[np.minimum(i + h, m - 1)].astype(np.int64), star[np.minimum(j + h, m - 1)].astype(np.int64)
            alike = a - star[i]
            prefixes[at + (at == 0) : at + BLOCK] = np.minimum(alike + common(text, a, b, np.maximum(0, cap - alike)), cap)
    else:
        seeds, prefixes = star, np.zeros(m, np.uint8)
    return _both(store, text, symbols, smaller, seeds, prefixes, cap)


def _both(store: Store, text: np.ndarray, symbols: int, smaller: np.ndarray, seeds: np.ndarray, prefixes: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Larger suffixes induced from S*-suffixes, then the smaller ones from these, in mirrored order."""
    n = len(text)
    q = induce(store, text, symbols, lambda p: ~smaller[p], seeds, prefixes, cap)
    sizes = []
    for at in range(0, n, BLOCK):
        got = np.asarray(q.data[at : at + BLOCK])
        sizes.append(int(((got >= 0) & ~smaller[np.maximum(got, 0)]).sum()))
    total = sum(sizes)
    larger, alike = store.array(total, np.int32), store.array(total + 1, np.uint8, 0)
    end = total
    for at, k in zip(range(0, n, BLOCK), sizes, strict=True):  # from the last to the first
        got = np.asarray(q.data[at : at + BLOCK])
        own = (got >= 0) & ~smaller[np.maximum(got, 0)]
        larger[end - k : end] = got[own][::-1]
        alike[end - k + 1 : end + 1] = np.asarray(q.prefix[at : at + BLOCK])[own][::-1]
        end -= k
    mirrored = store.array(n, text.dtype)
    for at in range(0, n, BLOCK):
        mirrored[at : at + BLOCK] = symbols - 1 - text[at : at + BLOCK]
    back = induce(store, mirrored, symbols, lambda p: smaller[p], larger, alike[:-1] if total else alike[:0], cap)
    back.data[n - 1] = n - 1  # the end has nothing after it to push it
    back.prefix[n - 1] = 0
    return back.data[::-1], np.concatenate([[0], back.prefix[1:][::-1]]).astype(np.uint8) if n <= store.memory else _shifted(store, back.prefix)


def _shifted(store: Store, prefix: np.ndarray) -> np.ndarray:
    """Common prefixes from the other end: each entry's is now that of the entry after it."""
    n = len(prefix)
    out = store.array(n, np.uint8, 0)
    for at in range(1, n, BLOCK):
        hi = min(n, at + BLOCK)
        out[at:hi] = prefix[n - hi + 1 : n - at + 1][::-1]
    return out
