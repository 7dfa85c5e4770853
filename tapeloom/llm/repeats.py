"""Removal of byte strings of a given length that occur more than once, by suffix sorting of what may repeat.

1. Anchors. In every window of `span` bytes the smallest hash of its k-byte strings is picked (the leftmost of
   equal ones); equal windows pick equal strings at equal offsets. A maximal run of window starts that share an
   anchor is a segment. A window can only repeat if its anchor's hash occurs twice, which a count of hashes
   tells; all other segments are done with.
2. Classes. Segments that are equal throughout (anchor, length, anchor's offset and a cryptographic hash of their
   bytes) form a class; one of two members or more repeats in full. Groups of copies of any size end here, as counts.
3. Induced sorting. Where different classes share an anchor, one segment of each class is cut into parts of
   PART window starts. All windows of a part hold its core, whose name (a cryptographic hash) stands for it, so a part
   is a few dozen symbols. The parts of a range of cores make up a shard, whose suffixes are sorted by external induced
   sorting (see induced_sort), which gives neighbours' common prefixes too: those of a window's length or more mark
   repeated windows.
4. The union of all repeated windows is cut out of each document.

Anchors and classes with very many segments are split over tasks by a salt.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import cut, folder, shuffle_partitions, small, table, text_batches, whole_groups
from tapeloom.llm.induced_sort import Store, suffix_order
from tapeloom.llm.shingles import _WEIGHT, mix, powers

SPAN, K = 200, 64
PART = 16  # windows in a part
SLICE = 60_000  # bytes hashed at once, few enough for a core's cache; positions within them take PLACE bits
PLACE = 18
MANY = 10_000  # segments handed on at once
ID_LIMIT = 500_000
HOT, HOT_KEYS, SALTS = 20_000, 100_000, 64  # segments of a hot key, hot keys at most, tasks that share one
QUEUE_MEMORY = 1 << 22  # entries of a shard above which its queues lie in files


def segments(data: np.ndarray, edges: np.ndarray, span: int, k: int) -> tuple[np.ndarray, ...]:
    """Segments of the texts data[edges[i]:edges[i + 1]]: text, first start, starts, anchor offset, anchor hash."""
    n, wide = len(data), span - k + 1
    none = np.zeros(0, np.int64)
    if n < span:
        return none, none, none, none, none
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_WEIGHT.take(data) * up[:n], out=sums[1:])
    grams = sums[k:] - sums[:-k]
    grams *= down[: n - k + 1]
    mix(grams)
    low = np.uint64((1 << PLACE) - 1)
    m = grams & ~low
    m |= np.arange(len(grams), dtype=np.uint64)
    w = 1
    while 2 * w <= wide:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    if w < wide:
        m = np.minimum(m[: w - wide], m[wide - w :])
    # a segment begins where the anchor's place changes or a text begins, and ends before the next and in its text
    lo = np.union1d(np.flatnonzero(m[1:] != m[:-1]) + 1, edges[:-1])
    lo = lo[lo < len(m)]
    text = np.searchsorted(edges, lo, side="right") - 1
    hi = np.minimum(np.append(lo[1:], len(m)), edges[text + 1] - span + 1)
    real = hi > lo
    text, lo, hi = text[real], lo[real], hi[real]
    anchor = (m[lo] & low).astype(np.int64)
    return text, lo, hi - lo, anchor - lo, grams[anchor].view(np.int64)


def names(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: int = 8) -> np.ndarray:
    """Cryptographic hashes of byte ranges, as rows of 64-bit numbers."""
    view, blake = memoryview(np.ascontiguousarray(data)), hashlib.blake2b
    return np.frombuffer(b"".join([blake(view[a:b], digest_size=size).digest() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]), np.int64).reshape(-1, size // 8)


def runs(column: pa.Array, span: int):
    """(first row, byte offset of the slice in its text, data, edges) over the texts of a binary column."""
    part: list[np.ndarray] = []
    size, first = 0, 0
    for row in range(len(column)):
        data = np.frombuffer(column[row].as_buffer() or b"", np.uint8)
        if part and size + len(data) > SLICE:
            yield first, 0, np.concatenate(part), np.cumsum([0, *map(len, part)])
            part, size, first = [], 0, row
        if len(data) > SLICE:
            for at in range(0, len(data) - span + 1, SLICE - span + 1):
                piece = data[at : at + SLICE]
                yield row, at, piece, np.array([0, len(piece)])
            first = row + 1
            continue
        part.append(data)
        size += len(data)
    if part:
        yield first, 0, np.concatenate(part), np.cumsum([0, *map(len, part)])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, id and key (which tell rows apart unless they agree in both id and text), data."""
    data = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    return docs.select(F.col(id_col).alias("doc_id"), data.alias("data")).select("doc_id", F.coalesce(F.xxhash64("doc_id"), F.lit(0)).alias("id"), F.xxhash64("doc_id", "data").alias("key"), "data")


def anchor_counts(rows: DataFrame, span: int, k: int) -> DataFrame:
    """How many segments each anchor hash has: h, c. Each batch of texts adds up first."""
    def run(batches):
        for batch in batches:
            found = [segments(data, edges, span, k)[4] for _, _, data, edges in runs(batch.column(0), span)]
            if found:
                h, c = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c)], ["h", "c"])

    return rows.select("data").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def all_segments(rows: DataFrame, span: int, k: int) -> DataFrame:
    """Segments with the digest of their bytes: h, digest, n (starts), off (of the anchor), id, key, lo (first start)."""
    def rows_of(part) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*part, strict=True)], ["h", "digest", "n", "off", "id", "key", "lo"])

    def run(batches):
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            part, size = [], 0
            for first, at, data, edges in runs(batch.column(2), span):
                text, lo, count, off, h = segments(data, edges, span, k)
                row, digest = first + text, names(data, lo, lo + count - 1 + span)[:, 0]
                part.append((h, digest, count.astype(np.int32), off.astype(np.int32), ids[row], keys[row], lo - edges[text] + at))
                size += len(h)
                if size >= MANY:
                    yield rows_of(part)
                    part, size = [], 0
            if part:
                yield rows_of(part)

    return rows.select("id", "key", "data").mapInArrow(run, "h long, digest long, n int, off int, id long, key long, lo long")


def spread_join(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame, salt: list[str]) -> DataFrame:
    """Join with a frame of unique keys; rows of `hot` keys, of which there are at most HOT_KEYS, are split by a salt."""
    mark = F.broadcast(hot.select(*on, F.lit(True).alias("_hot")))
    left = left.join(mark, on, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*salt), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = right.join(mark, on, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return left.join(right, [*on, "_salt"]).drop("_salt")


def solve(core: np.ndarray, sides: np.ndarray, first: np.ndarray, count: np.ndarray, queue: str | None = None) -> np.ndarray:
    """Which windows of PART-window parts some other part repeats, as booleans of shape (parts, PART).

    A part is the text around a core, which all its windows hold: PART - 1 bytes on each side. The core becomes
    one symbol, so that a window is PART symbols; parts laid end to end are the text to sort. Its suffixes come in
    blocks with their common prefixes; of those that start a window, two in a row whose prefix is a window's repeat.
    """
    m, row = len(core), 2 * PART
    with Store(queue, None if queue is None else QUEUE_MEMORY) as store:
        if queue is None:
            store.memory = m * row + 1
        text = store.array(m * row + 1, np.int32, 0)
        grid = text[:-1].reshape(m, row)
        grid[:, : PART - 1] = sides[:, : PART - 1].astype(np.int32) + 2
        grid[:, PART - 1] = core + 258
        grid[:, PART:-1] = sides[:, PART - 1 :].astype(np.int32) + 2
        grid[:, -1] = 1  # parts the rows; 0 ends the text
        order, prefix = suffix_order(text, int(core.max()) + 259, PART, store, whole=False)
        repeated = np.zeros((m, PART), bool)
        last, least = -1, PART  # the window before, and the least common prefix since
        for at in range(0, len(order), 1 << 20):
            o, c = np.asarray(order[at : at + (1 << 20)]).astype(np.int64), np.asarray(prefix[at : at + (1 << 20)])
            r, j = np.divmod(o, row)
            own = np.minimum(r, m - 1)
            here = np.flatnonzero((r < m) & (j < PART) & (j >= first[own]) & (j < (first + count)[own]))
            # two windows are alike if all prefixes from the one to the other are a window's length
            short = np.cumsum(c < PART)
            if len(here):
                alike = np.concatenate([[last >= 0 and least >= PART and short[here[0]] == 0], short[here[1:]] == short[here[:-1]]])
                before = np.concatenate([[max(last, 0)], o[here[:-1]]])
                for x in (o[here][alike], before[alike]):
                    repeated[x // row, x % row] = True
                last, least = int(o[here[-1]]), PART if short[-1] == short[here[-1]] else 0
            elif short[-1]:
                least = 0
        return repeated


def sort_shards(parts: DataFrame, shard: int, queue: str | None) -> DataFrame:
    """Intervals (id, key, lo, n: starts) of repeated windows; the rows come sorted by core.

    Whole core groups make up a text of about `shard` parts. Equal parts are one: they repeat each other. Queues of
    large shards lie in files below `queue`.
    """
    def part(rows: pd.DataFrame) -> pd.DataFrame:
        group = rows.groupby(["core1", "core2"], sort=False).ngroup().to_numpy()
        alike = rows.groupby(["core1", "core2", "sides", "first", "count"], sort=False)
        copies, one = alike["id"].transform("size").to_numpy() > 1, ~rows.duplicated(["core1", "core2", "sides", "first", "count"]).to_numpy()
        kinds = np.bincount(group[one], minlength=group.max() + 1)
        need = one & (kinds[group] > 1)
        first, count = rows["first"].to_numpy(), rows["count"].to_numpy()
        at = np.arange(PART)
        hits = np.zeros((len(rows), PART), bool)
        if need.any():
            _, core = np.unique(group[need], return_inverse=True)
            hits[need] = solve(core, np.frombuffer(b"".join(rows["sides"][need]), np.uint8).reshape(-1, 2 * (PART - 1)), first[need], count[need], queue)
        hits[copies] = (at >= first[copies, None]) & (at < (first + count)[copies, None])
        hits[~rows["single"].to_numpy()] = False
        edge = np.diff(np.pad(hits, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (r, lo), (_, hi) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        return pd.DataFrame({"id": rows["id"].to_numpy()[r], "key": rows["key"].to_numpy()[r], "lo": rows["lo"].to_numpy()[r] + lo - first[r], "n": hi - lo})

    def run(batches):
        rest, size = [], 0
        for pdf in whole_groups(batches, ["core1", "core2"]):
            rest.append(pdf)
            size += len(pdf)
            if size >= shard:
                yield part(pd.concat(rest, ignore_index=True))
                rest, size = [], 0
        if size:
            yield part(pd.concat(rest, ignore_index=True))

    return parts.mapInPandas(run, "id long, key long, lo long, n long")


def texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of documents joined with `wanted` (one row an id and key); a checked number of ids goes first as a filter."""
    ids = wanted.select("key").distinct()
    return rows.join(small(ids, ids.count(), ID_LIMIT), "key", "left_semi").join(wanted, ["id", "key"])


def cut_parts(rows: DataFrame, pieces: DataFrame, span: int) -> DataFrame:
    """Parts of open segments: core1, core2 (a hash of the bytes that all windows of the part hold), sides (the
    bytes before and after the core), first and count (windows of the part that the segment has), id, key, lo
    (the first of these in the text), single. Parts are cut by distance from the anchor, so that equal windows
    lie in parts of equal cores. A document's list of pieces is at most as long as it."""
    lists = cut(pieces.groupBy("id", "key").agg(F.collect_list(F.struct("lo", "n", "off", "single")).alias("pieces")), "pieces")
    inner = span - PART + 1

    def of(data: bytes, lo, n, off, single) -> tuple:
        a, steps = lo + off, (off // PART) - ((off - n + 1) // PART) + 1
        seg = np.repeat(np.arange(len(lo)), steps)
        q = (off // PART)[seg] - (np.arange(len(seg)) - np.repeat(np.cumsum(steps) - steps, steps))
        start = a[seg] - PART * q  # of the core
        near, far = np.maximum(PART * q, (off - n + 1)[seg]), np.minimum(PART * q + PART - 1, off[seg])
        x = np.frombuffer(data, np.uint8)
        cores = names(x, start, start + inner, 16).T
        padded = np.pad(x, PART)
        sides = np.concatenate([padded[(start + PART)[:, None] + np.arange(1 - PART, 0)], padded[(start + PART + inner)[:, None] + np.arange(PART - 1)]], axis=1)
        return *cores, sides, PART * q + PART - 1 - far, far - near + 1, a[seg] - far, single[seg]

    def run(batches):
        for batch in batches:
            p = batch.column(3)
            ends = p.offsets.to_numpy()
            flat = {c: p.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("lo", "n", "off", "single")}
            ends = ends - ends[0]
            for at in range(0, batch.num_rows, 256):  # a bounded number of documents at once
                out = []
                for i in range(at, min(at + 256, batch.num_rows)):
                    s = slice(ends[i], ends[i + 1])
                    got = of(batch.column(2)[i].as_buffer(), flat["lo"][s], flat["n"][s].astype(np.int64), flat["off"][s].astype(np.int64), flat["single"][s])
                    out.append((*got, np.full(len(got[0]), batch.column(0)[i].as_py()), np.full(len(got[0]), batch.column(1)[i].as_py())))
                core1, core2, sides, first, count, lo, single, ids, keys = (np.concatenate(c) for c in zip(*out, strict=True))
                flat_sides = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * PART - 2), len(sides), [None, pa.py_buffer(np.ascontiguousarray(sides))]).cast(pa.binary())
                columns = [pa.array(core1), pa.array(core2), flat_sides, pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(lo), pa.array(single), pa.array(ids), pa.array(keys)]
                yield pa.RecordBatch.from_arrays(columns, ["core1", "core2", "sides", "first", "count", "lo", "single", "id", "key"])

    texts = texts_of(rows.select("id", "key", "data"), lists)
    return texts.select("id", "key", "data", "pieces").mapInArrow(run, "core1 long, core2 long, sides binary, first int, count int, lo long, single boolean, id long, key long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, k: int = K, shard: int = 200_000, most: int = 50_000) -> DataFrame:
    """Cut every byte out of each text that lies in a string of `span` bytes which also starts anywhere else.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of the bytes left, kept
    (those bytes), one row per row of `docs`. Null text counts as empty; texts below `span` bytes keep all.
    Matches lie within one text. Rows that repeat both id and text are two places for each of their strings,
    so all of their bytes go where they are long enough. A null id is an id like others. An empty table gives an
    empty result; texts of any length are read as a whole; other columns aren't read.

    Core groups of more than `most` parts aren't sorted in one task: their windows are dealt out and counted.
    """
    if not k < span - PART:
        raise ValueError(f"anchors of {k} bytes need windows of more than {k + PART} bytes")
    spark = docs.sparkSession
    text_batches(spark)
    rows = keyed(docs, id_col, text_col)
    twice = cut(anchor_counts(rows, span, k).filter("c > 1"), "anchors")
    hot_from = max(HOT, (twice.agg(F.sum("c")).first()[0] or 0) // HOT_KEYS)
    hot = twice.filter(F.col("c") > hot_from).select("h")
    found = cut(spread_join(all_segments(rows, span, k), twice.select("h"), ["h"], hot, ["id", "lo"]), "segments")
    same = ["h", "digest", "n", "off"]
    # any member stands for its class; the three come from one row, and columns of their own need no sort
    classes = cut(found.groupBy(*same).agg(F.count("*").alias("c"), *[F.first(x).alias(x) for x in ("id", "key", "lo")]), "classes")
    again = classes.filter("c > 1")
    whole = spread_join(found, again.select(*same), same, again.filter(F.col("c") > hot_from), ["id", "lo"]).select("id", "key", "lo", "n")
    open_ = classes.groupBy("h").agg(F.count("*").alias("k"), F.count_if(F.col("c") == 1).alias("s")).filter("k > 1 and s > 0")
    pieces = cut(spread_join(classes, open_.select("h"), ["h"], hot, ["digest"]).select("id", "key", "lo", "n", "off", (F.col("c") == 1).alias("single")), "open")
    parts = cut(cut_parts(rows, pieces, span), "parts")
    # a core that one part has can't repeat
    groups = parts.groupBy("core1", "core2").agg(F.count("*").alias("k"), F.count_if("single").alias("s")).filter("k > 1 and s > 0").select("core1", "core2", (F.col("k") > most).alias("wide"))
    parts = parts.join(groups, ["core1", "core2"])
    dealt = parts.filter("not wide").repartition(shuffle_partitions(spark), "core1", "core2").sortWithinPartitions("core1", "core2")
    # a folder that is mounted at the same place everywhere can hold queues; beside one that isn't, shards fit memory
    queue = folder(spark, "queues").removeprefix("file:")
    starts = whole.unionByName(sort_shards(dealt, shard, queue if queue.startswith("/") else None)).unionByName(count_windows(parts.filter("wide")))
    parts = starts.select("id", "key", "lo", (F.col("lo") + F.col("n") - 1 + span).alias("hi"))
    lists = cut(parts.groupBy("id", "key").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans")), "spans")

    def run(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                data, spans = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                kept, at, n = [], 0, 0
                end = -1
                for s in spans:
                    n += s["lo"] > end
                    if s["lo"] > at:
                        kept.append(data[at : s["lo"]])
                    at = end = max(at, s["hi"])
                kept.append(data[at:])
                left = b"".join(kept)
                out.append((len(data), len(data) - len(left), n, hashlib.sha256(left).hexdigest(), left))
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    changed = texts_of(rows, lists).select("doc_id", "data", "spans").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    ids = lists.select("id", "key")
    zero = F.lit(0).cast("long")
    clean = rows.select("doc_id", "id", "key", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("kept_sha256")).join(ids, ["id", "key"], "left_anti")
    return changed.unionByName(clean.select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), "kept_sha256", F.lit(None).cast("binary").alias("kept")))


def count_windows(parts: DataFrame) -> DataFrame:
    """Intervals of repeated windows by counts, for core groups of any size: a window is its core and PART - 1
    bytes of the sides, from its place on."""
    each = parts.withColumn("j", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)))
    window = ["core1", "core2", "j", F.expr(f"substring(sides, j + 1, {PART - 1})").alias("w")]
    twice = each.select(*window).groupBy("core1", "core2", "j", "w").agg(F.count("*").alias("c")).filter("c > 1").drop("c")
    hits = each.filter("single").select(*window, "id", "key", (F.col("lo") + F.col("j") - F.col("first")).alias("lo")).join(twice, ["core1", "core2", "j", "w"], "left_semi")
    return hits.select("id", "key", "lo", F.lit(1).cast("long").alias("n"))


def op9(spark, sf_dir):
    """All documents without the bytes of strings of 200 bytes that occur twice."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


OP9_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT r, unnest(generate_series(1, octet_length(b) - 199)) AS i, b FROM d WHERE octet_length(b) >= 200),
w AS (SELECT r, i, md5(array_slice(b, i, i + 199)) AS h FROM p),
x AS (SELECT r, i, count(*) OVER (PARTITION BY h) AS k FROM w),
s AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) > 200 AS gap FROM x WHERE k > 1),
g AS (SELECT r, i, count(*) FILTER (gap) OVER (PARTITION BY r ORDER BY i) AS n FROM s),
m AS (SELECT r, n, min(i) AS lo, max(i) + 199 AS hi FROM g GROUP BY r, n),
q AS (SELECT r, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his FROM m GROUP BY r),
k AS (SELECT d.doc_id, octet_length(b) AS n_bytes, coalesce(len(los), 0) AS n_spans, coalesce(list_sum(list_transform(generate_series(1, len(los)), lambda j: his[j] - los[j] + 1)), 0) AS n_removed,
 CASE WHEN los IS NULL THEN b ELSE list_reduce(list_transform(generate_series(0, len(los)), lambda j: array_slice(b, CASE WHEN j = 0 THEN 1 ELSE his[j] + 1 END, CASE WHEN j = len(los) THEN octet_length(b) ELSE los[j + 1] - 1 END)), lambda u, v: u || v) END AS kept
 FROM d LEFT JOIN q USING (r))
SELECT doc_id, n_bytes::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(kept) AS kept_sha256 FROM k
"""
