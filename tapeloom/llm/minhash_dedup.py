"""Near-duplicate documents by MinHash bands, sequential Bayesian pruning and exact verification.

1. One pass over the texts gives each document its set of shingles (a count of it), a MinHash signature, one key a
   band, and a cryptographic digest of its words. Documents with equal words are one node from here on.
2. Nodes that share a band key are candidates. Not all pairs of a bucket are made: each member is compared
   with the pivots of its bucket first. Members that are then still in different components are compared
   with each other, so that no link that could join two components is left out: as pairs in buckets of at
   most BIG nodes; in larger ones the nodes outside the main component are a query set against all nodes, in
   blocks that return one link for each component that a query joins.
3. A pair's signatures are compared batch by batch, as pairs and in blocks alike. With m of n values equal and a
   uniform prior, the chance that the similarity reaches the threshold is P(Binomial(n + 1, threshold) <= m); the
   pair is dropped as soon as that falls below the chosen miss probability.
4. Survivors are confirmed on the full sets of their whole texts, word for word and in integers.
5. Connected components of the confirmed links.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import cut, drop_caches, named_apart, shuffle_partitions, small, table, text_batches, whole_groups
from tapeloom.llm.components import components
from tapeloom.llm.shingles import exact_sets, mix, shingle_sets

BANDS, ROWS = 28, 5  # a pair at 0.8 shares no band with probability (1 - 0.8**5)**28 = 1.5e-5
BATCH = 20
MISS = 1e-6
PIVOTS = 4
BIG = 16
QUERIES, MEMBERS = 256, 512  # nodes in a block
GROUP = 64  # pairs of one node whose texts go to one task together
AT_ONCE = 1 << 19  # characters whose sets are held word for word
ID_LIMIT = 500_000
_HASHES = BANDS * ROWS
_FACTORS = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, (2, _HASHES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(s: np.ndarray) -> np.ndarray:
    """The MinHash values of a set of hashes, 32 bits each."""
    out = np.full(_HASHES, np.iinfo(np.uint64).max, np.uint64)
    a, b = _FACTORS[0][:, None], _FACTORS[1][:, None]
    for i in range(0, len(s), 1024):
        x = a * s[None, i : i + 1024]
        x += b
        np.minimum(out, x.min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in sig.reshape(BANDS, ROWS).T.astype(np.uint64):
        keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + column)
    return keys.view(np.int64)


def describe(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, digest, sig (16 bits a value), bands: one row a document of (doc_id, text)."""
    def run(batches):
        drop_caches()
        for pdf in batches:
            n, digest, sigs, bands = [], [], [], []
            for t, s in zip(pdf["text"], shingle_sets(pdf["text"], width), strict=True):
                n.append(len(s))
                words = b" ".join((t or "").encode("utf-8", "surrogatepass").lower().split())
                digest.append(hashlib.blake2b(words, digest_size=32).digest() if words else None)
                sig = signature(s) if len(s) else None
                sigs.append(None if sig is None else sig.astype(np.uint16).tobytes())
                bands.append(None if sig is None else band_keys(sig))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_shingles": n, "digest": digest, "sig": sigs, "bands": bands})

    return docs.mapInPandas(run, "doc_id long, n_shingles long, digest binary, sig binary, bands array<long>")


def needed(threshold: float, miss: float) -> list[tuple[int, int]]:
    """(n, least m) after each batch: fewer than m equal values of n prune the pair."""
    out = []
    for n in range(BATCH, _HASHES + 1, BATCH):
        total, m = 0.0, -1
        while m < n:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
        out.append((n, m))
    return out


def prune(pairs: DataFrame, nodes: DataFrame, threshold: float, miss: float) -> DataFrame:
    """The pairs (a, b) that sequential comparison of signatures doesn't rule out."""
    steps = needed(threshold, miss)

    @F.pandas_udf("boolean")
    def likely(x: pd.Series, y: pd.Series) -> pd.Series:
        one, two = (np.frombuffer(b"".join(c), np.uint16).reshape(len(c), _HASHES) for c in (x, y))
        alive, hits, done = np.arange(len(x)), np.zeros(len(x), np.int64), 0
        for n, least in steps:
            hits[alive] += (one[alive, done:n] == two[alive, done:n]).sum(axis=1)
            alive, done = alive[hits[alive] >= least], n
        keep = np.zeros(len(x), bool)
        keep[alive] = True
        return pd.Series(keep)

    sig = nodes.select("node", "sig")
    both = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
    return both.filter(likely("sa", "sb")).select("a", "b")


def confirm(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets satisfy 100 * intersection >= percent * union, compared word for word.

    Pairs of one `a` go together in groups of about GROUP, however many it has, so a text of `a` travels and becomes
    a set once a group.
    """
    pairs = cut(pairs, "survivors")
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    ids = cut(ids, "ids")
    texts = cut(docs.join(small(ids, ids.count(), ID_LIMIT), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    others = pairs.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("g"), F.col("b").alias("node"))
    hubs = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), F.col("a").alias("node"))
    key = ["a", "g"]
    placed = others.unionByName(hubs).join(texts.withColumnRenamed("doc_id", "node"), "node")

    def run(batches):
        for pdf in whole_groups(batches, key):
            first = np.flatnonzero((pdf[key] != pdf[key].shift()).any(axis=1).to_numpy()).tolist()
            a, node, text = pdf["a"].to_numpy(), pdf["node"].to_numpy(), pdf["text"].tolist()
            out: list[tuple[int, int]] = []
            for start, end in zip(first, [*first[1:], len(pdf)], strict=True):
                hub = next((i for i in range(start, end) if node[i] == a[i]), None)
                others = [i for i in range(start, end) if i != hub] if hub is not None else []
                while others:  # the sets of about AT_ONCE characters are held at once
                    size, n = 0, 0
                    while n < len(others) and (size < AT_ONCE or not n):
                        size += len(text[others[n]] or "")
                        n += 1
                    part, others = others[:n], others[n:]
                    x, *sets = exact_sets([text[i] for i in (hub, *part)], width)
                    for i, y in zip(part, sets, strict=True):
                        both = len(x) + len(y) - len(np.union1d(x, y))
                        if 100 * both >= percent * (len(x) + len(y) - both):
                            out.append((a[i], node[i]))
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    dealt = placed.repartition(shuffle_partitions(docs.sparkSession), *key).sortWithinPartitions(*key)
    return dealt.select("a", "g", "node", "text").mapInPandas(run, "a long, b long")


def _pair(x, y):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _main(labelled: DataFrame, key: str) -> DataFrame:
    """Of each key with several labels the most frequent one, with the nodes inside and outside it: key, main, all, out."""
    parts = labelled.groupBy(key, "label").agg(F.count("*").alias("m"))
    g = parts.groupBy(key).agg(F.max(F.struct("m", F.col("label").alias("main"))).alias("x"), F.sum("m").alias("all"), F.count("*").alias("k")).filter("k > 1")
    return g.select(key, F.col("x.main").alias("main"), "all", (F.col("all") - F.col("x.m")).alias("out"))


def block_links(wide: DataFrame, found: DataFrame, sigs: DataFrame, docs: DataFrame, width: int, threshold: float, miss: float) -> DataFrame:
    """Links (a, b) that join components of nodes in large buckets; `wide` has node and pivot, one row a bucket.

    Buckets that share nodes form a region. Its nodes outside its main component, in blocks of QUERIES, meet
    all its nodes, in blocks of MEMBERS: signatures first, batch by batch, then the full sets of what is left. For
    each query and component one link suffices.
    """
    regions = components(wide.select(F.col("node").alias("u"), F.col("pivot").alias("v"))).withColumnRenamed("component", "region")
    nodes = regions.join(found, "node", "left").select("node", "region", F.coalesce("component", "node").alias("label"))
    nodes = cut(nodes.join(_main(nodes, "region"), "region"), "regions")
    ids = nodes.select(F.col("node").alias("doc_id"))
    texts = docs.join(small(ids, ids.count(), ID_LIMIT), "doc_id", "left_semi").dropDuplicates(["doc_id"])

    def sets(batches):
        for pdf in batches:
            yield pd.DataFrame({"node": pdf["doc_id"], "elements": [x.tobytes() for x in shingle_sets(pdf["text"], width)]})

    elements = cut(texts.mapInPandas(sets, "node long, elements binary").join(sigs.select("node", "sig"), "node"), "sets")
    qs, ms = F.ceil(F.col("out") / QUERIES).cast("int"), F.ceil(F.col("all") / MEMBERS).cast("int")
    spot = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    asks = nodes.filter("label != main").select("node", "label", "region", F.lit(True).alias("asks"), spot(qs).alias("q"), F.explode(F.sequence(F.lit(0), ms - 1)).alias("m"))
    told = nodes.select("node", "label", "region", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), qs - 1)).alias("q"), spot(ms).alias("m"))
    key = ["region", "q", "m"]
    placed = asks.unionByName(told).join(elements, "node")
    steps, percent = needed(threshold, miss), round(100 * threshold)

    def run(batches):
        for pdf in whole_groups(batches, key):
            for _, g in pdf.groupby(key, sort=False):
                yield _block(g, steps, percent)

    dealt = placed.repartition(shuffle_partitions(docs.sparkSession), *key).sortWithinPartitions(*key)
    return dealt.mapInPandas(run, "a long, b long").distinct()


def _block(g: pd.DataFrame, steps: list[tuple[int, int]], percent: int) -> pd.DataFrame:
    asks, told = g[g["asks"]], g[~g["asks"]]
    out: list[tuple[int, int]] = []
    if len(asks) and len(told):
        sigs = np.frombuffer(b"".join(told["sig"]), np.uint16).reshape(len(told), _HASHES)
        labels, nodes, sets = told["label"].to_numpy(), told["node"].to_numpy(), told["elements"].tolist()
        for node, label, sig, x in zip(asks["node"], asks["label"], asks["sig"], asks["elements"], strict=True):
            own, x = np.frombuffer(sig, np.uint16), np.frombuffer(x, np.uint64)
            alive, done, hits = np.flatnonzero(labels != label), 0, np.zeros(len(told), np.int64)
            for n, least in steps:
                hits[alive] += (sigs[alive, done:n] == own[done:n]).sum(axis=1)
                alive, done = alive[hits[alive] >= least], n
            joined = set()
            for i in alive[np.argsort(-hits[alive], kind="stable")].tolist():  # the likeliest first
                if labels[i] not in joined:
                    y = np.frombuffer(sets[i], np.uint64)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        joined.add(labels[i])
                        out.append((min(node, nodes[i]), max(node, nodes[i])))
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """Components of documents that are linked by near-equal sets of `width`-word shingles.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id), one row
    per row of `docs`. Null and wordless texts have an empty set and link with nothing; texts with fewer than
    `width` words have one shingle, their whole sequence. Rows with a null id link with nothing and aren't
    kept. Rows that repeat an id are linked with each other, whatever their texts, but for those of an empty set. An empty table gives an empty result. Texts of any length are read as
    a whole. Other columns aren't read. `id_col` holds integers. Documents of equal
    words in equal order, by a 256-bit cryptographic digest, are one node; links between nodes are confirmed on the words themselves.
    """
    threshold = percent / 100
    text_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut(describe(docs, width), "described")
    twice = cut(rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64("digest")).alias("x"), F.max(F.xxhash64("digest")).alias("y")).filter("x != y").select("doc_id"), "twice")
    names = None
    if not twice.isEmpty():  # an id of several texts: each is a node
        docs, names = named_apart(docs, "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256), twice)
        rows = cut(describe(docs, width), "described")
    sets = rows.filter("n_shingles > 0 and doc_id is not null")
    same = sets.groupBy("digest").agg(F.min("doc_id").alias("node"))
    # one node per sequence of words: the row of its smallest id carries signature and bands
    nodes = sets.join(same.withColumnRenamed("digest", "of"), (F.col("doc_id") == F.col("node")) & (F.col("digest") == F.col("of"))).dropDuplicates(["node"])
    nodes = cut(nodes.select("node", "n_shingles", "sig", "bands"), "nodes")

    members = nodes.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    pick = [F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("h"), "node", "n")).alias(f"p{i}") for i in range(PIVOTS)]
    pivots = F.array_distinct(F.array(*[F.struct(F.col(f"p{i}.node").alias("node"), F.col(f"p{i}.n").alias("n")) for i in range(PIVOTS)]))
    buckets = members.groupBy("key").agg(F.count("*").alias("m"), *pick).filter("m > 1").select("key", "m", pivots.alias("pivots"))
    shared = cut(members.join(buckets, "key"), "shared")
    close = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))  # noqa: E731  sizes alone rule out the others
    star = shared.select("node", "n", F.explode("pivots").alias("p")).filter((F.col("node") != F.col("p.node")) & close(F.col("n"), F.col("p.n")))
    # a pair once, with a pivot first
    star = star.select(F.col("p.node").alias("hub"), *_pair(F.col("node"), F.col("p.node"))).groupBy("a", "b").agg(F.min("hub").alias("hub"))
    star = cut(star.select(F.col("hub").alias("a"), F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("b")), "star")
    links = cut(confirm(prune(star, nodes, threshold, miss), docs, width, percent), "links")
    found = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    # members of a bucket that the pivots left in different components
    label = F.coalesce("component", "node").alias("label")
    labelled = shared.filter(F.col("m") <= BIG).select("key", "node", "n").join(found, "node", "left").select("key", "node", "n", label)
    main = _main(labelled, "key").select("key", "main")
    open_ = cut(labelled.join(main, "key"), "open")
    outside = open_.filter("label != main").select("key", F.col("node").alias("one"), F.col("n").alias("n1"), F.col("label").alias("l1"))
    # a pair of two outside members comes up from either side; distinct leaves one
    rest = outside.join(open_.select("key", F.col("node").alias("two"), F.col("n").alias("n2"), F.col("label").alias("l2")), "key").filter((F.col("l1") != F.col("l2")) & close(F.col("n1"), F.col("n2")))
    rest = rest.select(*_pair(F.col("one"), F.col("two"))).distinct().join(star.select(*_pair(F.col("a"), F.col("b"))), ["a", "b"], "left_anti")
    more = cut(confirm(prune(cut(rest, "rest"), nodes, threshold, miss), docs, width, percent), "links")
    wide = shared.filter(F.col("m") > BIG).select("node", F.col("pivots")[0]["node"].alias("pivot"))
    blocks = cut(confirm(block_links(wide, found, nodes, docs, width, threshold, miss), docs, width, percent), "links")
    links = links.unionByName(more).unionByName(blocks)
    if names is not None:
        links = links.unionByName(sets.join(names, F.col("doc_id") == F.col("name")).join(same, "digest").select(F.col("of").alias("a"), F.col("node").alias("b")))
    found = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    groups = same.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    out = rows.select("doc_id", "n_shingles", "digest").join(groups, "digest", "left")
    if names is not None:
        out = out.join(names, F.col("doc_id") == F.col("name"), "left").withColumn("doc_id", F.coalesce("of", "doc_id"))
    whole = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", whole.alias("component_id"), F.coalesce(F.col("doc_id") == whole, F.lit(False)).alias("kept"))


def op4(spark, sf_dir):
    """Near duplicates of all documents by two-word shingles at a similarity of 0.8."""
    return near_dedup(table(spark, sf_dir, "documents"), width=2, percent=80)


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]] ELSE list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
r AS (SELECT x AS root, x AS node FROM e UNION SELECT root, y FROM r JOIN e ON e.x = r.node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.root, w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(m.root, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node, min(root) AS root FROM r GROUP BY node) m ON m.node = w.doc_id
"""
