"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosine, components.

The signs of `bits` random projections form one key a table; a pair at the threshold differs in one sign with
probability acos(threshold) / pi, which gives the number of tables that misses such a pair with at most the
chosen probability. Vectors of a bucket are compared in blocks of bounded size. A pair that meets in several
tables counts in the first of them, so that link counts are exact sums over blocks and no pair list of a
large group is ever written: a block returns counts and the edges of a forest.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import cut, named_apart, shuffle_partitions, table, whole_groups
from tapeloom.llm.components import components

MISS = 1e-6
BLOCK = 1024


def plan(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables): buckets of about 64 unrelated vectors at any n, and tables enough for the miss rate."""
    bits = min(48, max(8, round(math.log2(max(1, n) / 64))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - same))


def signs(vectors: np.ndarray, bits: int, tables: int, seed: int = 11) -> np.ndarray:
    """Keys of each vector, one a table."""
    planes = np.random.Generator(np.random.PCG64([seed, vectors.shape[1]])).standard_normal((vectors.shape[1], tables * bits))
    on = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return on @ (1 << np.arange(bits, dtype=np.int64))


def unit(v: np.ndarray) -> np.ndarray:
    """Vectors at length one. Each is first scaled by a power of two, which is exact, so that no square leaves the range of doubles."""
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def linked(v: np.ndarray, keys: np.ndarray, t: int, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the index pairs (a, b) reach the threshold and don't meet in a table before t."""
    ok = np.einsum("ij,ij->i", v[a], v[b]) >= threshold
    at = np.flatnonzero(ok)
    ok[at] = ~(keys[a[at], :t] == keys[b[at], :t]).any(axis=1)
    return ok


def roots(adjacent: np.ndarray) -> np.ndarray:
    """Smallest index reachable in a symmetric boolean matrix."""
    label = np.arange(len(adjacent))
    while True:
        near = np.where(adjacent, label[None, :], len(label)).min(axis=1)
        new = np.minimum(label, near)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def key_type(bits: int):
    return np.int16 if bits < 16 else np.int32 if bits < 32 else np.int64


def compare(pdf: pd.DataFrame, threshold: float, kind, of_key) -> pd.DataFrame:
    """Counts and forest edges of whole blocks: rows (node, links, other), where one of the two is null."""
    node, weight, side, t, p, q = (pdf[c].to_numpy() for c in ("node", "copies", "side", "table", "p", "q"))
    counts = np.zeros(len(pdf), np.int64)
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    group = pdf.groupby(["table", "label", "dim", "bits", "p", "q"], sort=False, dropna=False).ngroup().to_numpy()
    cuts = np.flatnonzero(np.diff(group)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(pdf)], strict=True):
        if hi - lo < 2:
            continue
        v = unit(np.frombuffer(b"".join(pdf["vector"].iloc[lo:hi]), kind).reshape(hi - lo, -1).astype(np.float64))
        keys = np.frombuffer(b"".join(pdf["keys"].iloc[lo:hi]), of_key).reshape(hi - lo, -1)
        m, own, two = hi - lo, side[lo:hi], p[lo] != q[lo]  # two chunks: only pairs across them
        if m <= 64:
            a, b = np.triu_indices(m, 1)
            cross = own[a] != own[b] if two else slice(None)
            a, b = a[cross], b[cross]
            ok = linked(v, keys, t[lo], a, b, threshold)
            a, b = a[ok], b[ok]
        else:
            near = v @ v.T >= threshold - 1e-9
            np.fill_diagonal(near, False)
            if two:
                near &= own[:, None] != own[None, :]
            a, b = np.nonzero(np.triu(near))
            ok = linked(v, keys, t[lo], a, b, threshold)
            a, b = a[ok], b[ok]
        np.add.at(counts, lo + a, weight[lo + b])
        np.add.at(counts, lo + b, weight[lo + a])
        if m > 64 and len(a):
            graph = np.zeros((m, m), bool)
            graph[a, b] = graph[b, a] = True
            r = roots(graph)
            a = np.flatnonzero(r != np.arange(m))
            b = r[a]
        edges.append((node[lo + a], node[lo + b]))
    seen = np.flatnonzero(counts)
    u = np.concatenate([node[seen], *[x for x, _ in edges]]).astype(np.int64)
    links = np.concatenate([counts[seen], np.zeros(len(u) - len(seen), np.int64)])
    other = pd.array(np.concatenate([np.zeros(len(seen), np.int64), *[y for _, y in edges]]).astype(np.int64), "Int64")
    other[: len(seen)] = pd.NA
    return pd.DataFrame({"node": u, "links": links, "other": other})


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """Links and components of vectors of equal label whose cosine reaches the threshold.

    Returns vec_id, n_links (other rows linked directly, exact copies included), component_id, kept, one row
    per row. A null label, and a vector that is null, empty, zero or holds null or non-finite components,
    links with nothing; so do vectors of different length. Rows with a null id link with nothing and aren't
    kept. Rows that repeat an id count as rows in n_links and are linked with each other in components. An empty table gives an
    empty result; other columns aren't read. `id_col` holds integers. Blocks get vectors in the precision that they
    have, as bytes, and work in double precision.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    fine = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = rows.filter(fine).withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
    vector = F.xxhash64("label", "embedding")
    twice = cut(good.groupBy("vec_id").agg(F.min(vector).alias("x"), F.max(vector).alias("y")).filter("x != y").select("vec_id"), "twice")
    names = None
    if not twice.isEmpty():  # an id of several vectors: each is a node
        good, names = named_apart(good, "vec_id", vector, twice)
    # copies are one node
    nodes = cut(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")).withColumn("dim", F.size("embedding")), "nodes")
    n = nodes.count()
    bits, tables = plan(n, threshold, miss)

    kind, of_key = (np.float32 if df.schema[vector_col].dataType.elementType.simpleString() == "float" else np.float64), key_type(bits)

    def keys(batches):
        for pdf in batches:
            out, slots, vectors = np.empty(len(pdf), object), np.empty(len(pdf), object), np.empty(len(pdf), object)
            for _, part in pdf.groupby("dim"):
                v = np.array(part["embedding"].tolist(), np.float64)
                found = signs(unit(v), bits, tables)
                for i, k, x in zip(pdf.index.get_indexer(part.index), found, v.astype(kind), strict=True):
                    slots[i], out[i], vectors[i] = k, k.astype(of_key).tobytes(), x.tobytes()
            yield pdf[["node", "label", "dim", "copies"]].assign(slots=slots, keys=out, vector=vectors)

    label = rows.schema["label"].dataType.simpleString()
    keyed = cut(nodes.select("node", "label", "dim", "copies", "embedding").mapInPandas(keys, f"node long, label {label}, dim int, copies long, slots array<long>, keys binary, vector binary"), "keyed")
    slots = keyed.select("node", "label", "dim", F.posexplode("slots").alias("table", "bits"))
    where = ["table", "label", "dim", "bits"]
    sizes = slots.groupBy(*where).agg(F.count("*").alias("m")).filter("m > 1")
    placed = slots.join(sizes, where).withColumn("c", F.ceil(F.col("m") / block).cast("int"))
    # a bucket of c chunks has blocks (p, q) with p <= q; a row goes to the c blocks of its chunk
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("node", "table"), F.col("c")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    placed = placed.select("node", *where, F.least("chunk", "x").alias("p"), F.greatest("chunk", "x").alias("q"), (F.col("chunk") > F.col("x")).cast("int").alias("side"))
    full = placed.join(keyed.select("node", "copies", "vector", "keys"), "node")
    block_key = [*where, "p", "q"]

    def run(batches):
        for pdf in whole_groups(batches, block_key):
            yield compare(pdf, threshold, kind, of_key)

    dealt = full.repartition(shuffle_partitions(spark), *block_key).sortWithinPartitions(*block_key)
    found = cut(dealt.mapInPandas(run, "node long, links long, other long"), "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.filter("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v"))
    if names is not None:
        of = good.join(names, F.col("vec_id") == F.col("name")).select("of", F.col("label").alias("l"), F.col("embedding").alias("e"))
        edges = edges.unionByName(of.join(nodes, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e"))).select(F.col("node").alias("u"), F.col("of").alias("v")))
    groups = components(edges)
    per = nodes.join(links, "node", "left").join(groups, "node", "left").select(F.col("label").alias("l"), F.col("embedding").alias("e"), (F.coalesce("links", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    # the copies of a vector find their node by its label and components
    told = good.select("vec_id", "label", "embedding").join(per, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")))
    if names is not None:
        told = told.join(names, F.col("vec_id") == F.col("name"), "left").withColumn("vec_id", F.coalesce("of", "vec_id"))
    alone = rows.filter(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    return told.select("vec_id", "n_links", F.col("component").alias("component_id"), (F.col("vec_id") == F.col("component")).alias("kept")).unionByName(alone)


def op10(spark, sf_dir):
    """Links and components of all vectors of equal label at a cosine of 0.98."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
k AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT x AS root, x AS node FROM k UNION SELECT root, y FROM r JOIN k ON k.x = r.node)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(m.root, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(m.root, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN (SELECT x, count(*) AS n FROM k GROUP BY x) n ON n.x = e.vec_id
LEFT JOIN (SELECT node, min(root) AS root FROM r GROUP BY node) m ON m.node = e.vec_id
"""
