"""Relationship graph between instruments: edges (src, dst, weight), both directions of a link."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import series
from tapeloom.operators.pairs import pairwise
from tapeloom.scratch import Rounds
from tapeloom.scratch import cut as written

# Shares of the three parts of an edge weight.
WEIGHTS = {"correlation": 0.4, "sector": 0.3, "market_cap": 0.3}
MOST_INSTRUMENTS = 20_000
STATE = 50_000_000  # rows (source, node) that a batch of sources may reach


def padded_returns(bars: DataFrame, value: str = "close") -> DataFrame:
    """Returns on the grid of all dates and tickers; a day without a bar repeats the last value."""
    days = bars.agg(F.collect_set("date").alias("days"))  # a calendar: one value a day, one row
    grid = bars.select("ticker").distinct().crossJoin(F.broadcast(days)).select("ticker", F.explode("days").alias("date"))
    w = series()
    x = F.last(F.col(value), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    full = grid.join(bars.select("ticker", "date", value), ["ticker", "date"], "left").withColumn("_x", x)
    return full.withColumn("ret", F.try_divide("_x", F.lag("_x").over(w)) - 1).filter("ret is not null").select("ticker", "date", "ret")


def correlations(returns: DataFrame, least: float | None = None) -> DataFrame:
    """Pairwise Pearson correlation over common dates, both directions: src, dst, corr (see `pairwise`)."""
    half = pairwise(returns, least=least).select("src", "dst", "corr")
    return half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "corr"))


def edge_weights(metadata: DataFrame, corr: DataFrame) -> DataFrame:
    """Weight of every ordered pair: |correlation|, sector likeness and size likeness.

    A pair without a correlation lacks that term; a null correlation gives no edge. The result has a row for each
    pair of instruments by definition, so the metadata table is one of at most MOST_INSTRUMENTS rows, which is
    checked; each task pairs its rows with a broadcast copy.
    """
    columns = ("ticker", "sector", "market_cap", "sub_industry")
    m = metadata.select(*columns)
    if (n := m.count()) > MOST_INSTRUMENTS:
        raise ValueError(f"{n} instruments make {n * n} pairs: split them by sector first")
    a, b = (m.select(*[F.col(c).alias(f"{x}_{c}") for c in columns]) for x in "ab")
    p = a.crossJoin(F.broadcast(b)).filter("a_ticker != b_ticker").select(F.col("a_ticker").alias("src"), F.col("b_ticker").alias("dst"), "*")
    p = p.join(corr.select("src", "dst", "corr", F.lit(True).alias("_known")), ["src", "dst"], "left")
    sector = F.when(F.col("a_sub_industry") == F.col("b_sub_industry"), 1.0).otherwise(0.8)
    sector = F.when(F.col("a_sector") == F.col("b_sector"), sector).otherwise(0.2)
    cap = F.when(F.col("a_market_cap") == F.col("b_market_cap"), 1.0).otherwise(0.5)
    term = F.when(F.col("_known"), WEIGHTS["correlation"] * F.abs("corr")).otherwise(0.0)
    return p.select("src", "dst", (term + WEIGHTS["sector"] * sector + WEIGHTS["market_cap"] * cap).alias("weight")).filter("weight is not null")


def threshold(edges: DataFrame, least: float = 0.3) -> DataFrame:
    return edges.filter(F.col("weight") > least)


def sector_hubs(edges: DataFrame, metadata: DataFrame) -> DataFrame:
    """The most connected ticker of each sector; ties by name."""
    d = edges.groupBy(F.col("src").alias("ticker")).agg(F.count("*").alias("degree"))
    m = metadata.select("ticker", "sector").join(d, "ticker", "left")
    w = Window.partitionBy("sector").orderBy(F.coalesce("degree", F.lit(0)).desc(), "ticker")
    return m.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("sector", F.col("ticker").alias("hub"))


def add_hub_edges(edges: DataFrame, metadata: DataFrame, weight: float = 0.3, etf_weight: float = 0.5) -> DataFrame:
    """Missing edges between a sector's hub and its other members, both ways; members that are funds weigh more."""
    pairs = metadata.select("ticker", "sector", "market_cap").join(sector_hubs(edges, metadata), "sector").filter("ticker != hub")
    w = F.when(F.col("market_cap") == "etf", etf_weight).otherwise(weight)
    new = pairs.select(F.col("hub").alias("src"), F.col("ticker").alias("dst"), w.alias("weight")).unionByName(pairs.select(F.col("ticker").alias("src"), F.col("hub").alias("dst"), w.alias("weight")))
    return edges.unionByName(new.join(edges, ["src", "dst"], "left_anti"))


def components(edges: DataFrame, nodes: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each: node, component. Labels spread to neighbours and then jump to their
    label's label, until nothing changes; jumps double a label's reach, so `rounds` is never met but by an error."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = written(both, "links")
    tables = Rounds(edges.sparkSession, "labels")
    state = tables.cut(nodes.select("node", F.col("node").alias("component")))
    for _ in range(rounds):
        near = both.join(state, both.dst == state.node).groupBy("src").agg(F.min("component").alias("m"))
        step = state.join(near, state.node == near.src, "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"))
        up = step.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        new = tables.cut(step.join(up, step.component == up["_n"]).select("node", F.col("_c").alias("component")))
        changed = new.join(state.withColumnRenamed("component", "_old"), "node").filter("component != _old").limit(1).count()
        state = new
        if not changed:
            return state
    raise RuntimeError(f"labels still change after {rounds} rounds")


def connect(edges: DataFrame, nodes: DataFrame, anchor: str, weight: float = 0.4) -> DataFrame:
    """Tie components that the anchor isn't in to it: their most connected node, both ways. Edges are only added."""
    labels = components(edges, nodes)
    degree = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d"))
    w = Window.partitionBy("component").orderBy(F.coalesce("d", F.lit(0)).desc(), "node")
    heads = labels.join(degree, "node", "left").withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    home = labels.filter(F.col("node") == anchor).select("component")
    apart = heads.join(home, "component", "left_anti").select(F.col("node").alias("hub"))
    new = apart.select(F.col("hub").alias("src"), F.lit(anchor).alias("dst"), F.lit(weight).alias("weight")).unionByName(apart.select(F.lit(anchor).alias("src"), F.col("hub").alias("dst"), F.lit(weight).alias("weight")))
    return edges.unionByName(new)


def build(bars: DataFrame, metadata: DataFrame, anchor: str, least: float = 0.3) -> DataFrame:
    edges = written(threshold(edge_weights(metadata, correlations(padded_returns(bars))), least), "edges")
    return connect(add_hub_edges(edges, metadata), metadata.select(F.col("ticker").alias("node")), anchor)


# --- measures on the undirected graph: one row a pair, u < v ---


def undirected(edges: DataFrame) -> DataFrame:
    return edges.filter("src != dst").groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.max("weight").alias("weight"))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("src"), F.col("v").alias("dst"), "weight").unionByName(pairs.select(F.col("v").alias("src"), F.col("u").alias("dst"), "weight"))


def degree(pairs: DataFrame) -> DataFrame:
    return both_ways(pairs).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.sum("weight").alias("weighted_degree"))


def clustering(pairs: DataFrame) -> DataFrame:
    """2 T / (d (d - 1)). Pairs point to the end of higher degree (of equal ones the later name), so that no node points
    to more than about the root of twice the number of pairs: a hub is pointed to and makes no wedges of its leaves."""
    d = written(degree(pairs).select("node", "degree"), "degrees")
    ends = {x: d.select(F.col("node").alias(f"_{x}"), F.struct("degree", "node").alias(x)) for x in "uv"}
    placed = pairs.select(F.col("u").alias("_u"), F.col("v").alias("_v")).join(ends["u"], "_u").join(ends["v"], "_v").select(F.col("u").alias("a"), F.col("v").alias("b"))
    one = written(placed.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")), "directed")
    wedges = one.select("low", F.col("high").alias("x")).join(one.select("low", F.col("high").alias("y")), "low").filter("x < y")
    closing = one.select(F.col("low").alias("x"), F.col("high").alias("y"))
    t = wedges.join(closing, ["x", "y"]).select(F.explode(F.array("low.node", "x.node", "y.node")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    x = d.join(t, "node", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0).cast("long")))
    return x.select("node", "triangles", F.coalesce(F.try_divide(2.0 * F.col("triangles"), F.col("degree") * (F.col("degree") - 1)), F.lit(0.0)).alias("clustering"))


def hops(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """Breadth-first levels from all sources at once: source, node, hop, paths (number of shortest ones).

    Levels go on until one is empty, which the number of nodes bounds."""
    both = written(both_ways(pairs).select("src", "dst"), "links")
    fronts, reached, k = Rounds(pairs.sparkSession, "front"), Rounds(pairs.sparkSession, "seen"), 0
    front = fronts.cut(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("hop"), F.lit(1.0).alias("paths")))
    seen = reached.cut(front)
    while True:
        k += 1
        step = front.join(both, front.node == both.src).groupBy("source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        front = fronts.cut(step.join(seen.select("source", "node"), ["source", "node"], "left_anti").select("source", "node", F.lit(k).alias("hop"), "paths"))
        if not front.limit(1).count():
            return seen
        seen = reached.cut(seen.unionByName(front))


def batches(nodes: DataFrame, n: int) -> list[DataFrame]:
    """Sources in parts whose rows (source, node) are about STATE at most, whatever the number of nodes."""
    parts = max(1, math.ceil(n * n / STATE))
    return [nodes.filter(F.pmod(F.xxhash64("node"), F.lit(parts)) == i) for i in range(parts)] if parts > 1 else [nodes]


def _summed(found: list[DataFrame], by: str, *sums: str) -> DataFrame:
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy(by).agg(*[F.sum(c).alias(c) for c in sums])


def closeness(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(reached - 1) / sum of hops, scaled by the share of nodes reached. All nodes are sources, in batches."""
    n = nodes.count()
    found = [written(hops(pairs, part).groupBy(F.col("source").alias("node")).agg((F.count("*") - 1).alias("r"), F.sum("hop").alias("d")), "near") for part in batches(nodes, n)]
    h = _summed(found, "node", "r", "d")
    return h.select("node", F.coalesce(F.try_divide(F.col("r"), F.col("d")) * F.col("r") / max(1, n - 1), F.lit(0.0)).alias("closeness"))


def _dependencies(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """node, b: the dependency of the given sources on each node, which flows back level by level."""
    h = written(hops(pairs, sources), "levels")
    both = written(both_ways(pairs).select("src", "dst"), "links")
    deepest = h.agg(F.max("hop")).first()[0] or 0
    gathered = h.filter("false").select("source", "node", F.lit(0.0).alias("delta"))
    below = h.filter(F.col("hop") == deepest).select("source", "node", "paths", F.lit(0.0).alias("delta"))
    for k in range(deepest, 0, -1):
        up = h.filter(F.col("hop") == k - 1)
        flow = below.withColumnsRenamed({"node": "child", "paths": "p2", "delta": "d2"}).join(both, F.col("child") == both.src)
        flow = flow.join(up.select(F.col("source").alias("s"), F.col("node").alias("n"), F.col("paths").alias("p1")), (F.col("source") == F.col("s")) & (F.col("dst") == F.col("n")))
        part = flow.groupBy("s", "n").agg(F.sum(F.col("p1") / F.col("p2") * (1 + F.col("d2"))).alias("delta"))
        below = written(up.join(part, (up.source == part.s) & (up.node == part.n), "left").select("source", "node", "paths", F.coalesce("delta", F.lit(0.0)).alias("delta")), "back")
        gathered = gathered.unionByName(below.filter("source != node").select("source", "node", "delta"))
    return gathered.groupBy("node").agg(F.sum("delta").alias("b"))


def betweenness(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Share of shortest paths through each node, normalised. All nodes are sources, in batches that are folded into
    one row a node before the next begins."""
    n = nodes.count()
    total = _summed([written(_dependencies(pairs, part), "batch") for part in batches(nodes, n)], "node", "b")
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return nodes.join(total, "node", "left").select("node", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


def eigenvector(pairs: DataFrame, nodes: DataFrame, rounds: int = 1000, tolerance: float = 1e-6, per_table: int = 5) -> DataFrame:
    """Power iteration of A + 1 (which leaves the vector the same and can't swing), scaled to length 1."""
    both = written(both_ways(pairs).select("src", "dst"), "links")
    n = max(1, nodes.count())
    tables = Rounds(pairs.sparkSession, "x")
    x = tables.cut(nodes.select("node", F.lit(1.0 / n).alias("x")))
    for _ in range(0, rounds, per_table):
        old = x
        for _ in range(per_table):
            near = both.join(x, both.dst == x.node).groupBy("src").agg(F.sum("x").alias("s"))
            x = x.join(near, x.node == near.src, "left").select("node", (F.col("x") + F.coalesce("s", F.lit(0.0))).alias("x"))
        length = x.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_length"))
        x = tables.cut(x.crossJoin(F.broadcast(length)).select("node", F.try_divide("x", "_length").alias("x")))  # one row
        move = x.join(old.withColumnRenamed("x", "y"), "node").agg(F.sum(F.abs(F.col("x") - F.col("y"))).alias("d")).first()[0] or 0.0
        if move < n * tolerance:
            return x.withColumnRenamed("x", "eigenvector")
    raise RuntimeError(f"the vector still moves after {rounds} rounds")


def pagerank(pairs: DataFrame, nodes: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, per_table: int = 5) -> DataFrame:
    """Weighted PageRank; nodes without edges share their rank with all."""
    n = max(1, nodes.count())
    b = both_ways(pairs)
    share = b.withColumn("p", F.col("weight") / F.sum("weight").over(Window.partitionBy("src"))).select("src", "dst", "p")
    share = written(share, "shares")
    tables = Rounds(pairs.sparkSession, "rank")
    rank = tables.cut(nodes.join(share.select(F.col("src").alias("node")).distinct().withColumn("linked", F.lit(True)), "node", "left").select("node", F.coalesce("linked", F.lit(False)).alias("linked"), F.lit(1.0 / n).alias("r")))
    for _ in range(0, rounds, per_table):
        old = rank
        for _ in range(per_table):
            got = share.join(rank, share.src == rank.node).groupBy("dst").agg(F.sum(F.col("r") * F.col("p")).alias("g"))
            loose = rank.agg(F.coalesce(F.sum(F.when(~F.col("linked"), F.col("r"))), F.lit(0.0)).alias("_loose"))
            rank = rank.join(got, rank.node == got.dst, "left").crossJoin(F.broadcast(loose)).select("node", "linked", ((1 - damping) / n + damping * (F.coalesce("g", F.lit(0.0)) + F.col("_loose") / n)).alias("r"))  # one row
        rank = tables.cut(rank)
        move = rank.join(old.select("node", F.col("r").alias("q")), "node").agg(F.sum(F.abs(F.col("r") - F.col("q"))).alias("d")).first()[0] or 0.0
        if move < n * tolerance:
            return rank.select("node", F.col("r").alias("pagerank"))
    raise RuntimeError(f"ranks still move after {rounds} rounds")


def neighbour_degree(pairs: DataFrame) -> DataFrame:
    """Mean degree of neighbours, weighted by the edges."""
    b, d = both_ways(pairs), degree(pairs).select("node", "degree")
    j = b.join(d, b.dst == d.node)
    return j.groupBy(F.col("src").alias("node")).agg(F.try_divide(F.sum(F.col("weight") * F.col("degree")), F.sum("weight")).alias("avg_neighbor_degree"))


def khop_subgraph(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """Edges between nodes within k hops of the seeds."""
    near = seeds.select("node").distinct()
    for _ in range(k):
        near = written(near.unionByName(edges.join(near, edges.src == near.node, "left_semi").select(F.col("dst").alias("node"))).distinct(), "near")
    return edges.join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi")


def statistics(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    n, c = nodes.agg(F.count("*").alias("nodes")), clustering(pairs).agg(F.sum("clustering").alias("c"))
    e = pairs.agg(F.count("*").alias("edges"))
    x = n.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(c))  # one row each
    return x.select("nodes", "edges", F.try_divide(2.0 * F.col("edges"), "nodes").alias("mean_degree"), F.try_divide(2.0 * F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)).alias("density"), F.try_divide(F.coalesce("c", F.lit(0.0)), "nodes").alias("mean_clustering"))


def merge_metadata(universe: DataFrame, table: DataFrame) -> DataFrame:
    """Universe rows with industry and size class of the table where it has them."""
    t = table.select("ticker", F.col("sub_industry").alias("_i"), F.col("market_cap").alias("_c"))
    return universe.join(t, "ticker", "left").withColumns({"sub_industry": F.coalesce("_i", "sub_industry"), "market_cap": F.coalesce("_c", "market_cap")}).drop("_i", "_c")


def to_json(edges: DataFrame) -> DataFrame:
    """Adjacency as one JSON text a source node: src, adjacency."""
    return edges.groupBy("src").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("dst", "weight"))))).alias("adjacency"))


def from_json(rows: DataFrame) -> DataFrame:
    return rows.select("src", F.explode(F.from_json("adjacency", "map<string,double>")).alias("dst", "weight"))
