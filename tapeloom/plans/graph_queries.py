"""Queries over the relationship graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import rounded
from tapeloom.operators import graph
from tapeloom.plans import fixtures as fx
from tapeloom.plans.registry import query

CORR = {
    "grid": "SELECT t.ticker, d.date FROM (SELECT DISTINCT ticker FROM bars_daily) t CROSS JOIN (SELECT DISTINCT date FROM bars_daily) d",
    "x": "SELECT ticker, date, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS x FROM grid LEFT JOIN bars_daily USING (ticker, date)",
    "ret": "SELECT * FROM (SELECT ticker, date, x / nullif(lag(x) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS r FROM x) WHERE r IS NOT NULL",
    "c": "SELECT a.ticker AS src, b.ticker AS dst, corr(a.r, b.r) AS corr FROM ret a JOIN ret b ON a.date = b.date AND a.ticker <> b.ticker GROUP BY 1, 2",
}
EDGES = CORR | {
    "w": """SELECT a.ticker AS src, b.ticker AS dst, CASE WHEN c.src IS NOT NULL THEN 0.4 * abs(c.corr) ELSE 0 END + 0.3 * CASE WHEN a.sector = b.sector THEN CASE WHEN a.sub_industry = b.sub_industry THEN 1.0 ELSE 0.8 END ELSE 0.2 END
 + 0.3 * CASE WHEN a.market_cap = b.market_cap THEN 1.0 ELSE 0.5 END AS weight FROM metadata a JOIN metadata b ON a.ticker <> b.ticker LEFT JOIN c ON c.src = a.ticker AND c.dst = b.ticker""",
    "e": "SELECT * FROM w WHERE weight > 0.45",
    "p": "SELECT least(src, dst) AS u, greatest(src, dst) AS v, max(weight) AS weight FROM e GROUP BY 1, 2",
    "b2": "SELECT u AS src, v AS dst, weight FROM p UNION ALL SELECT v, u, weight FROM p",
    "deg": "SELECT src AS node, count(*) AS degree, sum(weight) AS weighted_degree FROM b2 GROUP BY src",
}
N = ("bars_daily", "metadata")


def _edges(spark, sf, least: float = 0.45):
    c = graph.correlations(graph.padded_returns(fx.bars_daily(spark, sf)))
    return graph.written(graph.threshold(graph.edge_weights(fx.metadata(spark, sf), c), least), "edges")


def _pairs(spark, sf):
    return graph.undirected(_edges(spark, sf))


def _nodes(spark, sf):
    return fx.metadata(spark, sf).select(F.col("ticker").alias("node"))


@query("g1_a20_correlations", N, "SELECT src, dst, round(corr, 5) AS corr FROM c", CORR)
def _(spark, sf):
    return rounded(graph.correlations(graph.padded_returns(fx.bars_daily(spark, sf))), 5)


@query("g2_j8_edge_weights", N, "SELECT src, dst, round(weight, 5) AS weight FROM w", EDGES)
def _(spark, sf):
    return rounded(_edges(spark, sf, 0.0), 5)


@query("g3_threshold", N, "SELECT src, dst, round(weight, 5) AS weight FROM e", EDGES)
def _(spark, sf):
    return rounded(_edges(spark, sf), 5)


@query("g4_hub_edges", N, """SELECT src, dst, round(weight, 5) AS weight FROM (SELECT * FROM e UNION ALL (SELECT n.* FROM (SELECT h.hub AS src, m.ticker AS dst, CASE m.market_cap WHEN 'etf' THEN 0.5 ELSE 0.3 END AS weight FROM metadata m JOIN h USING (sector) WHERE m.ticker <> h.hub
 UNION ALL SELECT m.ticker, h.hub, CASE m.market_cap WHEN 'etf' THEN 0.5 ELSE 0.3 END FROM metadata m JOIN h USING (sector) WHERE m.ticker <> h.hub) n ANTI JOIN e ON e.src = n.src AND e.dst = n.dst))""",
       EDGES | {"h": "SELECT sector, ticker AS hub FROM metadata LEFT JOIN (SELECT src, count(*) AS d FROM e GROUP BY src) ON src = ticker QUALIFY row_number() OVER (PARTITION BY sector ORDER BY coalesce(d, 0) DESC, ticker) = 1"})
def _(spark, sf):
    return rounded(graph.add_hub_edges(_edges(spark, sf), fx.metadata(spark, sf)), 5)


@query("g5_components", N, "SELECT node, min(root) AS component FROM r GROUP BY node", EDGES | {"b3": "SELECT src, dst FROM b2 WHERE weight > 0.7", "r": "SELECT ticker AS root, ticker AS node FROM metadata UNION SELECT root, b3.dst FROM r JOIN b3 ON b3.src = r.node"}, recursive=True)
def _(spark, sf):
    return graph.components(_pairs(spark, sf).filter("weight > 0.7").select(F.col("u").alias("src"), F.col("v").alias("dst")), _nodes(spark, sf))


BUILD = EDGES | {
    "e6": "SELECT * FROM w WHERE weight > 0.6",
    "h": "SELECT sector, ticker AS hub FROM metadata LEFT JOIN (SELECT src, count(*) AS d FROM e6 GROUP BY src) ON src = ticker QUALIFY row_number() OVER (PARTITION BY sector ORDER BY coalesce(d, 0) DESC, ticker) = 1",
    "hp": "SELECT h.hub, m.ticker, CASE m.market_cap WHEN 'etf' THEN 0.5 ELSE 0.3 END AS weight FROM metadata m JOIN h USING (sector) WHERE m.ticker <> h.hub",
    "n6": "SELECT hub AS src, ticker AS dst, weight FROM hp UNION ALL SELECT ticker, hub, weight FROM hp",
    "full6": "MATERIALIZED SELECT src, dst, weight FROM e6 UNION ALL SELECT n6.* FROM n6 ANTI JOIN e6 ON e6.src = n6.src AND e6.dst = n6.dst",
    "reach": "SELECT ticker AS root, ticker AS node FROM metadata UNION SELECT root, full6.dst FROM reach JOIN full6 ON full6.src = reach.node",
    "comp": "SELECT node, min(root) AS component FROM reach GROUP BY node",
    "head": "SELECT c.component, c.node FROM comp c LEFT JOIN (SELECT src, count(*) AS d FROM full6 GROUP BY src) g ON g.src = c.node QUALIFY row_number() OVER (PARTITION BY c.component ORDER BY coalesce(g.d, 0) DESC, c.node) = 1",
    "apart": "SELECT node AS hub FROM head WHERE component <> (SELECT component FROM comp WHERE node = 'NATION_0')",
}


@query("g6_build_graph", N, "SELECT src, dst, round(weight, 5) AS weight FROM (SELECT * FROM full6 UNION ALL SELECT hub, 'NATION_0', 0.4 FROM apart UNION ALL SELECT 'NATION_0', hub, 0.4 FROM apart)", BUILD, recursive=True)
def _(spark, sf):
    return rounded(graph.build(fx.bars_daily(spark, sf), fx.metadata(spark, sf), "NATION_0", 0.6), 5)


@query("g7_degree", N, "SELECT node, degree, round(weighted_degree, 4) AS weighted_degree FROM deg", EDGES)
def _(spark, sf):
    return rounded(graph.degree(_pairs(spark, sf)), 4)


TRI = EDGES | {"t": "SELECT a.src AS node, count(*) / 2 AS t FROM b2 a JOIN b2 b ON a.src = b.src JOIN b2 c ON c.src = a.dst AND c.dst = b.dst GROUP BY a.src"}


@query("g8_clustering", N, "SELECT node, coalesce(t, 0)::BIGINT AS triangles, round(coalesce(2.0 * coalesce(t, 0) / nullif(degree * (degree - 1), 0), 0), 6) AS clustering FROM deg LEFT JOIN t USING (node)", TRI)
def _(spark, sf):
    return rounded(graph.clustering(_pairs(spark, sf)), 6)


HOPS = EDGES | {"b3": "SELECT src, dst FROM b2", "h": "SELECT ticker AS source, ticker AS node, 0 AS hop FROM metadata UNION SELECT h.source, b3.dst, h.hop + 1 FROM h JOIN b3 ON b3.src = h.node WHERE h.hop < 25", "dist": "SELECT source, node, min(hop) AS hop FROM h GROUP BY 1, 2"}


PATHS = HOPS | {
    "dist": f"MATERIALIZED {HOPS['dist']}",
    "sigma": "SELECT ticker AS source, ticker AS node, 0 AS hop, 1.0::DOUBLE AS paths FROM metadata UNION ALL SELECT s.source, b3.dst, s.hop + 1, sum(s.paths) FROM sigma s JOIN b3 ON b3.src = s.node JOIN dist d ON d.source = s.source AND d.node = b3.dst AND d.hop = s.hop + 1 GROUP BY 1, 2, 3",
    "through": "SELECT a.node, sum(a.paths * b.paths / c.paths) AS t FROM sigma a JOIN sigma b ON b.source = a.node JOIN sigma c ON c.source = a.source AND c.node = b.node AND c.hop = a.hop + b.hop WHERE a.node <> a.source AND a.node <> b.node GROUP BY a.node",
}


@query("g9_betweenness", N, "SELECT ticker AS node, round(coalesce(t, 0) / (((SELECT count(*) FROM metadata) - 1) * ((SELECT count(*) FROM metadata) - 2)), 6) AS betweenness FROM metadata LEFT JOIN through ON node = ticker", PATHS, recursive=True)
def _(spark, sf):
    return rounded(graph.betweenness(_pairs(spark, sf), _nodes(spark, sf)), 6)


@query("g10_closeness", N, "SELECT source AS node, round(coalesce((count(*) - 1) / nullif(sum(hop), 0) * (count(*) - 1) / (SELECT count(*) - 1 FROM metadata), 0), 6) AS closeness FROM dist GROUP BY source", HOPS, recursive=True)
def _(spark, sf):
    return rounded(graph.closeness(_pairs(spark, sf), _nodes(spark, sf)), 6)


SPREAD = EDGES | {
    "links": "MATERIALIZED SELECT src, dst, weight FROM b2", "n": "SELECT count(*) AS n FROM metadata",
    # a step of A + 1 on all nodes, scaled to length 1; 400 steps settle the digits that are kept
    "power": "SELECT 0 AS k, ticker AS node, 1.0::DOUBLE AS x FROM metadata UNION ALL SELECT k + 1, node, x / sqrt(sum(x * x) OVER ()) FROM (SELECT p.k, p.node, any_value(p.x) + coalesce(sum(q.x), 0) AS x FROM power p LEFT JOIN links l ON l.src = p.node LEFT JOIN power q ON q.node = l.dst WHERE p.k < 400 GROUP BY p.k, p.node)",
    "share": "MATERIALIZED SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM links",
    "walk": "SELECT 0 AS k, ticker AS node, 1.0::DOUBLE / n AS r FROM metadata, n UNION ALL SELECT w.k + 1, w.node, 0.15 / any_value(n.n) + 0.85 * (coalesce(sum(v.r * s.p), 0) + coalesce((SELECT sum(r) FROM walk WHERE node NOT IN (SELECT src FROM share)), 0) / any_value(n.n)) FROM walk w CROSS JOIN n LEFT JOIN share s ON s.dst = w.node LEFT JOIN walk v ON v.node = s.src WHERE w.k < 100 GROUP BY w.k, w.node",
}


@query("g11_eigenvector", N, "SELECT node, round(x, 3) AS eigenvector FROM power WHERE k = 400", SPREAD, recursive=True)
def _(spark, sf):
    return rounded(graph.eigenvector(_pairs(spark, sf), _nodes(spark, sf), tolerance=1e-8), 3)


@query("g12_pagerank", N, "SELECT node, round(r, 4) AS pagerank FROM walk WHERE k = 100", SPREAD, recursive=True)
def _(spark, sf):
    return rounded(graph.pagerank(_pairs(spark, sf), _nodes(spark, sf), tolerance=1e-8, rounds=200), 4)


@query("g13_neighbour_degree", N, "SELECT b2.src AS node, round(sum(b2.weight * deg.degree) / sum(b2.weight), 5) AS avg_neighbor_degree FROM b2 JOIN deg ON deg.node = b2.dst GROUP BY b2.src", EDGES)
def _(spark, sf):
    return rounded(graph.neighbour_degree(_pairs(spark, sf)), 5)


@query("g14_khop", N, "SELECT src, dst, round(weight, 5) AS weight FROM b2 WHERE src IN (SELECT * FROM k) AND dst IN (SELECT * FROM k)", EDGES | {"b3": "SELECT src, dst FROM b2", "k": "SELECT 'NATION_3' AS n UNION SELECT dst FROM b3 WHERE src = 'NATION_3'"})
def _(spark, sf):
    e = graph.written(graph.both_ways(_pairs(spark, sf)), "both")
    return rounded(graph.khop_subgraph(e, _nodes(spark, sf).filter("node = 'NATION_3'"), 1), 5)


@query("g15_statistics", N, "SELECT count(*) AS nodes, (SELECT count(*) FROM p) AS edges, round(2.0 * (SELECT count(*) FROM p) / count(*), 6) AS mean_degree, round(2.0 * (SELECT count(*) FROM p) / (count(*) * (count(*) - 1)), 6) AS density, round(sum(coalesce(2.0 * coalesce(t, 0) / nullif(degree * (degree - 1), 0), 0)) / count(*), 6) AS mean_clustering FROM metadata LEFT JOIN deg ON deg.node = ticker LEFT JOIN t ON t.node = ticker", TRI)
def _(spark, sf):
    return rounded(graph.statistics(_pairs(spark, sf), _nodes(spark, sf)), 6)


@query("g16_merge_metadata", ("metadata",), "SELECT ticker, name, sector, CASE WHEN sector = 'ASIA' THEN market_cap ELSE 'unknown' END AS market_cap, CASE WHEN sector = 'ASIA' THEN sub_industry ELSE 'unknown' END AS sub_industry FROM metadata")
def _(spark, sf):
    m = fx.metadata(spark, sf)
    return graph.merge_metadata(m.withColumns({"market_cap": F.lit("unknown"), "sub_industry": F.lit("unknown")}), m.filter("sector = 'ASIA'"))


@query("k15_graph_json", N, "SELECT src, dst, round(weight, 5) AS weight FROM e", EDGES)
def _(spark, sf):
    return rounded(graph.from_json(graph.to_json(_edges(spark, sf))), 5)


@query("j13_valid_edges", N, "SELECT src, dst FROM e WHERE src IN (SELECT ticker FROM metadata WHERE sector <> 'ASIA') AND dst IN (SELECT ticker FROM metadata WHERE sector <> 'ASIA')", EDGES)
def _(spark, sf):
    m = fx.metadata(spark, sf).filter("sector <> 'ASIA'").select("ticker")
    return _edges(spark, sf).join(m.withColumnRenamed("ticker", "src"), "src", "left_semi").join(m.withColumnRenamed("ticker", "dst"), "dst", "left_semi").select("src", "dst")
