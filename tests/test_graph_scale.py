"""Graph work by blocks, degrees and batches, against plain code."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest

from tapeloom.operators import features, graph, metrics, pairs


@pytest.mark.parametrize("block, batch", [(256, 10_000), (3, 7)])
def test_correlations_match_all_pairs(spark, monkeypatch, block, batch):
    monkeypatch.setattr(pairs, "BLOCK", block)
    monkeypatch.setattr(pairs, "NAMES", 5)
    g = np.random.default_rng(1)
    base = g.normal(size=60)
    series = {f"t{i}": base * g.uniform(-1, 1) + g.normal(size=60) for i in range(11)} | {"flat": np.ones(60)}
    rows = [(t, dt.date(2024, 1, 1) + dt.timedelta(d), float(x[d])) for k, (t, x) in enumerate(series.items()) for d in range(k, 60 if t != "t3" else 4)]
    rows += [("alone", dt.date(2025, 1, 1), 1.0), ("t1", dt.date(2026, 1, 1), None)]
    held = {}
    for t, d, x in rows:
        if x is not None:
            held.setdefault(t, {})[d] = x
    want = {}
    for a, b in itertools.combinations(sorted(held), 2):
        common = sorted(held[a].keys() & held[b].keys())
        if common:
            x, y = np.array([held[a][d] for d in common]), np.array([held[b][d] for d in common])
            want[a, b] = np.corrcoef(x, y)[0, 1] if len(common) > 1 and np.ptp(x) > 0 and np.ptp(y) > 0 else None
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(batch))
    try:
        df = spark.createDataFrame(rows, "ticker string, date date, ret double")
        got = {(r["src"], r["dst"]): r["corr"] for r in pairs.pairwise(df).collect()}
        strong = {(r["src"], r["dst"]) for r in graph.correlations(df, least=0.3).collect()}
    finally:
        spark.conf.set(key, before)
    assert set(got) == set(want)
    for k, c in want.items():
        assert (got[k] is None) == (c is None) and (c is None or np.isclose(got[k], c)), k
    assert strong == {p for (a, b), c in want.items() if c is not None and abs(c) >= 0.3 for p in ((a, b), (b, a))}


def test_diversity_by_horizon(spark):
    g = random.Random(2)
    rows = [(h, dt.date(2024, 1, 1) + dt.timedelta(d), t, g.random() if t != "C" or h == 7 else 0.5) for h in (1, 7) for d in range(20) for t in "ABC"]
    got = {r["horizon_days"]: r["avg_correlation"] for r in metrics.prediction_diversity(spark.createDataFrame(rows, "horizon_days int, prediction_date date, ticker string, predicted_return double")).collect()}
    for h in (1, 7):
        x = {t: [r[3] for r in rows if r[0] == h and r[2] == t] for t in "ABC"}
        c = [np.corrcoef(x[a], x[b])[0, 1] for a, b in itertools.combinations("ABC", 2) if np.ptp(x[a]) and np.ptp(x[b])]
        assert np.isclose(got[h], np.mean(c))


def test_a_hub_makes_no_wedges(spark):
    """A star of 10,000 leaves with a clique of six beside it, tied by one pair."""
    star = [("hub", f"leaf{i:05}", 1.0) for i in range(10_000)]
    clique = [(f"k{a}", f"k{b}", 1.0) for a, b in itertools.combinations(range(6), 2)]
    df = spark.createDataFrame([*star, *clique, ("hub", "k0", 1.0), ("leaf00000", "leaf00001", 1.0)], "u string, v string, weight double")
    got = {r["node"]: (r["triangles"], r["clustering"]) for r in graph.clustering(df).filter("triangles > 0").collect()}
    want = {"hub": (1, 2 / (10_001 * 10_000)), "leaf00000": (1, 1.0), "leaf00001": (1, 1.0), "k0": (10, 20 / 30)} | {f"k{i}": (10, 1.0) for i in range(1, 6)}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_sources_in_batches(spark, monkeypatch):
    g = random.Random(5)
    edges = sorted({tuple(sorted(g.sample(range(14), 2))) for _ in range(20)})
    df = spark.createDataFrame([(f"n{a:02}", f"n{b:02}", 1.0) for a, b in edges], "u string, v string, weight double")
    nodes = spark.createDataFrame([(f"n{i:02}",) for i in range(14)], "node string")
    value = lambda f: {r[0]: round(r[1], 9) for r in f(df, nodes).collect()}
    whole = value(graph.closeness), value(graph.betweenness)
    monkeypatch.setattr(graph, "STATE", 40)
    assert len(graph.batches(nodes, 14)) == 5
    assert (value(graph.closeness), value(graph.betweenness)) == whole


def test_ridge_matches_numpy(spark):
    g = np.random.default_rng(3)
    x = g.normal(size=(400, 3))
    rows = []
    for i, v in enumerate(x):
        for h in (1, 7):
            t = None if i % 50 == 0 else float(0.1 * v[0] * h - 0.05 * v[1] + 0.01 * g.normal())
            rows.append((f"t{i % 4}", dt.date(2020, 1, 1) + dt.timedelta(i), h, None if i == 3 else float(v[0]), float(v[1]), float(v[2]), t, "train" if i < 300 else "validation"))
    df = spark.createDataFrame(rows, "ticker string, date date, horizon_days int, a double, b double, c double, target double, split string")
    models = features.fit_return_models(df, ["a", "b", "c"], (1, 7), penalty=0.3)
    for r in models.collect():
        own = [q for q in rows if q[2] == r["horizon_days"] and q[6] is not None and q[3] is not None]
        m = np.array([q[3:6] for q in own if q[7] == "train"])
        y = np.array([q[6] for q in own if q[7] == "train"])
        d = m - m.mean(axis=0)
        w = np.linalg.solve(d.T @ d / len(d) + 0.3 * np.eye(3), d.T @ (y - y.mean()) / len(d))
        assert np.allclose(r["weights"], w) and np.allclose(r["means"], m.mean(axis=0)) and np.isclose(r["target_mean"], y.mean())
        assert r["bins"] and all(0 <= c <= 1 for c in r["bins"].values())
    p = features.predict_returns(df.filter("horizon_days = 1").select("ticker", "date", "a", "b", "c"), models, ["a", "b", "c"])
    assert p.count() == 2 * 399 and p.columns == ["ticker", "prediction_date", "horizon_days", "predicted_return", "confidence_score"]
