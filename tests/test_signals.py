"""Signals, metrics, gates, features."""

import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from tapeloom.operators import features, graph, macro, metrics, signals

PRED = "horizon_days int, n int, predicted_return double, actual_return double, confidence_score double"


def rows(spark, pred, actual, conf=None):
    return spark.createDataFrame([(1, i, float(p), float(a), float((conf or [0.6] * len(pred))[i])) for i, (p, a) in enumerate(zip(pred, actual, strict=True))], PRED)


def test_direction_case(spark):
    d = rows(spark, [0.01, -0.02, 0.03, -0.01, 0.02], [0.02, -0.01, -0.01, 0.01, 0.03])
    assert metrics.direction(d).first()["direction_accuracy"] == 0.6


def test_sharpe_case(spark):
    p, a = np.array([1, -1, 1, -1, 1.0]), np.array([0.01, -0.01, 0.02, 0.01, 0.01])
    s = np.sign(p) * a - 0.02 / 252
    assert math.isclose(metrics.ratios(rows(spark, p, a)).first()["sharpe_ratio"], s.mean() / s.std() * math.sqrt(252))
    assert metrics.ratios(rows(spark, [1, 1], [0.0, 0.0])).first()["sharpe_ratio"] == 0


def test_all_metrics_against_numpy(spark):
    g = np.random.default_rng(1)
    p = g.uniform(-0.05, 0.05, 100)
    a = p + g.normal(0, 0.01, 100)
    c = g.uniform(0.5, 0.9, 100)
    m = metrics.all_metrics(rows(spark, p, a, list(c)), ["n"]).first()
    s = np.sign(p) * a
    cum = np.cumprod(1 + s)
    top = np.maximum.accumulate(cum)
    assert math.isclose(m["max_drawdown"], ((cum - top) / top).min(), rel_tol=1e-9)
    assert math.isclose(m["var_95"], np.percentile(s, 5), rel_tol=1e-9)
    assert math.isclose(m["cvar_95"], s[s <= np.percentile(s, 5)].mean(), rel_tol=1e-9)
    ranks = lambda x: np.argsort(np.argsort(x)) + 1
    assert math.isclose(m["rank_ic"], np.corrcoef(ranks(p), ranks(a))[0, 1], rel_tol=1e-9)
    edges = np.linspace(0, 1, 11)
    hit = np.sign(p) == np.sign(a)
    ece = sum(abs(hit[k].mean() - c[k].mean()) * k.sum() / 100 for lo, hi in zip(edges, edges[1:], strict=False) if (k := (c >= lo) & (c < hi)).any())
    assert math.isclose(m["ece"], ece, rel_tol=1e-9)
    assert metrics.report(metrics.all_metrics(rows(spark, p, a), ["n"])).count() == 2


def test_few_pairs_have_no_rank_ic(spark):
    assert metrics.rank_correlation(rows(spark, [1, 2], [1, 2])).first()["rank_ic"] == 0


def predictions(spark):
    data = [(f"T{i}", dt.date(2024, 1, 1), 7, (i - 5) / 50, 0.5 + i / 20) for i in range(10)]
    return spark.createDataFrame(data, "ticker string, prediction_date date, horizon_days int, predicted_return double, confidence_score double")


def test_signals_and_weights(spark):
    s = signals.signals(predictions(spark))
    assert {r["signal"] for r in s.collect()} == {"BUY", "SELL"} and s.agg(F.min("rank")).first()[0] == 1
    assert math.isclose(signals.allocate(s, 3).agg(F.sum(F.abs("weight"))).first()[0], 1.0)
    assert math.isclose(signals.allocate(s, 3, equal=True).agg(F.max(F.abs("weight"))).first()[0], 1 / 3)


def test_wide_and_long_predictions(spark):
    p = predictions(spark)
    assert signals.melt_predictions(signals.spread_predictions(p)).count() == p.count()


def test_gate_takes_missing_as_met(spark):
    m = spark.createDataFrame([(1, 0.6, 0.6, None), (7, 0.6, 0.4, -0.1), (30, 0.53, None, -0.1)], "horizon_days int, direction_accuracy double, sharpe_ratio double, max_drawdown double")
    assert tuple(signals.deployment_gate(m).first()) == (3, 2, True)


def test_forward_return_definitions_differ(spark):
    bars = spark.createDataFrame([("A", dt.date(2024, 1, d), 1.0 * d) for d in (1, 2, 5, 8)], "ticker string, date date, close double")
    p = spark.createDataFrame([("A", dt.date(2024, 1, d), 1, 0.1, 0.9) for d in (1, 5)], "ticker string, prediction_date date, horizon_days int, predicted_return double, confidence_score double")
    by = lambda df: {r["prediction_date"].day: r["actual_return"] for r in df.collect()}
    assert by(signals.evaluate_by_row(p, bars)) == {1: 1.0, 5: 0.6000000000000001}
    assert by(signals.evaluate_by_day(p, bars)) == {1: 1.0}
    assert by(signals.evaluate_by_prediction(p, bars)) == {1: 4.0}


def test_split_is_by_dates(spark):
    d = spark.createDataFrame([(t, dt.date(2024, 1, 1) + dt.timedelta(i), float(i)) for t in "AB" for i in range(100)], "ticker string, date date, x double")
    s = {r["split"]: (r["lo"], r["hi"]) for r in features.temporal_split(d).groupBy("split").agg(F.min("date").alias("lo"), F.max("date").alias("hi")).collect()}
    assert s["train"][1] < s["validation"][0] and s["validation"][1] < s["test"][0]


def test_sequences_are_padded(spark):
    d = spark.createDataFrame([(f"T{k}", dt.date(2024, 1, 1) + dt.timedelta(i), float(i)) for k in range(12) for i in range(10 - (k == 0))], "ticker string, date date, x double")
    got = {r["ticker"]: r for r in features.sequences(d, ["x"], dt.date(2024, 1, 10), 10).collect()}
    assert len(got) == 12 and {len(r["sequence"]) for r in got.values()} == {10} and got["T0"]["sequence"][0] == [0.0]
    assert features.sequences(d.filter("ticker < 'T2'"), ["x"], dt.date(2024, 1, 10), 10).count() == 0


def test_targets_have_a_mask(spark):
    b = spark.createDataFrame([("A", dt.date(2024, 1, 1), 1.0), ("A", dt.date(2024, 1, 2), 2.0)], "ticker string, date date, close double")
    got = {(r["date"].day, r["horizon_days"]): (r["target"], r["mask"]) for r in features.targets(b, (1, 7)).collect()}
    assert got[(1, 1)] == (1.0, 1) and got[(1, 7)] == (None, 0)


def test_edge_weights_and_measures(spark):
    m = spark.createDataFrame([("AAPL", "tech", "large", "hw"), ("MSFT", "tech", "large", "sw"), ("JPM", "fin", "mid", "bank")], "ticker string, sector string, market_cap string, sub_industry string")
    c = spark.createDataFrame([("AAPL", "MSFT", 0.8), ("MSFT", "AAPL", 0.8), ("AAPL", "JPM", 0.3)], "src string, dst string, corr double")
    w = {(r["src"], r["dst"]): r["weight"] for r in graph.edge_weights(m, c).collect()}
    assert w[("AAPL", "MSFT")] > w[("AAPL", "JPM")] and all(0 <= x <= 1 for x in w.values())
    # a path a-b-c-d and a triangle with a tail, worked by hand
    path = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0)], "u string, v string, weight double")
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "node string")
    assert {r["node"]: round(r["betweenness"], 6) for r in graph.betweenness(path, nodes).collect()} == {"a": 0, "b": round(2 / 3, 6), "c": round(2 / 3, 6), "d": 0}
    assert {r["node"]: round(r["closeness"], 6) for r in graph.closeness(path, nodes).collect()} == {"a": 0.5, "b": 0.75, "c": 0.75, "d": 0.5}
    e = {r["node"]: r["eigenvector"] for r in graph.eigenvector(path, nodes).collect()}
    assert abs(e["b"] / e["a"] - (1 + 5**0.5) / 2) < 1e-3
    tri = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 1.0), ("b", "c", 1.0), ("c", "d", 1.0)], "u string, v string, weight double")
    assert {r["node"]: round(r["clustering"], 4) for r in graph.clustering(tri).collect()} == {"a": 1.0, "b": 1.0, "c": 0.3333, "d": 0.0}
    pr = {r["node"]: r["pagerank"] for r in graph.pagerank(tri, nodes).collect()}
    assert abs(sum(pr.values()) - 1) < 1e-6 and max(pr, key=pr.get) == "c"


def test_components_and_connect(spark):
    e = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.5), ("c", "d", 0.5), ("d", "c", 0.5)], "src string, dst string, weight double")
    n = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    assert {r["node"]: r["component"] for r in graph.components(e, n).collect()} == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "e"}
    assert graph.connect(e, n, "a").count() == 8
    back = graph.from_json(graph.to_json(e))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, e.collect()))
    assert graph.khop_subgraph(e, n.filter("node = 'a'"), 1).count() == 2


def test_macro_features(spark):
    q = spark.createDataFrame([(dt.date(2022 + i // 4, 1 + 3 * (i % 4), 1), "gdp", 100.0 + i) for i in range(8)], "date date, indicator string, value double")
    d = {r["date"]: r for r in macro.derive(q).collect()}
    assert math.isclose(d[dt.date(2023, 1, 1)]["yoy_change"], 4.0) and d[dt.date(2022, 1, 1)]["yoy_change"] is None and d[dt.date(2023, 1, 1)]["zscore"] is None
    w = macro.wide(macro.derive(q), ["gdp"])
    assert w.filter("gdp is null").count() == 0 or w.count() > 300
    assert macro.categorise(spark.createDataFrame([(-1.0,), (-0.35,), (0.0,), (1.0,)], "overall_sentiment_score double")).agg(F.count("category_rank")).first()[0] == 3


def test_bias_at_the_threshold(spark):
    inf, nan = float("inf"), float("nan")
    scores = {"at": [0.1, 0.2, 0.0], "at_low": [-0.1, -0.2, 0.0], "above": [0.1, 0.1, 0.1 + 1e-15], "below": [-0.2, -0.1, -1e-9], "null": [None], "some": [None, 0.5], "huge": [1e20, 1e20], "minus": [-inf, 0.0], "nan": [nan]}
    news = spark.createDataFrame([(k, dt.datetime(2024, 1, 1), s) for k, v in scores.items() for s in v], "symbol string, timestamp timestamp, overall_sentiment_score double")
    got = {r["symbol"]: r["bias"] for r in macro.sentiment_summary(news).collect()}
    assert got == {"at": "neutral", "at_low": "neutral", "above": "bullish", "below": "bearish", "null": "neutral", "some": "bullish", "huge": "bullish", "minus": "bearish", "nan": "bullish"}
    assert {r["bias"]: r["n"] for r in macro.bias_distribution(macro.sentiment_summary(news)).collect()} == {"neutral": 3, "bullish": 4, "bearish": 2}
