"""Queries over predictions: forward returns, signals, portfolios, metrics, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import rounded
from tapeloom.operators import features, metrics, signals
from tapeloom.plans import fixtures as fx
from tapeloom.plans.registry import query

P = ("bars_daily", "predictions")
EV = {
    "a": " UNION ALL ".join(f"SELECT ticker, date AS prediction_date, {h} AS horizon_days, lead(close, {h}) OVER (PARTITION BY ticker ORDER BY date) / nullif(close, 0) - 1 AS actual_return FROM bars_daily" for h in (1, 7, 30, 60)),
    "ev": "SELECT p.*, a.actual_return, sign(p.predicted_return) * a.actual_return AS s FROM predictions p JOIN a USING (ticker, prediction_date, horizon_days) WHERE a.actual_return IS NOT NULL",
}


def _evaluated(spark, sf):
    return signals.evaluate_by_row(fx.predictions(spark, sf), fx.bars_daily(spark, sf))


@query("p9_unpivot_predictions", ("bars_daily", "predictions"), "SELECT ticker, prediction_date, horizon_days, round(predicted_return, 6) AS predicted_return, round(confidence_score, 6) AS confidence_score FROM predictions")
def _(spark, sf):
    return rounded(signals.melt_predictions(signals.spread_predictions(fx.predictions(spark, sf))), 6)


@query("r1_forward_by_row", P, "SELECT ticker, prediction_date, horizon_days, round(predicted_return, 6) AS predicted_return, round(confidence_score, 6) AS confidence_score, round(actual_return, 6) AS actual_return FROM ev", EV)
def _(spark, sf):
    return rounded(_evaluated(spark, sf), 6)


@query("r2_j4_forward_by_day", P, "SELECT p.ticker, p.prediction_date, p.horizon_days, round(t.close / n.close - 1, 6) AS actual_return FROM predictions p JOIN bars_daily n ON n.ticker = p.ticker AND n.date = p.prediction_date JOIN bars_daily t ON t.ticker = p.ticker AND t.date = p.prediction_date + p.horizon_days")
def _(spark, sf):
    return rounded(signals.evaluate_by_day(fx.predictions(spark, sf), fx.bars_daily(spark, sf)).select("ticker", "prediction_date", "horizon_days", "actual_return"), 6)


@query("r3_forward_by_prediction", P, "SELECT * FROM (SELECT p.ticker, prediction_date, horizon_days, round(lead(close) OVER (PARTITION BY p.ticker, horizon_days ORDER BY prediction_date) / close - 1, 6) AS actual_return FROM predictions p JOIN bars_daily b ON b.ticker = p.ticker AND b.date = prediction_date WHERE prediction_date < DATE '1999-01-01') WHERE actual_return IS NOT NULL")
def _(spark, sf):
    p = fx.predictions(spark, sf).filter("prediction_date < '1999-01-01'")
    return rounded(signals.evaluate_by_prediction(p, fx.bars_daily(spark, sf)).select("ticker", "prediction_date", "horizon_days", "actual_return"), 6)


HIT = "(sign(predicted_return) = sign(actual_return))::INT"


@query("a5_model_performance", P, f"SELECT horizon_days, count(*) AS predictions, round(avg({HIT}), 6) AS direction_accuracy, round(corr(predicted_return, actual_return), 6) AS correlation, round(avg(abs(predicted_return - actual_return)), 5) AS mae, round(sqrt(avg(pow(predicted_return - actual_return, 2))), 5) AS rmse FROM ev GROUP BY horizon_days", EV)
def _(spark, sf):
    return rounded(signals.performance(_evaluated(spark, sf)), {"mae": 5, "rmse": 5})


@query("a6_horizon_performance", P, f"SELECT horizon_days, count(*) AS predictions, round(avg({HIT}), 6) AS direction_accuracy, round(avg(actual_return), 5) AS avg_return, round(stddev(actual_return), 5) AS std_return, round(avg(actual_return) / stddev(actual_return) * sqrt(252), 5) AS sharpe FROM ev GROUP BY horizon_days", EV)
def _(spark, sf):
    return rounded(signals.horizon_performance(_evaluated(spark, sf)), {"avg_return": 5, "std_return": 5, "sharpe": 5})


SIG = {"sig": """SELECT *, CASE WHEN predicted_return > 0 THEN 'BUY' ELSE 'SELL' END AS signal, abs(predicted_return) * confidence_score AS strength,
 dense_rank() OVER (PARTITION BY prediction_date, horizon_days ORDER BY abs(predicted_return) * confidence_score DESC) AS rank FROM predictions WHERE confidence_score >= 0.3 AND abs(predicted_return) >= 0.02""",
       "top": "SELECT * FROM sig QUALIFY row_number() OVER (PARTITION BY prediction_date, horizon_days ORDER BY rank, ticker) <= 5"}


def _signals(spark, sf):
    return signals.signals(fx.predictions(spark, sf), 0.3, 0.02)


@query("r4_w11_signals", P, "SELECT ticker, prediction_date, horizon_days, signal, round(strength, 6) AS strength, rank FROM sig", SIG)
def _(spark, sf):
    return rounded(_signals(spark, sf).select("ticker", "prediction_date", "horizon_days", "signal", "strength", "rank"), 6)


@query("r5_allocation", P, "SELECT ticker, prediction_date, horizon_days, round(strength / sum(strength) OVER (PARTITION BY prediction_date, horizon_days) * CASE signal WHEN 'BUY' THEN 1 ELSE -1 END, 6) AS weight FROM top", SIG)
def _(spark, sf):
    return rounded(signals.allocate(_signals(spark, sf), 5).select("ticker", "prediction_date", "horizon_days", "weight"), 6)


@query("r6_t3_signals_by_horizon", P, "SELECT ticker, prediction_date, horizon_days, rank FROM top WHERE horizon_days = 7", SIG)
def _(spark, sf):
    return signals.top_ranked(_signals(spark, sf).filter("horizon_days = 7"), 5).select("ticker", "prediction_date", "horizon_days", "rank")


@query("r7_f4_t1_latest_predictions", P, "SELECT ticker, prediction_date, horizon_days, round(predicted_return, 6) AS predicted_return FROM predictions WHERE prediction_date = (SELECT max(prediction_date) FROM predictions WHERE prediction_date <= DATE '2001-01-15')")
def _(spark, sf):
    return rounded(signals.latest_predictions(fx.predictions(spark, sf), as_of="2001-01-15").select("ticker", "prediction_date", "horizon_days", "predicted_return"), 6)


@query("t4_strongest_predictions", P, "SELECT ticker, horizon_days, round(abs(predicted_return), 6) AS abs_prediction FROM predictions WHERE prediction_date = (SELECT max(prediction_date) FROM predictions) AND confidence_score > 0.02 ORDER BY abs(predicted_return) DESC, ticker, horizon_days LIMIT 10")
def _(spark, sf):
    return rounded(signals.strongest(fx.predictions(spark, sf), 10, 0.02).select("ticker", "horizon_days", "abs_prediction"), 6)


@query("t8_prediction_history", P, "SELECT prediction_date, horizon_days, round(predicted_return, 6) AS predicted_return FROM predictions WHERE ticker = 'NATION_3' ORDER BY prediction_date DESC, horizon_days LIMIT 100")
def _(spark, sf):
    return rounded(signals.history(fx.predictions(spark, sf), "NATION_3").select("prediction_date", "horizon_days", "predicted_return"), 6)


@query("a23_accuracy_by_confidence", P, f"""SELECT CASE WHEN c <= 0.5 THEN '(0,0.5]' WHEN c <= 0.6 THEN '(0.5,0.6]' WHEN c <= 0.7 THEN '(0.6,0.7]' WHEN c <= 0.8 THEN '(0.7,0.8]' WHEN c <= 0.9 THEN '(0.8,0.9]' ELSE '(0.9,1]' END AS confidence_bin, round(avg({HIT}), 6) AS accuracy, count(*) AS n FROM (SELECT *, confidence_score AS c FROM ev) GROUP BY 1""", EV)
def _(spark, sf):
    return rounded(signals.accuracy_by_confidence(_evaluated(spark, sf)), 6)


@query("r8_business_day_batches", ("bars_daily",), "SELECT ticker, date, close FROM bars_daily WHERE date BETWEEN DATE '1999-03-01' AND DATE '1999-04-30' AND isodow(date) <= 5")
def _(spark, sf):
    return signals.business_day_batches(fx.bars_daily(spark, sf).select("ticker", "date", "close"), "1999-03-01", "1999-04-30")


@query("r9_prediction_ids", P, "SELECT ticker, prediction_date, horizon_days, sha256(ticker || '|' || prediction_date::VARCHAR || '|' || horizon_days::VARCHAR) AS prediction_id FROM predictions")
def _(spark, sf):
    return signals.with_ids(fx.predictions(spark, sf), "2001-08-02").select("ticker", "prediction_date", "horizon_days", "prediction_id")


@query("r10_expected_portfolio", P, "SELECT horizon_days, round(avg(predicted_return), 6) AS expected_return, count(*) AS positions FROM (SELECT * FROM predictions WHERE prediction_date = (SELECT max(prediction_date) FROM predictions) QUALIFY row_number() OVER (PARTITION BY horizon_days ORDER BY predicted_return DESC, ticker) <= 5) GROUP BY horizon_days")
def _(spark, sf):
    return rounded(signals.expected_portfolio(fx.predictions(spark, sf)), 6)


@query("r11_validation", P, f"SELECT horizon_days, count(*) AS n, count(*) FILTER (abs(predicted_return) > 0.5) AS outliers, round(avg(abs(predicted_return - actual_return)), 5) AS mae, round(sqrt(avg(pow(predicted_return - actual_return, 2))), 5) AS rmse, round(avg({HIT}), 6) AS direction_accuracy, count(*) FILTER (abs(predicted_return) > 0.5) / count(*) > 0.01 AS outlier_warning FROM ev GROUP BY horizon_days", EV)
def _(spark, sf):
    return rounded(signals.validate(_evaluated(spark, sf)), {"mae": 5, "rmse": 5})


@query("r13a_errors", P, "SELECT horizon_days, round(avg(pow(predicted_return - actual_return, 2)), 4) AS mse, round(sqrt(avg(pow(predicted_return - actual_return, 2))), 5) AS rmse, round(avg(abs(predicted_return - actual_return)), 5) AS mae, round(1 - avg(pow(predicted_return - actual_return, 2)) / var_pop(actual_return), 5) AS r2 FROM ev GROUP BY horizon_days", EV)
def _(spark, sf):
    return rounded(metrics.basic(_evaluated(spark, sf)), {"mse": 4, "rmse": 5, "mae": 5, "r2": 5})


@query("r13b_direction", P, f"SELECT horizon_days, round(avg({HIT}), 6) AS direction_accuracy, round(coalesce(avg((actual_return > 0)::INT) FILTER (predicted_return > 0), 0), 6) AS up_precision, round(coalesce(avg((actual_return < 0)::INT) FILTER (predicted_return < 0), 0), 6) AS down_precision FROM ev GROUP BY horizon_days", EV)
def _(spark, sf):
    return rounded(metrics.direction(_evaluated(spark, sf)), 6)


@query("r13c_correlation", P, "SELECT horizon_days, round(corr(predicted_return, actual_return), 6) AS correlation, round(CASE WHEN count(*) >= 10 THEN corr(predicted_return, actual_return) ELSE 0 END, 6) AS information_coefficient FROM ev GROUP BY horizon_days", EV)
def _(spark, sf):
    return rounded(metrics.correlation(_evaluated(spark, sf)), 6)


@query("r13d_rank_ic", P, "SELECT horizon_days, round(corr(a, b), 6) AS rank_ic FROM (SELECT horizon_days, rank() OVER (PARTITION BY horizon_days ORDER BY predicted_return) + (count(*) OVER (PARTITION BY horizon_days, predicted_return) - 1) / 2 AS a, rank() OVER (PARTITION BY horizon_days ORDER BY actual_return) + (count(*) OVER (PARTITION BY horizon_days, actual_return) - 1) / 2 AS b FROM ev) GROUP BY horizon_days", EV)
def _(spark, sf):
    return rounded(metrics.rank_correlation(_evaluated(spark, sf)), 6)


@query("r13e_r13f_ratios", P, "SELECT horizon_days, round(coalesce(avg(x) / nullif(stddev_pop(x), 0) * sqrt(252), 0), 5) AS sharpe_ratio, round(coalesce(avg(x) / nullif(stddev_pop(x) FILTER (x < 0), 0) * sqrt(252), 0), 5) AS sortino_ratio FROM (SELECT horizon_days, s - 0.02 / 252 AS x FROM ev) GROUP BY horizon_days", EV)
def _(spark, sf):
    return rounded(metrics.ratios(_evaluated(spark, sf)), 5)


PD = EV | {"pd": "SELECT horizon_days, prediction_date, avg(predicted_return) AS p, avg(actual_return) AS a FROM ev GROUP BY 1, 2", "sm": "SELECT *, sign(p) * a * 0.01 AS s FROM pd",
           "cum": "SELECT *, product(1 + s) OVER w AS c FROM sm WINDOW w AS (PARTITION BY horizon_days ORDER BY prediction_date ROWS UNBOUNDED PRECEDING)"}


@query("r13g_r13h_drawdown", P, "SELECT horizon_days, round(min((c - m) / m), 5) AS max_drawdown, round(coalesce(avg(s) * 252 / nullif(abs(min((c - m) / m)), 0), 0), 4) AS calmar_ratio FROM (SELECT *, max(c) OVER (PARTITION BY horizon_days ORDER BY prediction_date ROWS UNBOUNDED PRECEDING) AS m FROM cum) GROUP BY horizon_days", PD)
def _(spark, sf):
    return rounded(metrics.drawdown(metrics.per_date(_evaluated(spark, sf)), ["prediction_date"], stake=0.01), {"max_drawdown": 5, "calmar_ratio": 4})


@query("r13i_r13j_tail", P, "SELECT horizon_days, round(max(v), 6) AS var_95, round(avg(s) FILTER (s <= v), 5) AS cvar_95 FROM ev JOIN (SELECT horizon_days, quantile_cont(s, 0.05) AS v FROM ev GROUP BY horizon_days) USING (horizon_days) GROUP BY horizon_days", EV)
def _(spark, sf):
    return rounded(metrics.tail(_evaluated(spark, sf)), {"cvar_95": 5})


@query("r13k_calibration", P, f"""SELECT horizon_days, round(sum(CASE WHEN b IS NOT NULL THEN abs(acc - conf) * n ELSE 0 END) / sum(n), 6) AS ece, round(coalesce(sum(hh) / nullif(sum(hn), 0), 0), 6) AS high_confidence_accuracy, round(sum(hn) / sum(n), 6) AS high_confidence_ratio FROM
 (SELECT horizon_days, CASE WHEN confidence_score < 1 THEN floor(confidence_score * 10) END AS b, count(*) AS n, avg({HIT}) AS acc, avg(confidence_score) AS conf, count(*) FILTER (confidence_score > 0.7) AS hn, sum({HIT}) FILTER (confidence_score > 0.7) AS hh FROM ev GROUP BY 1, 2) GROUP BY horizon_days""", EV)
def _(spark, sf):
    return rounded(metrics.calibration(_evaluated(spark, sf)), 6)


@query("r13l_trades", P, f"""SELECT horizon_days, round(avg((s > 0)::INT), 6) AS win_rate, round(coalesce(avg(s) FILTER (s > 0), 0), 5) AS avg_win, round(coalesce(avg(s) FILTER (s <= 0), 0), 5) AS avg_loss, round(sum(s) FILTER (s > 0) / nullif(abs(sum(s) FILTER (s <= 0)), 0), 5) AS profit_factor,
 """ + ", ".join(f"round(coalesce(avg({HIT}) FILTER (abs(actual_return) > {t / 100}), 0), 6) AS hit_rate_{t}pct" for t in (1, 2, 5)) + " FROM ev GROUP BY horizon_days", EV)
def _(spark, sf):
    return rounded(metrics.trades(_evaluated(spark, sf)), {"avg_win": 5, "avg_loss": 5, "profit_factor": 5})


@query("r13m_r15_report", P, """SELECT horizon_days::VARCHAR AS horizon, round(d, 5) AS direction_accuracy, round(x, 5) AS sharpe_ratio, round(m, 5) AS max_drawdown FROM rep
 UNION ALL SELECT 'average', round(avg(d), 5), round(avg(x), 5), round(avg(m), 5) FROM rep""", PD | {
    "top": "SELECT *, max(c) OVER (PARTITION BY horizon_days ORDER BY prediction_date ROWS UNBOUNDED PRECEDING) AS m FROM cum",
    "fall": "SELECT horizon_days, min((c - m) / m) AS m FROM top GROUP BY 1",
    "rep": "SELECT horizon_days, avg((sign(p) = sign(a))::INT) AS d, avg(sign(p) * a - 0.02 / 252) / stddev_pop(sign(p) * a - 0.02 / 252) * sqrt(252) AS x, any_value(fall.m) AS m FROM pd JOIN fall USING (horizon_days) GROUP BY horizon_days"})
def _(spark, sf):
    return rounded(metrics.report(metrics.all_metrics(metrics.per_date(_evaluated(spark, sf)), ["prediction_date"], stake=0.01)), 5)


@query("t2_latest_model", (), "SELECT o_orderkey AS model_version, o_orderdate::DATE AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def _(spark, sf):
    models = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("model_version"), F.to_date("o_orderdate").alias("created_at"))
    return signals.latest_model(models)


GATE = PD | {
    "top": "SELECT *, max(c) OVER (PARTITION BY horizon_days ORDER BY prediction_date ROWS UNBOUNDED PRECEDING) AS m FROM cum", "fall": "SELECT horizon_days, min((c - m) / m) AS m FROM top GROUP BY 1",
    "gate": f"SELECT horizon_days, avg({HIT}) AS d, avg(s - 0.02 / 252) / stddev_pop(s - 0.02 / 252) * sqrt(252) AS x FROM ev GROUP BY horizon_days"}


@query("r12_deployment_gate", P, "SELECT count(*) AS horizons, count(*) FILTER (d >= 0.40 AND x >= -50 AND m >= -0.9) AS passed, count(*) FILTER (d >= 0.40 AND x >= -50 AND m >= -0.9) >= 2 AS deploy FROM gate JOIN fall USING (horizon_days)", GATE)
def _(spark, sf):
    """All three limits, the fall of one hundredth of the capital a day among them."""
    e = _evaluated(spark, sf)
    fall = metrics.drawdown(metrics.per_date(e), ["prediction_date"], stake=0.01).select("horizon_days", "max_drawdown")
    return signals.deployment_gate(metrics.direction(e).join(metrics.ratios(e), "horizon_days").join(fall, "horizon_days"), 0.40, -50.0, -0.9)


FULL = EV | {
    "pd": "SELECT horizon_days, prediction_date, avg(predicted_return) AS p, avg(actual_return) AS a FROM ev GROUP BY 1, 2", "sm": "SELECT horizon_days, prediction_date, greatest(least(sign(p) * a, 0.5), -0.5) AS s FROM pd",
    "cum": "SELECT *, product(1 + s) OVER w AS c FROM sm WINDOW w AS (PARTITION BY horizon_days ORDER BY prediction_date ROWS UNBOUNDED PRECEDING)",
    "top": "SELECT *, max(c) OVER (PARTITION BY horizon_days ORDER BY prediction_date ROWS UNBOUNDED PRECEDING) AS m FROM cum"}


@query("r13h_full_stake", P, "SELECT horizon_days, round(min((c - m) / m), 6) AS max_drawdown, round(coalesce(avg(s) * 252 / nullif(abs(min((c - m) / m)), 0), 0), 5) AS calmar_ratio FROM top GROUP BY horizon_days", FULL)
def _(spark, sf):
    """The whole capital in each day's trade; a day's return is held within a half, as invented prices jump."""
    d = metrics.per_date(_evaluated(spark, sf))
    held = d.withColumn("actual_return", F.greatest(F.least("actual_return", F.lit(0.5)), F.lit(-0.5)))
    return rounded(metrics.drawdown(held, ["prediction_date"]), {"max_drawdown": 6, "calmar_ratio": 5})


@query("r14_portfolio", P, "SELECT horizon_days, prediction_date, round(sum(weight * predicted_return), 6) AS predicted_return, round(sum(weight * actual_return), 6) AS actual_return, round(sum(abs(weight)), 6) AS exposure FROM al JOIN a USING (ticker, prediction_date, horizon_days) WHERE actual_return IS NOT NULL GROUP BY 1, 2",
       EV | SIG | {"al": "SELECT *, strength / sum(strength) OVER (PARTITION BY prediction_date, horizon_days) * CASE signal WHEN 'BUY' THEN 1 ELSE -1 END AS weight FROM top"})
def _(spark, sf):
    w = signals.allocate(_signals(spark, sf), 5)
    return rounded(metrics.portfolio(signals.evaluate_by_row(w, fx.bars_daily(spark, sf))), 6)


@query("r14_diversity", P, "SELECT horizon_days, round(avg(c), 5) AS avg_correlation, round(1 - avg(c), 5) AS diversification FROM (SELECT a.horizon_days, a.ticker AS t1, b.ticker AS t2, CASE WHEN min(a.predicted_return) < max(a.predicted_return) AND min(b.predicted_return) < max(b.predicted_return) THEN corr(a.predicted_return, b.predicted_return) END AS c FROM predictions a JOIN predictions b ON a.horizon_days = b.horizon_days AND a.prediction_date = b.prediction_date AND a.ticker < b.ticker GROUP BY 1, 2, 3) GROUP BY horizon_days")
def _(spark, sf):
    return rounded(metrics.prediction_diversity(fx.predictions(spark, sf)), 5)


@query("j3_prediction_join", P, "SELECT p.ticker, p.prediction_date, p.horizon_days, b.close FROM predictions p JOIN bars_daily b ON b.ticker = p.ticker AND b.date = p.prediction_date WHERE p.horizon_days = 30")
def _(spark, sf):
    b = fx.bars_daily(spark, sf).select("ticker", F.col("date").alias("prediction_date"), "close")
    return fx.predictions(spark, sf).filter("horizon_days = 30").join(b, ["ticker", "prediction_date"]).select("ticker", "prediction_date", "horizon_days", "close")


@query("j2_feature_read", ("bars_daily",), "SELECT ticker, date, close FROM bars_daily WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' AND ticker IN ('NATION_1', 'NATION_4') ORDER BY ticker, date")
def _(spark, sf):
    return features.read_features(fx.bars_daily(spark, sf).select("ticker", "date", "close"), "1998-01-01", "1998-12-31", ["NATION_1", "NATION_4"])
