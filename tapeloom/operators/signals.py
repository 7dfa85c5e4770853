"""Forward returns, trading signals, portfolio weights and prediction checks. Predictions are long:
ticker, prediction_date, horizon_days, predicted_return, confidence_score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import corr, series

HORIZONS = (1, 7, 30, 60)


def melt_predictions(wide: DataFrame, horizons=HORIZONS) -> DataFrame:
    """horizon_{h}d and confidence_{h}d columns to one row a horizon."""
    each = F.array(*[F.struct(F.lit(h).alias("horizon_days"), F.col(f"horizon_{h}d").alias("predicted_return"), F.col(f"confidence_{h}d").alias("confidence_score")) for h in horizons])
    return wide.select("ticker", "prediction_date", F.inline(each)).filter("predicted_return is not null")


def spread_predictions(long: DataFrame, horizons=HORIZONS) -> DataFrame:
    p = long.groupBy("ticker", "prediction_date").pivot("horizon_days", list(horizons)).agg(F.first("predicted_return").alias("r"), F.first("confidence_score").alias("c"))
    return p.withColumnsRenamed({f"{h}_{x}": f"{n}_{h}d" for h in horizons for x, n in (("r", "horizon"), ("c", "confidence"))})


def forward_by_row(bars: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Returns over the next h rows of a ticker: ticker, date, horizon_days, actual_return."""
    w = series()
    wide = bars.select("ticker", "date", *[(F.try_divide(F.lead("close", h).over(w), F.col("close")) - 1).alias(str(h)) for h in horizons])
    return wide.unpivot(["ticker", "date"], [str(h) for h in horizons], "h", "actual_return").select("ticker", "date", F.col("h").cast("int").alias("horizon_days"), "actual_return")


def evaluate_by_row(predictions: DataFrame, bars: DataFrame) -> DataFrame:
    """Predictions beside the return over the next h rows of bars."""
    actual = forward_by_row(bars).withColumnRenamed("date", "prediction_date")
    return predictions.join(actual, ["ticker", "prediction_date", "horizon_days"]).filter("actual_return is not null")


def evaluate_by_day(predictions: DataFrame, bars: DataFrame) -> DataFrame:
    """Predictions beside the return to the bar exactly h calendar days later."""
    now = bars.select("ticker", F.col("date").alias("prediction_date"), F.col("close").alias("close_now"))
    then = bars.select("ticker", F.col("date").alias("_then"), F.col("close").alias("close_then"))
    p = predictions.join(now, ["ticker", "prediction_date"]).withColumn("_then", F.date_add("prediction_date", F.col("horizon_days").cast("int")))
    return p.join(then, ["ticker", "_then"]).drop("_then").withColumn("actual_return", F.try_divide("close_then", "close_now") - 1)


def evaluate_by_prediction(predictions: DataFrame, bars: DataFrame, rows: int = 1) -> DataFrame:
    """Predictions beside the return to the bar at the ticker's next prediction, `rows` predictions on."""
    p = predictions.join(bars.select("ticker", F.col("date").alias("prediction_date"), "close"), ["ticker", "prediction_date"])
    w = series(["ticker", "horizon_days"], "prediction_date")
    return p.withColumn("actual_return", F.try_divide(F.lead("close", rows).over(w), F.col("close")) - 1).filter("actual_return is not null")


def performance(evaluated: DataFrame) -> DataFrame:
    """Count, direction accuracy, correlation, MAE and RMSE per horizon."""
    p, a = F.col("predicted_return"), F.col("actual_return")
    return evaluated.groupBy("horizon_days").agg(
        F.count("*").alias("predictions"), F.avg((F.signum(p) == F.signum(a)).cast("double")).alias("direction_accuracy"), corr(p, a).alias("correlation"), F.avg(F.abs(p - a)).alias("mae"), F.sqrt(F.avg(F.pow(p - a, F.lit(2)))).alias("rmse")
    )


def horizon_performance(evaluated: DataFrame) -> DataFrame:
    g = evaluated.groupBy("horizon_days").agg(F.count("*").alias("predictions"), F.avg((F.signum("predicted_return") == F.signum("actual_return")).cast("double")).alias("direction_accuracy"), F.avg("actual_return").alias("avg_return"), F.stddev("actual_return").alias("std_return"))
    return g.withColumn("sharpe", F.try_divide("avg_return", "std_return") * F.sqrt(F.lit(252.0)))


def signals(predictions: DataFrame, least_confidence: float = 0.6, least_return: float = 0.02) -> DataFrame:
    """BUY and SELL for confident and large predictions, ranked by strength within date and horizon."""
    r = F.col("predicted_return")
    s = predictions.filter((F.col("confidence_score") >= least_confidence) & (F.abs(r) >= least_return))
    s = s.withColumns({"signal": F.when(r > 0, "BUY").otherwise("SELL"), "strength": F.abs(r) * F.col("confidence_score")})
    return s.withColumn("rank", F.dense_rank().over(Window.partitionBy("prediction_date", "horizon_days").orderBy(F.desc("strength"))))


def top_ranked(ranked: DataFrame, k: int) -> DataFrame:
    """The k best of each date and horizon; equal ranks by ticker."""
    w = Window.partitionBy("prediction_date", "horizon_days").orderBy("rank", "ticker")
    return ranked.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def allocate(ranked: DataFrame, most: int = 20, equal: bool = False) -> DataFrame:
    """Signed weights of the best signals: absolute weights of a date and horizon add up to 1."""
    w = Window.partitionBy("prediction_date", "horizon_days")
    s = F.lit(1.0) if equal else F.col("strength")
    return top_ranked(ranked, most).withColumn("weight", F.try_divide(s, F.sum(s).over(w)) * F.when(F.col("signal") == "BUY", 1).otherwise(-1))


def latest_predictions(predictions: DataFrame, limit: int | None = None, as_of=None, tickers: list[str] | None = None) -> DataFrame:
    """Predictions of the latest date, or of the latest up to a date, for all or some tickers."""
    p = predictions.filter(F.col("prediction_date") <= F.lit(as_of).cast("date")) if as_of else predictions
    p = p.filter(F.col("ticker").isin(tickers)) if tickers else p
    top = p.agg(F.max("prediction_date").alias("_top"))
    p = p.join(F.broadcast(top), F.col("prediction_date") == F.col("_top"), "left_semi").orderBy(F.desc("confidence_score"), "ticker", "horizon_days")  # one row
    return p.limit(limit) if limit else p


def strongest(predictions: DataFrame, k: int = 10, least_confidence: float = 0.7) -> DataFrame:
    p = latest_predictions(predictions).filter(F.col("confidence_score") > least_confidence).withColumn("abs_prediction", F.abs("predicted_return"))
    return p.orderBy(F.desc("abs_prediction"), "ticker", "horizon_days").limit(k)


def history(predictions: DataFrame, ticker: str, limit: int = 100) -> DataFrame:
    return predictions.filter(F.col("ticker") == ticker).orderBy(F.desc("prediction_date"), "horizon_days").limit(limit)


def accuracy_by_confidence(evaluated: DataFrame) -> DataFrame:
    """Direction accuracy in right-closed bins of confidence up to .5, .6, .7, .8, .9 and 1."""
    c = F.col("confidence_score")
    label = F.when(c <= 0, None)
    for lo, hi in ((0.0, 0.5), (0.5, 0.6), (0.6, 0.7), (0.7, 0.8), (0.8, 0.9), (0.9, 1.0)):
        label = label.when(c <= hi, f"({lo:g},{hi:g}]")
    hit = (F.signum("predicted_return") == F.signum("actual_return")).cast("double")
    return evaluated.withColumn("confidence_bin", label).filter("confidence_bin is not null").groupBy("confidence_bin").agg(F.avg(hit).alias("accuracy"), F.count("*").alias("n"))


def expected_portfolio(predictions: DataFrame, k: int = 5) -> DataFrame:
    """Expected return of equal parts of the k best predictions of the latest date, per horizon."""
    p = latest_predictions(predictions)
    w = Window.partitionBy("horizon_days").orderBy(F.desc("predicted_return"), "ticker")
    return p.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).groupBy("horizon_days").agg(F.avg("predicted_return").alias("expected_return"), F.count("*").alias("positions"))


def validate(evaluated: DataFrame, outlier: float = 0.5, share: float = 0.01) -> DataFrame:
    p, a = F.col("predicted_return"), F.col("actual_return")
    g = evaluated.groupBy("horizon_days").agg(F.count("*").alias("n"), F.count_if(F.abs(p) > outlier).alias("outliers"), F.avg(F.abs(p - a)).alias("mae"), F.sqrt(F.avg(F.pow(p - a, F.lit(2)))).alias("rmse"), F.avg((F.signum(p) == F.signum(a)).cast("double")).alias("direction_accuracy"))
    return g.withColumn("outlier_warning", F.try_divide("outliers", "n") > share)


def latest_model(models: DataFrame) -> DataFrame:
    """The row of the model that was created last; of equal times the greatest version. No model, no row."""
    return models.orderBy(F.desc_nulls_last("created_at"), F.desc("model_version")).limit(1)


def deployment_gate(metrics: DataFrame, direction: float = 0.52, sharpe: float = 0.5, drawdown: float = -0.2, least: int = 2) -> DataFrame:
    """Whether enough horizons meet all limits; a missing metric counts as met."""
    met = lambda c, ok: F.coalesce(ok, F.lit(True))
    good = met("d", F.col("direction_accuracy") >= direction) & met("s", F.col("sharpe_ratio") >= sharpe) & met("m", F.col("max_drawdown") >= drawdown)
    return metrics.agg(F.count("*").alias("horizons"), F.count_if(good).alias("passed"), (F.count_if(good) >= least).alias("deploy"))


def business_day_batches(features: DataFrame, start, end) -> DataFrame:
    """Feature rows of every weekday of a range, ready for one transform of the model."""
    spark = features.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date")).filter(F.weekday("date") < 5)
    return features.join(days, "date", "left_semi")


def with_ids(predictions: DataFrame, created) -> DataFrame:
    """Rows for storage: an id from ticker, date and horizon, and the time of creation, a parameter."""
    return predictions.withColumns({"prediction_id": F.sha2(F.concat_ws("|", "ticker", "prediction_date", "horizon_days"), 256), "created_at": F.lit(created).cast("timestamp")})
