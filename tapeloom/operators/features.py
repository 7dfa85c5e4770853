"""Feature view, preparation of training rows, sequences, targets and the per-horizon return model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import series
from tapeloom.operators.selection import quantiles

IDS = ("ticker", "date", "sector", "name")


def feature_view(bars: DataFrame, indicators: DataFrame, sentiment: DataFrame, calendar: DataFrame, metadata: DataFrame, as_of, years: int = 2) -> DataFrame:
    """Bars of the last years with indicators and sentiment (ticker, date), calendar (date) and metadata (ticker)."""
    recent = bars.filter(F.col("date") >= F.add_months(F.lit(as_of).cast("date"), -12 * years))
    return recent.join(indicators, ["ticker", "date"], "left").join(sentiment, ["ticker", "date"], "left").join(calendar, "date", "left").join(metadata, "ticker", "left")


def read_features(view: DataFrame, start, end, tickers: list[str] | None = None) -> DataFrame:
    v = view.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return (v.filter(F.col("ticker").isin(tickers)) if tickers else v).orderBy("ticker", "date")


def feature_columns(df: DataFrame, ids=IDS) -> list[str]:
    return [f.name for f in df.schema if f.name not in ids and f.dataType.simpleString() in ("double", "float", "int", "bigint")]


def impute(df: DataFrame, columns: list[str], rows: int = 5) -> DataFrame:
    """Missing values by the mean of what the last rows of the ticker hold."""
    over = series().rowsBetween(1 - rows, 0)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.avg(c).over(over)) for c in columns})


def robust_stats(train: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """Quartiles of each column, fitted on training rows only: one row. They are exact by distributed selection, or
    come from mergeable sketches of bounded size."""
    if exact:
        return quantiles(train, [], columns, [0.25, 0.5, 0.75])
    return train.agg(*[F.percentile_approx(c, [0.25, 0.5, 0.75], 10_000).alias(c) for c in columns])


def robust_scale(df: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    j = df.crossJoin(F.broadcast(stats.select(*[F.col(c).alias(f"_{c}") for c in columns])))  # one row
    return j.withColumns({c: F.try_divide(F.col(c) - F.col(f"_{c}")[1], F.col(f"_{c}")[2] - F.col(f"_{c}")[0]) for c in columns}).select(*df.columns)


def temporal_split(df: DataFrame, train: float = 0.7, validation: float = 0.15, col: str = "date") -> DataFrame:
    """`split` by position among the sorted distinct dates: a boundary date belongs to the earlier part."""
    days = df.select(col).distinct()
    w = Window.partitionBy(F.lit(0)).orderBy(col)  # one row a date
    ranked = days.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(F.lit(0)))})
    t, v = F.floor(F.col("_n") * train), F.floor(F.col("_n") * (train + validation))
    return df.join(ranked.withColumn("split", F.when(F.col("_i") <= t, "train").when(F.col("_i") <= v, "validation").otherwise("test")).select(col, "split"), col)


def sequences(df: DataFrame, columns: list[str], as_of, lookback: int, share: float = 0.8, least_tickers: int = 10) -> DataFrame:
    """For tickers with enough rows in (as_of - lookback, as_of]: sequence padded with zeros on the left, and the
    last row as node features. Fewer tickers than the limit give no rows."""
    end = F.lit(as_of).cast("date")
    part = df.filter((F.col("date") > F.date_sub(end, lookback)) & (F.col("date") <= end))
    row = F.struct("date", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]).alias("x"))
    g = part.groupBy("ticker").agg(F.sort_array(F.collect_list(row)).alias("s")).filter(F.size("s") >= share * lookback)
    all_rows = Window.partitionBy(F.lit(0))  # one row a ticker
    g = g.withColumns({"_n": F.count("*").over(all_rows), "_max": F.max(F.size("s")).over(all_rows)}).filter(F.col("_n") >= least_tickers)
    zeros = F.array_repeat(F.array(*[F.lit(0.0)] * len(columns)), (F.col("_max") - F.size("s")).cast("int"))
    return g.select("ticker", F.size("s").alias("length"), F.concat(zeros, F.transform("s", lambda r: r["x"])).alias("sequence"), F.element_at("s", -1)["x"].alias("node_features"))


def edge_index(edges: DataFrame, tickers: DataFrame) -> DataFrame:
    """Edges between known tickers by their position in name order, from 0."""
    ids = tickers.select("ticker").distinct().withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ticker")) - 1)  # a dimension
    a, b = ids.withColumnsRenamed({"ticker": "src", "i": "src_index"}), ids.withColumnsRenamed({"ticker": "dst", "i": "dst_index"})
    return edges.join(a, "src").join(b, "dst").select("src_index", "dst_index", "weight")


def targets(bars: DataFrame, horizons=(1, 7, 30, 60)) -> DataFrame:
    """Return to the bar h calendar days later; null with mask 0 where there is none."""
    days = bars.select("ticker", "date", "close", F.explode(F.array(*map(F.lit, horizons))).alias("horizon_days")).withColumn("_then", F.expr("date_add(date, horizon_days)"))
    then = bars.select("ticker", F.col("date").alias("_then"), F.col("close").alias("_close"))
    j = days.join(then, ["ticker", "_then"], "left").withColumn("target", F.try_divide("_close", "close") - 1)
    return j.select("ticker", "date", "horizon_days", "target", F.col("target").isNotNull().cast("int").alias("mask"))


def neighbour_means(features: DataFrame, edges: DataFrame, columns: list[str]) -> DataFrame:
    """Edge-weighted means of the neighbours' features on the same date."""
    j = edges.join(features.withColumnRenamed("ticker", "dst"), "dst")
    return j.groupBy(F.col("src").alias("ticker"), "date").agg(*[F.try_divide(F.sum(F.col("weight") * F.col(c)), F.sum(F.when(F.col(c).isNotNull(), F.col("weight")))).alias(f"neighbour_{c}") for c in columns])


def fit_return_models(rows: DataFrame, columns: list[str], horizons=(1, 7, 30, 60), penalty: float = 0.01) -> DataFrame:
    """Ridge regressions of the target on columns, one a horizon: horizon_days, means, weights, target_mean, bins.

    All horizons come from one aggregate of means and products over the training rows, whose size is that of the
    columns; the weights solve (S + penalty) w = c with the covariances S of columns and c of columns and target. `bins`
    is the direction accuracy of validation predictions in ten bins of size, which serves as confidence. Rows with a
    null among columns or target don't count; a horizon without training rows has no model.
    """
    full = rows.filter(F.col("horizon_days").isin(list(horizons)) & F.col("target").isNotNull()).dropna(subset=columns)
    p = len(columns)
    names = [*columns, "target"]
    train = full.filter("split = 'train'")
    # covariances about the means, so that nothing cancels
    sums = [F.avg(c).alias(f"m{i}") for i, c in enumerate(names)] + [F.covar_pop(names[i], names[j]).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p + 1)]
    fitted = []
    for r in train.groupBy("horizon_days").agg(*sums).collect():  # a row a horizon
        s = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) + penalty * np.eye(p)
        w = np.linalg.solve(s, np.array([r[f"s{i}_{p}"] for i in range(p)]))
        fitted.append((r["horizon_days"], [r[f"m{i}"] for i in range(p)], w.tolist(), r[f"m{p}"]))
    models = rows.sparkSession.createDataFrame(fitted, "horizon_days int, means array<double>, weights array<double>, target_mean double")
    checked = _predicted(full.filter("split = 'validation'"), models, columns)
    hits = checked.groupBy("horizon_days", _size().alias("bin")).agg(F.avg((F.signum("predicted_return") == F.signum("target")).cast("double")).alias("confidence"))
    bins = hits.groupBy("horizon_days").agg(F.map_from_entries(F.collect_list(F.struct("bin", "confidence"))).alias("bins"))  # ten rows a horizon
    return models.join(bins, "horizon_days", "left")


def _size():
    return F.least(F.floor(F.abs("predicted_return") * 100), F.lit(9)).cast("int")


def _predicted(rows: DataFrame, models: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a horizon (or of each, if they have none) with the prediction of its model."""
    m = F.broadcast(models)  # a row a horizon
    j = rows.join(m, "horizon_days") if "horizon_days" in rows.columns else rows.crossJoin(m)
    terms = [(F.col(c) - F.col("means")[i]) * F.col("weights")[i] for i, c in enumerate(columns)]
    return j.withColumn("predicted_return", sum(terms, F.col("target_mean")))


def predict_returns(features: DataFrame, models: DataFrame, columns: list[str]) -> DataFrame:
    """Long predictions of all horizons: ticker, prediction_date, horizon_days, predicted_return, confidence_score."""
    p = _predicted(features.dropna(subset=columns), models, columns)
    return p.select("ticker", F.col("date").alias("prediction_date"), "horizon_days", "predicted_return", F.coalesce(F.try_element_at("bins", _size()), F.lit(0.5)).alias("confidence_score"))

