"""Evaluation metrics per horizon from rows (horizon_days, predicted_return, actual_return, confidence_score).

s = sign(prediction) * actual return. Ordered metrics need a total order within a horizon, given as columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import corr, moments_corr
from tapeloom.operators import ordered
from tapeloom.operators.pairs import pairwise
from tapeloom.operators.selection import quantiles
from tapeloom.scratch import cut

KEY = "horizon_days"
YEAR = 252.0
RISK_FREE = 0.02


def _with_s(df: DataFrame) -> DataFrame:
    return df.withColumn("s", F.signum("predicted_return") * F.col("actual_return"))


def basic(df: DataFrame) -> DataFrame:
    e = F.col("predicted_return") - F.col("actual_return")
    g = df.groupBy(KEY).agg(F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.var_pop("actual_return").alias("_v"))
    return g.withColumn("r2", 1 - F.try_divide("mse", "_v")).drop("_v")


def direction(df: DataFrame) -> DataFrame:
    """Accuracy of signs (zero equals zero); precision of ups and downs, 0 if none was predicted."""
    p, a = F.signum("predicted_return"), F.signum("actual_return")
    up = F.try_divide(F.count_if((p > 0) & (a > 0)), F.count_if(p > 0))
    down = F.try_divide(F.count_if((p < 0) & (a < 0)), F.count_if(p < 0))
    return df.groupBy(KEY).agg(F.avg((p == a).cast("double")).alias("direction_accuracy"), F.coalesce(up, F.lit(0.0)).alias("up_precision"), F.coalesce(down, F.lit(0.0)).alias("down_precision"))


def correlation(df: DataFrame, least: int = 10) -> DataFrame:
    c = corr(F.col("predicted_return"), F.col("actual_return"))
    return df.groupBy(KEY).agg(c.alias("correlation"), F.when(F.count("*") >= least, F.coalesce(c, F.lit(0.0))).otherwise(0.0).alias("information_coefficient"))


def _ranked(df: DataFrame, col: str, out: str) -> DataFrame:
    """Add the rank of a value within its horizon, ties at their average, however many rows a horizon has.

    Rows are sorted over all tasks by horizon and value, which keeps equal values together, and written once. A
    rank is the rows of the horizon in the tasks before, which are counted, and those before it in its task.
    """
    dealt = df.repartitionByRange(KEY, col).sortWithinPartitions(KEY, col)
    kept = cut(dealt.withColumn("_task", F.spark_partition_id()), "ranked")
    counts = kept.groupBy(F.col("_task").alias("_t"), F.col(KEY).alias("_k")).agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.sum("_n").over(Window.partitionBy("_k").orderBy("_t")) - F.col("_n")).drop("_n")  # a row a task
    inside = F.rank().over(Window.partitionBy("_task", KEY).orderBy(col)) + (F.count("*").over(Window.partitionBy("_task", KEY, col)) - 1) / 2
    j = kept.withColumn("_inside", inside).join(F.broadcast(starts), (F.col("_task") == F.col("_t")) & F.col(KEY).eqNullSafe(F.col("_k")))
    return j.withColumn(out, F.col("_start") + F.col("_inside")).drop("_task", "_t", "_k", "_inside", "_start")


def rank_correlation(df: DataFrame, least: int = 10) -> DataFrame:
    """Spearman: correlation of ranks, ties at their average."""
    # each sort samples its input first, which is therefore written once
    pair = cut(df.filter("predicted_return is not null and actual_return is not null").select(KEY, "predicted_return", "actual_return"), "pairs")
    j = _ranked(_ranked(pair, "predicted_return", "rp"), "actual_return", "ra")
    x, y = F.col("rp"), F.col("ra")
    c = moments_corr(F.count("*").cast("double"), F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * y), F.sum(x * y))
    return j.groupBy(KEY).agg(F.when(F.count("*") >= least, F.coalesce(c, F.lit(0.0))).otherwise(0.0).alias("rank_ic"))


def ratios(df: DataFrame) -> DataFrame:
    """Sharpe and Sortino from s less the daily risk-free rate; 0 where the deviation is 0 or missing."""
    x = F.col("s") - RISK_FREE / YEAR
    sharpe = F.try_divide(F.avg(x), F.stddev_pop(x)) * F.sqrt(F.lit(YEAR))
    down = F.stddev_pop(F.when(x < 0, x))
    return _with_s(df).groupBy(KEY).agg(F.coalesce(sharpe, F.lit(0.0)).alias("sharpe_ratio"), F.coalesce(F.try_divide(F.avg(x), down) * F.sqrt(F.lit(YEAR)), F.lit(0.0)).alias("sortino_ratio"))


def drawdown(df: DataFrame, order: list[str], stake: float = 1.0) -> DataFrame:
    """Greatest fall of the compounded s from its running maximum, and Calmar; each trade puts in a share `stake` of
    the capital. Rows of a horizon are in the order of `order`, however many there are (see `ordered`)."""
    part = _with_s(df).withColumn("s", F.col("s") * stake).select(KEY, *order, "s")
    c = ordered.running_product(part, [KEY], order, 1 + F.col("s"))
    g = c.groupBy(KEY).agg(F.min(F.try_divide(F.col("running") - F.col("highest"), "highest")).alias("max_drawdown"), F.avg("s").alias("_mean"))
    return g.withColumn("calmar_ratio", F.coalesce(F.try_divide(F.col("_mean") * YEAR, F.abs("max_drawdown")), F.lit(0.0))).drop("_mean")


def tail(df: DataFrame, q: float = 0.05, exact: bool = True) -> DataFrame:
    """Value at risk and the mean beyond it. The quantile is exact by distributed selection, or comes from a mergeable
    sketch of bounded size."""
    s = _with_s(df)
    var = quantiles(s, [KEY], ["s"], [q]).select(KEY, F.col("s")[0].alias("var_95")) if exact else s.groupBy(KEY).agg(F.percentile_approx("s", q, 10_000).alias("var_95"))
    return s.join(var, KEY).groupBy(KEY).agg(F.first("var_95").alias("var_95"), F.avg(F.when(F.col("s") <= F.col("var_95"), F.col("s"))).alias("cvar_95"))


def calibration(df: DataFrame, bins: int = 10, high: float = 0.7) -> DataFrame:
    """Expected calibration error over bins [lo, hi), a confidence of 1 in none; accuracy and share of the confident."""
    hit = (F.signum("predicted_return") == F.signum("actual_return")).cast("double")
    c = F.col("confidence_score")
    b = df.withColumns({"_hit": hit, "_bin": F.when(c < 1, F.floor(c * bins))})
    per = b.groupBy(KEY, "_bin").agg(F.count("*").alias("n"), F.avg("_hit").alias("acc"), F.avg(c).alias("conf"), F.count_if(c > high).alias("hn"), F.sum(F.when(c > high, F.col("_hit"))).alias("hh"))
    gap = F.when(F.col("_bin").between(0, bins - 1), F.abs(F.col("acc") - F.col("conf")) * F.col("n")).otherwise(0.0)
    return per.groupBy(KEY).agg((F.sum(gap) / F.sum("n")).alias("ece"), F.coalesce(F.try_divide(F.sum("hh"), F.sum("hn")), F.lit(0.0)).alias("high_confidence_accuracy"), (F.sum("hn") / F.sum("n")).alias("high_confidence_ratio"))


def trades(df: DataFrame) -> DataFrame:
    """Win rate, mean win and loss (losses hold zero trades), profit factor, hit rates of sizes."""
    s, a = F.col("s"), F.abs("actual_return")
    win = F.sum(F.when(s > 0, s))
    loss = F.abs(F.sum(F.when(s <= 0, s)))
    same = F.signum("predicted_return") == F.signum("actual_return")
    return _with_s(df).groupBy(KEY).agg(
        F.avg((s > 0).cast("double")).alias("win_rate"), F.coalesce(F.avg(F.when(s > 0, s)), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(F.when(s <= 0, s)), F.lit(0.0)).alias("avg_loss"), F.try_divide(win, loss).alias("profit_factor"),
        *[F.coalesce(F.avg(F.when(a > t / 100, same.cast("double"))), F.lit(0.0)).alias(f"hit_rate_{t}pct") for t in (1, 2, 5)],
    )


def all_metrics(df: DataFrame, order: list[str], stake: float = 1.0) -> DataFrame:
    parts = [basic(df), direction(df), correlation(df), rank_correlation(df), ratios(df), drawdown(df, order, stake), tail(df), calibration(df), trades(df)]
    return reduce(lambda x, y: x.join(y, KEY), parts)


def per_date(df: DataFrame) -> DataFrame:
    """One row a date and horizon: means over tickers; bounded input for ordered metrics."""
    return df.groupBy(KEY, "prediction_date").agg(F.avg("predicted_return").alias("predicted_return"), F.avg("actual_return").alias("actual_return"), F.avg("confidence_score").alias("confidence_score"))


def portfolio(weighted: DataFrame) -> DataFrame:
    """Weighted predicted and actual returns of a portfolio per date and horizon."""
    return weighted.groupBy(KEY, "prediction_date").agg(F.sum(F.col("weight") * F.col("predicted_return")).alias("predicted_return"), F.sum(F.col("weight") * F.col("actual_return")).alias("actual_return"), F.sum(F.abs("weight")).alias("exposure"))


def prediction_diversity(predictions: DataFrame) -> DataFrame:
    """Mean correlation between the predictions of two tickers, over dates, and one less it, per horizon."""
    pair = pairwise(predictions, KEY, date="prediction_date", value="predicted_return")
    return pair.groupBy(KEY).agg(F.avg("corr").alias("avg_correlation")).withColumn("diversification", 1 - F.col("avg_correlation"))


def report(metrics: DataFrame, columns=("direction_accuracy", "sharpe_ratio", "max_drawdown")) -> DataFrame:
    """Rows of horizons and a row of their means."""
    rows = metrics.select(F.col(KEY).cast("string").alias("horizon"), *columns)
    return rows.unionByName(metrics.agg(F.lit("average").alias("horizon"), *[F.avg(c).alias(c) for c in columns]))
