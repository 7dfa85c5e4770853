"""Data quality: bar and indicator validation, keys, nulls, freshness, fingerprints, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import rolling, series

PRICES = ("open", "high", "low", "close")
PRICE_RULES = {"high_below_low": "high < low", "high_below_open": "high < open", "high_below_close": "high < close", "low_above_open": "low > open", "low_above_close": "low > close"}
# The rules that are checked by default.
INTEGRITY_RULES = {"high_not_below_low": "high >= low", "close_positive": "close > 0", "volume_not_negative": "volume >= 0", "close_within_range": "close BETWEEN low AND high"}
NUMBERS = {"double", "float", "bigint", "int", "decimal"}
EXPECTED_TYPES = {"date": {"date", "timestamp", "timestamp_ntz"}, **{c: {"double", "float"} for c in PRICES}, "volume": {"bigint", "int", "double"}}


def price_consistency(bars: DataFrame) -> DataFrame:
    """Broken price rules, one row a rule: rule, broken."""
    wide = bars.agg(*[F.count_if(F.expr(sql)).alias(rule) for rule, sql in PRICE_RULES.items()])
    return wide.unpivot([], list(PRICE_RULES), "rule", "broken")


def volume_validity(bars: DataFrame, most_zero: float = 0.1) -> DataFrame:
    g = bars.agg(F.count_if(F.col("volume") < 0).alias("negative"), F.coalesce(F.try_divide(F.count_if(F.col("volume") == 0), F.count("*")), F.lit(0.0)).alias("zero_share"))
    return g.withColumn("valid", (F.col("negative") == 0) & (F.col("zero_share") <= most_zero))


def date_gaps(bars: DataFrame, most_days: int = 14) -> DataFrame:
    """Gaps between neighbouring bars of a ticker above the limit: ticker, date, previous_date, gap_days."""
    before = F.lag("date").over(series())
    return bars.select("ticker", "date", before.alias("previous_date")).withColumn("gap_days", F.datediff("date", "previous_date")).filter(F.col("gap_days") > most_days)


def price_outliers(bars: DataFrame, n: int = 20, k: float = 5.0, include_self: bool = True) -> DataFrame:
    """Bars further than k deviations from the rolling mean. A window that holds the bar itself can't exceed
    (n - 1) / sqrt(n) deviations; `include_self=False` takes the n bars before it."""
    w = series()
    x = F.col("close")
    if include_self:
        mean, sd = rolling(F.avg, x, w, n, 1), rolling(F.stddev_samp, x, w, n, 1)
    else:
        over = w.rowsBetween(-n, -1)
        mean, sd = F.avg(x).over(over), F.stddev_samp(x).over(over)
    return bars.withColumns({"_m": mean, "_s": sd}).filter(F.abs(x - F.col("_m")) > k * F.col("_s")).drop("_m", "_s")


def type_issues(df: DataFrame, expected: dict[str, set[str]] = EXPECTED_TYPES) -> list[str]:
    """Columns whose type isn't among the expected ones; read from the schema, no job."""
    have = {f.name: f.dataType.simpleString().split("(")[0] for f in df.schema}
    return [f"{c}: {have[c]}" for c, kinds in expected.items() if c in have and have[c] not in kinds]


def type_report(df: DataFrame, expected: dict[str, set[str]] = EXPECTED_TYPES) -> DataFrame:
    """The columns of unexpected type as rows: column, type."""
    rows = [tuple(t.split(": ", 1)) for t in type_issues(df, expected)]
    return df.sparkSession.createDataFrame(rows, "column string, type string")


def table_statistics(df: DataFrame) -> DataFrame:
    """Rows, files and bytes of a dataset beside the statistics of its closes and volumes: one row."""
    from tapeloom.operators.bars import price_statistics
    from tapeloom.sources.files import dataset_info

    return dataset_info(df).crossJoin(F.broadcast(price_statistics(df)))  # one row each


def validate_bars(bars: DataFrame, required=("date", *PRICES, "volume")) -> DataFrame:
    """Issues found in a bar table: check, found. Missing columns end the check."""
    spark = bars.sparkSession
    missing = [c for c in required if c not in bars.columns]
    rows = [("missing_column", c) for c in missing] + [("type", t) for t in type_issues(bars)]
    fixed = spark.createDataFrame(rows or [("", "")], "check string, found string").filter("check != ''")
    if missing:
        return fixed
    prices = price_consistency(bars).filter("broken > 0").select(F.concat(F.lit("price: "), "rule").alias("check"), F.col("broken").cast("string").alias("found"))
    volume = volume_validity(bars).filter("not valid").select(F.lit("volume").alias("check"), F.concat_ws(" ", "negative", "zero_share").alias("found"))
    with_key = bars if "ticker" in bars.columns else bars.withColumn("ticker", F.lit(""))
    gaps = date_gaps(with_key).agg(F.count("*").alias("n")).filter("n > 0").select(F.lit("date_gap").alias("check"), F.col("n").cast("string").alias("found"))
    far = price_outliers(with_key).agg(F.count("*").alias("n")).filter("n > 0").select(F.lit("outlier").alias("check"), F.col("n").cast("string").alias("found"))
    return fixed.unionByName(prices).unionByName(volume).unionByName(gaps).unionByName(far)


def validate_indicators(df: DataFrame, most_null: float = 0.3) -> DataFrame:
    """Range and null checks by column name: RSI in 0..100, correlations and percentages in -1..1, one pass."""
    def limits(c: str):
        name = c.lower()
        return (0.0, 100.0) if "rsi" in name else (-1.0, 1.0) if "corr" in name or "percent" in name else None

    columns = [f.name for f in df.schema if f.dataType.simpleString().split("(")[0] in NUMBERS]
    each = [F.struct(F.lit(c).alias("indicator"), (F.count_if((F.col(c) < r[0]) | (F.col(c) > r[1])) if (r := limits(c)) else F.lit(0).cast("long")).alias("out_of_range"), F.try_divide(F.count_if(F.col(c).isNull()), F.count("*")).alias("null_ratio")) for c in columns]
    return df.agg(F.array(*each).alias("x")).select(F.inline("x")).withColumn("valid", (F.col("out_of_range") == 0) & (F.coalesce("null_ratio", F.lit(0.0)) <= most_null))


def column_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Non-null, null share, distinct, range, mean, deviation of each column; prices pass if above 0."""
    def of(c: str):
        x = F.col(c).cast("double")
        return F.struct(F.lit(c).alias("column"), F.count(x).alias("non_null"), (F.try_divide(F.count_if(x.isNull()), F.count("*")) * 100).alias("null_pct"), F.countDistinct(x).alias("distinct"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev(x).alias("std"),
                        (F.coalesce(F.min(x) > 0, F.lit(False)) if c in PRICES else F.lit(True)).alias("passed"))

    return df.agg(F.array(*map(of, columns)).alias("x")).select(F.inline("x"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).unpivot([], columns, "column", "nulls")


def freshness(df: DataFrame, as_of, col: str = "date") -> DataFrame:
    return df.agg(F.max(col).alias("latest"), F.min(col).alias("earliest"), F.countDistinct(col).alias("dates")).withColumn("days_old", F.datediff(F.lit(as_of).cast("date"), "latest"))


def integrity(df: DataFrame, rules: dict[str, str] = INTEGRITY_RULES) -> DataFrame:
    from tapeloom.operators.bars import violations

    return violations(df, rules)


def fingerprint(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Order-free fingerprint of a table, or of each of its partitions `by`: records, fingerprint.

    Rows are spelled column by column in name order (null, and a bar within a value, as signs that no value's spelling has) and hashed by MD5;
    60 bits of it are added up, so equal rows don't cancel. Fingerprints of parts that share no row add up to the whole.
    """
    plain = lambda c: F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\p"))
    spelled = F.concat_ws("|", *[F.coalesce(plain(c), F.lit("\\n")) for c in sorted(df.columns)])
    h = F.conv(F.substring(F.md5(spelled), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*by).agg(F.count("*").alias("records"), F.coalesce(F.sum(h), F.lit(0)).cast("decimal(38,0)").alias("fingerprint"))


def fold_fingerprints(parts: DataFrame) -> DataFrame:
    """The fingerprint of a table from those of its partitions."""
    return parts.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum("fingerprint"), F.lit(0)).cast("decimal(38,0)").alias("fingerprint"))


def differing_partitions(one: DataFrame, two: DataFrame, by: list[str]) -> DataFrame:
    """Partitions whose fingerprints differ or that only one table has: by, records and fingerprint of both."""
    a, b = (fingerprint(x, by).withColumnsRenamed({"records": f"records_{i}", "fingerprint": f"fingerprint_{i}"}) for i, x in ((1, one), (2, two)))
    b = b.withColumnsRenamed({c: f"_{c}" for c in by})
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    j = a.join(b, on, "full").filter(~(F.col("fingerprint_1").eqNullSafe(F.col("fingerprint_2")) & F.col("records_1").eqNullSafe(F.col("records_2"))))
    return j.select(*[F.when(F.col("records_1").isNotNull(), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in by], "records_1", "fingerprint_1", "records_2", "fingerprint_2")


def file_checksum(df: DataFrame) -> DataFrame:
    """SHA-256 over the sorted names and sizes of the files that a frame reads."""
    files = df.select("_metadata.file_name", "_metadata.file_size").distinct()
    return files.agg(F.sha2(F.array_join(F.sort_array(F.collect_set(F.concat_ws(":", "file_name", "file_size"))), "\n"), 256).alias("checksum"))


def table_check(df: DataFrame, keys: list[str], critical: list[str], as_of) -> DataFrame:
    """Count, duplicates, nulls and age in one row."""
    dup = duplicate_keys(df, keys).agg(F.count("*").alias("duplicate_keys"))
    one = df.agg(F.count("*").alias("records"), F.max("date").alias("latest"), F.datediff(F.lit(as_of).cast("date"), F.max("date")).alias("days_old"), sum(F.count_if(F.col(c).isNull()) for c in critical).alias("nulls"))
    return one.crossJoin(F.broadcast(dup))  # one row each


def indicator_coverage(bars: DataFrame, indicators: DataFrame, as_of) -> DataFrame:
    """Tickers with a bar at a date, those of them that have indicators of that ticker and date, and their ratio."""
    at = F.col("date") == F.lit(as_of).cast("date")
    have = indicators.filter(at).select("ticker").distinct().withColumn("_has", F.lit(True))
    pairs = bars.filter(at).select("ticker").distinct().join(have, "ticker", "left")
    return pairs.agg(F.count("*").alias("tickers"), F.count("_has").alias("with_indicators")).withColumn("coverage", F.try_divide("with_indicators", "tickers"))


def coverage_ratios(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns]).unpivot([], columns, "indicator", "coverage")


def completeness(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct("ticker").alias("tickers"), F.count("*").alias("records"), F.countDistinct("date").alias("dates"), F.min("date").alias("first"), F.max("date").alias("last"))


def daily_gate(bars: DataFrame, indicators: DataFrame, as_of, tickers: int = 10, days: int = 2, coverage: float = 0.9) -> DataFrame:
    """Whether enough tickers have bars, the latest are fresh, and enough tickers of the as-of date have indicators.

    Without a bar at that date there is no coverage and the gate doesn't pass.
    """
    c = completeness(bars).crossJoin(F.broadcast(indicator_coverage(bars, indicators, as_of).select("coverage")))  # one row each
    old = F.datediff(F.lit(as_of).cast("date"), "last")
    passed = (F.col("tickers") >= tickers) & (F.col("days_old") <= days) & (F.col("coverage") >= coverage)
    return c.select("tickers", "records", old.alias("days_old"), "coverage").withColumn("passed", F.coalesce(passed, F.lit(False)))


def training_gate(df: DataFrame, rsi: str = "rsi_14", tickers: int = 20, dates: int = 250, warn: float = 0.8) -> DataFrame:
    g = df.agg(F.countDistinct("ticker").alias("tickers"), F.countDistinct("date").alias("dates"), F.avg(F.col(rsi).isNotNull().cast("double")).alias("rsi_coverage"))
    return g.withColumns({"passed": (F.col("tickers") >= tickers) & (F.col("dates") >= dates), "warning": F.col("rsi_coverage") < warn})


def histogram(df: DataFrame, column: str, lo: float, hi: float, bins: int = 50) -> DataFrame:
    return df.filter(F.col(column).between(lo, hi)).groupBy(F.least(F.width_bucket(column, F.lit(lo), F.lit(hi), F.lit(bins)), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


