"""Declared tables: columns with required or nullable, partition and clustering columns, retention days."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The declared tables. A column with "!" is required.
TABLES = {
    "bars_daily": ("ticker string!, date date!, open double, high double, low double, close double, volume bigint, adjusted_close double, inserted_at timestamp", "date", ("ticker",), 365),
    "bars_hourly": ("ticker string!, datetime timestamp_ntz!, date date!, hour int, open double, high double, low double, close double, volume bigint, adjusted_close double, inserted_at timestamp", "date", ("ticker", "hour"), 365),
    "indicators": ("ticker string!, date date!, rsi_14 double, macd double, macd_signal double, macd_hist double, sma_20 double, sma_50 double, ema_20 double, bb_upper double, bb_middle double, bb_lower double, atr_14 double, adx double, obv double, vwap double, inserted_at timestamp", "date", ("ticker",), 365),
    "macro": ("date date!, indicator string!, value double, inserted_at timestamp", "date", ("indicator",), -1),
    "sentiment": ("symbol string!, timestamp timestamp_ntz!, date date, title string, overall_sentiment_score double, source string, inserted_at timestamp", "date", ("symbol",), 365),
    "calendar": ("date date!, day_of_week int, month int, quarter int, is_holiday int, is_trading_day int, days_to_next_holiday int, days_to_quarter_end int", None, (), -1),
    "metadata": ("ticker string!, name string, sector string, market_cap string, sub_industry string", None, ("sector",), -1),
    "predictions": ("prediction_id string!, ticker string!, prediction_date date!, horizon_days int!, predicted_return double, confidence_score double, created_at timestamp", "prediction_date", ("ticker", "horizon_days"), 365),
    "job_log": ("job_name string!, started_at timestamp, finished_at timestamp, duration_seconds double, success boolean, detail string", None, (), 90),
    "backfill_progress": ("backfill_id string!, status string, symbols array<string>, start_date date, end_date date, months_total bigint, months_done bigint, started_at timestamp, updated_at timestamp, error string", None, (), -1),
    "backfill_checkpoints": ("backfill_id string!, symbol string!, year int!, month int!, data_type string!, status string, rows_fetched bigint, error string, created_at timestamp", None, ("symbol",), -1),
}


@dataclass(frozen=True)
class Table:
    name: str
    schema: T.StructType
    partition: str | None
    cluster: tuple[str, ...]
    days: int


def table(name: str) -> Table:
    ddl, partition, cluster, days = TABLES[name]
    required = {part.strip().split(" ")[0] for part in ddl.split(", ") if part.endswith("!")}
    fields = T.StructType.fromDDL(ddl.replace("!", "")).fields
    return Table(name, T.StructType([T.StructField(f.name, f.dataType, f.name not in required) for f in fields]), partition, cluster, days)


def conform(df: DataFrame, t: Table) -> DataFrame:
    """Columns of the table in its order and types; absent nullable ones are null, further ones are kept last."""
    missing = [f.name for f in t.schema if not f.nullable and f.name not in df.columns]
    if missing:
        raise ValueError(f"{t.name} needs {', '.join(missing)}")
    own = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in t.schema]
    return df.select(*own, *[c for c in df.columns if c not in t.schema.names])
