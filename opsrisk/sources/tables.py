"""Raw CSV scan, clean table, traffic series, metadata and alert sink."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsrisk.constants import DELAY_LABEL_THRESHOLD, MISSING_TOKENS
from opsrisk.functions.rates import nan_to_null
from opsrisk.operators.series import traffic_series
from opsrisk.schemas import ALERT_COLUMNS, ALERT_SCHEMA, CLEAN_SCHEMA, META_SCHEMA, RAW_SCHEMA, TRAFFIC_CSV_SCHEMA
from opsrisk.session import path_exists


def _typed(name: str, kind: T.DataType) -> Column:
    """Text to its type: missing-value tokens become null, other bad text fails the job."""
    text = F.trim(name)
    present = F.when(~text.isin(*MISSING_TOKENS), text)
    if isinstance(kind, T.StringType):
        return present.alias(name)
    if isinstance(kind, T.IntegerType):
        return present.cast("double").cast("int").alias(name)
    return nan_to_null(present.cast(kind)).alias(name)


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw monthly rows; columns are taken by name and others in the file are left out."""
    text = spark.read.option("header", True).option("nullValue", "").csv(path)
    return text.select(*(_typed(f.name, f.dataType) for f in RAW_SCHEMA))


def write_clean(featured: DataFrame, path: str) -> None:
    """The clean table, one folder per year.

    Rebalancing brings the rows of a year together, so that not every task writes
    to every year, and splits large years over several tasks.
    """
    featured.hint("rebalance", "year").write.mode("overwrite").partitionBy("year").parquet(path)


def write_clean_csv(featured: DataFrame, path: str) -> None:
    featured.write.mode("overwrite").option("header", True).csv(path)


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CLEAN_SCHEMA).parquet(path).select(*CLEAN_SCHEMA.names)


def read_traffic_csv(spark: SparkSession, path: str) -> DataFrame:
    return traffic_series(spark.read.schema(TRAFFIC_CSV_SCHEMA).option("header", True).csv(path))


def read_traffic_parquet(spark: SparkSession, path: str) -> DataFrame:
    return traffic_series(spark.read.parquet(path))


def write_meta(meta: DataFrame, path: str) -> None:
    meta.write.mode("append").json(path)


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """Training metadata; empty when none was written yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], META_SCHEMA)
    return spark.read.schema(META_SCHEMA).json(path)


def latest_meta(meta: DataFrame) -> DataFrame:
    """The newest metadata of each series."""
    others = [name for name in META_SCHEMA.names if name != "series_key"]
    return (
        meta.groupBy("series_key")
        .agg(F.max_by(F.struct(*others), F.struct("trained_on", "date_max")).alias("newest"))
        .select("series_key", "newest.*")
    )


def model_health(meta: DataFrame) -> DataFrame:
    """Version and quality of the newest forecast models, with the classifier's threshold."""
    return latest_meta(meta).select(
        "series_key",
        "model_version",
        F.col("mae").alias("traffic_model_mae"),
        F.col("mape_pct").alias("traffic_model_mape_pct"),
        F.lit(DELAY_LABEL_THRESHOLD).alias("delay_threshold"),
    )


def append_alerts(alerts: DataFrame, path: str, batch: str | None = None) -> None:
    """Add alerts to the table at ``path``, one folder per ``batch``, which replaces itself."""
    rows = alerts.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in ALERT_SCHEMA))
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch or uuid4().hex}")


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ALERT_SCHEMA).parquet(path).select(*ALERT_COLUMNS)
