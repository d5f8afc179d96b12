"""The seed rows as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opsrisk.schemas import REQUEST_SCHEMA, SEED_ROWS


def seed_requests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SEED_ROWS), REQUEST_SCHEMA)


def seed_for(history: DataFrame) -> DataFrame:
    """The literal rule: all seed rows for an empty history, otherwise none."""
    seed = seed_requests(history.sparkSession)
    return seed if history.isEmpty() else seed.limit(0)
