"""Cleaning of the raw monthly table and its audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsrisk.functions.rates import clipped_ratio


def clean(raw: DataFrame) -> DataFrame:
    """Rows with recorded activity, with their delay rate."""
    return (
        raw.na.drop("any", subset=["arr_flights", "arr_del15"])
        .filter(F.col("arr_flights") > 0)
        .withColumn("delay_rate", clipped_ratio(F.col("arr_del15"), F.col("arr_flights")))
    )


def clean_audit(raw: DataFrame) -> DataFrame:
    """What cleaning dropped and clipped, counted in one pass."""
    recorded = F.col("arr_flights").isNotNull() & F.col("arr_del15").isNotNull()
    usable = recorded & (F.col("arr_flights") > 0)
    counts = raw.agg(
        F.count("*").alias("raw_rows"),
        F.count_if(~recorded).alias("dropped_missing"),
        F.count_if(recorded & ~usable).alias("dropped_zero_flights"),
        F.count_if(usable & (F.col("arr_del15") > F.col("arr_flights"))).alias("clipped_rates"),
        F.count_if(usable).alias("clean_rows"),
    )
    share = F.try_divide(F.col("dropped_missing") * F.lit(100.0), F.col("raw_rows"))
    return counts.withColumn("dropped_missing_pct", F.round(F.coalesce(share, F.lit(0.0)), 2))


def clean_sample(cleaned: DataFrame, rows: int = 3) -> DataFrame:
    """The first rows in key order."""
    return cleaned.orderBy("year", "month", "carrier", "airport").limit(rows)
