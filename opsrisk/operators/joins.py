"""Attaching group values to the rows they were made from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsrisk.session import scratch_path


def stored_groups(groups: DataFrame) -> DataFrame:
    """One row per key, computed once as a table in the shared folder and read back."""
    path = scratch_path(groups.sparkSession, "group-values")
    groups.write.parquet(path)
    return groups.sparkSession.read.schema(groups.schema).parquet(path)


def attach_group_values(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Left-join one row per key onto ``rows``.

    ``groups`` is computed once, as a table in the shared folder that is read
    back without a hint. Spark broadcasts it if its measured size allows;
    otherwise it is a shuffle join, whose hot keys adaptive execution splits.
    """
    return rows.join(stored_groups(groups), keys, "left")


def group_sums(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sum and count of a value per key combination, combined before the shuffle."""
    return rows.groupBy(*keys).agg(F.sum(value).alias("value_sum"), F.count(value).alias("value_rows"))
