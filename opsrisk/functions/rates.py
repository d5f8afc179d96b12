"""Rates, shares and rounding rules."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clipped_ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` held inside [0, 1]; null when either side is null or whole is 0.

    The guard is needed because ``least`` and ``greatest`` skip nulls.
    """
    ratio = F.try_divide(part, whole)
    return F.when(ratio.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)))


def null_skipping_total(columns: Iterable[str]) -> Column:
    """Row-wise sum that takes null as nothing."""
    return reduce(lambda a, b: a + b, (F.coalesce(F.col(c), F.lit(0.0)) for c in columns))


def safe_share(part: Column, total: Column) -> Column:
    """Share of a total; 0 when the part is missing or the total is 0."""
    return F.coalesce(F.try_divide(part, total), F.lit(0.0))


def binary_label(rate: Column, threshold: float) -> Column:
    """1 when the rate is strictly above the threshold."""
    return (rate > F.lit(threshold)).cast("int")


def served_probability(probability: Column) -> Column:
    """Probability as served: four digits, halves to the even digit."""
    return F.bround(probability, 4)


def whole_count(value: Column) -> Column:
    """Nearest whole number, halves to even, never below zero; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0).cast("bigint"), F.bround(value).cast("bigint")))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)
