"""Daily series: shape, tail, extension, calendar features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opsrisk.constants import (
    FOOTFALL_FLOOR,
    FORECAST_DAYS,
    HOLDOUT_DAYS,
    MAX_FORECAST_DAYS,
    TREND_LOOKBACK,
)
from opsrisk.functions.calendar import HOLIDAY_NAMES, seasonal_effect, us_holiday, weekly_effect
from opsrisk.operators.joins import stored_groups

KEY = "series_key"
CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
YEARLY_ORDER = 10
WEEKLY_ORDER = 3
YEARLY_PERIOD = 365.25
WEEKLY_PERIOD = 7.0


def traffic_series(raw: DataFrame) -> DataFrame:
    """The series under its working names, dates parsed."""
    renamed = raw.withColumnsRenamed({"date": "ds", "passenger_footfall": "y"})
    if KEY not in renamed.columns:
        renamed = renamed.withColumn(KEY, F.lit("ALL"))
    return renamed.select(KEY, F.to_date("ds").alias("ds"), F.col("y").cast("bigint").alias("y"))


def traffic_profile(series: DataFrame) -> DataFrame:
    return series.groupBy(KEY).agg(
        F.min("ds").alias("date_min"), F.max("ds").alias("date_max"), F.count("*").alias("n")
    )


def last_rows(series: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest rows of each series."""
    newest = Window.partitionBy(KEY).orderBy(F.desc("ds"))
    return (
        series.withColumn("recency", F.row_number().over(newest))
        .filter(F.col("recency") <= n)
        .drop("recency")
    )


def holdout_split(series: DataFrame, holdout_days: int = HOLDOUT_DAYS) -> DataFrame:
    """``is_holdout`` for the rows of the newest days of each series.

    A day counts once, however many rows it has. Days are merged before they are
    numbered, and Spark keeps no more than the newest per task before it
    shuffles; the first of them then tells all rows apart.
    """
    days = series.select(KEY, "ds").distinct()
    newest = last_rows(days, holdout_days).groupBy(KEY).agg(F.min("ds").alias("first_recent"))
    return series.join(newest, KEY).select(
        KEY, "ds", "y", (F.col("ds") >= F.col("first_recent")).alias("is_holdout")
    )


def traffic_trend(series: DataFrame, lookback: int = TREND_LOOKBACK) -> DataFrame:
    """Last day, last value and mean daily change over the newest rows of each series.

    The change is divided by the number of rows, not by the gaps between them.
    """
    return (
        last_rows(series, lookback)
        .groupBy(KEY)
        .agg(
            F.max("ds").alias("last_ds"),
            F.max_by("y", "ds").alias("last_y"),
            F.min_by("y", "ds").alias("first_y"),
            F.count("*").alias("recent_rows"),
        )
        .select(
            KEY,
            "last_ds",
            "last_y",
            ((F.col("last_y") - F.col("first_y")) / F.col("recent_rows")).alias("slope"),
        )
    )


def missing_days(trend: DataFrame, until: Column) -> DataFrame:
    """The days after the last one up to ``until``, numbered from 1; none when it is not later."""
    behind = trend.withColumn("until", until).filter(F.col("last_ds") < F.col("until"))
    days = F.sequence(F.date_add("last_ds", 1), F.col("until"))
    return (
        behind.withColumn("ds", F.explode(days))
        .withColumn("step", F.date_diff("ds", "last_ds"))
        .drop("until")
    )


def gaussian(key: Column, day: Column, seed: int) -> Column:
    """A standard normal number for each key and day, the same however the rows are partitioned.

    Two uniform numbers, of 52 bits each, are read from a digest of seed, key and
    day, and turned into a normal one (Box-Muller).
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(key, F.lit("")), day.cast("string")))
    first, second = (F.conv(F.substring(digest, at, 13), 16, 10).cast("double") / F.lit(2.0**52) for at in (1, 14))
    return F.sqrt(-2 * F.log(1 - first)) * F.cos(2 * math.pi * second)


def extrapolated(days: DataFrame, noise_sd: float = 0.0, seed: int = 0) -> DataFrame:
    """Trend plus weekday and seasonal effect, not below the floor, cut to a whole number."""
    value = (
        F.col("last_y")
        + F.col("step") * F.col("slope")
        + weekly_effect(F.col("ds"))
        + seasonal_effect(F.col("ds"))
    )
    if noise_sd:
        value = value + gaussian(F.col(KEY), F.col("ds"), seed) * noise_sd
    return days.select(
        KEY, "ds", F.greatest(F.lit(float(FOOTFALL_FLOOR)), value).cast("bigint").alias("y")
    )


def extend_series(
    series: DataFrame,
    as_of: str,
    lookback: int = TREND_LOOKBACK,
    noise_sd: float = 0.0,
    seed: int = 0,
) -> DataFrame:
    """The series carried on to ``as_of`` by its recent trend.

    Without noise the result is a function of the input; a noise of
    ``constants.NOISE_SD`` with a seed gives the scattered variant.
    """
    days = missing_days(traffic_trend(series, lookback), F.lit(as_of).cast("date"))
    return series.select(KEY, "ds", "y").unionByName(extrapolated(days, noise_sd, seed))


def checked_days(days: int) -> int:
    if not 1 <= days <= MAX_FORECAST_DAYS:
        raise ValueError(f"days must be between 1 and {MAX_FORECAST_DAYS}, not {days}")
    return days


def future_days(series: DataFrame, days: int = FORECAST_DAYS) -> DataFrame:
    """The days after the last one of each series."""
    checked_days(days)
    last = series.groupBy(KEY).agg(F.max("ds").alias("last_ds"))
    return missing_days(last, F.date_add("last_ds", days)).select(KEY, "ds")


def with_holiday(series: DataFrame) -> DataFrame:
    return series.withColumn("holiday", us_holiday("ds"))


def changepoints() -> list[float]:
    """Places of trend changes on the scaled time axis, evenly over its first part."""
    return [CHANGEPOINT_RANGE * (i + 1) / CHANGEPOINTS for i in range(CHANGEPOINTS)]


def scaled_time(start: str = "start_ds", end: str = "end_ds") -> Column:
    """0 on the first training day and 1 on the last."""
    return F.date_diff("ds", start) / F.greatest(F.date_diff(end, start), F.lit(1))


def regression_features() -> dict[str, str]:
    """Trend, trend changes, yearly and weekly waves and holidays.

    Expressions over ``ds``, the scaled time ``t`` and ``holiday``.
    """
    terms = {"t": "t"}
    for i, place in enumerate(changepoints(), start=1):
        terms[f"bend_{i}"] = f"greatest(0D, t - {place!r}D)"
    for name, period, order in (("yearly", YEARLY_PERIOD, YEARLY_ORDER), ("weekly", WEEKLY_PERIOD, WEEKLY_ORDER)):
        for k in range(1, order + 1):
            angle = f"unix_date(ds) * {2 * math.pi * k / period!r}D"
            terms[f"{name}_sin_{k}"] = f"sin({angle})"
            terms[f"{name}_cos_{k}"] = f"cos({angle})"
    for i, holiday in enumerate(HOLIDAY_NAMES, start=1):
        quoted = holiday.replace("'", "\\'")
        terms[f"holiday_{i}"] = f"double(holiday <=> '{quoted}')"
    return terms


def with_group_range(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows with the first and last day of their series, of which ``ranges`` has one row each.

    ``ranges`` is written first, so that Spark knows its size when it picks the join.
    """
    kept = stored_groups(ranges).withColumnRenamed(KEY, "range_key")
    return rows.join(kept, F.col(KEY).eqNullSafe(F.col("range_key"))).drop("range_key")


def with_training_range(series: DataFrame) -> DataFrame:
    """Rows with the first and last day of their series.

    The rows of a series are its days, so a partition of this window is bounded
    by the calendar.
    """
    whole = Window.partitionBy(KEY)
    return series.withColumns({"start_ds": F.min("ds").over(whole), "end_ds": F.max("ds").over(whole)})


def traffic_features(series: DataFrame) -> DataFrame:
    """The regression features as columns, for inspection."""
    timed = with_holiday(with_training_range(series)).withColumn("t", scaled_time())
    terms = regression_features()
    return timed.selectExpr(KEY, "ds", "y", *(f"{term} AS {name}" for name, term in terms.items()))
