"""Request validation, derivation of missing features, and naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsrisk.constants import (
    DEFAULT_AIRPORT_RATE,
    DEFAULT_CARRIER_RATE,
    DEFAULT_FLIGHTS,
    REQUEST_NAMES,
    RESPONSE_NAMES,
)
from opsrisk.functions.calendar import is_summer, is_winter_holiday, years_since_base

# --- fixed values: limits and messages of the request fields --------------------
# field, lowest, message below it, highest, message above it
REQUEST_RULES = (
    ("year", 2013.0, "year must be >= 2013", 2030.0, "year must be <= 2030"),
    ("month", 1.0, "month must be between 1 and 12", 12.0, "month must be between 1 and 12"),
    ("arr_flights", 1.0, "arr_flights must be >= 1", None, None),
    ("is_summer", 0.0, "must be greater than or equal to 0", 1.0, "must be less than or equal to 1"),
    ("is_winter_holiday", 0.0, "must be greater than or equal to 0", 1.0, "must be less than or equal to 1"),
    ("years_since_2013", 0.0, "must be greater than or equal to 0", None, None),
    ("airport_avg_delay_rate", 0.0, "must be greater than or equal to 0.0", 1.0, "must be less than or equal to 1.0"),
    ("carrier_avg_delay_rate", 0.0, "must be greater than or equal to 0.0", 1.0, "must be less than or equal to 1.0"),
)
REQUIRED_SUFFIX = " is required"


def violations() -> Column:
    """Messages of the rules a request breaks, in field order; empty when valid.

    A NaN is no number within any limits and breaks the lower one, although
    Spark orders it above all numbers.
    """
    found = []
    for field, low, below, high, above in REQUEST_RULES:
        value = F.col(field)
        found.append(F.when(value.isNull(), F.lit(field + REQUIRED_SUFFIX)))
        found.append(F.when((value < low) | F.isnan(value), F.lit(below)))
        if high is not None:
            found.append(F.when((value > high) & ~F.isnan(value), F.lit(above)))
    return F.array_compact(F.array(*found))


def validate(requests: DataFrame) -> DataFrame:
    """Requests with the list of broken rules and whether there are none."""
    return requests.withColumn("violations", violations()).withColumn(
        "is_valid", F.size("violations") == 0
    )


def valid_rows(validated: DataFrame) -> DataFrame:
    return validated.filter("is_valid").drop("violations", "is_valid")


def quarantine(validated: DataFrame) -> DataFrame:
    """Rejected requests with one joined message each."""
    return (
        validated.filter("NOT is_valid")
        .withColumn("message", F.array_join("violations", ", "))
        .drop("violations", "is_valid")
    )


def validation_report(validated: DataFrame) -> DataFrame:
    """How often each message occurred, by row and in all."""
    return (
        validated.select(F.explode("violations").alias("message"))
        .groupBy("message")
        .agg(F.count("*").alias("n"))
    )


def derive_features(requests: DataFrame, defaults: bool = False) -> DataFrame:
    """Fill calendar features a request lacks from its year and month.

    With ``defaults`` the measures it lacks take the monitoring job's fixed values.
    """
    filled = {
        "is_summer": F.coalesce("is_summer", is_summer(F.col("month")).cast("double")),
        "is_winter_holiday": F.coalesce(
            "is_winter_holiday", is_winter_holiday(F.col("month")).cast("double")
        ),
        "years_since_2013": F.coalesce(
            "years_since_2013", years_since_base(F.col("year")).cast("double")
        ),
    }
    if defaults:
        filled |= {
            "arr_flights": F.coalesce("arr_flights", F.lit(DEFAULT_FLIGHTS)),
            "airport_avg_delay_rate": F.coalesce("airport_avg_delay_rate", F.lit(DEFAULT_AIRPORT_RATE)),
            "carrier_avg_delay_rate": F.coalesce("carrier_avg_delay_rate", F.lit(DEFAULT_CARRIER_RATE)),
        }
    return requests.withColumns(filled)


def monitoring_requests(moments: DataFrame, at: str) -> DataFrame:
    """One request per moment, with that month's calendar features and the fixed measures."""
    day = F.col(at)
    empty = F.lit(None).cast("double")
    requests = moments.select(
        at,
        F.year(day).cast("double").alias("year"),
        F.month(day).cast("double").alias("month"),
        *(empty.alias(name) for name, *_ in REQUEST_RULES[2:]),
    )
    return derive_features(requests, defaults=True)


def from_public_names(requests: DataFrame) -> DataFrame:
    return requests.withColumnsRenamed(REQUEST_NAMES)


def to_public_names(responses: DataFrame) -> DataFrame:
    """Responses under their public names, other columns left out."""
    return responses.select(*RESPONSE_NAMES).withColumnsRenamed(RESPONSE_NAMES)
