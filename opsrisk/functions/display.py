"""Columns the dashboards show: badges, percentages, periods and messages."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsrisk.constants import BADGE_NOMINAL, BADGE_RISK, CAPACITY_TEXT, MONITORING_TEXT, RISK_SCAN_TEXT, STATUS_NOMINAL, STATUS_RISK


def status_of(prediction: Column) -> Column:
    return F.when(prediction == 1, F.lit(STATUS_RISK)).otherwise(F.lit(STATUS_NOMINAL))


def badge_of(status: Column) -> Column:
    return F.when(status == STATUS_RISK, F.lit(BADGE_RISK)).otherwise(F.lit(BADGE_NOMINAL))


def percent_tenths(probability: Column) -> Column:
    """Per mille, halves up, from a four-digit probability; whole-number arithmetic only."""
    return F.floor((F.round(probability * 10000).cast("bigint") + 5) / 10).cast("bigint")


def percent(probability: Column) -> Column:
    """Percentage with one decimal, as a number."""
    return percent_tenths(probability) / F.lit(10.0)


def percent_text(probability: Column) -> Column:
    """Percentage with one decimal, as text without the sign."""
    tenths = percent_tenths(probability)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def period_text(year: Column, month: Column) -> Column:
    return F.concat_ws("/", year.cast("string"), F.lpad(month.cast("string"), 2, "0"))


def chart_date(day: Column) -> Column:
    return F.concat_ws("/", F.month(day).cast("string"), F.dayofmonth(day).cast("string"))


def filled(text: str, **values: Column | str) -> Column:
    """A text with its ``{places}`` filled; null if a value is null."""
    parts = [
        part if isinstance(part, Column) else F.lit(part)
        for before, name, *_ in Formatter().parse(text)
        for part in ([before] if name is None else [before, values[name]])
    ]
    return F.concat(*parts)


def capacity_message(day: Column, footfall: Column, limit: int) -> Column:
    return filled(CAPACITY_TEXT, day=day.cast("string"), footfall=F.format_number(footfall, 0), limit=f"{limit:,}")


def risk_scan_message(count: Column, probability: float, hours: int = 24) -> Column:
    return filled(RISK_SCAN_TEXT, count=count.cast("string"), hours=str(hours), percent=str(int(probability * 100)))


def monitoring_message(label: Column, year: Column, probability: Column) -> Column:
    return filled(MONITORING_TEXT, month=label, year=year.cast("string"), percent=percent_text(probability))
