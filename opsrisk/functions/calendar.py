"""Calendar flags, labels, effects and holidays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsrisk.constants import (
    BASE_YEAR,
    MONTH_LABELS,
    PEAK_MONTHS,
    SUMMER_EFFECT,
    SUMMER_MONTHS,
    WEEKDAY_EFFECT,
    WINTER_HOLIDAY_MONTHS,
    YEAR_END_EFFECT,
    YEAR_END_FIRST_DAY,
)


def is_summer(month: Column) -> Column:
    return month.isin(*SUMMER_MONTHS).cast("int")


def is_winter_holiday(month: Column) -> Column:
    return month.isin(*WINTER_HOLIDAY_MONTHS).cast("int")


def is_peak_month(month: Column) -> Column:
    return month.isin(*PEAK_MONTHS)


def years_since_base(year: Column) -> Column:
    return year - F.lit(BASE_YEAR)


def month_label(month: Column) -> Column:
    """Short month name; numbers outside 1..12 take the nearest end, no month has none."""
    slot = F.greatest(F.lit(1), F.least(F.lit(len(MONTH_LABELS)), month.cast("int")))
    # least and greatest pass over nulls
    return F.when(month.isNotNull(), F.element_at(F.array(*map(F.lit, MONTH_LABELS)), slot))


def month_index(year: Column, month: Column) -> Column:
    """Months since year 0, so that consecutive months differ by one."""
    return year * F.lit(12) + month - F.lit(1)


def weekly_effect(day: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WEEKDAY_EFFECT)), F.weekday(day) + 1)


def seasonal_effect(day: Column) -> Column:
    summer = F.when(F.month(day).isin(*SUMMER_MONTHS), SUMMER_EFFECT).otherwise(0)
    year_end = F.when(
        (F.month(day) == 12) & (F.dayofmonth(day) >= YEAR_END_FIRST_DAY), YEAR_END_EFFECT
    ).otherwise(0)
    return summer + year_end


# --- fixed values: United States federal holidays ----------------------------
# name, month, day, first year
FIXED_DATE_HOLIDAYS = (
    ("New Year's Day", 1, 1, 1871),
    ("Juneteenth National Independence Day", 6, 19, 2021),
    ("Independence Day", 7, 4, 1871),
    ("Veterans Day", 11, 11, 1938),
    ("Christmas Day", 12, 25, 1871),
)
# name, month, weekday (Monday is 0), first and last day of the month it can fall on
FLOATING_HOLIDAYS = (
    ("Martin Luther King Jr. Day", 1, 0, 15, 21),
    ("Washington's Birthday", 2, 0, 15, 21),
    ("Memorial Day", 5, 0, 25, 31),
    ("Labor Day", 9, 0, 1, 7),
    ("Columbus Day", 10, 0, 8, 14),
    ("Thanksgiving Day", 11, 3, 22, 28),
)
OBSERVED_SUFFIX = " (observed)"
HOLIDAY_NAMES = (
    *(name for name, *_ in FIXED_DATE_HOLIDAYS),
    *(name for name, *_ in FLOATING_HOLIDAYS),
    *(name + OBSERVED_SUFFIX for name, *_ in FIXED_DATE_HOLIDAYS),
)

_MONDAY, _FRIDAY = 0, 4


def _text(value: str) -> str:
    return "'" + value.replace("'", "\\'") + "'"


def _falls_on(day: str, month: int, day_of_month: int, first_year: int) -> str:
    return f"(month({day}) = {month} AND day({day}) = {day_of_month} AND year({day}) >= {first_year})"


def us_holiday(day: str) -> Column:
    """Name of the holiday the date in a column is, or null.

    Each date is judged by itself, so no holiday table has to be built, bounded
    or joined. A fixed-date holiday on a Saturday is also observed on the
    Friday before, one on a Sunday on the Monday after.
    """
    rules = []
    for name, month, day_of_month, first_year in FIXED_DATE_HOLIDAYS:
        rules.append((_falls_on(day, month, day_of_month, first_year), name))
    for name, month, weekday, first, last in FLOATING_HOLIDAYS:
        rules.append(
            (
                f"month({day}) = {month} AND weekday({day}) = {weekday} AND day({day}) BETWEEN {first} AND {last}",
                name,
            )
        )
    for name, month, day_of_month, first_year in FIXED_DATE_HOLIDAYS:
        after = _falls_on(f"date_add({day}, 1)", month, day_of_month, first_year)
        before = _falls_on(f"date_sub({day}, 1)", month, day_of_month, first_year)
        rules.append(
            (
                f"weekday({day}) = {_FRIDAY} AND {after} OR weekday({day}) = {_MONDAY} AND {before}",
                name + OBSERVED_SUFFIX,
            )
        )
    cases = " ".join(f"WHEN {condition} THEN {_text(name)}" for condition, name in rules)
    return F.expr(f"CASE {cases} END")
