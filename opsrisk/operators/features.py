"""Feature engineering on the clean monthly table."""

from __future__ import annotations

from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opsrisk.constants import CAUSES
from opsrisk.functions.calendar import is_summer, is_winter_holiday, month_index, years_since_base
from opsrisk.functions.rates import clipped_ratio, null_skipping_total, safe_share
from opsrisk.operators.joins import attach_group_values, group_sums
from opsrisk.schemas import CLEAN_COLUMNS
from opsrisk.session import checkpointed


def add_row_features(cleaned: DataFrame) -> DataFrame:
    """Features that need nothing but their own row."""
    total = null_skipping_total(CAUSES)
    shares = {f"{cause}_share": safe_share(F.col(cause), total) for cause in CAUSES}
    return cleaned.withColumns(
        {
            **shares,
            "is_summer": is_summer(F.col("month")),
            "is_winter_holiday": is_winter_holiday(F.col("month")),
            "years_since_2013": years_since_base(F.col("year")),
            "cancellation_rate": clipped_ratio(F.col("arr_cancelled"), F.col("arr_flights")),
            "diversion_rate": clipped_ratio(F.col("arr_diverted"), F.col("arr_flights")),
        }
    )


def _mean() -> Column:
    return F.try_divide(F.col("value_sum"), F.col("value_rows"))


def add_group_averages(cleaned: DataFrame) -> DataFrame:
    """Mean delay rate of the row's airport and of its carrier, over all rows.

    One pass reduces the rows to airport-carrier pairs; both averages come from those.
    """
    pairs = checkpointed(group_sums(cleaned, ["airport", "carrier"], "delay_rate"))
    out = cleaned
    for key in ("airport", "carrier"):
        sums = pairs.filter(F.col(key).isNotNull()).groupBy(key).agg(
            F.sum("value_sum").alias("value_sum"), F.sum("value_rows").alias("value_rows")
        )
        means = sums.select(key, _mean().alias(f"{key}_avg_delay_rate"))
        out = attach_group_values(out, means, [key])
    return out


def add_group_averages_by_window(cleaned: DataFrame) -> DataFrame:
    """The same averages with window functions over the airport-carrier pairs.

    The windows see one row per pair and not the rows themselves, however many a
    key has. Each average is joined by its own key, so a row that lacks the other
    key has it all the same.
    """
    pairs = group_sums(cleaned, ["airport", "carrier"], "delay_rate")
    out = cleaned
    for key in ("airport", "carrier"):
        whole = Window.partitionBy(key)
        means = pairs.filter(F.col(key).isNotNull()).select(
            key,
            F.try_divide(F.sum("value_sum").over(whole), F.sum("value_rows").over(whole)).alias(f"{key}_avg_delay_rate"),
        )
        out = attach_group_values(out, means.distinct(), [key])
    return out


def prior_month_means(cleaned: DataFrame, key: str) -> DataFrame:
    """Mean delay rate of a key over all months before each month it has rows in.

    Rows are first reduced to one per key and month, so the running sum works on
    as many rows as there are months.
    """
    dated = cleaned.filter(F.col(key).isNotNull()).withColumn(
        "month_idx", month_index(F.col("year"), F.col("month"))
    )
    monthly = group_sums(dated, [key, "month_idx"], "delay_rate")
    before = Window.partitionBy(key).orderBy("month_idx").rangeBetween(Window.unboundedPreceding, -1)
    return monthly.select(
        key,
        "month_idx",
        F.try_divide(F.sum("value_sum").over(before), F.sum("value_rows").over(before)).alias(
            f"{key}_avg_delay_rate"
        ),
    )


def add_prior_averages(cleaned: DataFrame) -> DataFrame:
    """Airport and carrier averages that look only at earlier months."""
    out = cleaned.withColumn("month_idx", month_index(F.col("year"), F.col("month")))
    for key in ("airport", "carrier"):
        out = attach_group_values(out, prior_month_means(cleaned, key), [key, "month_idx"])
    return out.drop("month_idx")


def add_features(cleaned: DataFrame, averages: Literal["full", "asof"] = "full") -> DataFrame:
    """The feature table, 21 columns in fixed order.

    ``full`` averages look at all rows, later ones included; ``asof`` averages
    look only at earlier months and so leak nothing of the target.
    """
    if averages not in ("full", "asof"):
        raise ValueError(f"averages must be 'full' or 'asof', not {averages!r}")
    attach = add_group_averages if averages == "full" else add_prior_averages
    return attach(add_row_features(cleaned)).select(*CLEAN_COLUMNS)


def primary_cause(featured: DataFrame) -> DataFrame:
    """The cause with the largest share per row; null when no cause has any."""
    ranked = F.array_max(
        F.array(
            *(
                F.struct(F.col(f"{cause}_share").alias("share"), F.lit(-rank).alias("order"), F.lit(cause).alias("name"))
                for rank, cause in enumerate(CAUSES)
            )
        )
    )
    return featured.withColumn("primary_cause", F.when(ranked["share"] > 0, ranked["name"]))
