"""Exploratory aggregates over the clean monthly table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsrisk.constants import (
    ANNOTATED_YEAR,
    CAUSE_LABELS,
    HISTOGRAM_BINS,
    MIN_CARRIER_ROWS,
    MONTH_LABELS,
    TOP_CARRIERS,
)
from opsrisk.functions.calendar import is_peak_month, month_label
from opsrisk.operators.joins import stored_groups
from opsrisk.operators.ordered import exact_quantiles

def delay_profile(rows: DataFrame) -> DataFrame:
    """Rows, carriers, airports, year range and mean rate.

    Rows are reduced to carrier-airport pairs first, so that the distinct counts
    run over pairs and not over every row once per counted column.
    """
    pairs = rows.groupBy("carrier", "airport").agg(
        F.count("*").alias("n"),
        F.min("year").alias("first"),
        F.max("year").alias("last"),
        F.sum("delay_rate").alias("rate_sum"),
        F.count("delay_rate").alias("rate_rows"),
    )
    return pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.count_distinct("carrier").alias("carriers"),
        F.count_distinct("airport").alias("airports"),
        F.min("first").alias("first_year"),
        F.max("last").alias("last_year"),
        F.try_divide(F.sum("rate_sum"), F.sum("rate_rows")).alias("mean_delay_rate"),
    )


def delay_describe(rows: DataFrame) -> DataFrame:
    """Count, mean, spread, extremes and exact quartiles, one row per statistic."""
    moments = rows.agg(
        F.count("delay_rate").cast("double").alias("count"),
        F.avg("delay_rate").alias("mean"),
        F.stddev_samp("delay_rate").alias("std"),
        F.min("delay_rate").alias("min"),
        F.max("delay_rate").alias("max"),
    ).unpivot([], ["count", "mean", "std", "min", "max"], "statistic", "value")
    quartiles = exact_quantiles(rows, "delay_rate", {"25%": 0.25, "50%": 0.5, "75%": 0.75}).unpivot(
        [], ["`25%`", "`50%`", "`75%`"], "statistic", "value"
    )
    return moments.unionByName(quartiles)


def delay_histogram(rows: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins from the smallest to the largest rate; the last one is closed.

    Edges are ``low + i * width``. The bin computed by division is moved by one
    where rounding put the value on the wrong side of an edge.
    """
    found = rows.agg(F.min("delay_rate").alias("low"), F.max("delay_rate").alias("high"))
    # a single value gets a range of width one around it
    spread = F.when(F.col("low") == F.col("high"), 0.5).otherwise(0.0)
    ends = found.select(
        F.struct((F.col("low") - spread).alias("low"), (F.col("high") + spread).alias("high"))
    ).scalar()
    low, high = ends["low"], ends["high"]

    ranged = (
        rows.filter(F.col("delay_rate").isNotNull())
        .select(F.col("delay_rate").alias("x"), low.alias("low"), high.alias("high"))
        .withColumn("width", (F.col("high") - F.col("low")) / bins)
        .withColumn(
            "guess",
            F.least(
                F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * bins),
                F.lit(bins - 1),
            ),
        )
    )
    starts = F.col("low") + F.col("guess") * F.col("width")
    ends = F.col("low") + (F.col("guess") + 1) * F.col("width")
    bin_id = (
        F.when(F.col("x") < starts, F.col("guess") - 1)
        .when((F.col("x") >= ends) & (F.col("guess") < bins - 1), F.col("guess") + 1)
        .otherwise(F.col("guess"))
    )
    counted = ranged.groupBy(bin_id.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every_bin = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = (high - low) / bins
    return (
        every_bin.join(counted, "bin", "left")
        .select(
            "bin",
            (low + F.col("bin") * width).alias("bin_start"),
            (low + (F.col("bin") + 1) * width).alias("bin_end"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )


def delay_by_month(rows: DataFrame) -> DataFrame:
    return (
        rows.filter("month IS NOT NULL")
        .groupBy("month")
        .agg(
            F.avg("delay_rate").alias("mean_rate"),
            F.stddev_samp("delay_rate").alias("std_rate"),
        )
        .select(
            "month",
            month_label(F.col("month")).alias("month_label"),
            "mean_rate",
            "std_rate",
            is_peak_month(F.col("month")).alias("is_peak"),
        )
        .orderBy("month")
    )


def delay_by_carrier(rows: DataFrame, min_rows: int = MIN_CARRIER_ROWS) -> DataFrame:
    """Mean rate per carrier with enough rows, lowest first.

    The comparison mean is that of the kept carriers, each counted once; the
    mean over all rows stands next to it.
    """
    # all three uses read the same sums and counts, one row per carrier: they are written once
    stats = stored_groups(
        rows.groupBy("carrier", "carrier_name")
        .agg(F.sum("delay_rate").alias("rate_sum"), F.count("delay_rate").alias("n"))
        .withColumn("mean_rate", F.try_divide("rate_sum", "n"))
    )
    # rows without a carrier are in the mean over all rows only
    kept = stats.filter((F.col("n") >= min_rows) & F.col("carrier").isNotNull() & F.col("carrier_name").isNotNull())
    mean_of_kept = kept.agg(F.avg("mean_rate")).scalar()
    overall = stats.agg(F.try_divide(F.sum("rate_sum"), F.sum("n"))).scalar()
    return kept.select(
        "carrier",
        "carrier_name",
        "mean_rate",
        "n",
        (F.col("mean_rate") > mean_of_kept).alias("above_average"),
        overall.alias("overall_mean"),
    ).orderBy("mean_rate", "carrier")


def delay_by_year(rows: DataFrame, annotated_year: int = ANNOTATED_YEAR) -> DataFrame:
    stats = rows.filter("year IS NOT NULL").groupBy("year").agg(
        F.avg("delay_rate").alias("mean"),
        F.stddev_samp("delay_rate").alias("std"),
        F.count("delay_rate").alias("n"),
    )
    return stats.select(
        "year",
        F.col("mean").alias("mean_rate"),
        F.col("std").alias("std_rate"),
        "n",
        (F.col("mean") - F.col("std")).alias("lower"),
        (F.col("mean") + F.col("std")).alias("upper"),
        (F.col("year") == annotated_year).alias("annotated"),
    ).orderBy("year")


def delay_causes(featured: DataFrame) -> DataFrame:
    """Mean share of each cause, its part of all shares in percent, and its rank."""
    means = featured.agg(*(F.avg(share).alias(share) for share in CAUSE_LABELS))
    entries = F.array_sort(
        F.array(
            *(
                F.struct((-F.col(share)).alias("order"), F.lit(label).alias("cause"), F.col(share).alias("mean"))
                for share, label in CAUSE_LABELS.items()
            )
        )
    )
    total = sum((F.col(share) for share in CAUSE_LABELS), F.lit(0.0))
    return (
        means.select(total.alias("total"), F.posexplode(entries).alias("pos", "entry"))
        .select(
            F.col("entry.cause").alias("cause"),
            F.col("entry.mean").alias("mean_share"),
            F.try_divide(F.col("entry.mean") * 100, F.col("total")).alias("composition_pct"),
            (F.col("pos") + 1).alias("rank"),
        )
    )


def top_carriers(rows: DataFrame, k: int = TOP_CARRIERS) -> DataFrame:
    """The carriers with the most rows; equal counts go by name."""
    return (
        rows.filter("carrier_name IS NOT NULL")
        .groupBy("carrier_name")
        .agg(F.count("delay_rate").alias("n"))
        .orderBy(F.desc("n"), "carrier_name")
        .limit(k)
    )


def rows_of_top_carriers(rows: DataFrame, k: int = TOP_CARRIERS) -> DataFrame:
    """Rows whose carrier is among the top ``k``; the broadcast side has ``k`` rows at most."""
    names = top_carriers(rows, k).select("carrier_name")
    return rows.join(F.broadcast(names), "carrier_name", "left_semi")


def delay_heatmap(rows: DataFrame, top: int = TOP_CARRIERS) -> DataFrame:
    """Mean rate of the top carriers by month, one column per month.

    One pass: the months are conditional averages of the same aggregate that
    counts the rows the ranking needs.
    """
    by_month = [
        F.avg(F.when(F.col("month") == number, F.col("delay_rate"))).alias(label)
        for number, label in enumerate(MONTH_LABELS, start=1)
    ]
    return (
        rows.filter("carrier_name IS NOT NULL")
        .groupBy("carrier_name")
        .agg(F.count("delay_rate").alias("n"), *by_month)
        .orderBy(F.desc("n"), "carrier_name")
        .limit(top)
        .select("carrier_name", *MONTH_LABELS)
    )


def delay_extremes(rows: DataFrame) -> DataFrame:
    """Month and carrier with the highest and the lowest mean rate; ties go to the smaller key."""
    # both dimensions are means over the same pairs, which are written once
    pairs = stored_groups(
        rows.groupBy("month", "carrier_name").agg(
            F.sum("delay_rate").alias("rate_sum"), F.count("delay_rate").alias("rate_rows")
        )
    )
    mean = F.round(F.try_divide(F.sum("rate_sum"), F.sum("rate_rows")), 12).alias("mean")
    months = pairs.filter("month IS NOT NULL").groupBy("month").agg(mean).select(
        F.lit("month").alias("dimension"),
        F.col("month").alias("position"),
        month_label(F.col("month")).alias("name"),
        "mean",
    )
    carriers = pairs.filter("carrier_name IS NOT NULL").groupBy("carrier_name").agg(mean).select(
        F.lit("carrier").alias("dimension"),
        F.lit(0).alias("position"),
        F.col("carrier_name").alias("name"),
        "mean",
    )
    highest = F.struct(-F.col("mean"), "position", "name")
    lowest = F.struct("mean", "position", "name")
    return (
        months.unionByName(carriers)
        .groupBy("dimension")
        .agg(
            F.min_by("name", highest).alias("highest"),
            F.max("mean").alias("highest_mean"),
            F.min_by("name", lowest).alias("lowest"),
            F.min("mean").alias("lowest_mean"),
        )
    )
