"""Queries on the prediction history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsrisk.constants import BAR_PROBABILITY, RECENT_ROWS
from opsrisk.functions.display import badge_of, percent, period_text

ITEM_COLUMNS = (
    "id", "high_delay_prediction", "high_delay_probability", "status", "flight_month", "flight_year", "created_at",
)


def _newest_first() -> list[Column]:
    return [F.desc("created_at"), F.desc("id")]


def items(history: DataFrame) -> DataFrame:
    """The seven columns lists of predictions show."""
    return history.select(*ITEM_COLUMNS)


def with_display(rows: DataFrame) -> DataFrame:
    """Badge, percentage, period and bar colour of each prediction."""
    probability = F.col("high_delay_probability")
    return rows.withColumns(
        {
            "badge": badge_of(F.col("status")),
            "probability_pct": percent(probability),
            "period": period_text(F.col("flight_year"), F.col("flight_month")),
            "bar_high": probability > BAR_PROBABILITY,
        }
    )


def history_recent(history: DataFrame, n: int = RECENT_ROWS) -> DataFrame:
    """The newest ``n`` predictions; Spark keeps only ``n`` rows per task on the way."""
    return items(history).orderBy(*_newest_first()).limit(n)


def history_by_class(history: DataFrame, prediction: int) -> DataFrame:
    return items(history.filter(F.col("high_delay_prediction") == prediction)).orderBy(*_newest_first())


def history_alerts(history: DataFrame) -> DataFrame:
    """All predictions of the high class, newest first."""
    return history_by_class(history, 1)


def created_between(history: DataFrame, start: str, end: str) -> DataFrame:
    """Rows created in the range, both ends included."""
    kind = history.schema["created_at"].dataType.simpleString()
    return history.filter(
        F.col("created_at").between(F.lit(start).cast(kind), F.lit(end).cast(kind))
    )


def history_between(history: DataFrame, start: str, end: str) -> DataFrame:
    return items(created_between(history, start, end)).orderBy(*_newest_first())


def status_counts(history: DataFrame) -> DataFrame:
    return history.groupBy("status").agg(F.count("*").alias("n"))


def dashboard_summary(history: DataFrame) -> DataFrame:
    """Totals of the history and the share of high-risk rows, 0 when there are none.

    Also the number of active alerts, which is the number of high-class rows.
    """
    counts = history.agg(
        F.count("*").alias("total_predictions"),
        F.count_if(F.col("high_delay_prediction") == 1).alias("high_risk_count"),
        F.count_if(F.col("high_delay_prediction") == 0).alias("nominal_count"),
    )
    share = F.try_divide(F.col("high_risk_count") * F.lit(100.0), F.col("total_predictions"))
    return counts.withColumns(
        {
            "high_risk_percentage": F.round(F.coalesce(share, F.lit(0.0)), 2),
            "active_alerts": F.col("high_risk_count"),
        }
    )


def missing_seed_rows(seed: DataFrame, history: DataFrame) -> DataFrame:
    """Seed rows whose year and month the history has no prediction for.

    The history is first reduced to its distinct months.
    """
    months = history.select(
        F.col("flight_year").cast("double").alias("year"),
        F.col("flight_month").cast("double").alias("month"),
    ).distinct()
    return seed.join(months, ["year", "month"], "left_anti")


def risk_counts(probability: float) -> list[Column]:
    """Rows and rows at or above a probability, for any grouping."""
    return [
        F.count("*").alias("predictions"),
        F.count_if(F.col("high_delay_probability") >= probability).alias("high_risk"),
    ]
