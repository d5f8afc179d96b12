"""Risk scans and the alerts they raise, as rows of one alert table."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsrisk.constants import CAPACITY_LIMIT, HIGH_RISK_PROBABILITY
from opsrisk.functions.calendar import month_label
from opsrisk.functions.display import capacity_message, monitoring_message, risk_scan_message
from opsrisk.operators.history import created_between, risk_counts

# --- fixed values: alert subjects ------------------------------------------------
CAPACITY_SUBJECT = "High Traffic Day Forecast"
RISK_SCAN_SUBJECT = "Daily Risk Scan: High-Risk Detections"
MONITORING_SUBJECT = "Automated Monitoring Alert"


def capacity_alerts(forecast: DataFrame, limit: int = CAPACITY_LIMIT) -> DataFrame:
    """One alert per forecast day above the capacity limit."""
    footfall = F.col("predicted_footfall")
    return forecast.filter(footfall > limit).select(
        F.lit("capacity").alias("alert_type"),
        F.lit(CAPACITY_SUBJECT).alias("subject"),
        capacity_message(F.col("ds"), footfall, limit).alias("message"),
        F.col("ds").cast("timestamp_ntz").alias("event_time"),
        F.concat_ws("|", "series_key", F.col("ds").cast("string")).alias("ref_id"),
    )


def forecast_totals(forecast: DataFrame, series: DataFrame | None = None) -> DataFrame:
    """Sum and peak of each forecast.

    With ``series``, the keys that were to be forecast, a series without any
    forecast day has a sum and a peak of 0.
    """
    totals = forecast.groupBy("series_key").agg(
        F.sum("predicted_footfall").alias("total_footfall"), F.max("predicted_footfall").alias("peak_footfall")
    )
    if series is not None:
        totals = series.select("series_key").distinct().join(totals, "series_key", "left")
    return totals.na.fill(0, ["total_footfall", "peak_footfall"])


def risk_counts_before(
    history: DataFrame, as_of: str, hours: int = 24, probability: float = HIGH_RISK_PROBABILITY
) -> DataFrame:
    """Predictions and high-risk predictions of the hours before ``as_of``, both ends included."""
    start = datetime.fromisoformat(as_of) - timedelta(hours=hours)
    return created_between(history, start.isoformat(sep=" "), as_of).agg(*risk_counts(probability))


def risk_scan(
    history: DataFrame, as_of: str, hours: int = 24, probability: float = HIGH_RISK_PROBABILITY
) -> DataFrame:
    """One summary alert when the window has a high-risk prediction, otherwise no row."""
    counted = risk_counts_before(history, as_of, hours, probability)
    return counted.filter(F.col("high_risk") > 0).select(
        F.lit("risk_scan").alias("alert_type"),
        F.lit(RISK_SCAN_SUBJECT).alias("subject"),
        risk_scan_message(F.col("high_risk"), probability, hours).alias("message"),
        F.lit(as_of).cast("timestamp_ntz").alias("event_time"),
        F.lit(as_of).alias("ref_id"),
        "predictions",
        "high_risk",
    )


def monitoring_alerts(predictions: DataFrame, probability: float = HIGH_RISK_PROBABILITY) -> DataFrame:
    """One alert per prediction at or above the probability; also applies to streams."""
    return predictions.filter(F.col("high_delay_probability") >= probability).select(
        F.lit("monitoring").alias("alert_type"),
        F.lit(MONITORING_SUBJECT).alias("subject"),
        monitoring_message(
            month_label(F.col("flight_month")), F.col("flight_year"), F.col("high_delay_probability")
        ).alias("message"),
        F.col("created_at").alias("event_time"),
        F.col("id").cast("string").alias("ref_id"),
    )


def risk_windows(
    history: DataFrame,
    length: str = "24 hours",
    slide: str = "24 hours",
    start: str = "6 hours 5 minutes",
    probability: float = HIGH_RISK_PROBABILITY,
) -> DataFrame:
    """Risk counts per time window, closed at the start and open at the end.

    The defaults are the daily scan; a shorter slide gives rolling windows. The
    same plan serves batch tables and, with a watermark, streams.
    """
    return (
        history.groupBy(F.window("created_at", length, slide, start).alias("w"))
        .agg(*risk_counts(probability))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "predictions", "high_risk")
    )
