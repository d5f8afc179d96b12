"""Scheduled scans over the prediction history."""

from __future__ import annotations

from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from opsrisk.operators import alerts, validation
from opsrisk.plans.scoring import scored_requests, to_history
from opsrisk.sources import tables
from opsrisk.sources.history_store import append_history, read_history


def _batch(job: str, as_of: str) -> str:
    """A name for the run of a job, so that a repeated run replaces its first one."""
    return f"{job}-{datetime.fromisoformat(as_of):%Y%m%dT%H%M%S}"


def daily_risk_scan(spark: SparkSession, history_path: str, as_of: str, alerts_path: str) -> DataFrame:
    """Scan the day before ``as_of``, store the alert it raises, if any, and return it."""
    batch = _batch("risk-scan", as_of)
    tables.append_alerts(alerts.risk_scan(read_history(spark, history_path), as_of), alerts_path, batch)
    return tables.read_alerts(spark, f"{alerts_path}/batch={batch}")


def monitor(spark: SparkSession, model: PipelineModel, as_of: str, history_path: str, alerts_path: str) -> DataFrame:
    """Score the month of ``as_of``, store the prediction and the alert it raises, and return the alert."""
    batch = _batch("monitor", as_of)
    moment = spark.sql("SELECT CAST(:as_of AS TIMESTAMP) AS created_at", args={"as_of": as_of})
    request = validation.monitoring_requests(moment, "created_at")
    stored = append_history(to_history(scored_requests(request, model)), history_path, batch)
    tables.append_alerts(alerts.monitoring_alerts(stored), alerts_path, batch)
    return tables.read_alerts(spark, f"{alerts_path}/batch={batch}")
