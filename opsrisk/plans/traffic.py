"""Traffic job: series to model, quality, forecast and capacity alerts."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Literal

from pyspark.sql import DataFrame

from opsrisk.constants import CAPACITY_LIMIT, FORECAST_DAYS, HOLDOUT_DAYS, MODEL_VERSION
from opsrisk.operators import alerts, forecast, series
from opsrisk.session import checkpointed


@dataclass(frozen=True)
class TrafficModel:
    coefficients: DataFrame
    meta: DataFrame


def train_traffic(
    observed: DataFrame,
    as_of: str,
    holdout_days: int = HOLDOUT_DAYS,
    split: Literal["observed", "extended"] = "observed",
    model_version: str = MODEL_VERSION,
) -> TrafficModel:
    """Measure on the newest days, then fit on the whole series carried on to ``as_of``.

    ``observed`` holds out days that were seen; ``extended`` holds out the newest
    days after extension, which then are extrapolated ones in part or in whole.
    """
    if split not in ("observed", "extended"):
        raise ValueError(f"split must be 'observed' or 'extended', not {split!r}")
    extended = checkpointed(series.extend_series(observed, as_of))
    measured = checkpointed(
        series.holdout_split(observed if split == "observed" else extended, holdout_days)
    )
    metrics = forecast.evaluate(measured)
    return TrafficModel(
        coefficients=checkpointed(forecast.fit(extended)),
        meta=checkpointed(
            forecast.training_meta(extended, metrics, as_of, model_version, holdout_days)
        ),
    )


@dataclass(frozen=True)
class DailyForecast:
    points: DataFrame
    totals: DataFrame
    alerts: DataFrame


def daily_forecast(
    coefficients: DataFrame, days: int = FORECAST_DAYS, limit: int = CAPACITY_LIMIT
) -> DailyForecast:
    """The scheduled morning job: forecast, its totals, and alerts for crowded days.

    Every series with a model has totals, 0 if there is no day in its forecast.
    """
    points = forecast.forecast(coefficients, days)
    totals = alerts.forecast_totals(points, coefficients)
    return DailyForecast(points, totals, alerts.capacity_alerts(points, limit))
