"""Seasonal regression forecast, one model per series.

The logarithm of the daily value is regressed on a trend with bends, yearly and
weekly waves and holidays, so that effects multiply. Bends and effects are held
small by Gaussian priors. The features and the prediction are Spark expressions;
only the small system of equations of a series is solved in Python.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsrisk.constants import (
    CHANGEPOINT_PRIOR,
    FORECAST_DAYS,
    HOLDOUT_DAYS,
    INTERVAL_WIDTH,
    SEASONALITY_PRIOR,
)
from opsrisk.functions.display import chart_date
from opsrisk.functions.rates import whole_count
from opsrisk.operators import series as S
from opsrisk.operators.quality import forecast_metrics

MODEL_SCHEMA = T.StructType(
    [
        T.StructField(S.KEY, T.StringType()),
        T.StructField("start_ds", T.DateType()),
        T.StructField("end_ds", T.DateType()),
        T.StructField("train_rows", T.LongType()),
        T.StructField("intercept", T.DoubleType()),
        T.StructField("coefficients", T.ArrayType(T.DoubleType())),
        T.StructField("sigma", T.DoubleType()),
        T.StructField("bend_scale", T.DoubleType()),
    ]
)

TREND_PRIOR = 5.0


def _prior_widths() -> list[float]:
    """Standard deviation of each coefficient's prior, in feature order.

    A bend's prior has the variance of a Laplace distribution of that scale.
    """
    widths = []
    for name in S.regression_features():
        if name == "t":
            widths.append(TREND_PRIOR)
        elif name.startswith("bend_"):
            widths.append(CHANGEPOINT_PRIOR * 2**0.5)
        else:
            widths.append(SEASONALITY_PRIOR)
    return widths


def _with_features(timed: DataFrame) -> DataFrame:
    """Add the feature vector; the rows carry the training range of their series."""
    placed = S.with_holiday(timed).withColumn("t", S.scaled_time())
    return placed.withColumn("features", F.expr(f"array({', '.join(S.regression_features().values())})"))


#: What a fit needs of a series: number, means and centred sums of products of its rows' features and logged values, as packed doubles.
_SUMS = T.StructType(
    [
        T.StructField(S.KEY, T.StringType()),
        T.StructField("start_ds", T.DateType()),
        T.StructField("end_ds", T.DateType()),
        T.StructField("sums", T.BinaryType()),
    ]
)

#: Series whose sums a task holds at once, some 40 KB each.
_SERIES_HELD = 500


@dataclass
class Moments:
    """Number, means and centred sums of products of some rows; those of more rows are put together from parts."""

    n: float
    mean: np.ndarray
    products: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Moments:
        mean = rows.mean(0)
        moved = rows - mean
        return cls(float(len(rows)), mean, moved.T @ moved)

    def __add__(self, other: Moments) -> Moments:
        n, apart = self.n + other.n, other.mean - self.mean
        products = self.products + other.products + np.outer(apart, apart) * (self.n * other.n / n)
        return Moments(n, self.mean + apart * (other.n / n), products)

    def packed(self) -> bytes:
        return np.concatenate([[self.n], self.mean, self.products.ravel()]).tobytes()

    @classmethod
    def unpacked(cls, held: bytes, size: int) -> Moments:
        numbers = np.frombuffer(held, float)
        return cls(float(numbers[0]), numbers[1 : size + 1], numbers[size + 1 :].reshape(size, size))


def _sums(rows: DataFrame) -> DataFrame:
    """Per task and series the moments of (features, z): all that least squares asks for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def sent() -> pa.RecordBatch:
            rows = [(key, *ends, moments.packed()) for key, (ends, moments) in held.items()]
            held.clear()
            kinds = (pa.string(), pa.date32(), pa.date32(), pa.binary())
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _SUMS.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            coded = pc.dictionary_encode(batch.column(S.KEY), null_encoding="encode")
            number = coded.indices.to_numpy(zero_copy_only=False)
            x = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1)
            wide = np.column_stack([x, batch.column("z").to_numpy()])
            for k, key in enumerate(coded.dictionary.to_pylist()):
                own = np.flatnonzero(number == k)
                first = int(own[0])
                ends = (batch.column("start_ds")[first].as_py(), batch.column("end_ds")[first].as_py())
                moments = Moments.of(wide[own])
                held[key] = (ends, held[key][1] + moments if key in held else moments)
                if len(held) >= _SERIES_HELD:
                    yield sent()
        yield sent()

    return rows.mapInArrow(run, _SUMS)


def _solved(moments: Moments, widths: list[float]) -> tuple[float, np.ndarray, float]:
    """Intercept, coefficients and noise of the ridge regression with these moments."""
    gram, right, spread = moments.products[:-1, :-1], moments.products[:-1, -1], moments.products[-1, -1]
    # the prior's weight depends on the noise, the noise on the fit: settle both
    variance, beta = spread / moments.n, np.zeros(len(gram))
    for _ in range(10):
        penalty = max(variance, 1e-12) / np.square(widths)
        beta = np.linalg.solve(gram + np.diag(penalty), right)
        residual = spread - 2 * beta @ right + beta @ gram @ beta
        variance = max(residual, 0.0) / moments.n
    return float(moments.mean[-1] - moments.mean[:-1] @ beta), beta, float(np.sqrt(variance))


def fit(series: DataFrame) -> DataFrame:
    """One row of coefficients per series.

    Least squares needs of a series the sums of products of its rows only, some
    5,000 numbers. Each task adds them up for its rows, so what is shuffled and
    solved is one row of numbers per series and task, however many days or rows
    a series has.
    """
    known = series.filter(F.col("y").isNotNull()).select(
        S.KEY, "ds", F.log(F.greatest(F.col("y").cast("double"), F.lit(1.0))).alias("z")
    )
    ranges = known.groupBy(S.KEY).agg(F.min("ds").alias("start_ds"), F.max("ds").alias("end_ds"))
    rows = _with_features(S.with_group_range(known, ranges)).select(S.KEY, "start_ds", "end_ds", "z", "features")
    widths = _prior_widths()
    key = S.KEY
    bends = [i for i, name in enumerate(S.regression_features()) if name.startswith("bend_")]

    def solve(parts: pd.DataFrame) -> pd.DataFrame:
        total = reduce(add, (Moments.unpacked(x, len(widths) + 1) for x in parts["sums"]))
        intercept, beta, sigma = _solved(total, widths)
        return pd.DataFrame(
            {
                key: [parts[key].iloc[0]],
                "start_ds": [parts["start_ds"].iloc[0]],
                "end_ds": [parts["end_ds"].iloc[0]],
                "train_rows": [round(total.n)],
                "intercept": [intercept],
                "coefficients": [beta.tolist()],
                "sigma": [sigma],
                "bend_scale": [float(np.abs(beta[bends]).mean())],
            }
        )

    return _sums(rows).groupBy(S.KEY).applyInPandas(solve, MODEL_SCHEMA)


def _dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def predict(days: DataFrame, width: float = INTERVAL_WIDTH) -> DataFrame:
    """yhat with its interval for rows that carry ``ds`` and their series' model.

    The interval holds the noise of the fit and, after the training end, the
    variance of trend bends still to come: bends arrive at the rate they had in
    training with their mean absolute size as Laplace scale, which over a time h
    adds rate * 2 * scale^2 * h^3 / 3.
    """
    featured = _with_features(days)
    ahead = F.greatest(F.lit(0.0), F.col("t") - 1.0)
    bend_variance = S.CHANGEPOINTS * 2 * F.pow("bend_scale", F.lit(2.0)) * F.pow(ahead, F.lit(3.0)) / 3
    reach = F.lit(NormalDist().inv_cdf(0.5 + width / 2)) * F.sqrt(F.pow("sigma", F.lit(2.0)) + bend_variance)
    centre = F.col("intercept") + _dot(F.col("features"), F.col("coefficients"))
    return featured.withColumns(
        {
            "yhat": F.exp(centre),
            "yhat_lower": F.exp(centre - reach),
            "yhat_upper": F.exp(centre + reach),
        }
    ).drop("features", "t", "holiday", *(f.name for f in MODEL_SCHEMA if f.name != S.KEY))


def clamp(predicted: DataFrame) -> DataFrame:
    """Forecast points: whole numbers, none below zero."""
    return predicted.select(
        S.KEY,
        "ds",
        whole_count(F.col("yhat")).alias("predicted_footfall"),
        whole_count(F.col("yhat_lower")).alias("lower_bound"),
        whole_count(F.col("yhat_upper")).alias("upper_bound"),
    )


def forecast(model: DataFrame, days: int = FORECAST_DAYS) -> DataFrame:
    """The ``days`` days after the training end of each series.

    The days grow out of the model row itself, so nothing is joined.
    """
    S.checked_days(days)
    ahead = model.withColumn(
        "ds", F.explode(F.sequence(F.date_add("end_ds", 1), F.date_add("end_ds", days)))
    )
    return clamp(predict(ahead))


def evaluate(split: DataFrame) -> DataFrame:
    """Fit on the rows before the holdout and measure on the holdout, per series.

    A series that is too short to have rows before its holdout is listed without
    quality: ``n`` is 0, the errors are null.
    """
    model = fit(split.filter("NOT is_holdout").select(S.KEY, "ds", "y"))
    held = split.filter("is_holdout").select(S.KEY, "ds", "y")
    measured = forecast_metrics(predict(held.join(model, S.KEY)), by=S.KEY)
    return split.select(S.KEY).distinct().join(measured, S.KEY, "left").na.fill(0, ["n"])


def extrapolation(split: DataFrame) -> DataFrame:
    """Holdout rows with the noise-free trend extrapolation of the rows before them as yhat."""
    train = split.filter("NOT is_holdout").select(S.KEY, "ds", "y")
    held = split.filter("is_holdout").select(S.KEY, "ds", "y")
    last_held = held.groupBy(S.KEY).agg(F.max("ds").alias("last_held"))
    trend = S.traffic_trend(train).join(last_held, S.KEY)
    guessed = S.extrapolated(S.missing_days(trend, F.col("last_held")))
    return held.join(guessed.withColumnRenamed("y", "yhat"), [S.KEY, "ds"])


def training_meta(
    series: DataFrame, metrics: DataFrame, trained_on: str, model_version: str, holdout_days: int = HOLDOUT_DAYS
) -> DataFrame:
    """One row per series: its quality (null if it has none), rows and date range."""
    return (
        S.traffic_profile(series)
        .join(metrics.select(S.KEY, "mae", "mape_pct"), S.KEY, "left")
        .select(
            S.KEY,
            F.round("mae", 2).alias("mae"),
            F.round("mape_pct", 4).alias("mape_pct"),
            F.col("n").alias("train_rows"),
            F.lit(holdout_days).alias("holdout_days"),
            "date_min",
            "date_max",
            F.lit(model_version).alias("model_version"),
            F.lit(trained_on).cast("date").alias("trained_on"),
        )
    )


def forecast_document(points: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """One document per series: its points in date order with range and quality.

    A forecast has 365 points at most, so a document is bounded.
    """
    point = F.struct(
        F.col("ds").cast("string").alias("date"), "predicted_footfall", "lower_bound", "upper_bound"
    )
    documents = points.groupBy(S.KEY).agg(
        F.count("*").cast("int").alias("forecast_days"),
        F.min("ds").cast("string").alias("forecast_from"),
        F.max("ds").cast("string").alias("forecast_to"),
        F.array_sort(F.collect_list(point)).alias("forecast"),
    )
    quality = ("mae", "mape_pct")
    if meta is None:
        documents = documents.withColumns({name: F.lit(0.0) for name in quality})
    else:
        documents = documents.join(meta.select(S.KEY, *quality), S.KEY, "left").fillna(0.0, list(quality))
    return documents.withColumnsRenamed({"mae": "model_mae", "mape_pct": "model_mape_pct"}).select(
        S.KEY, "forecast_days", "forecast_from", "forecast_to", "model_mae", "model_mape_pct", "forecast"
    )


def with_chart_dates(points: DataFrame) -> DataFrame:
    return points.withColumn("chart_date", chart_date(F.col("ds")))
