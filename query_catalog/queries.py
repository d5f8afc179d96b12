"""Registered queries: each takes a session and a table folder, and returns a DataFrame."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsrisk.constants import MAX_FORECAST_DAYS, MODEL_FEATURES, MODEL_VERSION, NOISE_SD
from opsrisk.operators import (
    alerts,
    cleaning,
    delay_model,
    eda,
    features,
    forecast,
    history,
    learning_sets,
    quality,
    series,
    validation,
)
from opsrisk.plans import scoring, traffic
from opsrisk.schemas import CLEAN_COLUMNS
from opsrisk.session import checkpointed, scratch_path, shared_folder
from opsrisk.sources import history_store, models, requests, seeds, tables, testdata
from opsrisk.streaming import queries as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CELL_KEYS = ["year", "month", "carrier", "airport"]


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits.

    Sums of doubles differ in their last bits with the order of their terms. The
    first, finer rounding takes that away, so that values half-way between two
    results of the second go the same way in every engine. Adding zero turns a
    negative zero into a plain one.
    """
    return df.selectExpr(
        *(
            f"round(round(`{f.name}`, 10), 6) + 0D AS `{f.name}`"
            if isinstance(f.dataType, T.DoubleType)
            else f"`{f.name}`"
            for f in df.schema
        )
    )


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """The clean monthly table, for queries that read it once."""
    return cleaning.clean(testdata.monthly_raw(spark, folder))


def stored_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The clean monthly table computed once, for queries that read it several times."""
    return checkpointed(cells(spark, folder))


# --- cleaning and features ---------------------------------------------------------


@query
def clean_monthly(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cells(spark, folder))


@query
def clean_audit(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.clean_audit(testdata.monthly_raw(spark, folder))


@query
def clean_sample(spark: SparkSession, folder: str) -> DataFrame:
    sample = cleaning.clean_sample(cells(spark, folder))
    return rounded(sample.select(*CELL_KEYS, "arr_flights", "arr_del15", "delay_rate"))


@query
def features_monthly(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(features.add_features(stored_cells(spark, folder)))


@query
def features_window(spark: SparkSession, folder: str) -> DataFrame:
    rows = features.add_row_features(stored_cells(spark, folder))
    return rounded(features.add_group_averages_by_window(rows).select(*CLEAN_COLUMNS))


@query
def features_asof(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(features.add_features(stored_cells(spark, folder), averages="asof"))


@query
def primary_cause(spark: SparkSession, folder: str) -> DataFrame:
    rows = features.primary_cause(features.add_row_features(cells(spark, folder)))
    return rows.select(*CELL_KEYS, "primary_cause")


# --- exploratory aggregates ----------------------------------------------------------


@query
def delay_profile(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(eda.delay_profile(cells(spark, folder)))


@query
def delay_describe(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(eda.delay_describe(stored_cells(spark, folder)))


@query
def delay_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(eda.delay_histogram(stored_cells(spark, folder)))


@query
def delay_by_month(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(eda.delay_by_month(cells(spark, folder)))


@query
def delay_by_carrier(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(eda.delay_by_carrier(cells(spark, folder)))


@query
def delay_by_year(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(eda.delay_by_year(cells(spark, folder)))


@query
def delay_causes(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(eda.delay_causes(features.add_row_features(cells(spark, folder))))


@query
def top_carriers(spark: SparkSession, folder: str) -> DataFrame:
    return eda.top_carriers(cells(spark, folder))


@query
def top_carrier_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = eda.rows_of_top_carriers(stored_cells(spark, folder))
    return rounded(rows.select("year", "month", "carrier_name", "airport", "delay_rate"))


@query
def delay_heatmap(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(eda.delay_heatmap(cells(spark, folder)))


@query
def delay_extremes(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(eda.delay_extremes(cells(spark, folder)))


# --- learning sets and quality measures ------------------------------------------------


@query
def delay_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = learning_sets.with_label(cells(spark, folder))
    return rounded(rows.select(*CELL_KEYS, "delay_rate", "high_delay"))


@query
def model_matrix(spark: SparkSession, folder: str) -> DataFrame:
    rows = features.add_features(stored_cells(spark, folder))
    return rounded(learning_sets.model_matrix(learning_sets.with_label(rows)))


@query
def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = learning_sets.with_label(cells(spark, folder))
    split = learning_sets.with_split(rows, ["carrier", "airport", "year", "month"])
    return split.select(*CELL_KEYS, "high_delay", "is_train")


@query
def exact_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = learning_sets.with_label(stored_cells(spark, folder))
    split = learning_sets.with_exact_split(rows, ["carrier", "airport", "year", "month"])
    return split.select(*CELL_KEYS, "high_delay", "is_train")


@query
def classification_report(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(quality.classification_report(testdata.scored_labels(spark, folder)))


@query
def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(quality.roc_auc(testdata.scored_labels(spark, folder)))


@query
def roc_auc_margins(spark: SparkSession, folder: str) -> DataFrame:
    """The same over raw margins: unrounded, of either sign, far from [0, 1]."""
    margins = testdata.table(spark, folder, "events").selectExpr(
        "int(event_type = 'error') AS label", "(value - 40) * (value - 40) * (value - 40) / 7 AS margin"
    )
    return rounded(quality.roc_auc(margins, score="margin"))


# --- requests --------------------------------------------------------------------------


@query
def validate_requests(spark: SparkSession, folder: str) -> DataFrame:
    checked = validation.validate(testdata.score_requests(spark, folder))
    return checked.select(
        "request_id", "is_valid", F.array_join("violations", ", ").alias("message")
    )


@query
def validation_report(spark: SparkSession, folder: str) -> DataFrame:
    return validation.validation_report(validation.validate(testdata.score_requests(spark, folder)))


@query
def quarantined_requests(spark: SparkSession, folder: str) -> DataFrame:
    rejected = validation.quarantine(validation.validate(testdata.score_requests(spark, folder)))
    return rejected.select("request_id", "year", "month", "arr_flights", "message")


@query
def scoring_outcome(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of every request of the scoring job: accepted, or refused with its message."""
    return scoring.outcomes(testdata.score_requests(spark, folder)).select("request_id", "accepted", "message")


@query
def derived_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Calendar features left empty for some events and filled from year and month."""
    gaps = testdata.table(spark, folder, "events").selectExpr(
        "event_id AS request_id",
        "double(year(ts) - user_id % 9) AS year",
        "double(1 + event_id % 12) AS month",
        "CASE WHEN event_type <> 'view' THEN floor(value) + 1.0D END AS arr_flights",
        "CASE WHEN event_type = 'signup' THEN 1.0D END AS is_summer",
        "CASE WHEN event_type = 'purchase' THEN 1.0D END AS is_winter_holiday",
        "CASE WHEN event_type = 'click' THEN 3.0D END AS years_since_2013",
        "CASE WHEN event_type <> 'click' THEN 0.25D END AS airport_avg_delay_rate",
        "CASE WHEN event_type <> 'error' THEN 0.125D END AS carrier_avg_delay_rate",
    )
    return validation.derive_features(gaps, defaults=True)


@query
def monitor_requests(spark: SparkSession, folder: str) -> DataFrame:
    """One monitoring request per day that has events."""
    days = testdata.table(spark, folder, "events").selectExpr("date(ts) AS day").distinct()
    return validation.monitoring_requests(days, "day")


# --- history ---------------------------------------------------------------------------


@query
def score_status(spark: SparkSession, folder: str) -> DataFrame:
    return validation.to_public_names(testdata.prediction_history(spark, folder))


@query
def history_recent(spark: SparkSession, folder: str) -> DataFrame:
    return history.with_display(history.history_recent(testdata.prediction_history(spark, folder)))


@query
def history_alerts(spark: SparkSession, folder: str) -> DataFrame:
    return history.with_display(history.history_alerts(testdata.prediction_history(spark, folder)))


@query
def history_between(spark: SparkSession, folder: str) -> DataFrame:
    return history.history_between(
        testdata.prediction_history(spark, folder), "2024-01-10 00:00:00", "2024-01-12 12:00:00"
    )


@query
def status_counts(spark: SparkSession, folder: str) -> DataFrame:
    return history.status_counts(testdata.prediction_history(spark, folder))


@query
def dashboard_summary(spark: SparkSession, folder: str) -> DataFrame:
    return history.dashboard_summary(testdata.prediction_history(spark, folder))


@query
def seed_if_empty(spark: SparkSession, folder: str) -> DataFrame:
    seed = seeds.seed_requests(spark)
    return history.missing_seed_rows(seed, testdata.prediction_history(spark, folder))


# --- scans and alerts --------------------------------------------------------------------

SCAN_TIME = "2024-01-15 06:05:00"


@query
def risk_scan_24h(spark: SparkSession, folder: str) -> DataFrame:
    return alerts.risk_scan(testdata.prediction_history(spark, folder), SCAN_TIME)


@query
def monitor_alerts(spark: SparkSession, folder: str) -> DataFrame:
    return alerts.monitoring_alerts(testdata.prediction_history(spark, folder))


@query
def risk_windows_daily(spark: SparkSession, folder: str) -> DataFrame:
    return alerts.risk_windows(testdata.prediction_history(spark, folder))


@query
def risk_windows_sliding(spark: SparkSession, folder: str) -> DataFrame:
    rows = testdata.prediction_history(spark, folder)
    return alerts.risk_windows(rows, slide="6 hours", start="0 seconds")


# --- daily series --------------------------------------------------------------------------

EXTEND_TO = "2001-12-31"


def whole_series(spark: SparkSession, folder: str) -> DataFrame:
    return series.traffic_series(testdata.traffic_raw(spark, folder))


def panel(spark: SparkSession, folder: str) -> DataFrame:
    return series.traffic_series(testdata.traffic_panel_raw(spark, folder))


def stored_panel(spark: SparkSession, folder: str) -> DataFrame:
    return checkpointed(panel(spark, folder))


@query
def traffic_series(spark: SparkSession, folder: str) -> DataFrame:
    return whole_series(spark, folder).orderBy("series_key", "ds")


@query
def traffic_panel(spark: SparkSession, folder: str) -> DataFrame:
    return panel(spark, folder)


@query
def traffic_profile(spark: SparkSession, folder: str) -> DataFrame:
    return series.traffic_profile(panel(spark, folder))


@query
def traffic_trend(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(series.traffic_trend(panel(spark, folder)))


@query
def traffic_extended(spark: SparkSession, folder: str) -> DataFrame:
    return series.extend_series(stored_panel(spark, folder), EXTEND_TO)


@query
def traffic_extended_noise(spark: SparkSession, folder: str) -> DataFrame:
    """The scattered variant: noise drawn from series, day and seed."""
    return series.extend_series(stored_panel(spark, folder), EXTEND_TO, noise_sd=NOISE_SD, seed=42)


@query
def traffic_holdout_split(spark: SparkSession, folder: str) -> DataFrame:
    return series.holdout_split(stored_panel(spark, folder))


@query
def traffic_future_dates(spark: SparkSession, folder: str) -> DataFrame:
    return series.future_days(panel(spark, folder))


@query
def traffic_holidays(spark: SparkSession, folder: str) -> DataFrame:
    return series.with_holiday(whole_series(spark, folder)).select("series_key", "ds", "holiday")


@query
def traffic_features(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(series.traffic_features(panel(spark, folder)))


@query
def capacity_alerts(spark: SparkSession, folder: str) -> DataFrame:
    days = panel(spark, folder).withColumnRenamed("y", "predicted_footfall")
    return alerts.capacity_alerts(days)


@query
def forecast_totals(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored_panel(spark, folder)
    days = series.extend_series(rows, EXTEND_TO)
    return alerts.forecast_totals(days.withColumnRenamed("y", "predicted_footfall"), rows)


@query
def forecast_clamp(spark: SparkSession, folder: str) -> DataFrame:
    """Per order an estimate with many exact halves and values below zero."""
    estimates = testdata.table(spark, folder, "orders").selectExpr(
        "string(o_orderkey) AS series_key",
        "date(o_orderdate) AS ds",
        "floor(o_totalprice) / 2 - 60000 AS yhat",
        "floor(o_totalprice) / 2 - 90000 AS yhat_lower",
        "floor(o_totalprice) / 2 - 30000 AS yhat_upper",
    )
    return forecast.clamp(estimates)


@query
def forecast_metrics(spark: SparkSession, folder: str) -> DataFrame:
    split = series.holdout_split(stored_panel(spark, folder))
    return rounded(quality.forecast_metrics(forecast.extrapolation(checkpointed(split))))


def _as_points(days: DataFrame) -> DataFrame:
    return days.select(
        "series_key",
        "ds",
        F.col("y").alias("predicted_footfall"),
        (F.col("y") - 1000).alias("lower_bound"),
        (F.col("y") + 1000).alias("upper_bound"),
    )


@query
def forecast_display(spark: SparkSession, folder: str) -> DataFrame:
    return forecast.with_chart_dates(_as_points(panel(spark, folder)))


@query
def forecast_document(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the holdout days of every series."""
    held = series.last_rows(panel(spark, folder), 90)
    documents = forecast.forecast_document(_as_points(held))
    return documents.withColumn("forecast", F.to_json("forecast"))


@query
def traffic_meta(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored_panel(spark, folder)
    split = checkpointed(series.holdout_split(rows))
    measured = quality.forecast_metrics(forecast.extrapolation(split))
    return forecast.training_meta(rows, measured, trained_on=EXTEND_TO, model_version=MODEL_VERSION)


@query
def traffic_forecast(spark: SparkSession, folder: str) -> DataFrame:
    return forecast.forecast(forecast.fit(panel(spark, folder)))


def example_model(spark: SparkSession, folder: str) -> DataFrame:
    """A model of each series with coefficients that are stated and not learned, to check what is made from a model."""
    places = range(len(series.regression_features()))
    return panel(spark, folder).groupBy("series_key").agg(
        F.min("ds").alias("start_ds"),
        F.max("ds").alias("end_ds"),
        F.count("*").alias("train_rows"),
        F.lit(10.0).alias("intercept"),
        F.array(*(F.lit((k * 37 % 11 - 5) / 400) for k in places)).alias("coefficients"),
        F.lit(0.05).alias("sigma"),
        F.lit(0.04).alias("bend_scale"),
    )


@query
def traffic_predict(spark: SparkSession, folder: str) -> DataFrame:
    """Prediction and bounds of the stated models, from ten days before to ninety days after the training end."""
    days = F.explode(F.sequence(F.date_sub("end_ds", 10), F.date_add("end_ds", 90))).alias("ds")
    return rounded(forecast.predict(example_model(spark, folder).select("*", days)))


@query
def daily_forecast_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of the morning job over the stated models."""
    return traffic.daily_forecast(example_model(spark, folder)).totals


@query
def daily_forecast_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Capacity alerts of the morning job over the stated models, for all days ahead that it may be asked for."""
    return traffic.daily_forecast(example_model(spark, folder), days=MAX_FORECAST_DAYS, limit=22_000).alerts


@query
def daily_forecast_document(spark: SparkSession, folder: str) -> DataFrame:
    """The answers of the morning job with the quality of its models."""
    model = example_model(spark, folder)
    points = traffic.daily_forecast(model, days=14).points
    measured = model.select("series_key", F.lit(812.5).alias("mae"), F.lit(4.25).alias("mape_pct"))
    return forecast.forecast_document(points, measured).withColumn("forecast", F.to_json("forecast"))


@query
def traffic_forecast_shape(spark: SparkSession, folder: str) -> DataFrame:
    """What forecasts of fitted models over 1, 7, 14, 30 and 90 days look like: days, range, order of the bounds."""
    path = scratch_path(spark, "forecast-model")
    models.save_forecast_model(forecast.fit(panel(spark, folder)), path)
    model = models.load_forecast_model(spark, path)
    shapes = [
        forecast.forecast(model, days)
        .groupBy("series_key")
        .agg(
            F.lit(days).alias("days"),
            F.count("*").alias("points"),
            F.countDistinct("ds").alias("distinct_days"),
            F.min("ds").alias("first_ds"),
            F.max("ds").alias("last_ds"),
            F.every(F.expr("0 <= lower_bound AND lower_bound <= predicted_footfall AND predicted_footfall <= upper_bound")).alias("ordered"),
        )
        for days in (1, 7, 14, 30, 90)
    ]
    return reduce(DataFrame.unionByName, shapes)


@query
def traffic_eval(spark: SparkSession, folder: str) -> DataFrame:
    split = series.holdout_split(stored_panel(spark, folder))
    return rounded(forecast.evaluate(checkpointed(split)))


# --- streams: all events are played through a standing query; its table is the result -------


#: Parts of the events' time that arrive one after the other.
ARRIVALS = 4


def events_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events as a stream: files that arrive part by part of their time, a few per micro-batch."""
    path, events = scratch_path(spark, "arriving"), testdata.table(spark, folder, "events")
    ends = events.agg(F.min("ts").alias("first"), F.max("ts").alias("last")).first()
    if ends["first"] is not None:
        span = (ends["last"] - ends["first"]) / ARRIVALS
        for k in range(ARRIVALS):
            arrived = events.filter(F.col("ts") >= ends["first"] + k * span)
            if k + 1 < ARRIVALS:
                arrived = arrived.filter(F.col("ts") < ends["first"] + (k + 1) * span)
            arrived.write.mode("append").parquet(path)
    else:
        events.write.parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(path)


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return testdata.history_from(events_stream(spark, folder))


def _windows_now(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """The windows of all events that arrived, open ones too, as a standing query left them."""
    path = scratch_path(spark, "risk-windows")
    windows = streams.risk_window_stream(event_stream(spark, folder), lateness=None, **options)
    writer = streams.keyed_writer(windows, f"{path}/table", ["window_start", "window_end"])
    streams.run_available(writer, f"{path}/checkpoint")
    return streams.read_keyed(spark, f"{path}/table", windows.schema).withColumns(
        {name: F.col(name).cast("timestamp_ntz") for name in ("window_start", "window_end")}
    )


@query
def stream_risk_windows(spark: SparkSession, folder: str) -> DataFrame:
    return _windows_now(spark, folder)


@query
def stream_risk_windows_sliding(spark: SparkSession, folder: str) -> DataFrame:
    return _windows_now(spark, folder, slide="6 hours", start="0 seconds")


@query
def stream_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Requests that arrive as a stream, scored by the registered classifier: what was kept of them in either table."""
    path = scratch_path(spark, "streamed")
    requests_ = testdata.requests_from(events_stream(spark, folder))
    model = registered_classifier(spark, folder).model("delay")
    streams.run_available(streams.scoring_writer(requests_, model, f"{path}/history"), f"{path}/checkpoint")
    scored, refused = streams.read_scored(spark, f"{path}/history")
    both = scored.select("id", F.lit(None).cast("bigint").alias("refused_id")).unionByName(
        refused.select(F.lit(None).cast("bigint").alias("id"), F.col("request_id").alias("refused_id"))
    )
    return both.agg(
        F.count("id").alias("accepted"),
        F.countDistinct("id").alias("ids"),
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
        F.count("refused_id").alias("refused"),
        F.countDistinct("refused_id").alias("refused_requests"),
    )


@query
def stream_alerts(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "alerts")
    predictions = event_stream(spark, folder)
    streams.run_available(streams.alert_writer(predictions, f"{path}/table"), f"{path}/checkpoint")
    return streams.read_alerts(spark, f"{path}/table", predictions)


@query
def stream_status_counts(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "status-counts")
    writer = streams.status_count_writer(event_stream(spark, folder), f"{path}/table")
    streams.run_available(writer, f"{path}/checkpoint")
    return streams.latest_status_counts(spark, f"{path}/table")


# --- sources and sinks: what was written is read back -----------------------------------------


@query
def raw_csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The raw monthly table through a CSV file and back, then cleaned."""
    path = scratch_path(spark, "raw-csv")
    testdata.monthly_raw(spark, folder).write.option("header", True).csv(path)
    return rounded(cleaning.clean(tables.read_raw_csv(spark, path)))


@query
def clean_table_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The feature table written by year and read back."""
    path = scratch_path(spark, "clean-table")
    tables.write_clean(features.add_features(stored_cells(spark, folder)), path)
    return rounded(tables.read_clean(spark, path))


@query
def meta_json_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Training metadata written as JSON, read back, newest per series."""
    path = scratch_path(spark, "meta")
    tables.write_meta(traffic_meta(spark, folder), path)
    return tables.latest_meta(tables.read_meta(spark, path))


@query
def model_health(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of the live models, as the registry has it."""
    registry = models.ModelRegistry(spark, scratch_path(spark, "models"))
    registry.publish("traffic", None, {"meta": traffic_meta(spark, folder)})
    return tables.model_health(registry.table("traffic", "meta"))


@query
def requests_from_json(spark: SparkSession, folder: str) -> DataFrame:
    """Requests as JSON text, some with words or nothing where a number belongs, parsed and checked."""
    texts = testdata.table(spark, folder, "events").selectExpr(
        "event_id AS request_id",
        """CASE event_type
             WHEN 'error' THEN '{"year": "many'
             ELSE concat('{"year":', 2013 + user_id % 18, ',"month":"', 1 + event_id % 12, '","arr_flights":',
               IF(event_type = 'signup', '"many"', string(1 + floor(value))),
               IF(event_type = 'click', '', ',"isSummer":0'),
               ',"is_winter_holiday":0,"yearsSince2013":', user_id % 18,
               ',"airport_avg_delay_rate":0.25,"carrier_avg_delay_rate":0.125}')
           END AS body""",
    )
    checked = validation.validate(requests.parse_requests(texts))
    return checked.select(
        "request_id", "year", "month", "arr_flights", "is_summer", "years_since_2013",
        F.array_join("violations", ", ").alias("message"),
    )


@query
def history_append(spark: SparkSession, folder: str) -> DataFrame:
    """The history stored in two appends and read back: rows and ids per status."""
    path = scratch_path(spark, "history")
    rows = testdata.prediction_history(spark, folder)
    for prediction in (1, 0):
        history_store.append_history(rows.filter(F.col("high_delay_prediction") == prediction), path)
    return history_store.read_history(spark, path).groupBy("status").agg(
        F.count("*").alias("n"),
        F.count_distinct("id").alias("ids"),
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
    )


@query
def history_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Two batches, then the first one again, with the ids it had."""
    path = scratch_path(spark, "history")
    rows = testdata.prediction_history(spark, folder)
    for prediction in (1, 0, 1):
        part = rows.filter(F.col("high_delay_prediction") == prediction)
        history_store.append_history(part, path, f"prediction-{prediction}")
    return history_store.read_history(spark, path).groupBy("status").agg(
        F.count("*").alias("n"),
        F.count_distinct("id").alias("ids"),
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
    )


# --- delay model --------------------------------------------------------------------------------


@query
def seed_outcome(spark: SparkSession, folder: str) -> DataFrame:
    """An empty history filled with scenarios: how many were stored and how many refused, and what the history then holds."""
    path = scratch_path(spark, "seeded")
    model = registered_classifier(spark, folder).model("delay")
    outcome = scoring.seed_history(spark, model, path, testdata.score_requests(spark, folder))
    again = scoring.seed_history(spark, model, path, testdata.score_requests(spark, folder))
    return history_store.read_history(spark, path).agg(
        F.lit(outcome.seeded).cast("bigint").alias("seeded"),
        F.lit(outcome.failed).cast("bigint").alias("failed"),
        F.lit(again.seeded).cast("bigint").alias("seeded_again"),
        F.count("*").alias("held"),
    )


def registered_classifier(spark: SparkSession, folder: str) -> models.ModelRegistry:
    """The registry of this folder's models, with the delay classifier trained if it is not there yet.

    The classifier learns from averages over earlier months only. Its held-out
    rows are kept with it.
    """
    place = hashlib.sha256(os.path.normpath(folder).encode()).hexdigest()[:16]
    registry = models.ModelRegistry(spark, f"{shared_folder(spark)}/models/{spark.sparkContext.applicationId}/{place}")

    def train() -> tuple[PipelineModel, dict[str, DataFrame]]:
        featured = features.add_features(stored_cells(spark, folder), averages="asof")
        rows = delay_model.learning_rows(featured.na.drop(subset=list(MODEL_FEATURES)))
        return delay_model.fit(rows), {"held_out": rows.filter("NOT is_train")}

    registry.trained("delay", train)
    return registry


@query
def delay_eval(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of the registered delay classifier on the rows held out from its training."""
    registry = registered_classifier(spark, folder)
    return rounded(delay_model.evaluate(registry.table("delay", "held_out"), registry.model("delay")).report)


@query
def delay_score(spark: SparkSession, folder: str) -> DataFrame:
    """Requests scored by the registered delay classifier, kept in the history and answered."""
    return scoring.score_batch(
        testdata.score_requests(spark, folder),
        registered_classifier(spark, folder).model("delay"),
        scratch_path(spark, "predictions"),
    )
