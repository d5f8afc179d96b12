from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opsrisk.operators import alerts, delay_model, history
from opsrisk.schemas import REQUEST_FIELDS, REQUEST_SCHEMA
from opsrisk.sources import history_store, testdata
from opsrisk.streaming import queries as streams

EVENTS = testdata.TABLE_SCHEMAS["events"]


def write_events(spark, folder, *files):
    """Event files that a stream reads one by one, oldest first."""
    import os
    import time

    for i, rows in enumerate(files):
        path = f"{folder}/part-{i}"
        spark.createDataFrame(
            [(n, datetime(2024, 1, 1) + timedelta(hours=h), 1, "view", v, "{}") for n, h, v in rows], EVENTS
        ).coalesce(1).write.parquet(path)
        for name in os.listdir(path):
            stamp = time.time() - 1000 + i
            os.utime(f"{path}/{name}", (stamp, stamp))


def stream_of(spark, folder):
    events = (
        spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
    )
    return testdata.history_from(events)


def batch_of(spark, folder):
    return testdata.history_from(spark.read.schema(EVENTS).option("recursiveFileLookup", True).parquet(folder))


@pytest.fixture
def source(spark, tmp_path):
    folder = str(tmp_path / "events")
    rows = [(i, i * 0.7, float((i * 37) % 120)) for i in range(200)]
    write_events(spark, folder, rows[:60], rows[60:61], rows[61:140], rows[140:])
    return folder


def test_stream_windows_equal_batch_windows(spark, source, folder):
    windows = streams.risk_window_stream(stream_of(spark, source))
    done = streams.run_available(streams.table_writer(windows, f"{folder}/out"), f"{folder}/cp")
    assert done.lastProgress is not None
    got = spark.read.schema(windows.schema).parquet(f"{folder}/out")
    whole = alerts.risk_windows(batch_of(spark, source))
    closed = whole.filter(F.col("window_end") <= F.lit(datetime(2024, 1, 1) + timedelta(hours=199 * 0.7 - 1)))
    kinds = [F.col(c).cast("string").alias(c) for c in whole.columns]
    assert sorted(got.select(*kinds).collect()) == sorted(closed.select(*kinds).collect())
    assert got.count() >= 4


def test_late_rows_do_not_change_closed_windows(spark, tmp_path, folder):
    source = str(tmp_path / "events")
    write_events(
        spark, source,
        [(1, 10.0, 90.0), (2, 40.0, 90.0)],
        [(3, 41.0, 10.0)],
        [(4, 11.0, 90.0)],  # its window has been closed
        [(5, 80.0, 90.0)],
    )
    windows = streams.risk_window_stream(stream_of(spark, source))
    streams.run_available(streams.table_writer(windows, f"{folder}/out"), f"{folder}/cp")
    counts = [r["predictions"] for r in spark.read.schema(windows.schema).parquet(f"{folder}/out").orderBy("window_start").collect()]
    assert counts == [1, 2]


def test_alerts_are_raised_once(spark, tmp_path, folder):
    source = str(tmp_path / "events")
    write_events(
        spark, source,
        [(1, 1.0, 90.0), (2, 1.1, 20.0)],
        [(1, 1.0, 90.0), (3, 1.2, 65.0)],  # the first one arrives again
    )
    predictions = stream_of(spark, source)
    streams.run_available(streams.alert_writer(predictions, f"{folder}/out"), f"{folder}/cp")
    assert sorted(r["ref_id"] for r in streams.read_alerts(spark, f"{folder}/out", predictions).collect()) == ["1", "3"]


def test_late_predictions_raise_alerts(spark, tmp_path, folder):
    source = str(tmp_path / "events")
    write_events(spark, source, [(1, 10.0, 90.0)], [(2, 40.0, 20.0)], [(3, 11.0, 99.0)], [(4, 80.0, 90.0), (1, 10.0, 90.0)])
    predictions = stream_of(spark, source)
    streams.run_available(streams.alert_writer(predictions, f"{folder}/out"), f"{folder}/cp")
    assert sorted(r["ref_id"] for r in streams.read_alerts(spark, f"{folder}/out", predictions).collect()) == ["1", "3", "4"]


def test_restart_goes_on_where_it_stopped(spark, source, folder, tmp_path):
    writer = lambda: streams.status_count_writer(stream_of(spark, source), f"{folder}/out")
    streams.run_available(writer(), f"{folder}/cp")
    write_events(spark, str(tmp_path / "events" / "later"), [(900, 150.0, 90.0)])
    streams.run_available(writer(), f"{folder}/cp")
    got = {r["status"]: r["n"] for r in streams.latest_status_counts(spark, f"{folder}/out").collect()}
    assert got == {r["status"]: r["n"] for r in history.status_counts(batch_of(spark, source)).collect()}
    assert sum(got.values()) == 201


def test_stream_scoring_equals_batch_scoring(spark, folder, tmp_path):
    rows = [(2020.0, float(1 + i % 12), 10.0 + i, 0.0, 0.0, 7.0, (i % 50) / 100, 0.2) for i in range(300)]
    requests = spark.createDataFrame(rows, REQUEST_SCHEMA)
    labelled = requests.withColumn("high_delay", (F.col("airport_avg_delay_rate") > 0.25).cast("int"))
    model = delay_model.delay_pipeline(delay_model.BoostingSettings(trees=3, depth=2)).fit(labelled)
    source = str(tmp_path / "requests")
    bad = requests.limit(10).withColumn("month", F.lit(13.0))
    requests.unionByName(bad).repartition(3).write.parquet(source)
    stream = spark.readStream.schema(REQUEST_SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    streams.run_available(streams.scoring_writer(stream, model, f"{folder}/history"), f"{folder}/cp")
    stored = history_store.read_history(spark, f"{folder}/history")
    assert sorted(r["id"] for r in stored.select("id").collect()) == list(range(1, 301))
    expected = delay_model.score(requests, model)
    pair = ["arr_flights", "high_delay_probability", "status"]
    assert sorted(stored.select(*pair).collect()) == sorted(expected.select(*pair).collect())
    assert len(REQUEST_FIELDS) == 8
