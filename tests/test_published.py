"""Versioned tables, the model registry, and standing queries that publish through them."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsrisk.operators import alerts, history
from opsrisk.plans import scoring
from opsrisk.sources import models, published, testdata
from opsrisk.streaming import queries as streams
from tests.test_streaming import EVENTS, batch_of, stream_of, write_events

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType())])


def rows_of(table):
    return sorted((r["k"] or "", r["n"]) for r in table.read().collect())


def test_pointer_is_replaced(spark, folder):
    assert published.published(spark, f"{folder}/a b") is None
    for version in ("1", "2", "é"):
        published.publish(spark, f"{folder}/a b", version)
        assert published.published(spark, f"{folder}/a b") == version


def test_merge_keeps_the_newest_row_of_each_key_and_one_version(spark, folder):
    table = published.VersionedTable(spark, f"{folder}/t", SCHEMA)
    assert rows_of(table) == [] and table.live() is None
    frame = lambda *rows: spark.createDataFrame(rows, SCHEMA)
    table.merge(frame(("a", 1), (None, 1)), ["k"], "01")
    table.merge(frame(("a", 2), ("b", 5)), ["k"], "02")
    table.merge(frame((None, 7)), ["k"], "03")
    assert rows_of(table) == [("", 7), ("a", 2), ("b", 5)]
    # batches that are repeated change nothing
    table.merge(frame(("a", 100)), ["k"], "02")
    table.merge(frame(("a", 100)), ["k"], "03")
    assert rows_of(table) == [("", 7), ("a", 2), ("b", 5)]
    assert published.versions(spark, f"{folder}/t") == ["03"]


def test_a_version_that_was_not_published_is_not_read(spark, folder):
    table = published.VersionedTable(spark, f"{folder}/t", SCHEMA)
    table.merge(spark.createDataFrame([("a", 1)], SCHEMA), ["k"], "01")
    spark.createDataFrame([("a", 9)], SCHEMA).write.parquet(f"{folder}/t/02")
    assert rows_of(table) == [("a", 1)]
    table.merge(spark.createDataFrame([("a", 2)], SCHEMA), ["k"], "02")
    assert rows_of(table) == [("a", 2)] and published.versions(spark, f"{folder}/t") == ["02"]


def test_registry_trains_once_and_keeps_the_live_version(spark, folder):
    registry = models.ModelRegistry(spark, f"{folder}/models")
    with pytest.raises(FileNotFoundError):
        registry.table("m", "rows")
    trained = []

    def train():
        trained.append(1)
        return None, {"rows": spark.range(len(trained))}

    first = registry.trained("m", train)
    assert registry.trained("m", train) == first == registry.live("m") and trained == [1]
    registry.publish("m", *train())
    assert registry.table("m", "rows").count() == 2 and registry.live("m") != first
    assert registry.live("other") is None


@pytest.fixture
def source(spark, tmp_path):
    folder = str(tmp_path / "events")
    rows = [(i, i * 0.7, float((i * 37) % 120)) for i in range(200)]
    # the second file is late by days
    write_events(spark, folder, rows[:60], rows[120:], rows[60:61], rows[61:120])
    return folder


@pytest.mark.parametrize("options", [{}, {"slide": "6 hours", "start": "0 seconds"}])
def test_open_windows_and_late_rows_are_in_the_keyed_table(spark, source, folder, options):
    def writer():
        windows = streams.risk_window_stream(stream_of(spark, source), lateness=None, **options)
        return windows.schema, streams.keyed_writer(windows, f"{folder}/out", ["window_start", "window_end"])

    schema, first = writer()
    done = streams.run_available(first, f"{folder}/cp")
    assert done.lastProgress.batchId == 3
    got = streams.read_keyed(spark, f"{folder}/out", schema)
    whole = alerts.risk_windows(batch_of(spark, source), **options)
    kinds = [F.col(c).cast("string").alias(c) for c in whole.columns]
    assert sorted(got.select(*kinds).collect()) == sorted(whole.select(*kinds).collect())
    # events after a restart change the windows they fall in
    write_events(spark, f"{source}/more", [(900, 100.0, 99.0)])
    streams.run_available(writer()[1], f"{folder}/cp")
    whole = alerts.risk_windows(batch_of(spark, source), **options)
    got = streams.read_keyed(spark, f"{folder}/out", schema)
    assert sorted(got.select(*kinds).collect()) == sorted(whole.select(*kinds).collect())
    assert len(published.versions(spark, f"{folder}/out")) == 1


def test_windows_beyond_the_lateness_stay_as_they_were(spark, source, folder):
    windows = streams.risk_window_stream(stream_of(spark, source), lateness="1 hour")
    streams.run_available(streams.keyed_writer(windows, f"{folder}/out", ["window_start", "window_end"]), f"{folder}/cp")
    got = {r["window_start"]: r["predictions"] for r in streams.read_keyed(spark, f"{folder}/out", windows.schema).collect()}
    # rows are judged by the watermark of the batch before: the third file comes in time for it, the fourth doesn't
    on_time = batch_of(spark, source).filter(~F.col("id").between(61, 119))
    assert got == {r["window_start"]: r["predictions"] for r in _as_instants(alerts.risk_windows(on_time)).collect()}


def _as_instants(windows):
    return windows.withColumns({c: F.col(c).cast("timestamp") for c in ("window_start", "window_end")})


class _Fails(Exception):
    pass


@pytest.mark.parametrize("broken", ["append_history", "publish"])
def test_streamed_scoring_is_exactly_once_after_a_crash_between_its_tables(spark, source, folder, monkeypatch, broken):
    """The job dies in its second micro-batch, after one or both tables are written, and is started again."""
    monkeypatch.setattr(streams, "scored_requests", lambda batch, model: scoring.validation.valid_rows(scoring.validation.validate(batch)).withColumns(
        {"high_delay_prediction": F.lit(1), "high_delay_probability": F.lit(0.7), "status": F.lit("s"), "model_version": F.lit("v")}
    ))
    calls, real = [], getattr(streams, broken)

    def dies(*args):
        calls.append(1)
        if len(calls) == 2:
            raise _Fails
        return real(*args)

    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
    requests = testdata.requests_from(events)
    monkeypatch.setattr(streams, broken, dies)
    with pytest.raises(Exception):  # noqa: B017
        streams.run_available(streams.scoring_writer(requests, None, f"{folder}/h"), f"{folder}/cp")
    first, refused = streams.read_scored(spark, f"{folder}/h")
    assert first.count() + refused.count() == 60
    monkeypatch.setattr(streams, broken, real)
    streams.run_available(streams.scoring_writer(requests, None, f"{folder}/h"), f"{folder}/cp")
    scored, refused = streams.read_scored(spark, f"{folder}/h")
    ids = sorted(r["id"] for r in scored.collect())
    assert ids == list(range(1, len(ids) + 1))
    assert len(ids) + refused.count() == 200 and refused.select("request_id").distinct().count() == refused.count()


def test_no_batch_is_read_before_it_is_complete(spark, folder):
    with pytest.raises(FileNotFoundError):
        streams.read_scored(spark, f"{folder}/h")


def test_running_counts_leave_one_version(spark, source, folder):
    streams.run_available(streams.status_count_writer(stream_of(spark, source), f"{folder}/out"), f"{folder}/cp")
    got = {r["status"]: r["n"] for r in streams.latest_status_counts(spark, f"{folder}/out").collect()}
    assert got == {r["status"]: r["n"] for r in history.status_counts(batch_of(spark, source)).collect()}
    assert len(published.versions(spark, f"{folder}/out")) == 1
