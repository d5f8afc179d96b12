from datetime import datetime

import pytest
from pyspark.sql import functions as F

from opsrisk.operators import alerts, history, validation
from opsrisk.schemas import HISTORY_SCHEMA, REQUEST_FIELDS, REQUEST_SCHEMA
from opsrisk.sources import history_store, seeds
from opsrisk.sources.requests import parse_requests

VALID = (2026.0, 7.0, 150.0, 1.0, 0.0, 13.0, 0.185, 0.142)


def request(spark, **changes):
    row = dict(zip(REQUEST_FIELDS, VALID)) | changes
    return spark.createDataFrame([tuple(row[f] for f in REQUEST_FIELDS)], REQUEST_SCHEMA)


def reasons(df):
    return validation.validate(df).first()["violations"]


def test_valid_request(spark):
    assert reasons(request(spark)) == []


@pytest.mark.parametrize(
    ("change", "message"),
    [
        ({"arr_flights": None}, "arr_flights is required"),
        ({"month": 13.0}, "month must be between 1 and 12"),
        ({"month": 0.0}, "month must be between 1 and 12"),
        ({"year": 2012.0}, "year must be >= 2013"),
        ({"year": 2031.0}, "year must be <= 2030"),
        ({"arr_flights": 0.5}, "arr_flights must be >= 1"),
        ({"arr_flights": float("nan")}, "arr_flights must be >= 1"),
        ({"month": float("nan")}, "month must be between 1 and 12"),
        ({"is_summer": 2.0}, "must be less than or equal to 1"),
        ({"years_since_2013": -1.0}, "must be greater than or equal to 0"),
        ({"airport_avg_delay_rate": 1.5}, "must be less than or equal to 1.0"),
        ({"carrier_avg_delay_rate": -0.1}, "must be greater than or equal to 0.0"),
    ],
)
def test_broken_rules(spark, change, message):
    assert reasons(request(spark, **change)) == [message]


def test_messages_are_joined_in_quarantine(spark):
    checked = validation.validate(request(spark, year=None, month=13.0))
    assert validation.valid_rows(checked).count() == 0
    assert validation.quarantine(checked).first()["message"] == "year is required, month must be between 1 and 12"


def test_requests_from_json(spark):
    bodies = [
        '{"year":2026,"month":"7","arrFlights":150,"isSummer":1,"isWinterHoliday":0,"yearsSince2013":13,'
        '"airportAvgDelayRate":0.185,"carrierAvgDelayRate":0.142}',
        '{"year":2026,"month":7,"arr_flights":"many"}',
        "no json",
        '{"year":"NaN"}',
    ]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    got = {r["i"]: r for r in validation.validate(parse_requests(rows)).collect()}
    assert got[0]["is_valid"] and got[0]["month"] == 7.0 and got[0]["arr_flights"] == 150.0
    assert "arr_flights is required" in got[1]["violations"]
    assert len(got[2]["violations"]) == len(REQUEST_FIELDS)
    assert got[3]["violations"][0] == "year is required"


def test_public_names(spark):
    public = request(spark).withColumnsRenamed({v: k for k, v in validation.REQUEST_NAMES.items()})
    assert tuple(validation.from_public_names(public).columns) == REQUEST_FIELDS


def past(spark, *rows):
    """History rows from (id, probability, created_at)."""
    return spark.createDataFrame(
        [
            (i, 1, 2024, 250.0, 0.0, 1.0, 11.0, 0.2, 0.2, int(p >= 0.5), p,
             "disruption_risk" if p >= 0.5 else "nominal", "v1", datetime.fromisoformat(t))
            for i, p, t in rows
        ],
        HISTORY_SCHEMA,
    )


def test_empty_history(spark):
    empty = past(spark)
    row = history.dashboard_summary(empty).first()
    assert tuple(row) == (0, 0, 0, 0.0, 0)
    assert history.history_recent(empty).count() == 0
    assert alerts.risk_scan(empty, "2024-01-15 06:05:00").count() == 0


def test_range_includes_both_ends(spark):
    rows = past(spark, (1, 0.1, "2024-01-01 00:00:00"), (2, 0.1, "2024-01-02 00:00:00"), (3, 0.1, "2024-01-02 00:00:01"))
    got = history.history_between(rows, "2024-01-01 00:00:00", "2024-01-02 00:00:00").collect()
    assert [r["id"] for r in got] == [2, 1]


def test_alert_threshold_is_inclusive(spark):
    rows = past(spark, (1, 0.65, "2024-01-15 06:05:00"), (2, 0.6499, "2024-01-15 06:00:00"), (3, 0.9, "2024-01-14 06:04:59"))
    scan = alerts.risk_scan(rows, "2024-01-15 06:05:00").first()
    assert (scan["predictions"], scan["high_risk"]) == (2, 1)
    assert scan["message"].startswith("1 high-risk delay predictions detected")
    messages = [r["message"] for r in alerts.monitoring_alerts(rows).orderBy("ref_id").collect()]
    assert len(messages) == 2
    assert "for Jan/2024: probability=65.0%." in messages[0]


def test_display_columns(spark):
    rows = history.with_display(past(spark, (1, 0.5, "2024-01-01 00:00:00"), (2, 0.1235, "2024-01-01 00:00:00")))
    got = {r["id"]: r for r in rows.collect()}
    assert (got[1]["badge"], got[1]["period"], got[1]["bar_high"], got[1]["probability_pct"]) == (
        "High Risk", "2024/01", False, 50.0,
    )
    assert (got[2]["badge"], got[2]["probability_pct"]) == ("Nominal", 12.4)


def test_appends_get_consecutive_ids(spark, folder):
    path = f"{folder}/history"
    assert history_store.read_history(spark, path).count() == 0
    rows = past(spark, *((0, i / 1000, "2024-01-01 00:00:00") for i in range(500))).repartition(7)
    history_store.append_history(rows, path, "a")
    history_store.append_history(rows.drop("created_at"), path, "b")
    ids = sorted(r["id"] for r in history_store.read_history(spark, path).select("id").collect())
    assert ids == list(range(1, 1001))


def test_repeated_append_replaces_itself(spark, folder):
    path = f"{folder}/history"
    rows = past(spark, *((0, i / 100, "2024-01-01 00:00:00") for i in range(50)))
    history_store.append_history(rows, path, "000")
    for _ in range(2):
        history_store.append_history(rows, path, "001")
    ids = sorted(r["id"] for r in history_store.read_history(spark, path).select("id").collect())
    assert ids == list(range(1, 101))


def test_replayed_batch_keeps_its_ids(spark, folder):
    path = f"{folder}/history"
    rows = {k: past(spark, *((0, k + i / 100, "2024-01-01 00:00:00") for i in range(50))) for k in (0, 1)}
    for k, batch in ((0, "a"), (1, "b"), (0, "a")):
        history_store.append_history(rows[k], path, batch)
    got = history_store.read_history(spark, path).select("id", "high_delay_probability").collect()
    assert sorted(r["id"] for r in got if r["high_delay_probability"] < 1) == list(range(1, 51))
    assert sorted(r["id"] for r in got if r["high_delay_probability"] >= 1) == list(range(51, 101))
    with pytest.raises(ValueError, match="had 50 rows and now has 49"):
        history_store.append_history(rows[0].limit(49), path, "a")


def test_appending_nothing(spark, folder):
    path = f"{folder}/history"
    history_store.append_history(past(spark), path)
    assert history_store.read_history(spark, path).count() == 0


def test_missing_values_are_refused(spark, folder):
    rows = past(spark, (1, 0.5, "2024-01-01 00:00:00")).withColumn("model_version", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="must not be null"):
        history_store.append_history(rows, f"{folder}/history")


def test_seed_only_when_empty(spark):
    assert seeds.seed_requests(spark).count() == 30
    assert seeds.seed_for(past(spark)).count() == 30
    assert seeds.seed_for(past(spark, (1, 0.5, "2024-01-01 00:00:00"))).count() == 0
    assert validation.valid_rows(validation.validate(seeds.seed_requests(spark))).count() == 30
