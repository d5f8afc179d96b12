import random

import pytest
from pyspark.sql import functions as F

from opsrisk.constants import MODEL_FEATURES
from opsrisk.operators import delay_model, features
from opsrisk.plans import delay, monitoring, scoring
from opsrisk.schemas import RAW_SCHEMA, REQUEST_FIELDS, REQUEST_SCHEMA
from opsrisk.sources import history_store, models, tables

SMALL = delay_model.BoostingSettings(trees=8, depth=4)

HIGH = (2023.0, 7.0, 2000.0, 1.0, 0.0, 10.0, 0.35, 0.32)
LOW = (2023.0, 2.0, 50.0, 0.0, 0.0, 10.0, 0.08, 0.07)
BAD = (2023.0, 13.0, 50.0, 0.0, 0.0, 10.0, 0.08, 0.07)


def raw_rows(n=2000):
    """Rows whose delays depend on carrier, airport and season."""
    draw = random.Random(11)
    rows = []
    for i in range(n):
        year, month = 2013 + i % 11, 1 + (i // 11) % 12
        carrier, airport = draw.randrange(8), draw.randrange(12)
        flights = float(draw.randrange(40, 400))
        rate = 0.02 + 0.025 * carrier + 0.012 * airport + (0.08 if month in (6, 7, 8, 12) else 0.0)
        delayed = float(int(flights * min(1.0, max(0.0, rate + draw.gauss(0, 0.03)))))
        rows.append((year, month, f"C{carrier}", f"Carrier {carrier}", f"A{airport}", f"Airport {airport}", flights,
                     delayed, delayed, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0))
    return rows


@pytest.fixture(scope="module")
def pipeline(spark, tmp_path_factory):
    """Raw CSV to stored clean table to stored model."""
    folder = str(tmp_path_factory.mktemp("delay"))
    spark.createDataFrame(raw_rows(), RAW_SCHEMA).write.option("header", True).csv(f"{folder}/raw")
    audit = delay.build_clean_table(spark, f"{folder}/raw", f"{folder}/clean")
    model, evaluation = delay.train_and_save(spark, f"{folder}/clean", f"{folder}/model", SMALL)
    return folder, audit, model, evaluation


def requests(spark, *rows):
    return spark.createDataFrame(list(rows), REQUEST_SCHEMA)


def test_learnable_labels_are_learned(pipeline):
    _, audit, _, evaluation = pipeline
    assert audit.first()["clean_rows"] == 2000
    assert evaluation.auc.first()[0] > 0.8
    report = {r["row_label"]: r for r in evaluation.report.collect()}
    assert report["accuracy"]["support"] == report["0"]["support"] + report["1"]["support"]
    assert 300 < report["accuracy"]["support"] < 500


def test_explore(spark, pipeline):
    folder, *_ = pipeline
    found = delay.explore(tables.read_clean(spark, f"{folder}/clean"))
    assert {name: df.count() for name, df in found.items()} == {
        "profile": 1, "describe": 8, "histogram": 60, "by_month": 12, "by_carrier": 8, "causes": 5, "by_year": 11,
        "heatmap": 8, "extremes": 2,
    }


def test_saved_model_scores_alike(spark, pipeline):
    folder, _, model, _ = pipeline
    rows = requests(spark, HIGH, LOW)
    loaded = models.load_delay_model(f"{folder}/model")
    assert delay_model.score(rows, model).collect() == delay_model.score(rows, loaded).collect()
    with pytest.raises(Exception):
        models.load_delay_model(f"{folder}/none")


def test_scores(spark, pipeline):
    _, _, model, _ = pipeline
    high, low = delay_model.score(requests(spark, HIGH, LOW), model).orderBy(F.desc("arr_flights")).collect()
    for row in (high, low):
        assert row["high_delay_prediction"] in (0, 1)
        assert 0.0 <= row["high_delay_probability"] <= 1.0
        assert row["status"] == ("disruption_risk" if row["high_delay_prediction"] == 1 else "nominal")
        assert row["model_version"] == "v1"
    assert low["high_delay_probability"] < 0.5 < high["high_delay_probability"]


def test_batch_scoring_stores_and_answers(spark, pipeline, folder):
    _, _, model, _ = pipeline
    answers = scoring.score_batch(requests(spark, HIGH, LOW, BAD), model, f"{folder}/history")
    assert set(answers.columns) == {
        "highDelayPrediction", "highDelayProbability", "status", "modelVersion", "predictedAt", "historyId",
    }
    assert sorted(r["historyId"] for r in answers.collect()) == [1, 2]
    stored = history_store.read_history(spark, f"{folder}/history")
    assert sorted(r["flight_month"] for r in stored.collect()) == [2, 7]
    assert scoring.read_refused(spark, f"{folder}/history").count() == 1


def test_nothing_that_is_required_is_filled_in(spark, pipeline, folder):
    _, _, model, _ = pipeline
    good = requests(spark, HIGH)
    for gap in ("is_summer", "is_winter_holiday", "years_since_2013"):
        row = good.withColumn(gap, F.lit(None).cast("double"))
        assert scoring.scored_requests(row, model).count() == 0
        assert [tuple(r) for r in scoring.outcomes(row).select("accepted", "message").collect()] == [(False, f"{gap} is required")]


def test_seeding_happens_once(spark, pipeline, folder):
    _, _, model, _ = pipeline
    first = scoring.seed_history(spark, model, f"{folder}/history")
    again = scoring.seed_history(spark, model, f"{folder}/history")
    assert (first.seeded, first.failed, again.seeded, again.failed) == (30, 0, 0, 0)
    assert history_store.read_history(spark, f"{folder}/history").count() == 30


def test_monitoring_and_scan(spark, pipeline, folder):
    _, _, model, _ = pipeline
    raised = monitoring.monitor(spark, model, "2024-07-03 12:00:00", f"{folder}/history", f"{folder}/alerts")
    stored = history_store.read_history(spark, f"{folder}/history").first()
    assert (stored["flight_year"], stored["flight_month"], stored["arr_flights"], stored["is_summer"]) == (2024, 7, 250.0, 1.0)
    assert raised.count() == int(stored["high_delay_probability"] >= 0.65)
    scan = monitoring.daily_risk_scan(spark, f"{folder}/history", "2024-07-04 06:05:00", f"{folder}/alerts")
    stored_alerts = scan.count() + raised.count()
    assert scan.count() == raised.count()
    # a repeated run replaces itself
    monitoring.monitor(spark, model, "2024-07-03 12:00:00", f"{folder}/history", f"{folder}/alerts")
    assert history_store.read_history(spark, f"{folder}/history").count() == 1
    assert tables.read_alerts(spark, f"{folder}/alerts").count() == stored_alerts


def test_scan_stores_its_alert(spark, folder):
    sure = spark.range(5).selectExpr(
        "1 AS flight_month", "2024 AS flight_year", "250D AS arr_flights", "0D AS is_summer", "1D AS is_winter_holiday",
        "11D AS years_since_2013", "0.2D AS airport_avg_delay_rate", "0.2D AS carrier_avg_delay_rate",
        "1 AS high_delay_prediction", "0.5D + id / 10D AS high_delay_probability", "'disruption_risk' AS status",
        "'v1' AS model_version", "TIMESTAMP '2024-01-10 08:00:00' AS created_at",
    )
    history_store.append_history(sure, f"{folder}/history")
    for _ in range(2):
        alert = monitoring.daily_risk_scan(spark, f"{folder}/history", "2024-01-10 09:00:00", f"{folder}/alerts").first()
    assert alert["message"].startswith("3 high-risk delay predictions")
    assert tables.read_alerts(spark, f"{folder}/alerts").count() == 1


def test_asof_features_train_too(spark):
    rows = spark.createDataFrame(raw_rows(600), RAW_SCHEMA).withColumn("delay_rate", F.col("arr_del15") / F.col("arr_flights"))
    featured = features.add_features(rows, "asof")
    known = featured.na.drop(subset=list(MODEL_FEATURES))
    learning = delay_model.learning_rows(known)
    # no row is lost but for what the model reads
    assert learning.count() == featured.filter("airport_avg_delay_rate IS NOT NULL AND carrier_avg_delay_rate IS NOT NULL").count()
    assert set(MODEL_FEATURES) <= set(learning.columns)
    assert delay_model.fit(learning, delay_model.BoostingSettings(trees=2, depth=2)).stages[-1].getNumTrees == 2


def test_csv_missing_tokens(spark, folder):
    header = "carrier,year,month," + ",".join(f.name for f in RAW_SCHEMA if f.name not in ("carrier", "year", "month")) + ",extra"
    lines = [
        header,
        "AA,2020,7,Alpha,XXX,X Hub,10.0,NA,NaN,,1.0,0.0,null,1.0,0.0,ignored",
        "BB,2020.0,8,Beta,YYY,Y Hub,5,2,1,0,1,0,0,0,0,ignored",
    ]
    with open(f"{folder}/raw.csv", "w") as out:
        out.write("\n".join(lines))
    got = {r["month"]: r for r in tables.read_raw_csv(spark, f"{folder}/raw.csv").collect()}
    assert got[7]["arr_del15"] is None and got[7]["carrier_ct"] is None and got[7]["weather_ct"] is None
    assert (got[8]["year"], got[8]["arr_flights"], got[8]["carrier"]) == (2020, 5.0, "BB")


def test_bad_number_fails(spark, folder):
    header = ",".join(f.name for f in RAW_SCHEMA)
    with open(f"{folder}/raw.csv", "w") as out:
        out.write(f"{header}\n2020,7,A,A,X,X,many,1,0,0,0,0,0,0,0\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tables.read_raw_csv(spark, f"{folder}/raw.csv").collect()


def test_absent_metadata_is_empty(spark, folder):
    assert tables.read_meta(spark, f"{folder}/none").count() == 0


def test_clean_csv_round_trip(spark, folder, pipeline):
    where, *_ = pipeline
    clean = tables.read_clean(spark, f"{where}/clean")
    tables.write_clean_csv(clean, f"{folder}/clean-csv")
    back = spark.read.schema(clean.schema).option("header", True).csv(f"{folder}/clean-csv")
    assert back.exceptAll(clean).count() == 0 and back.count() == clean.count()


def test_request_fields_match_model_features():
    assert tuple(REQUEST_FIELDS) == MODEL_FEATURES
