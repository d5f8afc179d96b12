from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsrisk.functions.calendar import seasonal_effect, us_holiday, weekly_effect
from opsrisk.functions.rates import whole_count
from opsrisk.operators import alerts, forecast, series
from opsrisk.plans import traffic
from opsrisk.sources import models, tables

SCHEMA = "series_key string, ds date, y bigint"


def daily(spark, values, start=date(2020, 1, 1), key="A"):
    return spark.createDataFrame([(key, start + timedelta(i), v) for i, v in enumerate(values)], SCHEMA)


def seasonal_values(days, start=date(2018, 1, 1)):
    out = []
    for i in range(days):
        d = start + timedelta(i)
        level = 20000 + 4 * i
        out.append(int(level * (1 + 0.2 * np.sin(2 * np.pi * d.timetuple().tm_yday / 365.25)) * (1.15 if d.weekday() == 4 else 1.0)))
    return out


def test_effects(spark):
    days = [date(2020, 12, 13), date(2020, 12, 14), date(2020, 12, 15), date(2020, 7, 1)]
    rows = spark.createDataFrame([(d,) for d in days], "ds date").select(
        weekly_effect(F.col("ds")).alias("w"), seasonal_effect(F.col("ds")).alias("s")
    )
    assert [tuple(r) for r in rows.collect()] == [(1700, 0), (-600, 0), (-1400, 4200), (-900, 3500)]


def test_observed_holidays(spark):
    expected = {
        date(2021, 12, 31): "New Year's Day (observed)",  # Jan 1, 2022 is a Saturday
        date(2022, 1, 1): "New Year's Day",
        date(2020, 6, 19): None,
        date(2021, 6, 18): "Juneteenth National Independence Day (observed)",
        date(2023, 11, 10): "Veterans Day (observed)",
        date(2022, 12, 26): "Christmas Day (observed)",
        date(2023, 11, 23): "Thanksgiving Day",
        date(2023, 5, 29): "Memorial Day",
        date(2023, 5, 22): None,
    }
    rows = spark.createDataFrame([(d,) for d in expected], "ds date")
    assert {r["ds"]: r["h"] for r in rows.select("ds", us_holiday("ds").alias("h")).collect()} == expected


def test_extension_of_current_series_adds_nothing(spark):
    rows = daily(spark, [10000] * 5)
    for as_of in ("2020-01-05", "2019-12-31"):
        assert series.extend_series(rows, as_of).count() == 5


def test_extension_floor_and_trend(spark):
    rows = daily(spark, [6000 - 40 * i for i in range(100)])
    new = series.extend_series(rows, "2020-05-01").filter("ds > '2020-04-09'").orderBy("ds").collect()
    assert len(new) == 22
    assert min(r["y"] for r in new) == 5000
    # change over the last 90 rows is divided by 90
    slope = (6000 - 40 * 99 - (6000 - 40 * 10)) / 90
    assert series.traffic_trend(rows).first()["slope"] == pytest.approx(slope)


def test_noise_is_repeatable(spark):
    rows = daily(spark, [20000] * 10)
    first, second = (series.extend_series(rows, "2020-02-01", noise_sd=500.0, seed=1).collect() for _ in range(2))
    assert sorted(first) == sorted(second)
    assert sorted(first) != sorted(series.extend_series(rows, "2020-02-01").collect())


def test_short_series_is_all_holdout(spark):
    assert series.holdout_split(daily(spark, [1, 2, 3]), 90).filter("is_holdout").count() == 3


def test_rounding_of_points(spark):
    rows = spark.createDataFrame([(2.5,), (3.5,), (-4.0,), (None,)], "v double")
    assert [r[0] for r in rows.select(whole_count(F.col("v"))).collect()] == [2, 4, 0, None]


@pytest.fixture(scope="module")
def model(spark):
    return forecast.fit(daily(spark, seasonal_values(1100), date(2018, 1, 1))).cache()


@pytest.mark.parametrize("days", [1, 7, 14, 30, 90])
def test_number_of_points(model, days):
    points = forecast.forecast(model, days).collect()
    assert len(points) == days
    for p in points:
        assert 0 <= p["lower_bound"] <= p["predicted_footfall"] <= p["upper_bound"]
    assert min(p["ds"] for p in points) == date(2018, 1, 1) + timedelta(1100)


@pytest.mark.parametrize("days", [0, 366, 400])
def test_days_out_of_range(model, days):
    with pytest.raises(ValueError, match="days must be between 1 and 365"):
        forecast.forecast(model, days)


def test_seasonal_series_is_learned(spark):
    rows = daily(spark, seasonal_values(1100), date(2018, 1, 1))
    row = forecast.evaluate(series.holdout_split(rows)).first()
    assert row["n"] == 90
    assert row["mape_pct"] < 3


def test_interval_widens(model):
    points = forecast.forecast(model, 365).orderBy("ds").collect()
    width = [(p["upper_bound"] - p["lower_bound"]) / p["predicted_footfall"] for p in points]
    assert width[-1] > width[0]


def test_rows_merged_by_day_give_the_same_fit(spark):
    """Many rows a day fit like the rows themselves in a direct solve."""
    draw = np.random.default_rng(0)
    days = [(date(2019, 1, 1) + timedelta(int(i)), int(v)) for i, v in zip(draw.integers(0, 500, 3000), draw.integers(500, 900, 3000))]
    days += [(date(2019, 1, 1), 700), (date(2019, 1, 1) + timedelta(499), 700)]
    rows = spark.createDataFrame([("A", d, v) for d, v in days], SCHEMA)
    fitted = forecast.fit(rows).first()
    assert fitted["train_rows"] == len(days)

    featured = forecast._with_features(series.with_training_range(rows)).select("features", "y").collect()
    x = np.array([r["features"] for r in featured])
    z = np.log([r["y"] for r in featured])
    x0, z0 = x.mean(axis=0), z.mean()
    penalty = fitted["sigma"] ** 2 / np.square(forecast._prior_widths())
    beta = np.linalg.solve((x - x0).T @ (x - x0) + np.diag(penalty), (x - x0).T @ (z - z0))
    assert np.allclose(beta, fitted["coefficients"], atol=1e-6)
    residual = (z - z0) - (x - x0) @ beta
    assert fitted["sigma"] == pytest.approx(np.sqrt((residual**2).mean()), rel=1e-6)


def test_one_series_does_not_change_another(spark):
    a = daily(spark, seasonal_values(800), date(2018, 1, 1), "A")
    b = daily(spark, [500] * 400, date(2019, 1, 1), "B")
    both = {r["series_key"]: r for r in forecast.fit(a.unionByName(b)).collect()}
    assert set(both) == {"A", "B"}
    alone = forecast.fit(b).first()
    assert np.allclose(both["B"]["coefficients"], alone["coefficients"], atol=1e-9)


def test_saved_coefficients_forecast_alike(spark, model, folder):
    models.save_forecast_model(model, f"{folder}/model")
    loaded = models.load_forecast_model(spark, f"{folder}/model")
    assert forecast.forecast(loaded, 7).collect() == forecast.forecast(model, 7).collect()
    with pytest.raises(Exception):
        models.load_forecast_model(spark, f"{folder}/none").collect()


def test_series_from_csv(spark, folder):
    with open(f"{folder}/traffic.csv", "w") as out:
        out.write("date,passenger_footfall\n2020-01-02,110\n2020-01-01,100\n")
    rows = tables.read_traffic_csv(spark, f"{folder}/traffic.csv").orderBy("ds").collect()
    assert [tuple(r) for r in rows] == [("ALL", date(2020, 1, 1), 100), ("ALL", date(2020, 1, 2), 110)]


def test_document(spark, model):
    points = forecast.forecast(model, 3)
    document = forecast.forecast_document(points).first()
    assert document["forecast_days"] == 3
    assert [p["date"] for p in document["forecast"]] == [document["forecast_from"], "2021-01-06", document["forecast_to"]]
    assert document["model_mae"] == 0.0


def test_empty_forecast_has_no_rows(spark):
    empty = spark.createDataFrame([], "series_key string, ds date, predicted_footfall bigint")
    assert alerts.capacity_alerts(empty).count() == 0
    assert alerts.forecast_totals(empty).count() == 0
    asked = spark.createDataFrame([("a",)], "series_key string")
    assert [tuple(r) for r in alerts.forecast_totals(empty, asked).collect()] == [("a", 0, 0)]


def test_traffic_job(spark):
    observed = daily(spark, seasonal_values(900), date(2018, 1, 1))
    trained = {split: traffic.train_traffic(observed, "2020-09-01", split=split) for split in ("observed", "extended")}
    for fitted in trained.values():
        meta = fitted.meta.first()
        assert (meta["holdout_days"], str(meta["date_max"]), meta["train_rows"]) == (90, "2020-09-01", 975)
    assert trained["observed"].meta.first()["mape_pct"] != trained["extended"].meta.first()["mape_pct"]
    morning = traffic.daily_forecast(trained["observed"].coefficients, 30, limit=0)
    assert morning.points.count() == morning.alerts.count() == 30
    assert morning.totals.first()["peak_footfall"] == morning.points.agg(F.max("predicted_footfall")).first()[0]
    with pytest.raises(ValueError):
        traffic.train_traffic(observed, "2020-09-01", split="none")
