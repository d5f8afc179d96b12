"""Ranks by counting, fits from sums, hash noise, and jobs that read their rows once."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsrisk.operators import alerts, eda, forecast, learning_sets, ordered, quality, series
from opsrisk.plans import traffic


def frame(spark, values, name="v"):
    return spark.createDataFrame([(float(v),) for v in values], f"{name} double").repartition(4)


@pytest.mark.parametrize("listed", [1, 7, 20_000])
def test_values_at_ranks_are_those_of_the_sorted_values(spark, monkeypatch, listed):
    monkeypatch.setattr(ordered, "LISTED", listed)
    monkeypatch.setattr(ordered, "PARTS", 16)
    draw = np.random.default_rng(1)
    kinds = {
        0: draw.normal(0, 1, 300),
        1: np.exp(draw.normal(0, 12, 300)) * draw.choice([-1, 1], 300),
        2: np.repeat([3.0, 3.0 + 1e-15, 7.0], 50),
        3: np.array([-1.7e308, 1.7e308, 0.0, 5e-324, 1.0]),
        4: np.array([2.5]),
    }
    rows = [(k, float(v)) for k, values in kinds.items() for v in values] + [(0, None), (0, float("nan")), (0, float("inf"))]
    df = spark.createDataFrame(rows, "g int, v double")
    wanted = {k: sorted({0, len(v) // 3, len(v) // 2, len(v) - 1, len(v)}) for k, v in kinds.items()} | {9: [0]}
    got = ordered.values_at(df, "v", wanted, by="g")
    assert got == {(k, r): float(np.sort(v)[r]) for k, v in kinds.items() for r in wanted[k] if r < len(v)}


def test_quantiles_of_any_numbers(spark):
    values = np.random.default_rng(2).lognormal(0, 3, 999) - 2
    found = ordered.exact_quantiles(frame(spark, values), "v", {"a": 0.0, "b": 0.1, "c": 0.5, "d": 1.0}).first()
    assert list(found) == pytest.approx(np.quantile(values, [0, 0.1, 0.5, 1]), rel=1e-12)
    assert list(ordered.exact_quantiles(frame(spark, []), "v", {"a": 0.5}).first()) == [None]


def test_running_totals_of_any_numbers(spark):
    values = np.random.default_rng(3).integers(-5, 5, 400) * 1e6
    rows = frame(spark, values).withColumn("n", F.lit(2))
    got = {r["v"]: (r["n"], r["n_before"], r["n_total"]) for r in ordered.cumulative_counts(rows, "v", ["n"]).collect()}
    assert got == {v: (2 * (values == v).sum(), 2 * (values < v).sum(), 800) for v in set(values)}


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_auc_of_margins(spark, scale):
    draw = np.random.default_rng(4)
    label = draw.integers(0, 2, 700)
    score = np.round(draw.normal(label, 1.5, 700), 1) * scale
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(label, score)], "label int, score double").repartition(5)
    pos, neg = score[label == 1], score[label == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert quality.roc_auc(df).first()[0] == pytest.approx(want, abs=1e-12)


def test_exact_split_moves_no_rows(spark):
    rows = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 7 == 0).cast("int").alias("high_delay"))
    split = learning_sets.with_exact_split(rows, ["k"])
    counts = {(r["high_delay"], r["is_train"]): r["count"] for r in split.groupBy("high_delay", "is_train").count().collect()}
    assert counts[1, False] + counts[0, False] == 600 and counts[1, False] in (85, 86)
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    single = learning_sets.with_exact_split(rows.filter("high_delay = 0"), ["k"])
    assert single.filter("NOT is_train").count() == -(-2571 * 2 // 10)
    assert learning_sets.with_exact_split(rows.limit(0), ["k"]).count() == 0


def days(n, start=date(2020, 1, 1), key="a", seed=0):
    draw = np.random.default_rng(seed)
    return [(key, start + timedelta(days=k), int(20_000 + 10 * k + 900 * (k % 7) + draw.normal(0, 500))) for k in range(n)]


SERIES = "series_key string, ds date, y bigint"


def direct_fit(spark, rows):
    """The same ridge regression from all rows of one series at once, centred before anything is multiplied."""
    featured = forecast._with_features(series.with_training_range(rows)).orderBy("ds").toPandas()
    x, z = np.stack(featured["features"]), np.log(np.maximum(featured["y"].to_numpy(float), 1.0))
    moved, right = x - x.mean(0), z - z.mean()
    widths = np.square(forecast._prior_widths())
    variance = (right**2).mean()
    for _ in range(10):
        beta = np.linalg.solve(moved.T @ moved + np.diag(max(variance, 1e-12) / widths), moved.T @ right)
        variance = ((right - moved @ beta) ** 2).mean()
    return z.mean() - x.mean(0) @ beta, beta, variance**0.5


def test_fit_from_sums_is_the_fit_from_rows(spark):
    rows = spark.createDataFrame(days(900) + days(40)[:17], SERIES).repartition(7)
    found = forecast.fit(rows).first()
    intercept, beta, sigma = direct_fit(spark, rows)
    assert found["coefficients"] == pytest.approx(beta.tolist(), rel=1e-7, abs=1e-9)
    assert (found["intercept"], found["sigma"]) == pytest.approx((intercept, sigma), rel=1e-9)
    assert found["train_rows"] == 917 and found["end_ds"] == date(2020, 1, 1) + timedelta(days=899)


def test_a_series_sends_sums_and_not_days(spark, monkeypatch):
    """What is shuffled and solved is one row per series and task, also if a task has to send some early."""
    monkeypatch.setattr(forecast, "_SERIES_HELD", 2)
    rows = spark.createDataFrame(days(500) + days(400, key="b") + days(300, key="c") + [(None, date(2020, 1, 1) + timedelta(days=k), k) for k in range(50)], SERIES)
    one = {r["series_key"]: r["coefficients"] for r in forecast.fit(rows.coalesce(1)).collect()}
    many = {r["series_key"]: r["coefficients"] for r in forecast.fit(rows.repartition(6)).collect()}
    assert set(one) == {"a", "b", "c", None} == set(many)
    for key, coefficients in one.items():
        assert many[key] == pytest.approx(coefficients, rel=1e-6, abs=1e-9)
    plan = forecast.fit(rows)._jdf.queryExecution().optimizedPlan().toString()
    solve = plan[: plan.index("MapInArrow")]
    assert "FlatMapGroupsInPandas" in solve and "features" not in solve.split("\n")[0]


def test_every_series_is_evaluated(spark):
    rows = spark.createDataFrame(days(400) + days(60, key="short"), SERIES)
    split = series.holdout_split(rows)
    found = {r["series_key"]: r for r in forecast.evaluate(split).collect()}
    assert found["a"]["n"] == 90 and found["a"]["mae"] > 0
    assert found["short"]["n"] == 0 and found["short"]["mae"] is None
    model = traffic.train_traffic(rows, as_of="2021-06-01")
    assert {r["series_key"]: r["mae"] is None for r in model.meta.collect()} == {"a": False, "short": True}


def test_repeated_days_count_once_in_the_holdout(spark):
    rows = spark.createDataFrame(days(200) + days(200)[150:], SERIES)
    held = series.holdout_split(rows).filter("is_holdout")
    assert held.select("ds").distinct().count() == 90 and held.count() == 140


def test_a_forecast_without_days_has_totals(spark):
    model = forecast.fit(spark.createDataFrame(days(100), SERIES))
    none = forecast.forecast(model, 1).filter("false")
    assert [tuple(r) for r in alerts.forecast_totals(none, model).collect()] == [("a", 0, 0)]
    assert traffic.daily_forecast(model, 7).totals.count() == 1


def test_noise_is_normal_and_the_same_in_any_partitions(spark):
    rows = spark.createDataFrame(days(30) + days(30, key="b"), SERIES)
    once = series.extend_series(rows, "2025-12-31", noise_sd=500.0, seed=7)
    again = series.extend_series(rows.repartition(5), "2025-12-31", noise_sd=500.0, seed=7).repartition(3)
    assert sorted(once.collect()) == sorted(again.collect())
    assert sorted(once.collect()) != sorted(series.extend_series(rows, "2025-12-31", noise_sd=500.0, seed=8).collect())
    drawn = np.array([r[0] for r in once.select(series.gaussian(F.col("series_key"), F.col("ds"), 7)).collect()])
    assert abs(drawn.mean()) < 0.06 and abs(drawn.std() - 1) < 0.05 and abs(np.quantile(drawn, 0.975) - 1.96) < 0.15


@pytest.mark.parametrize("job", [eda.delay_by_carrier, eda.delay_extremes])
def test_rows_are_read_once(spark, job):
    read = spark.sparkContext.accumulator(0)

    def counted(frames):
        for one in frames:
            read.add(len(one))
            yield one

    rows = spark.range(500).selectExpr(
        "int(id % 12 + 1) AS month", "concat('c', id % 3) AS carrier", "concat('n', id % 3) AS carrier_name", "id % 10 / 10D AS delay_rate"
    )
    assert job(rows.mapInPandas(counted, rows.schema)).count() > 0
    assert read.value == 500


def test_scores_are_dealt_by_range(spark):
    """Scores are dealt by range, not ordered in one place."""
    rows = frame(spark, range(100)).withColumn("label", (F.col("v") > 50).cast("int"))
    plan = quality.roc_auc(rows, score="v")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan
