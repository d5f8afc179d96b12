import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsrisk.operators import eda, learning_sets, quality
from opsrisk.operators.ordered import cumulative_counts, exact_quantiles


def brute_auc(labels, scores):
    pairs = [(p, n) for p, y in zip(scores, labels) if y == 1 for n, z in zip(scores, labels) if z == 0]
    return sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in pairs) / len(pairs)


@pytest.mark.parametrize("kind", ["spread", "dense", "ties"])
def test_auc_against_all_pairs(spark, kind):
    draw = random.Random(7)
    scores = {
        "spread": [draw.random() for _ in range(300)],
        # many distinct scores inside one fine interval, next to the ends of the range
        "dense": [0.2 + draw.random() * 1e-9 for _ in range(200)] + [0.0] * 30 + [1.0] * 30,
        "ties": [draw.choice([0.0, 0.25, 0.5, 1.0]) for _ in range(300)],
    }[kind]
    labels = [int(draw.random() < 0.2 + 0.5 * s) for s in scores]
    rows = spark.createDataFrame(list(zip(labels, scores)), "label int, score double")
    assert quality.roc_auc(rows).first()[0] == pytest.approx(brute_auc(labels, scores), abs=1e-12)
    rounded = [round(s, 4) for s in scores]
    rows = spark.createDataFrame(list(zip(labels, rounded)), "label int, score double")
    assert quality.roc_auc(rows, digits=4).first()[0] == pytest.approx(brute_auc(labels, rounded), abs=1e-12)


def test_auc_of_one_class_is_null(spark):
    rows = spark.createDataFrame([(1, 0.2), (1, 0.9)], "label int, score double")
    assert quality.roc_auc(rows).first()[0] is None


def test_cumulative_counts(spark):
    draw = random.Random(3)
    values = [draw.choice([draw.random(), round(draw.random(), 2)]) for _ in range(400)]
    rows = spark.createDataFrame([(v, 1) for v in values] + [(None, 1)], "v double, n int")
    got = {r["v"]: r for r in cumulative_counts(rows, "v", ["n"]).collect()}
    assert set(got) == set(values)
    for v, row in got.items():
        assert row["n"] == values.count(v)
        assert row["n_before"] == sum(x < v for x in values)
        assert row["n_total"] == len(values)


@pytest.mark.parametrize("n", [1, 2, 5, 101, 400])
def test_quantiles_against_numpy(spark, n):
    draw = random.Random(n)
    values = [draw.choice([draw.random(), 0.5, 1.0]) for _ in range(n)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    row = exact_quantiles(rows, "v", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}).first()
    assert list(row) == pytest.approx(list(np.quantile(values, [0, 0.25, 0.5, 0.9, 1])), abs=1e-12)


def cells(spark, rows):
    return spark.createDataFrame(
        rows, "year int, month int, carrier string, carrier_name string, airport string, delay_rate double"
    )


@pytest.mark.parametrize("spread", ["random", "edges", "single"])
def test_histogram_against_numpy(spark, spread):
    draw = random.Random(1)
    values = {
        "random": [draw.random() for _ in range(500)],
        "edges": [i / 60 for i in range(61)] * 2,
        "single": [0.3] * 5,
    }[spread]
    rows = cells(spark, [(2020, 1, "A", "A", "X", v) for v in values])
    got = eda.delay_histogram(rows).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=60)
    assert [r["n"] for r in got] == counts.tolist()
    assert [r["bin_start"] for r in got] == pytest.approx(edges[:-1].tolist())


def test_ties_go_to_the_smaller_name(spark):
    rows = cells(spark, [(2020, m, c, c, "X", 0.5) for m in (3, 11) for c in ("Bravo", "Alpha", "Chat")])
    assert [r["carrier_name"] for r in eda.top_carriers(rows, 2).collect()] == ["Alpha", "Bravo"]
    found = {r["dimension"]: r for r in eda.delay_extremes(rows).collect()}
    assert (found["month"]["highest"], found["month"]["lowest"]) == ("Mar", "Mar")
    assert (found["carrier"]["highest"], found["carrier"]["lowest"]) == ("Alpha", "Alpha")


def test_spread_of_one_row_is_null(spark):
    rows = cells(spark, [(2020, 1, "A", "A", "X", 0.5)])
    assert eda.delay_by_month(rows).first()["std_rate"] is None
    assert eda.delay_by_year(rows).first()["upper"] is None


def test_min_support(spark):
    rows = cells(spark, [(2020, 1, "A", "A", "X", 0.5)] * 3 + [(2020, 1, "B", "B", "X", 0.1)] * 2)
    kept = eda.delay_by_carrier(rows, min_rows=3).collect()
    assert [r["carrier"] for r in kept] == ["A"]
    assert kept[0]["overall_mean"] == pytest.approx((1.5 + 0.2) / 5)
    assert kept[0]["above_average"] is False


def test_label_is_strict(spark):
    rows = spark.createDataFrame([(1.0 / 5.0,), (0.2000001,)], "delay_rate double")
    assert [r["high_delay"] for r in learning_sets.with_label(rows).collect()] == [0, 1]


def test_split_keeps_the_class_ratio(spark):
    rows = spark.range(20000).selectExpr("id AS k", "int(id % 10 < 3) AS high_delay")
    split = learning_sets.with_split(rows, ["k"])
    for label in (0, 1):
        part = split.filter(f"high_delay = {label}")
        assert part.filter("is_train").count() / part.count() == pytest.approx(0.8, abs=0.02)
    again = learning_sets.with_split(rows.repartition(5), ["k"])
    assert split.filter("is_train").exceptAll(again.filter("is_train")).count() == 0


@pytest.mark.parametrize("n", [1, 10, 37, 1000])
def test_exact_split_quota(spark, n):
    rows = spark.range(n).selectExpr("id AS k", "int(id % 10 < 3) AS high_delay")
    split = learning_sets.with_exact_split(rows, ["k"])
    tests = {r["high_delay"]: r["n"] for r in split.filter("NOT is_train").groupBy("high_delay").agg(F.count("*").alias("n")).collect()}
    total = math.ceil(n * 0.2)
    positives = sum(i % 10 < 3 for i in range(n))
    assert sum(tests.values()) == total
    assert abs(tests.get(1, 0) - positives * total / n) < 1


def test_model_matrix_drops_leaks_and_text(spark):
    rows = cells(spark, [(2020, 1, "A", "A", "X", 0.5)])
    assert learning_sets.model_matrix(learning_sets.with_label(rows)).columns == ["year", "month"]


def test_report_of_one_class_has_zeros(spark):
    rows = spark.createDataFrame([(1, 1), (1, 1)], "label int, prediction int")
    report = {r["row_label"]: r for r in quality.classification_report(rows).collect()}
    assert report["0"]["precision"] == report["0"]["recall"] == report["0"]["f1_score"] == 0.0
    assert report["1"]["f1_score"] == 1.0
    assert report["macro avg"]["f1_score"] == 0.5
    assert report["weighted avg"]["f1_score"] == 1.0


def test_forecast_metrics(spark):
    rows = spark.createDataFrame([("a", 100, 90.0), ("a", 200, 220.0), ("b", 0, 1.0)], "series_key string, y bigint, yhat double")
    got = {r["series_key"]: r for r in quality.forecast_metrics(rows).collect()}
    assert got["a"]["mae"] == 15.0 and got["a"]["mape_pct"] == pytest.approx(10.0)
    assert math.isfinite(got["b"]["mape_pct"]) and got["b"]["mape_pct"] > 1e15
