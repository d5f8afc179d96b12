"""Quality measures of classifiers and forecasts."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsrisk.operators.ordered import ranked_pairs


def _ratio(part: Column, whole: Column) -> Column:
    """Division where nothing over nothing is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def classification_report(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and both averages.

    The rows are reduced to the four counts of a two-class table; all measures
    are expressions over that one row.
    """
    y, p = F.col(label), F.col(prediction)
    counts = rows.agg(
        *(
            F.count_if((y == actual) & (p == given)).alias(f"a{actual}g{given}")
            for actual in (0, 1)
            for given in (0, 1)
        )
    )

    def cell(actual: int, given: int) -> Column:
        return F.col(f"a{actual}g{given}")

    n = cell(0, 0) + cell(0, 1) + cell(1, 0) + cell(1, 1)
    right = cell(0, 0) + cell(1, 1)
    classes = []
    for c in (0, 1):
        support = cell(c, 0) + cell(c, 1)
        precision = _ratio(cell(c, c), cell(0, c) + cell(1, c))
        recall = _ratio(cell(c, c), support)
        f1 = _ratio(2 * cell(c, c), support + cell(0, c) + cell(1, c))
        classes.append((str(c), precision, recall, f1, support))

    def averaged(name: str, weights: list[Column]) -> tuple:
        whole = weights[0] + weights[1]
        means = (
            _ratio(classes[0][i] * weights[0] + classes[1][i] * weights[1], whole) for i in (1, 2, 3)
        )
        return (name, *means, n)

    accuracy = _ratio(right, n)
    report = [
        *classes,
        ("accuracy", accuracy, accuracy, accuracy, n),
        averaged("macro avg", [F.lit(1), F.lit(1)]),
        averaged("weighted avg", [classes[0][4], classes[1][4]]),
    ]
    lines = F.array(
        *(
            F.struct(
                F.lit(name).alias("row_label"),
                precision.alias("precision"),
                recall.alias("recall"),
                f1.alias("f1_score"),
                support.cast("bigint").alias("support"),
            )
            for name, precision, recall, f1, support in report
        )
    )
    return counts.select(F.inline(lines))


def roc_auc(
    rows: DataFrame, label: str = "label", score: str = "score", digits: int | None = None
) -> DataFrame:
    """Area under the ROC curve: pairs ranked rightly, ties counted half; null for one class.

    Scores are any numbers; null and NaN ones are left out. ``digits`` rounds
    them first. Rows are merged per distinct score before anything is ordered.
    """
    flagged = rows.select(
        (F.col(score) if digits is None else F.round(score, digits)).alias("score"),
        (F.col(label) == 1).cast("bigint").alias("pos"),
        (F.col(label) != 1).cast("bigint").alias("neg"),
    )
    pairs = 2.0 * F.col("neg") * F.col("pos")
    return ranked_pairs(flagged, "score", "neg", "pos").select(F.try_divide("won", pairs).alias("roc_auc"))


def forecast_metrics(rows: DataFrame, by: str = "series_key") -> DataFrame:
    """Mean absolute error and mean absolute percentage error per series, over y and yhat."""
    error = F.abs(F.col("y") - F.col("yhat"))
    scale = F.greatest(F.abs(F.col("y").cast("double")), F.lit(sys.float_info.epsilon))
    return rows.groupBy(by).agg(
        F.count("*").alias("n"),
        F.avg(error).alias("mae"),
        (F.avg(error / scale) * 100).alias("mape_pct"),
    )
