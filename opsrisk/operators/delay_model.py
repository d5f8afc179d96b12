"""Delay classifier: boosted trees, their training, scoring and evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsrisk.constants import DELAY_LABEL_THRESHOLD, MODEL_FEATURES, MODEL_VERSION
from opsrisk.functions.display import status_of
from opsrisk.functions.rates import served_probability
from opsrisk.operators.learning_sets import LABEL, with_label, with_split
from opsrisk.operators.quality import classification_report, roc_auc
from opsrisk.session import checkpointed

CELL_KEYS = ["carrier", "airport", "year", "month"]

#: Rows that make a task of boosting worth its while.
ROWS_PER_TASK = 10_000

_MODEL_COLUMNS = ("features", "rawPrediction", "probability", "prediction")


@dataclass(frozen=True)
class BoostingSettings:
    trees: int = 100
    depth: int = 5
    step: float = 0.1
    bins: int = 256
    seed: int = 42


def delay_pipeline(settings: BoostingSettings = BoostingSettings()) -> Pipeline:
    """Feature vector in fixed order, then boosted trees trained level by level."""
    assembler = VectorAssembler(
        inputCols=list(MODEL_FEATURES), outputCol="features", handleInvalid="error"
    )
    trees = GBTClassifier(
        featuresCol="features",
        labelCol=LABEL,
        maxIter=settings.trees,
        maxDepth=settings.depth,
        stepSize=settings.step,
        maxBins=settings.bins,
        seed=settings.seed,
        checkpointInterval=10,
    )
    return Pipeline(stages=[assembler, trees])


def predict(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """Class and unrounded probability of the high class."""
    scored = model.transform(rows)
    return scored.withColumns(
        {
            "high_delay_prediction": F.col("prediction").cast("int"),
            "high_delay_probability": vector_to_array("probability")[1],
        }
    ).drop(*_MODEL_COLUMNS)


def score(requests: DataFrame, model: PipelineModel, model_version: str = MODEL_VERSION) -> DataFrame:
    """Requests with class, probability as served, status and model version."""
    return predict(requests, model).withColumns(
        {
            "high_delay_probability": served_probability(F.col("high_delay_probability")),
            "status": status_of(F.col("high_delay_prediction")),
            "model_version": F.lit(model_version),
        }
    )


def learning_rows(
    featured: DataFrame, threshold: float = DELAY_LABEL_THRESHOLD, test_fraction: float = 0.2, seed: int = 42
) -> DataFrame:
    """Feature rows with label and split, computed once as boosting reads them many times.

    Boosting runs a job per level of each tree, so rows are held in no more
    partitions than they fill: on small tables the tasks cost more than the work.
    """
    rows = with_split(with_label(featured, threshold), CELL_KEYS, test_fraction, seed)
    kept = checkpointed(rows.select(*CELL_KEYS[:2], *MODEL_FEATURES, LABEL, "is_train"))
    return kept.coalesce(max(1, -(-kept.count() // ROWS_PER_TASK)))


def fit(rows: DataFrame, settings: BoostingSettings = BoostingSettings()) -> PipelineModel:
    return delay_pipeline(settings).fit(rows.filter("is_train").select(*MODEL_FEATURES, LABEL))


@dataclass(frozen=True)
class DelayEvaluation:
    report: DataFrame
    auc: DataFrame


def evaluate(rows: DataFrame, model: PipelineModel) -> DelayEvaluation:
    """Classification report and area under the curve on the held-out rows."""
    tested = checkpointed(
        predict(rows.filter("NOT is_train"), model).select(
            LABEL, "high_delay_prediction", "high_delay_probability"
        )
    )
    return DelayEvaluation(
        report=classification_report(tested, LABEL, "high_delay_prediction"),
        auc=roc_auc(tested, LABEL, "high_delay_probability"),
    )


def train_delay(
    featured: DataFrame,
    threshold: float = DELAY_LABEL_THRESHOLD,
    test_fraction: float = 0.2,
    seed: int = 42,
    settings: BoostingSettings = BoostingSettings(),
) -> tuple[PipelineModel, DelayEvaluation]:
    """Label, split, fit and evaluate."""
    rows = learning_rows(featured, threshold, test_fraction, seed)
    model = fit(rows, settings)
    return model, evaluate(rows, model)
