"""Batch scoring: requests to validated, scored and stored predictions."""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from opsrisk.constants import MODEL_VERSION
from opsrisk.operators import delay_model, validation
from opsrisk.sources.history_store import append_history, read_history
from opsrisk.sources.seeds import seed_for


def scored_requests(requests: DataFrame, model: PipelineModel, model_version: str = MODEL_VERSION) -> DataFrame:
    """Scored rows of the valid requests; also applies to streams.

    Requests are judged as they come: nothing that a rule asks for is filled in.
    """
    checked = validation.validate(requests)
    return delay_model.score(validation.valid_rows(checked), model, model_version)


def outcomes(requests: DataFrame) -> DataFrame:
    """Every request with ``accepted`` and, if it is refused, the ``message`` of the rules it breaks."""
    message = F.when(~F.col("is_valid"), F.array_join("violations", ", "))
    return validation.validate(requests).select("*", F.col("is_valid").alias("accepted"), message.alias("message"))


def refused_path(history_path: str) -> str:
    """Where refused requests are kept, beside the history."""
    return f"{history_path.rstrip('/')}-refused"


def store_refused(requests: DataFrame, history_path: str, batch: str) -> None:
    """Keep the refused requests of a batch with their messages; a batch that is repeated replaces itself."""
    refused = validation.quarantine(validation.validate(requests))
    refused.write.mode("overwrite").parquet(f"{refused_path(history_path)}/batch={batch}")


def read_refused(spark: SparkSession, history_path: str) -> DataFrame:
    """All refused requests, with the batch they came in."""
    return spark.read.parquet(refused_path(history_path))


def to_history(scored: DataFrame) -> DataFrame:
    """History columns of scored requests, year and month as whole numbers."""
    return scored.withColumns(
        {"flight_year": F.col("year").cast("int"), "flight_month": F.col("month").cast("int")}
    ).drop("year", "month")


def score_batch(
    requests: DataFrame, model: PipelineModel, history_path: str, batch: str | None = None
) -> DataFrame:
    """Score requests, store the predictions and return the responses under public names.

    Refused requests are stored beside the history, so that each request is in
    one of the two tables.
    """
    batch = batch or uuid4().hex
    store_refused(requests, history_path, batch)
    stored = append_history(to_history(scored_requests(requests, model)), history_path, batch)
    return validation.to_public_names(stored)


@dataclass(frozen=True)
class SeedOutcome:
    seeded: int
    failed: int


def seed_history(
    spark: SparkSession, model: PipelineModel, history_path: str, scenarios: DataFrame | None = None
) -> SeedOutcome:
    """Fill an empty history with scenarios, the seed table if none are given; counts what was stored and what was rejected.

    Both counts are observed while the scored rows are written, so the scenarios
    are read once.
    """
    history = read_history(spark, history_path)
    if scenarios is None:
        scenarios = seed_for(history)
    elif not history.isEmpty():
        return SeedOutcome(seeded=0, failed=0)
    counts = Observation("seeds")
    checked = validation.validate(validation.derive_features(scenarios)).observe(
        counts, F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid")
    )
    append_history(to_history(delay_model.score(validation.valid_rows(checked), model)), history_path)
    return SeedOutcome(seeded=counts.get["valid"], failed=counts.get["invalid"])
