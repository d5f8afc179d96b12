"""Offline delay job: raw file to clean table, aggregates and model."""

from __future__ import annotations

from typing import Literal

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from opsrisk.operators import cleaning, delay_model, eda, features
from opsrisk.session import checkpointed
from opsrisk.sources import models, tables


def build_clean_table(
    spark: SparkSession, raw_path: str, clean_path: str, averages: Literal["full", "asof"] = "full"
) -> DataFrame:
    """Raw CSV to the stored feature table; returns the cleaning audit."""
    raw = tables.read_raw_csv(spark, raw_path)
    cleaned = checkpointed(cleaning.clean(raw))
    tables.write_clean(features.add_features(cleaned, averages), clean_path)
    return cleaning.clean_audit(raw)


def explore(clean: DataFrame) -> dict[str, DataFrame]:
    """All exploratory aggregates over the stored clean table."""
    return {
        "profile": eda.delay_profile(clean),
        "describe": eda.delay_describe(clean),
        "histogram": eda.delay_histogram(clean),
        "by_month": eda.delay_by_month(clean),
        "by_carrier": eda.delay_by_carrier(clean),
        "causes": eda.delay_causes(clean),
        "by_year": eda.delay_by_year(clean),
        "heatmap": eda.delay_heatmap(clean),
        "extremes": eda.delay_extremes(clean),
    }


def train_and_save(
    spark: SparkSession,
    clean_path: str,
    model_path: str,
    settings: delay_model.BoostingSettings = delay_model.BoostingSettings(),
) -> tuple[PipelineModel, delay_model.DelayEvaluation]:
    model, evaluation = delay_model.train_delay(tables.read_clean(spark, clean_path), settings=settings)
    models.save_delay_model(model, model_path)
    return model, evaluation
