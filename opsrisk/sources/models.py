"""Saving, loading and publishing of fitted models."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from opsrisk.operators.forecast import MODEL_SCHEMA
from opsrisk.sources.published import publish, published


def save_delay_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_delay_model(path: str) -> PipelineModel:
    """The model at ``path``; fails when there is none."""
    return PipelineModel.load(path)


def save_forecast_model(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def load_forecast_model(spark: SparkSession, path: str) -> DataFrame:
    """The coefficients at ``path``; fails when there are none."""
    return spark.read.schema(MODEL_SCHEMA).parquet(path)


class ModelRegistry:
    """Fitted models by name, each in versions with a pointer to the live one.

    A version has three parts: ``model``, the tables that ``tables`` names (as the
    rows it was judged on and its training notes), and the pointer that is moved
    once all parts are written. A training that dies leaves no version to be read.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def live(self, name: str) -> str | None:
        """The folder of the live version of a model."""
        version = published(self.spark, f"{self.root}/{name}")
        return None if version is None else f"{self.root}/{name}/{version}"

    def publish(self, name: str, model: PipelineModel | None, tables: dict[str, DataFrame]) -> str:
        """Write a new version and make it the live one; earlier versions stay for those who still read them."""
        version = uuid4().hex
        folder = f"{self.root}/{name}/{version}"
        if model is not None:
            save_delay_model(model, f"{folder}/model")
        for part, rows in tables.items():
            rows.write.parquet(f"{folder}/{part}")
        publish(self.spark, f"{self.root}/{name}", version)
        return folder

    def trained(self, name: str, train: Callable[[], tuple[PipelineModel | None, dict[str, DataFrame]]]) -> str:
        """The folder of the live version, trained first if there is none."""
        return self.live(name) or self.publish(name, *train())

    def model(self, name: str) -> PipelineModel:
        """The live model; fails when none was published."""
        return load_delay_model(f"{self._needed(name)}/model")

    def table(self, name: str, part: str) -> DataFrame:
        """A table of the live version; fails when none was published."""
        return self.spark.read.parquet(f"{self._needed(name)}/{part}")

    def _needed(self, name: str) -> str:
        folder = self.live(name)
        if folder is None:
            raise FileNotFoundError(f"no model {name!r} was published at {self.root}")
        return folder
