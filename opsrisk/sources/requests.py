"""Scoring requests from JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsrisk.constants import REQUEST_NAMES
from opsrisk.functions.rates import nan_to_null
from opsrisk.schemas import REQUEST_SCHEMA


def parse_requests(texts: DataFrame, column: str = "body") -> DataFrame:
    """One typed request per JSON document.

    Fields come as numbers or numeric text, under their internal or public name.
    A field that is absent or no number is null, which validation then reports;
    a document that is no JSON object is null in every field.
    """
    public = {name: public for public, name in REQUEST_NAMES.items()}
    names = dict.fromkeys([*REQUEST_SCHEMA.names, *REQUEST_NAMES])
    as_text = T.StructType([T.StructField(name, T.StringType()) for name in names])
    parsed = F.from_json(F.col(column), as_text, {"mode": "PERMISSIVE"})
    typed = {
        name: nan_to_null(
            F.coalesce(
                F.expr(f"try_cast(_request.{name} AS double)"),
                F.expr(f"try_cast(_request.{public[name]} AS double)"),
            )
        )
        for name in REQUEST_SCHEMA.names
    }
    return texts.withColumn("_request", parsed).withColumns(typed).drop("_request")
