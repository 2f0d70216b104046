"""Fitted models as JSON files, read and written by Spark, so that any file system it knows will do."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..errors import InvalidInput
from ..operators.base import Model


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    """Write a model to a folder, which must not exist."""
    spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.text(path)


def load_model(spark: SparkSession, path: str) -> Model:
    """The model in a folder; an inconsistent one is refused."""
    rows = spark.read.text(path, wholetext=True).collect()
    if len(rows) != 1:
        raise InvalidInput(f"{path} holds {len(rows)} files, not one model")
    return Model.from_json(rows[0]["value"].strip())
