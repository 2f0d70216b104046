"""Fitted models on streams: a transform is a projection, so a streaming DataFrame takes it as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.base import Model


def transform_stream(stream: DataFrame, model: Model, path: str, checkpoint: str, kind: str = "parquet") -> StreamingQuery:
    """Start a query that writes the model's output for all rows available, then ends; a later one goes on from there."""
    out = model.transform(stream)
    return out.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
