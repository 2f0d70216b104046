"""Tables in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import num


def read_table(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    """A table in any format that Spark reads."""
    return spark.read.format(kind).options(**options).load(path)


def numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """df with these columns as double and NaN as null."""
    return df.withColumns({c: num(c) for c in cols})


def as_strings(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(f"`{c}`").cast("string") for c in cols})
