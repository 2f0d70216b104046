"""The folder that driver and executors share for checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from ..errors import InvalidConfig


def need_folder(spark: SparkSession) -> None:
    """See to it that checkpoints have a folder: spark.checkpoint.dir, or, in a local session only, one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not context.master.startswith("local"):
        raise InvalidConfig("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(found or tempfile.mkdtemp(prefix="sparkloom-"))
