"""Every row against every other without a broadcast: rows in blocks, each block against a stream of all others."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

#: Rows of a block on either side: the smaller the left ones, the more tasks share them.
LEFT, RIGHT = 256, 2048


def packed(df: DataFrame, size: int) -> DataFrame:
    """df in rows of up to `size` of its rows each, columns as arrays, in order; __first numbers them within a task."""
    schema = StructType([StructField("__first", LongType()), *(StructField(f.name, ArrayType(f.dataType)) for f in df.schema)])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = 0
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                part = batch.slice(i, size)
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), c) for c in part.columns]
                yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), *lists], names)
                first += part.num_rows

    return df.mapInArrow(run, schema)


def sweep(left: DataFrame, right: DataFrame, order: str, start: Callable, meet: Callable, finish: Callable, schema) -> DataFrame:
    """What finish(state) gives for each block of left rows after it met all right rows, in the order of a column.

    start(columns) makes the state of a left block, meet(state, columns) takes a block of right rows into it; columns
    are Arrow arrays by name. The right rows lie in one partition that every task streams past its left blocks,
    block by block: no side has to fit into memory, and nothing of a pair leaves its task.
    """
    spark = left.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    a = packed(left, LEFT).drop("__first").repartition(n)
    a = a.select(F.monotonically_increasing_id().alias("__block"), *(F.col(f"`{c}`").alias(f"l:{c}") for c in left.columns))
    b = packed(right.repartition(1).sortWithinPartitions(order), RIGHT).repartition(1).sortWithinPartitions("__first")
    b = b.select(*(F.col(f"`{c}`").alias(f"r:{c}") for c in right.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, state = None, None
        for batch in batches:
            columns = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            for i, now in enumerate(columns["__block"].to_pylist()):
                if now != block:
                    if block is not None:
                        yield from finish(state)
                    block, state = now, start({c[2:]: v[i].values for c, v in columns.items() if c.startswith("l:")})
                meet(state, {c[2:]: v[i].values for c, v in columns.items() if c.startswith("r:")})
        if block is not None:
            yield from finish(state)

    return a.crossJoin(b.hint("shuffle_replicate_nl")).mapInArrow(run, schema)


def matrix(columns: dict, names: list[str]) -> np.ndarray:
    """These columns of a block as doubles, missing ones as NaN: one row a column."""
    return np.array([columns[c].to_numpy(zero_copy_only=False).astype(float) for c in names])
