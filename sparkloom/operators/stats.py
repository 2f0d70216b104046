"""Column statistics, covariance and Gram matrices, contingency tables and duplicates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInput
from ..functions.exprs import num
from ..plans.folder import need_folder
from ..plans.quantiles import exact_quantiles

#: Columns up to which products are summed by aggregate expressions; above, tasks sum them in numpy.
EXPRESSION_COLUMNS = 8


def column_stats(df: DataFrame, cols: list[str], ddof: int = 1) -> DataFrame:
    """A row for each column: column, n, sum, mean, min, max, var, std; null where undefined (n <= ddof), nulls left out."""
    items = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), num(c).alias("v")) for i, c in enumerate(cols)))
    x, n = F.col("v"), F.count("v")
    spread = F.var_pop(x) * n / F.nullif(n - ddof, F.lit(0))
    var = F.when(n > ddof, spread)
    out = df.select(F.inline(items)).groupBy("i", "column").agg(n.alias("n"), F.sum(x).alias("sum"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"), var.alias("var"), F.sqrt(var).alias("std"))
    return out.drop("i")


def quantiles(df: DataFrame, cols: list[str], qs: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of each column, interpolated at q * (n - 1)."""
    if any(not 0 <= q <= 1 for q in qs):
        raise InvalidInput("quantiles lie within 0 and 1")
    return exact_quantiles(df, {c: list(qs) for c in cols}, df.count())


def median(df: DataFrame, column: str) -> float | None:
    return quantiles(df, [column], [0.5])[column][0]


def mode(df: DataFrame, column: str) -> DataFrame:
    """One row (value, n): the most frequent value, the smallest of several."""
    return df.select(num(column).alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(1)


def means(df: DataFrame, cols: list[str]) -> tuple[int, np.ndarray]:
    """Rows and column means."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *(F.avg(num(c)).alias(f"m{i}") for i, c in enumerate(cols))).first()
    return row["n"], np.array([np.nan if row[f"m{i}"] is None else row[f"m{i}"] for i in range(len(cols))])


def gram(df: DataFrame, cols: list[str], centre: np.ndarray | None = None, weight: Column | None = None) -> np.ndarray:
    """Sums of products of each two columns after taking off `centre`, optionally weighted.

    Few columns go by aggregate expressions, which stay in generated code; for more, each task adds up its own
    matrix in numpy and returns it in one row, so that a matrix a task is all that moves.
    """
    p = len(cols)
    centre = np.zeros(p) if centre is None else np.asarray(centre, dtype=float)
    if p <= EXPRESSION_COLUMNS:
        x = [num(c) - F.lit(float(m)) for c, m in zip(cols, centre, strict=True)]
        w = F.lit(1.0) if weight is None else weight
        pairs = [(i, j) for i in range(p) for j in range(i + 1)]
        row = df.agg(*(F.sum(x[i] * x[j] * w).alias(f"g{i}_{j}") for i, j in pairs)).first()
        out = np.zeros((p, p))
        for i, j in pairs:
            out[i, j] = out[j, i] = row[f"g{i}_{j}"] or 0.0
        return out
    narrow = df.select(*(num(c).alias(f"x{i}") for i, c in enumerate(cols)), *([weight.alias("w")] if weight is not None else []))

    def partial(batches):
        total = np.zeros((p, p))
        for batch in batches:
            x = batch[[f"x{i}" for i in range(p)]].to_numpy(dtype=float) - centre
            total += x.T @ (x * batch["w"].to_numpy()[:, None] if "w" in batch else x)
        yield pd.DataFrame({"g": [total.ravel().tolist()]})

    return _sum_of_arrays(narrow.mapInPandas(partial, "g array<double>"), p * p).reshape(p, p)


def _sum_of_arrays(rows: DataFrame, size: int) -> np.ndarray:
    """Element-wise sum of one array column; tasks' arrays are summed in the executors, by position."""
    got = rows.select(F.posexplode(rows.columns[0]).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in got:
        out[r["i"]] = r["v"]
    return out


def covariance(df: DataFrame, cols: list[str], ddof: int = 1) -> np.ndarray:
    n, centre = means(df, cols)
    if n <= ddof:
        raise InvalidInput("too few rows for a covariance")
    return gram(df, cols, centre) / (n - ddof)


def correlation(df: DataFrame, cols: list[str]) -> np.ndarray:
    """Pearson correlations; a column without spread has 0 with all others and 1 with itself.

    A column with a null or NaN has NaN with all others, but 0 with columns without spread: there is no pairwise deletion.
    """
    row = df.agg(F.count(F.lit(1)).alias("n"), *(F.count(num(c)).alias(f"n{i}") for i, c in enumerate(cols))).first()
    cov = covariance(df, cols)
    for i in range(len(cols)):
        if row[f"n{i}"] < row["n"]:
            cov[i, :] = cov[:, i] = np.nan
    std = np.sqrt(np.diag(cov))
    out = np.eye(len(cols))
    for i in range(len(cols)):
        for j in range(len(cols)):
            if i != j:
                out[i, j] = 0.0 if std[i] == 0 or std[j] == 0 else cov[i, j] / (std[i] * std[j])
    return out


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts (a, b, n) of each pair of values."""
    return df.groupBy(F.col(f"`{a}`").alias("a"), F.col(f"`{b}`").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def duplicate_rows(df: DataFrame, numeric: list[str], strings: list[str]) -> DataFrame:
    """One row (rows, duplicates): rows that repeat an earlier one.

    Rows with a null or NaN number are left out; -0.0 equals 0.0; strings are compared untrimmed.
    """
    values = [(num(c) + F.lit(0.0)).alias(f"n{i}") for i, c in enumerate(numeric)]
    values += [F.col(f"`{c}`").cast("string").alias(f"s{i}") for i, c in enumerate(strings)]
    rows = df.select(*values)
    whole = F.lit(True)
    for i in range(len(numeric)):
        whole = whole & F.col(f"n{i}").isNotNull()
    groups = rows.where(whole).groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    repeated = groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    return df.agg(F.count(F.lit(1)).alias("rows")).join(F.broadcast(repeated))  # one row each


def with_rid(df: DataFrame, keys: list[str], name: str = "rid") -> DataFrame:
    """df with row numbers from 0 in the order of keys, which must be unique.

    A range-partitioned sort and the sizes of its partitions number the rows, so that no task sees them all. The
    sorted rows are checkpointed, in the folder that all executors share.
    """
    ordered = df.repartitionByRange(*(F.col(f"`{k}`") for k in keys)).sortWithinPartitions(*(F.col(f"`{k}`") for k in keys))
    need_folder(df.sparkSession)
    ordered = ordered.checkpoint()
    tagged = ordered.withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id())
    sizes = sorted((r["__p"], r["n"], r["first"]) for r in tagged.groupBy("__p").agg(F.count(F.lit(1)).alias("n"), F.min("__m").alias("first")).collect())
    begin, at = [], 0
    for p, n, first in sizes:
        begin.append((p, at - first))
        at += n
    shift = df.sparkSession.createDataFrame(begin or [(0, 0)], "__p int, __shift bigint")
    return tagged.join(F.broadcast(shift), "__p").withColumn(name, F.col("__m") + F.col("__shift")).drop("__p", "__m", "__shift")


def finite_or_nan(x: float | None) -> float:
    return math.nan if x is None else float(x)
