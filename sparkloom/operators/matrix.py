"""Matrix operations on DataFrames of numeric columns, with rows known by rid."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EmptyInput, InvalidInput, ShapeMismatch
from ..functions.exprs import dot, num


def select_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns in the order given; a repeated one gets a number."""
    if not cols:
        raise EmptyInput("no columns")
    return df.select(*(F.col(f"`{c}`").alias(c if c not in cols[:i] else f"{c}__{cols[: i + 1].count(c)}") for i, c in enumerate(cols)))


def select_rows(df: DataFrame, rids: list[int], rid: str = "rid") -> DataFrame:
    """Rows by rid, in the order given and as often as given, with that order as position."""
    if not rids:
        raise EmptyInput("no rows")
    wanted = df.sparkSession.createDataFrame(list(enumerate(rids)), "position bigint, __rid bigint")
    return wanted.join(df, F.col("__rid") == F.col(rid)).drop("__rid")


def matmul(df: DataFrame, cols: list[str], matrix: np.ndarray, names: list[str]) -> DataFrame:
    """df with the products of its rows and a small matrix (columns by names) instead of cols."""
    matrix = np.asarray(matrix, dtype=float)
    if matrix.shape != (len(cols), len(names)):
        raise ShapeMismatch(f"a matrix of {matrix.shape} for {len(cols)} columns and {len(names)} names")
    x = [num(c) for c in cols]
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in cols), *(dot(x, matrix[:, j].tolist()).alias(n) for j, n in enumerate(names)))


def from_columns(spark, columns: dict[str, list[float]]) -> DataFrame:
    """A DataFrame with a rid from equally long columns."""
    if len({len(v) for v in columns.values()}) != 1 or len(next(iter(columns.values()))) == 0:
        raise ShapeMismatch("columns of one length, not empty, are needed")
    rows = [(i, *map(float, r)) for i, r in enumerate(zip(*columns.values(), strict=True))]
    return spark.createDataFrame(rows, "rid bigint, " + ", ".join(f"`{c}` double" for c in columns))


def from_rows(spark, rows: list[list[float]], names: list[str]) -> DataFrame:
    """A DataFrame with a rid from equally long rows."""
    if not rows or any(len(r) != len(names) for r in rows):
        raise ShapeMismatch(f"rows of {len(names)} values, one at least, are needed")
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "rid bigint, " + ", ".join(f"`{c}` double" for c in names))


def zeros(spark, rows: int, names: list[str]) -> DataFrame:
    """A DataFrame of zeros with a rid; its rows are made where they are needed."""
    if rows < 1 or not names:
        raise ShapeMismatch("a row and a column at least are needed")
    return spark.range(rows).select(F.col("id").alias("rid"), *(F.lit(0.0).alias(c) for c in names))


def identity(spark, names: list[str]) -> DataFrame:
    """The identity matrix with a rid."""
    if not names:
        raise ShapeMismatch("a column at least is needed")
    return spark.range(len(names)).select(F.col("id").alias("rid"), *(F.when(F.col("id") == i, 1.0).otherwise(0.0).alias(c) for i, c in enumerate(names)))


def cell(df: DataFrame, rid_value: int, column: str, rid: str = "rid"):
    """The value of one cell, a number or a string."""
    if column not in df.columns:
        raise ShapeMismatch(f"no column {column}")
    found = df.where(F.col(rid) == rid_value).select(F.col(f"`{column}`")).first()
    if found is None:
        raise ShapeMismatch(f"no row {rid_value}")
    return found[0]


def row(df: DataFrame, rid_value: int, cols: list[str], rid: str = "rid") -> list:
    """The values of one row."""
    found = df.where(F.col(rid) == rid_value).select(*(F.col(f"`{c}`") for c in cols)).first()
    if found is None:
        raise ShapeMismatch(f"no row {rid_value}")
    return list(found)


def column(df: DataFrame, name: str, rid: str = "rid") -> DataFrame:
    """(rid, value) of one column, of numbers or strings."""
    if name not in df.columns:
        raise ShapeMismatch(f"no column {name}")
    return df.select(F.col(rid).alias("rid"), F.col(f"`{name}`").alias("value"))


def transposed_cells(df: DataFrame, cols: list[str], rid: str = "rid") -> DataFrame:
    """(row, col, value) of the transpose, for any number of rows: row is the number of a column of df, col its rid."""
    items = F.array(*(F.struct(F.lit(i).cast("bigint").alias("row"), num(c).alias("value")) for i, c in enumerate(cols)))
    return df.select(F.col(rid).cast("bigint").alias("col"), F.inline(items)).select("row", "col", "value")


def transpose(df: DataFrame, cols: list[str], rid: str = "rid", most: int = 10_000) -> DataFrame:
    """(column, values): one row for each column with its values by rid, for up to `most` rows; transposed_cells() takes any number."""
    n = df.count()
    if n > most:
        raise InvalidInput(f"a row of more than {most} values; transposed_cells() takes any number")
    items = F.array(*(F.struct(F.lit(c).alias("column"), num(c).alias("v")) for c in cols))
    long = df.select(F.col(rid).alias("__rid"), F.inline(items))
    return long.groupBy("column").agg(F.transform(F.sort_array(F.collect_list(F.struct("__rid", "v"))), lambda x: x["v"]).alias("values"))


def from_triplets(triplets: DataFrame, n_cols: int) -> DataFrame:
    """(row, size, indices, values) from (row, col, value): duplicates are summed, zero sums dropped, columns ascending."""
    summed = triplets.groupBy("row", "col").agg(F.sum("value").alias("value")).where("value != 0")
    wrong = F.raise_error(F.lit("InvalidInput: a column out of bounds")).cast("int")
    cells = F.struct(F.when((F.col("col") >= 0) & (F.col("col") < n_cols), F.col("col").cast("int")).otherwise(wrong).alias("i"), "value")
    rows = summed.groupBy("row").agg(F.sort_array(F.collect_list(cells)).alias("cells"))
    return rows.select("row", F.lit(n_cols).alias("size"), F.transform("cells", lambda c: c["i"]).alias("indices"), F.transform("cells", lambda c: c["value"]).alias("values"))


def to_dense(sparse: DataFrame) -> DataFrame:
    """(row, values) with all cells."""
    at = lambda i: F.array_position("indices", i)
    return sparse.select("row", F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.coalesce(F.get("values", (at(i) - 1).cast("int")), F.lit(0.0))).alias("values"))


def density(sparse: DataFrame, n_rows: int) -> float:
    """Share of cells that are held."""
    row = sparse.agg(F.sum(F.size("indices")).alias("n"), F.max("size").alias("size")).first()
    return (row["n"] or 0) / (n_rows * row["size"]) if row["size"] else 0.0


def sparse_get(sparse: DataFrame, row_value: int, col: int) -> float:
    """A cell of (row, size, indices, values); 0 where none is held."""
    found = sparse.where(F.col("row") == row_value).select("size", F.get("values", (F.array_position("indices", F.lit(col).cast("int")) - 1).cast("int")).alias("v")).first()
    if found is not None and not 0 <= col < found["size"]:
        raise ShapeMismatch(f"no column {col}")
    return 0.0 if found is None or found["v"] is None else found["v"]


def row_nz(sparse: DataFrame, row_value: int) -> list[tuple[int, float]]:
    """Columns and values that a row of a sparse matrix holds."""
    found = sparse.where(F.col("row") == row_value).select("indices", "values").first()
    return [] if found is None else list(zip(found["indices"], found["values"], strict=True))
