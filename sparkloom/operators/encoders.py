"""Categorical encoders. Categories are sorted by their UTF-8 bytes; an empty string is a category like any other."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EmptyInput, InvalidConfig, InvalidInput, ShapeMismatch
from ..plans.fitplan import FitPlan
from ..plans.folder import need_folder
from .base import Estimator, Model, per_column
from .stats import with_rid

#: Categories up to which a dictionary is inlined in the projection; more are joined. Categories up to which the model
#: holds a dictionary itself; a larger one stays a table in the shared folder, and never passes the driver.
INLINE, HELD = 256, 100_000


def _s(c: str) -> Column:
    return F.col(f"`{c}`").cast("string")


def _unknown(c: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"UnknownCategory: column {c}: "), F.coalesce(_s(c), F.lit("null"))))


def _table(df: DataFrame, pairs: list[tuple], types: str) -> DataFrame:
    return df.sparkSession.createDataFrame(pairs, types)


def _stored(table: DataFrame) -> str:
    """Write (k, v) to the shared folder; its path."""
    spark = table.sparkSession
    need_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/dictionary-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return path


@dataclass
class DictionaryModel(Model):
    """Base of encoders that look categories up: column values by category, and what unknown ones give.

    Small dictionaries are inlined as a map; a large one is joined from the left, broadcast only while it is small. A
    column with a table (a path) has its dictionary there and none here.
    """

    guards: ClassVar[bool] = False
    values: list[dict[str, float]] = per_column()
    #: "error", "null" or a number for each column.
    unknown: list = per_column()
    tables: list[str | None] = field(default_factory=list)

    def check(self) -> None:
        super().check()
        if self.tables and len(self.tables) != len(self.cols):
            raise InvalidInput(f"{type(self).__name__}: {len(self.tables)} tables for {len(self.cols)} columns")

    def _table_of(self, i: int) -> str | None:
        return self.tables[i] if self.tables else None

    def outputs(self) -> list[Column]:
        return [self._looked_up(c, F.col(f"`{c}`"), v, u) for c, v, u in zip(self.cols, self.values, self.unknown, strict=True)]

    @staticmethod
    def _otherwise(c: str, unknown) -> Column:
        if unknown == "error":
            return _unknown(c).cast("double")
        return F.lit(None).cast("double") if unknown == "null" else F.lit(float(unknown))

    def _looked_up(self, c: str, col: Column, values: dict[str, float], unknown) -> Column:
        if not values:
            return self._otherwise(c, unknown)
        if len(values) <= 16:
            found = F.lit(None).cast("double")
            for k, v in values.items():
                found = F.when(col.cast("string") == k, F.lit(float(v))).otherwise(found)
        else:
            found = F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in (kv[0], float(kv[1])))), col.cast("string"))
        return F.coalesce(found, self._otherwise(c, unknown))

    def transform(self, df: DataFrame) -> DataFrame:
        self.need(df)
        columns, helpers = [], []
        for i, (c, v, u) in enumerate(zip(self.cols, self.values, self.unknown, strict=True)):
            path = self._table_of(i)
            if len(v) <= INLINE and path is None:
                columns.append(self._looked_up(c, F.col(f"`{c}`"), v, u))
                continue
            if path is None:
                table = _table(df, [(k, float(x)) for k, x in v.items()], f"__k{i} string, __v{i} double")
            else:
                table = df.sparkSession.read.parquet(path).select(F.col("k").alias(f"__k{i}"), F.col("v").alias(f"__v{i}"))
            df = df.join(table, _s(c) == F.col(f"__k{i}"), "left").drop(f"__k{i}")
            columns.append(F.coalesce(F.col(f"__v{i}"), self._otherwise(c, u)))
            helpers.append(f"__v{i}")
        return self._put(df, self.cols, columns, self.names_out()).drop(*helpers)


def _categories(df: DataFrame, cols: list[str]) -> list[list[str]]:
    """Sorted distinct non-null values of each column, in one aggregate."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *(F.sort_array(F.collect_set(_s(c))).alias(f"c{i}") for i, c in enumerate(cols))).first()
    if not row["n"]:
        raise EmptyInput("no rows to fit to")
    return [list(row[f"c{i}"]) for i in range(len(cols))]


@dataclass
class OneHotModel(Model):
    guards: ClassVar[bool] = False
    categories: list[list[str]] = per_column()
    drop: str | None = None
    handle_unknown: str = "error"

    def check(self) -> None:
        super().check()
        if any(len(set(k)) != len(k) for k in self.categories):
            raise InvalidInput("categories must be distinct")

    def _kept(self) -> list[list[str]]:
        return [k[1:] if self.drop == "first" else k for k in self.categories]

    def names_out(self) -> list[str]:
        return [f"{c}_{k}" for c, kept in zip(self.cols, self._kept(), strict=True) for k in kept]

    def outputs(self) -> list[Column]:
        out = []
        for c, kept, known in zip(self.cols, self._kept(), self.categories, strict=True):
            miss = F.lit(0.0) if self.handle_unknown == "ignore" else F.when(_s(c).isin(*known), F.lit(0.0)).otherwise(_unknown(c).cast("double"))
            out += [F.when(_s(c) == k, 1.0).otherwise(miss) for k in kept]
        return out

    def transform_sparse(self, df: DataFrame, name: str = "onehot") -> DataFrame:
        """df with the cells as a struct of size, indices and values, for dictionaries of any size."""
        self.need(df)
        base, found = 0, []
        for c, kept, known in zip(self.cols, self._kept(), self.categories, strict=True):
            at = F.array_position(F.array(*map(F.lit, kept)), _s(c)) if kept else F.lit(0)
            if self.handle_unknown != "ignore":
                at = F.when(_s(c).isin(*known), at).otherwise(_unknown(c).cast("bigint"))
            found.append(F.when(at > 0, (at - 1 + base).cast("int")))
            base += len(kept)
        indices = F.filter(F.array(*found), lambda i: i.isNotNull())
        return df.withColumn(name, F.struct(F.lit(base).alias("size"), indices.alias("indices"), F.transform(indices, lambda _: F.lit(1.0)).alias("values")))

    def inverse(self) -> list[Column]:
        out = []
        for c, kept, known in zip(self.cols, self._kept(), self.categories, strict=True):
            none = known[0] if self.drop == "first" and known else ""
            first = F.lit(none)
            for k in reversed(kept):
                first = F.when(F.col(f"`{c}_{k}`") >= 0.5, F.lit(k)).otherwise(first)
            out.append(first)
        return out


@dataclass
class OneHotEncoder(Estimator):
    """A 0/1 column for each category. drop "first" leaves out the first; unknown categories fail or give all zeros."""

    drop: str | None = None
    handle_unknown: str = "error"

    def validate(self) -> None:
        if self.drop not in (None, "first") or self.handle_unknown not in ("error", "ignore"):
            raise InvalidConfig("drop is None or first; handle_unknown is error or ignore")

    def _fit(self, df: DataFrame, cols: list[str], target: str | None) -> OneHotModel:
        return OneHotModel(cols, _categories(df, cols), self.drop, self.handle_unknown)


@dataclass
class OrdinalModel(DictionaryModel):
    categories: list[list[str]] = per_column(default=list)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        self.need(df, self.names_out())
        for i, c in enumerate(self.cols):
            if self._table_of(i) is not None:
                table = df.sparkSession.read.parquet(self.tables[i]).select(F.col("k").alias(f"__k{i}"), F.col("v").alias(f"__v{i}"))
                df = df.join(table, F.col(f"`{c}`").cast("double") == F.col(f"__v{i}"), "left").drop(f"__v{i}")
        out = self._put(df, self.names_out(), self.inverse(), self.cols)
        return out.drop(*(f"__k{i}" for i in range(len(self.cols)) if self._table_of(i) is not None))

    def inverse(self) -> list[Column]:
        out = []
        for i, (c, known) in enumerate(zip(self.cols, self.categories, strict=True)):
            x = F.col(f"`{c}`").cast("double")
            if self._table_of(i) is not None:
                wrong = F.raise_error(F.lit(f"InvalidInput: column {c} has a code that stands for no category")).cast("string")
                out.append(F.when(x == -1.0, F.lit("")).otherwise(F.coalesce(F.col(f"__k{i}"), wrong)))
                continue
            wrong = F.raise_error(F.lit(f"InvalidInput: column {c} has a code that stands for no category")).cast("string")
            found = F.get(F.array(*map(F.lit, known)), x.cast("int")) if known else F.lit(None).cast("string")
            out.append(F.when(x == -1.0, F.lit("")).when((x == F.floor(x)) & (x >= 0) & (x < len(known)), found).otherwise(wrong))
        return out


@dataclass
class OrdinalEncoder(Estimator):
    """Index of the category, in sorted order or in given lists; unknown ones fail or give -1."""

    categories: list[list[str]] | None = None
    handle_unknown: str = "error"

    def validate(self) -> None:
        if self.handle_unknown not in ("error", "use_neg_one"):
            raise InvalidConfig("handle_unknown is error or use_neg_one")
        if self.categories is not None and any(not k or len(set(k)) != len(k) for k in self.categories):
            raise InvalidConfig("category lists must be distinct and not empty")

    def _fit(self, df: DataFrame, cols: list[str], target: str | None) -> OrdinalModel:
        if self.categories is not None and len(self.categories) != len(cols):
            raise ShapeMismatch(f"{len(self.categories)} category lists for {len(cols)} columns")
        unknown = "error" if self.handle_unknown == "error" else -1.0
        if self.categories is None:
            values, tables = _codes(df, cols)
        else:
            values, tables = [{k: float(i) for i, k in enumerate(ks)} for ks in self.categories], []
        return OrdinalModel(cols, values, [unknown] * len(cols), tables, [list(v) for v in values])


@dataclass
class LabelEncoderModel(OrdinalModel):
    """Codes of labels as bigint; null stands for an unknown label."""

    def outputs(self) -> list[Column]:
        return [c.cast("bigint") for c in super().outputs()]

    def transform(self, df: DataFrame) -> DataFrame:
        out = super().transform(df)
        return out.withColumn(self.cols[0], F.col(f"`{self.cols[0]}`").cast("bigint"))

    def inverse(self) -> list[Column]:
        return [F.coalesce(c, F.lit("")) for c in (F.when(F.col(f"`{n}`").isNotNull(), i) for n, i in zip(self.cols, super().inverse(), strict=True))]


@dataclass
class LabelEncoder(Estimator):
    """Class labels, one column, to 0..n-1 in sorted order; unknown ones fail or give null."""

    handle_unknown: str = "error"

    def validate(self) -> None:
        if self.handle_unknown not in ("error", "ignore"):
            raise InvalidConfig("handle_unknown is error or ignore")

    def _fit(self, df: DataFrame, cols: list[str], target: str | None) -> LabelEncoderModel:
        if len(cols) != 1:
            raise ShapeMismatch("labels are one column")
        values, tables = _codes(df, cols)
        return LabelEncoderModel(cols, values, ["error" if self.handle_unknown == "error" else "null"], tables, [list(v) for v in values])


def _grouped(df: DataFrame, cols: list[str], aggregates: list[Column], value: Callable[[DataFrame], DataFrame]) -> tuple[list[dict[str, float]], list[str | None]]:
    """Dictionaries of each column and the paths of those that are too large to be held.

    All columns' categories are aggregated in one shuffle of partial results; value() makes of their rows (i, k, and
    the aggregates) rows with v.
    """
    items = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), _s(c).alias("k")) for i, c in enumerate(cols))))
    need_folder(df.sparkSession)
    groups = value(df.select("*", items.alias("__x")).groupBy("__x.i", "__x.k").agg(*aggregates).where("k is not null")).select("i", "k", F.col("v").cast("double").alias("v")).checkpoint()
    sizes = {r["i"]: r["n"] for r in groups.groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()}
    large = [i for i, n in sizes.items() if n > HELD]
    values: list[dict[str, float]] = [{} for _ in cols]
    for r in groups.where(~F.col("i").isin(large) if large else F.lit(True)).orderBy("i", "k").collect():  # HELD a column at most
        values[r["i"]][r["k"]] = r["v"]
    return values, [_stored(groups.where(F.col("i") == i).select("k", "v")) if i in large else None for i in range(len(cols))]


def _codes(df: DataFrame, cols: list[str]) -> tuple[list[dict[str, float]], list[str | None]]:
    """Numbers of each column's categories in their order."""

    def numbered(groups: DataFrame) -> DataFrame:
        rows = with_rid(groups, ["i", "k"], "v")
        first = rows.groupBy("i").agg(F.min("v").alias("first"))
        return rows.join(F.broadcast(first), "i").withColumn("v", F.col("v") - F.col("first"))  # a row a column

    if df.isEmpty():
        raise EmptyInput("no rows to fit to")
    return _grouped(df, cols, [F.count(F.lit(1)).alias("n")], numbered)


@dataclass
class FrequencyEncoder(Estimator):
    """How often the category occurs, as a count or as a share; unknown ones give 0 or fail."""

    normalized: bool = False
    handle_unknown: str = "zero"

    def validate(self) -> None:
        if self.handle_unknown not in ("zero", "error"):
            raise InvalidConfig("handle_unknown is zero or error")

    def _fit(self, df: DataFrame, cols: list[str], target: str | None) -> DictionaryModel:
        rows = df.count()
        if not rows:
            raise EmptyInput("no rows to fit to")
        by = (1.0 / rows) if self.normalized else 1.0
        values, tables = _grouped(df, cols, [F.count(F.lit(1)).alias("n")], lambda g: g.withColumn("v", F.col("n") * F.lit(by)))
        return DictionaryModel(cols, values, [0.0 if self.handle_unknown == "zero" else "error"] * len(cols), tables)


@dataclass
class TargetEncoder(Estimator):
    """Mean of the target by category, drawn towards the global mean by `smoothing` rows' worth of it.

    The same means serve the rows they were taken from: there is no protection against leakage.
    """

    supervised: ClassVar[bool] = True
    smoothing: float = 10.0
    handle_unknown: str = "global_mean"

    def validate(self) -> None:
        if not self.smoothing >= 0 or self.handle_unknown not in ("global_mean", "nan", "error"):
            raise InvalidConfig("smoothing of 0 or more, and handle_unknown global_mean, nan (null) or error are needed")

    def _fit(self, df: DataFrame, cols: list[str], target: str | None) -> DictionaryModel:
        if target is None:
            raise InvalidConfig("a target column is needed")
        y = F.col(f"`{target}`").cast("double")
        plan = FitPlan()
        plan.guard(target)
        plan.ask("mean", F.avg(y))
        mean = plan.run(df.select(F.col(f"`{target}`")))["mean"]
        s = self.smoothing
        drawn = (F.col("n") * F.col("m") + F.lit(s * mean)) / (F.col("n") + F.lit(s))
        values, tables = _grouped(df, cols, [F.count(F.lit(1)).alias("n"), F.avg(y).alias("m")], lambda g: g.withColumn("v", drawn))
        unknown = {"global_mean": mean, "nan": "null", "error": "error"}[self.handle_unknown]
        return DictionaryModel(cols, values, [unknown] * len(cols), tables)


