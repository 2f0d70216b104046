"""Feature selection: by variance, or by a score against class labels."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidConfig, InvalidInput
from ..functions.exprs import finite, is_bad
from ..plans.fitplan import FitPlan
from .base import Estimator, Model


def _c(name: str) -> Column:
    return F.col(f"`{name}`").cast("double")


@dataclass
class SelectionModel(Model):
    """Keeps some of the fitted columns, in their order; scores are for all of them."""

    kept: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)

    def names_out(self) -> list[str]:
        return list(self.kept)

    def outputs(self) -> list[Column]:
        return [finite(c) for c in self.kept]


@dataclass
class VarianceThreshold(Estimator):
    """Columns whose population variance is over the threshold."""

    threshold: float = 0.0

    def validate(self) -> None:
        if not self.threshold >= 0:
            raise InvalidConfig("threshold must be 0 or more")

    def ask(self, plan: FitPlan, cols: list[str]) -> None:
        plan.guard(*cols)
        for c in cols:
            plan.ask(f"varp:{c}", F.var_pop(_c(c)))

    def build(self, plan: FitPlan, cols: list[str], df: DataFrame) -> SelectionModel:
        variance = [plan[f"varp:{c}"] for c in cols]
        kept = [c for c, v in zip(cols, variance, strict=True) if v > self.threshold]
        if not kept:
            raise InvalidInput("no column has a variance over the threshold")
        return SelectionModel(cols, kept, variance)


def f_classif(df: DataFrame, cols: list[str], label: str) -> list[float]:
    """One-way ANOVA F of each column between classes; infinite where classes don't vary within."""
    groups = df.groupBy(F.col(f"`{label}`").alias("y")).agg(F.count(F.lit(1)).alias("n"), *(a.alias(f"{k}{i}") for i, c in enumerate(cols) for k, a in (("m", F.avg(_c(c))), ("v", F.var_pop(_c(c)))))).collect()
    k, n = len(groups), sum(g["n"] for g in groups)
    if k < 2 or n <= k:
        raise InvalidInput("two classes and more rows than classes are needed")
    out = []
    for i in range(len(cols)):
        mean = sum(g["n"] * g[f"m{i}"] for g in groups) / n
        between = sum(g["n"] * (g[f"m{i}"] - mean) ** 2 for g in groups) / (k - 1)
        within = sum(g["n"] * g[f"v{i}"] for g in groups) / (n - k)
        out.append(between / within if within else math.inf)
    return out


def chi2(df: DataFrame, cols: list[str], label: str) -> list[float]:
    """Chi-squared of each column's sums by class against their expected share; columns must not be negative."""
    groups = df.groupBy(F.col(f"`{label}`").alias("y")).agg(F.count(F.lit(1)).alias("n"), *(a.alias(f"{k}{i}") for i, c in enumerate(cols) for k, a in (("s", F.sum(_c(c))), ("lo", F.min(_c(c)))))).collect()
    n = sum(g["n"] for g in groups)
    out = []
    for i, c in enumerate(cols):
        if min(g[f"lo{i}"] for g in groups) < 0:
            raise InvalidInput(f"column {c} has negative values")
        total = sum(g[f"s{i}"] for g in groups)
        expected = [total * g["n"] / n for g in groups]
        out.append(sum((g[f"s{i}"] - e) ** 2 / e for g, e in zip(groups, expected, strict=True) if e > 0))
    return out


def mutual_information(df: DataFrame, cols: list[str], label: str) -> list[float]:
    """Mutual information, in nats, of class and column in max(2, ceil(sqrt(n))) bins of equal width."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *(f(_c(c)).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("lo", F.min), ("hi", F.max)))).first()
    n = row["n"]
    bins = max(2, math.ceil(math.sqrt(n)))
    items = []
    for i, c in enumerate(cols):
        low, width = row[f"lo{i}"], (row[f"hi{i}"] - row[f"lo{i}"]) / bins
        b = F.least(F.lit(bins - 1), F.floor((_c(c) - F.lit(low)) / F.lit(width)).cast("int")) if width > 0 else F.lit(0)
        items.append(F.struct(F.lit(i).alias("i"), b.alias("b")))
    cells = df.select(F.col(f"`{label}`").alias("y"), F.explode(F.array(*items)).alias("x")).groupBy("y", "x.i", "x.b").agg(F.count(F.lit(1)).alias("n"))
    both = cells.withColumn("by_bin", F.sum("n").over(_over("i", "b"))).withColumn("by_class", F.sum("n").over(_over("i", "y")))
    part = F.col("n") / n * F.ln(F.col("n") * F.lit(float(n)) / (F.col("by_bin") * F.col("by_class")))
    found = {r["i"]: r["mi"] for r in both.groupBy("i").agg(F.sum(part).alias("mi")).collect()}
    return [max(0.0, found.get(i, 0.0)) for i in range(len(cols))]


def _over(*cols: str):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


SCORES: dict[str, Callable] = {"f_classif": f_classif, "chi2": chi2, "mutual_information": mutual_information}


@dataclass
class SelectKBest(Estimator):
    """The k columns of the highest scores, ties to the earlier; they stay in their order."""

    supervised: ClassVar[bool] = True
    k: int = 10
    score: str = "f_classif"

    def validate(self) -> None:
        if self.k < 1 or self.score not in SCORES:
            raise InvalidConfig(f"k of 1 or more and a score of {sorted(SCORES)} are needed")

    def _fit(self, df: DataFrame, cols: list[str], target: str | None) -> SelectionModel:
        if target is None:
            raise InvalidConfig("a label column is needed")
        if self.k > len(cols):
            raise InvalidConfig(f"k is {self.k}, but there are {len(cols)} columns")
        plan = FitPlan()
        plan.guard(*cols)
        plan.ask("no label", F.sum(F.col(f"`{target}`").isNull().cast("long")))
        if plan.run(df)["no label"]:
            raise InvalidInput("some rows have no label")
        scores = SCORES[self.score](df, cols, target)
        best = sorted(sorted(range(len(cols)), key=lambda i: -scores[i])[: self.k])
        return SelectionModel(cols, [cols[i] for i in best], scores)


def non_finite(df: DataFrame, cols: list[str]) -> dict[str, int]:
    """How many null, NaN or infinite values each column has."""
    row = df.agg(*(F.coalesce(F.sum(is_bad(_c(c)).cast("long")), F.lit(0)).alias(f"b{i}") for i, c in enumerate(cols))).first()
    return dict(zip(cols, row, strict=True))
