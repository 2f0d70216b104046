"""Principal components and truncated SVD: one distributed Gram matrix, eigenvectors on the driver, dot products per row."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidConfig
from ..functions.exprs import dot, finite
from ..plans.fitplan import FitPlan
from .base import Estimator, Model, per_column
from .linalg import eigen
from .splits import Xorshift
from .stats import gram


def _guarded(df: DataFrame, cols: list[str]) -> tuple[int, np.ndarray]:
    plan = FitPlan()
    plan.guard(*cols)
    for c in cols:
        plan.ask(f"mean:{c}", F.avg(F.col(f"`{c}`").cast("double")))
    plan.run(df)
    return plan["rows"], np.array([plan[f"mean:{c}"] for c in cols])


def _enough(values: np.ndarray, total: float, share: float) -> int:
    """How many of the largest values reach this share of the total."""
    acc = 0.0
    for k, v in enumerate(values):
        acc += v / total
        if acc >= share:
            return k + 1
    return len(values)


@dataclass
class ProjectionModel(Model):
    """Dot products with components (rows), after taking off the mean; whitened ones are divided by `scale`."""

    mean: list[float] = per_column(finite=True)
    components: list[list[float]] = field(default_factory=list, metadata={"finite": True})
    scale: list[float] = field(default_factory=list, metadata={"finite": True})
    explained_variance: list[float] = field(default_factory=list)
    explained_variance_ratio: list[float] = field(default_factory=list)
    noise_variance: float = 0.0
    singular_values: list[float] = field(default_factory=list)
    prefix: str = "pca"

    def names_out(self) -> list[str]:
        return [f"{self.prefix}{i}" for i in range(len(self.components))]

    def outputs(self) -> list[Column]:
        x = [finite(c) - F.lit(m) for c, m in zip(self.cols, self.mean, strict=True)]
        return [dot(x, row) / F.lit(s) for row, s in zip(self.components, self.scale, strict=True)]

    def inverse(self) -> list[Column]:
        z = [finite(n) * F.lit(s) for n, s in zip(self.names_out(), self.scale, strict=True)]
        return [dot(z, [row[j] for row in self.components], self.mean[j]) for j in range(len(self.cols))]

    def transform_array(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """df with the projection of an array column as another; for wide rows, whose columns would make long plans."""
        x = F.zip_with(F.col(column).cast("array<double>"), F.array(*map(F.lit, self.mean)), lambda v, m: v - m)
        rows = [F.aggregate(F.zip_with(x, F.array(*map(F.lit, row)), lambda v, w: v * w), F.lit(0.0), lambda a, b: a + b) / F.lit(s) for row, s in zip(self.components, self.scale, strict=True)]
        return df.withColumn(name, F.array(*rows))


def randomized_eigen(a: np.ndarray, k: int, seed: int = 0xA5C0FFEE) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and vectors of a symmetric matrix from a random range: oversampled by 10, 7 power steps."""
    p = len(a)
    rng, width = Xorshift(seed), min(p, k + 10)
    q, _ = np.linalg.qr(a @ np.array([[rng.normal() for _ in range(width)] for _ in range(p)]))
    for _ in range(7):
        q, _ = np.linalg.qr(a @ q)
    values, rows = eigen(q.T @ a @ q)
    return values[:k], rows[:k] @ q.T


@dataclass
class PCA(Estimator):
    """Components of the sample covariance.

    n_components: a count (at most the columns and rows count), a share of variance in (0, 1], or None for all. The
    randomized solver works on the covariance matrix, from a count. Signs are those of each component's largest entry.
    """

    n_components: int | float | None = 0.95
    whiten: bool = False
    solver: str = "auto"

    def validate(self) -> None:
        k = self.n_components
        if isinstance(k, float) and not 0 < k <= 1 or isinstance(k, int) and k < 1:
            raise InvalidConfig("n_components is a count of 1 or more or a share of variance in (0, 1]")
        if self.solver not in ("auto", "full", "randomized"):
            raise InvalidConfig("solver is auto, full or randomized")

    def _fit(self, df: DataFrame, cols: list[str], target: str | None) -> ProjectionModel:
        n, mean = _guarded(df, cols)
        cov = gram(df, cols, mean) / max(1, n - 1)
        most = min(n, len(cols))
        total = float(np.trace(cov))
        if self.solver == "randomized" and isinstance(self.n_components, int):
            values, rows = randomized_eigen(cov, min(self.n_components, most))
        else:
            values, rows = eigen(cov)
        values = np.maximum(values, 0.0)
        if self.n_components is None:
            k = most
        elif isinstance(self.n_components, int):
            k = min(self.n_components, most)
        else:
            k = min(most, _enough(values, total, self.n_components)) if total > 0 else most
        scale = [math.sqrt(v) if self.whiten and v > 0 else 1.0 for v in values[:k]]
        noise = (total - float(values[:k].sum())) / (most - k) if k < most else 0.0
        ratio = [float(v) / total if total > 0 else 0.0 for v in values[:k]]
        return ProjectionModel(cols, mean.tolist(), rows[:k].tolist(), scale, values[:k].tolist(), ratio, max(0.0, noise))


@dataclass
class TruncatedSVD(Estimator):
    """Right singular vectors of the columns as they are, not centred; explained variance is s^2 / (n - 1)."""

    n_components: int | float | None = 2

    def validate(self) -> None:
        k = self.n_components
        if isinstance(k, float) and not 0 < k < 1 or isinstance(k, int) and k < 1:
            raise InvalidConfig("n_components is a count of 1 or more or a share in (0, 1)")

    def _fit(self, df: DataFrame, cols: list[str], target: str | None) -> ProjectionModel:
        n, _ = _guarded(df, cols)
        if isinstance(self.n_components, int) and self.n_components > min(n, len(cols)):
            raise InvalidConfig("more components than columns or rows")
        values, rows = eigen(gram(df, cols))
        values = np.maximum(values, 0.0)
        total, most = float(values.sum()), min(n, len(cols))
        if isinstance(self.n_components, int):
            k = self.n_components
        elif self.n_components is None or total <= 0:
            k = most
        else:
            k = min(most, _enough(values, total, self.n_components))
        variance = (values[:k] / max(1, n - 1)).tolist()
        ratio = [float(v) / total if total > 0 else 0.0 for v in values[:k]]
        return ProjectionModel(cols, [0.0] * len(cols), rows[:k].tolist(), [1.0] * k, variance, ratio, 0.0, np.sqrt(values[:k]).tolist(), "svd")
