"""Linear and logistic models: distributed sums of products, a small solve on the driver, a dot product per row."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import ClassVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidConfig, InvalidInput, Singular
from ..functions.exprs import dot, finite, sigmoid
from ..plans.fitplan import FitPlan
from .base import Estimator, Model, per_column
from .linalg import pinv_solve, solve
from .stats import _sum_of_arrays, gram


def _c(name: str) -> Column:
    return F.col(f"`{name}`").cast("double")


@dataclass
class Predictor(Model):
    """A model that adds a prediction column and has a score."""

    prediction: str = "prediction"

    def predicted(self) -> Column:
        raise NotImplementedError

    def transform(self, df: DataFrame) -> DataFrame:
        self.need(df)
        return df.withColumn(self.prediction, self.predicted())

    predict = transform


@dataclass
class LinearModel(Predictor):
    coef: list[float] = per_column(finite=True, default=list)
    intercept: float = 0.0
    n_iter: int = 0

    def predicted(self) -> Column:
        return dot([finite(c) for c in self.cols], self.coef, self.intercept)

    def score(self, df: DataFrame, target: str) -> float:
        """R squared."""
        from .metrics import regression_metrics

        return regression_metrics(self.transform(df), target, self.prediction).first()["r2"]


@dataclass
class _Regression(Estimator):
    supervised: ClassVar[bool] = True
    fit_intercept: bool = True

    def _sums(self, df: DataFrame, cols: list[str], target: str | None) -> tuple[int, np.ndarray, float, np.ndarray, np.ndarray]:
        """Rows, means of columns and target (0 without intercept), and products of the centred columns with each other and the target."""
        if target is None:
            raise InvalidConfig("a target column is needed")
        plan = FitPlan()
        plan.guard(*cols, target)
        for c in [*cols, target]:
            plan.ask(f"mean:{c}", F.avg(_c(c)))
        plan.run(df)
        mean = np.array([plan[f"mean:{c}"] if self.fit_intercept else 0.0 for c in [*cols, target]])
        g = gram(df, [*cols, target], mean)
        return plan["rows"], mean[:-1], float(mean[-1]), g[:-1, :-1], g[:-1, -1]


@dataclass
class LinearRegression(_Regression):
    """Least squares by the normal equations of centred columns; "svd" tolerates dependent columns."""

    solver: str = "cholesky"

    def validate(self) -> None:
        if self.solver not in ("cholesky", "svd"):
            raise InvalidConfig("solver is cholesky or svd")

    def _fit(self, df: DataFrame, cols: list[str], target: str | None) -> LinearModel:
        _, mean, y, g, q = self._sums(df, cols, target)
        beta = solve(g, q, self.solver)
        return LinearModel(cols, coef=beta.tolist(), intercept=float(y - mean @ beta) if self.fit_intercept else 0.0)


@dataclass
class Ridge(_Regression):
    """Least squares with alpha * |beta|^2, alpha as it is and columns not standardised."""

    alpha: float = 1.0
    solver: str = "cholesky"

    def validate(self) -> None:
        if not (math.isfinite(self.alpha) and self.alpha >= 0) or self.solver not in ("cholesky", "svd"):
            raise InvalidConfig("alpha of 0 or more and solver cholesky or svd are needed")

    def _fit(self, df: DataFrame, cols: list[str], target: str | None) -> LinearModel:
        _, mean, y, g, q = self._sums(df, cols, target)
        beta = solve(g + self.alpha * np.eye(len(cols)), q, self.solver)
        return LinearModel(cols, coef=beta.tolist(), intercept=float(y - mean @ beta) if self.fit_intercept else 0.0)


@dataclass
class Lasso(_Regression):
    """Least squares with n * alpha * |beta| by cyclic coordinate descent on the sums; no further pass over the data."""

    alpha: float = 1.0
    max_iter: int = 1000
    tol: float = 1e-4

    def validate(self) -> None:
        if not (math.isfinite(self.alpha) and self.alpha >= 0) or self.max_iter < 1:
            raise InvalidConfig("alpha of 0 or more and max_iter of 1 or more are needed")

    def _fit(self, df: DataFrame, cols: list[str], target: str | None) -> LinearModel:
        n, mean, y, g, q = self._sums(df, cols, target)
        beta, bar, rounds = np.zeros(len(cols)), n * self.alpha, 0
        for _ in range(self.max_iter):
            rounds += 1
            moved = 0.0
            for j in np.flatnonzero(np.diag(g)):
                pull = q[j] - g[j] @ beta + g[j, j] * beta[j]
                new = math.copysign(max(0.0, abs(pull) - bar), pull) / g[j, j]
                moved = max(moved, abs(new - beta[j]))
                beta[j] = new
            if moved < self.tol:
                break
        return LinearModel(cols, coef=beta.tolist(), intercept=float(y - mean @ beta) if self.fit_intercept else 0.0, n_iter=rounds)


@dataclass
class LogisticModel(Predictor):
    """Binary: one row of coefficients, for the higher class. More classes: a row for each but the last, whose logit is 0."""

    coef: list[list[float]] = field(default_factory=list, metadata={"finite": True})
    intercept: list[float] = field(default_factory=list, metadata={"finite": True})
    classes: list[float] = field(default_factory=list)
    n_iter: int = 0

    def check(self) -> None:
        super().check()
        rows = 1 if len(self.classes) == 2 else len(self.classes) - 1
        if len(self.classes) < 2 or len(self.coef) != rows or len(self.intercept) != rows or any(len(r) != len(self.cols) for r in self.coef):
            raise InvalidInput("LogisticModel: coefficients don't fit classes and columns")

    def _logits(self) -> list[Column]:
        x = [finite(c) for c in self.cols]
        return [dot(x, row, b) for row, b in zip(self.coef, self.intercept, strict=True)]

    def probabilities(self) -> list[Column]:
        """A Column for each class."""
        z = self._logits()
        if len(self.classes) == 2:
            return [1.0 - sigmoid(z[0]), sigmoid(z[0])]
        z = [*z, F.lit(0.0)]
        most = F.greatest(*z)
        e = [F.exp(v - most) for v in z]
        total = sum(e[1:], e[0])
        return [v / total for v in e]

    def predicted(self) -> Column:
        p = self.probabilities()
        if len(self.classes) == 2:
            return F.when(p[1] >= 0.5, self.classes[1]).otherwise(self.classes[0])
        # Of equal probabilities the last class counts.
        best = F.array_max(F.array(*(F.struct(v.alias("p"), F.lit(i).alias("i")) for i, v in enumerate(p))))
        return F.element_at(F.array(*map(F.lit, self.classes)), best["i"] + 1)

    def predict_proba(self, df: DataFrame, name: str = "probability") -> DataFrame:
        """df with an array of the classes' probabilities."""
        self.need(df)
        return df.withColumn(name, F.array(*self.probabilities()))

    def probability_of(self, label: float) -> Column:
        if label not in self.classes:
            raise InvalidInput(f"{label} is none of the classes {self.classes}")
        return self.probabilities()[self.classes.index(label)]

    def score(self, df: DataFrame, target: str) -> float:
        """Share of rows predicted right."""
        return self.transform(df).agg(F.avg((_c(target) == F.col(self.prediction)).cast("double"))).first()[0]


@dataclass
class LogisticRegression(Estimator):
    """Unregularised logistic regression by Newton steps; each is one pass of partial sums over the data.

    Columns are centred and fitted without an intercept term. The intercept follows afterwards: for two classes the
    base rate's logit less mean * beta, for more just minus mean * beta. Of more than two classes the last is the
    reference, the Hessian gets 1e-10 on its diagonal, and steps end once none is above tol, by their signed maximum.
    """

    supervised: ClassVar[bool] = True
    fit_intercept: bool = True
    solver: str = "cholesky"
    max_iter: int = 100
    tol: float = 1e-4

    def validate(self) -> None:
        if self.solver not in ("cholesky", "svd") or self.max_iter < 1 or not self.tol > 0:
            raise InvalidConfig("solver cholesky or svd, max_iter of 1 or more and a positive tol are needed")

    def _fit(self, df: DataFrame, cols: list[str], target: str | None) -> LogisticModel:
        if target is None:
            raise InvalidConfig("a label column is needed")
        plan = FitPlan()
        plan.guard(*cols, target)
        for c in [*cols, target]:
            plan.ask(f"mean:{c}", F.avg(_c(c)))
        plan.run(df)
        classes = labels(df, target)
        if len(classes) < 2:
            raise InvalidInput("two classes are needed")
        mean = np.array([plan[f"mean:{c}"] if self.fit_intercept else 0.0 for c in cols])
        index = F.array_position(F.array(*map(F.lit, classes)), _c(target) + 0.0) - 1
        rows = df.select(*(_c(c).alias(f"x{i}") for i, c in enumerate(cols)), index.cast("int").alias("y")).persist()
        try:
            if len(classes) == 2:
                beta, rounds = self._binary(rows, mean)
                # The base rate is that of the labels' positions.
                base = rows.agg(F.avg("y")).first()[0]
                base = min(1 - 1e-12, max(1e-12, base))
                intercept = [math.log(base / (1 - base)) - float(mean @ beta)] if self.fit_intercept else [0.0]
                return LogisticModel(cols, coef=[beta.tolist()], intercept=intercept, classes=classes, n_iter=rounds)
            betas, rounds = self._several(rows, mean, len(classes))
            intercept = [-float(mean @ b) if self.fit_intercept else 0.0 for b in betas]
            return LogisticModel(cols, coef=betas.tolist(), intercept=intercept, classes=classes, n_iter=rounds)
        finally:
            rows.unpersist()

    def _binary(self, rows: DataFrame, mean: np.ndarray) -> tuple[np.ndarray, int]:
        p = len(mean)
        beta = np.zeros(p)
        for i in range(self.max_iter):

            def sums(x: np.ndarray, y: np.ndarray, beta: np.ndarray = beta) -> np.ndarray:
                eta = x @ beta
                chance = _sigmoid(eta)
                w = np.clip(chance * (1 - chance), 1e-12, 1.0)
                return np.concatenate([((x * w[:, None]).T @ x).ravel(), x.T @ (w * eta + y - chance)])

            total = _partial(rows, mean, sums, p * p + p)
            new = solve(total[: p * p].reshape(p, p), total[p * p :], self.solver)
            moved = float(np.max(np.abs(new - beta), initial=0.0))
            beta = new
            if moved < self.tol:
                break
        return beta, i + 1

    def _several(self, rows: DataFrame, mean: np.ndarray, k: int) -> tuple[np.ndarray, int]:
        p, free = len(mean), k - 1
        beta = np.zeros((free, p))
        size = free * p
        for i in range(self.max_iter):

            def sums(x: np.ndarray, y: np.ndarray, beta: np.ndarray = beta) -> np.ndarray:
                z = np.concatenate([x @ beta.T, np.zeros((len(x), 1))], axis=1)
                e = np.exp(z - z.max(axis=1, keepdims=True))
                chance = e / e.sum(axis=1, keepdims=True)
                off = chance[:, :free] - (y[:, None] == np.arange(free))
                hessian = np.empty((free, p, free, p))
                for a in range(free):
                    for b in range(free):
                        w = chance[:, a] * ((a == b) - chance[:, b])
                        hessian[a, :, b, :] = (x * w[:, None]).T @ x
                return np.concatenate([hessian.ravel(), (off.T @ x).ravel()])

            total = _partial(rows, mean, sums, size * size + size)
            hessian = total[: size * size].reshape(size, size) + 1e-10 * np.eye(size)
            try:
                step = solve(hessian, total[size * size :], self.solver)
            except Singular:
                step = pinv_solve(hessian, total[size * size :])
            beta = beta - step.reshape(free, p)
            if abs(max(0.0, float(np.max(step, initial=0.0)))) < self.tol:
                break
        return beta, i + 1


def _sigmoid(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1 / (1 + e), e / (1 + e))


def _partial(rows: DataFrame, mean: np.ndarray, sums, size: int) -> np.ndarray:
    """Sum over tasks of sums(centred columns, label): one array a task."""
    p = len(mean)

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += sums(batch[[f"x{i}" for i in range(p)]].to_numpy(dtype=float) - mean, batch["y"].to_numpy())
        yield pd.DataFrame({"s": [total.tolist()]})

    return _sum_of_arrays(rows.mapInPandas(run, "s array<double>"), size)


def labels(df: DataFrame, target: str) -> list[float]:
    """Sorted distinct class labels: finite whole numbers of 0 or more; gaps are kept and -0.0 is 0.0."""
    found = sorted(r[0] for r in df.select((_c(target) + 0.0).alias("y")).distinct().collect())
    if any(not math.isfinite(y) or y < 0 or y != int(y) for y in found):
        raise InvalidInput("class labels are whole numbers of 0 or more")
    return found
