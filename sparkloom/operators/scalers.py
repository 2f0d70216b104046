"""Scalers, discretisers and distribution transforms: a few aggregates each, then a projection."""

from __future__ import annotations

import itertools
import math
import sys
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidConfig, InvalidInput
from ..functions.exprs import box_cox, box_cox_inverse, finite, inverse_normal, plus_zero, yeo_johnson, yeo_johnson_inverse
from ..plans.fitplan import FitPlan
from .base import Estimator, Model, per_column

EPSILON = sys.float_info.epsilon


def _c(name: str) -> Column:
    return F.col(f"`{name}`").cast("double")


@dataclass
class AffineModel(Model):
    """(x - centre) * factor + base; a factor of 0 gives base, and its inverse gives back."""

    centre: list[float] = per_column(finite=True)
    factor: list[float] = per_column(finite=True)
    base: list[float] = per_column(finite=True)
    back: list[float] = per_column(finite=True)

    def outputs(self) -> list[Column]:
        return [plus_zero((finite(c) - m) * f + b) if f else finite(c) * 0.0 + b for c, m, f, b in zip(self.cols, self.centre, self.factor, self.base, strict=True)]

    def inverse(self) -> list[Column]:
        return [(finite(c) - b) / f + m if f else finite(c) * 0.0 + k for c, m, f, b, k in zip(self.cols, self.centre, self.factor, self.base, self.back, strict=True)]


@dataclass
class DividedModel(Model):
    """(x - centre) / scale; a scale of 0 gives 0, and its inverse gives back."""

    centre: list[float] = per_column(finite=True)
    scale: list[float] = per_column(finite=True)
    back: list[float] = per_column(finite=True)

    def outputs(self) -> list[Column]:
        return [plus_zero((finite(c) - m) / F.lit(s)) if s else finite(c) * 0.0 for c, m, s in zip(self.cols, self.centre, self.scale, strict=True)]

    def inverse(self) -> list[Column]:
        return [finite(c) * s + m if s else finite(c) * 0.0 + k for c, m, s, k in zip(self.cols, self.centre, self.scale, self.back, strict=True)]


@dataclass
class StandardScaler(Estimator):
    """(x - mean) / population standard deviation; a constant column gives 0."""

    with_mean: bool = True
    with_std: bool = True

    def ask(self, plan: FitPlan, cols: list[str]) -> None:
        plan.guard(*cols)
        for c in cols:
            plan.ask(f"mean:{c}", F.avg(_c(c)))
            plan.ask(f"stdp:{c}", F.stddev_pop(_c(c)))

    def build(self, plan: FitPlan, cols: list[str], df: DataFrame) -> DividedModel:
        mean = [plan[f"mean:{c}"] for c in cols]
        std = [plan[f"stdp:{c}"] if self.with_std else 1.0 for c in cols]
        return DividedModel(cols, [m if self.with_mean else 0.0 for m in mean], std, [m if self.with_mean else 0.0 for m in mean])


@dataclass
class MinMaxScaler(Estimator):
    """To the range [low, high] without clipping; a constant column gives low."""

    low: float = 0.0
    high: float = 1.0

    def validate(self) -> None:
        if not (math.isfinite(self.low) and math.isfinite(self.high) and self.low < self.high):
            raise InvalidConfig("low must be under high, both finite")

    def ask(self, plan: FitPlan, cols: list[str]) -> None:
        plan.guard(*cols)
        for c in cols:
            plan.ask(f"min:{c}", F.min(_c(c)))
            plan.ask(f"max:{c}", F.max(_c(c)))

    def build(self, plan: FitPlan, cols: list[str], df: DataFrame) -> AffineModel:
        low, high = [plan[f"min:{c}"] for c in cols], [plan[f"max:{c}"] for c in cols]
        factor = [(self.high - self.low) / (b - a) if b > a else 0.0 for a, b in zip(low, high, strict=True)]
        return AffineModel(cols, low, factor, [self.low] * len(cols), low)


@dataclass
class MaxAbsScaler(Estimator):
    """x / largest absolute value; an all-zero column stays 0."""

    def ask(self, plan: FitPlan, cols: list[str]) -> None:
        plan.guard(*cols)
        for c in cols:
            plan.ask(f"maxabs:{c}", F.max(F.abs(_c(c))))

    def build(self, plan: FitPlan, cols: list[str], df: DataFrame) -> DividedModel:
        zero = [0.0] * len(cols)
        return DividedModel(cols, zero, [plan[f"maxabs:{c}"] for c in cols], zero)


@dataclass
class RobustScaler(Estimator):
    """(x - median) / (quantile high - quantile low), by exact interpolated quantiles; no spread gives 0."""

    with_centering: bool = True
    with_scaling: bool = True
    low: float = 0.25
    high: float = 0.75

    def validate(self) -> None:
        if not 0 < self.low < self.high < 1:
            raise InvalidConfig("0 < low < high < 1 is needed")

    def ask(self, plan: FitPlan, cols: list[str]) -> None:
        plan.guard(*cols)
        for c in cols:
            plan.ask_quantiles(c, [self.low, 0.5, self.high])

    def build(self, plan: FitPlan, cols: list[str], df: DataFrame) -> DividedModel:
        centre = [plan.quantile(c, 0.5) if self.with_centering else 0.0 for c in cols]
        scale = [plan.quantile(c, self.high) - plan.quantile(c, self.low) if self.with_scaling else 1.0 for c in cols]
        return DividedModel(cols, centre, scale, centre)


@dataclass
class BinarizerModel(Model):
    threshold: float = 0.0

    def outputs(self) -> list[Column]:
        return [F.when(finite(c) > self.threshold, 1.0).otherwise(0.0) for c in self.cols]


@dataclass
class Binarizer(Estimator):
    """1 above the threshold, else 0."""

    threshold: float = 0.0

    def validate(self) -> None:
        if not math.isfinite(self.threshold):
            raise InvalidConfig("threshold must be finite")

    def _fit(self, df: DataFrame, cols: list[str], target: str | None) -> BinarizerModel:
        return BinarizerModel(cols, self.threshold)


@dataclass
class NormalizerModel(Model):
    norm: str = "l2"

    def outputs(self) -> list[Column]:
        x = [finite(c) for c in self.cols]
        if self.norm == "l1":
            size = sum((F.abs(v) for v in x[1:]), F.abs(x[0]))
        elif self.norm == "max":
            size = F.greatest(*(F.abs(v) for v in x)) if len(x) > 1 else F.abs(x[0])
        else:
            size = F.sqrt(sum((v * v for v in x[1:]), x[0] * x[0]))
        return [F.when(size == 0, v).otherwise(v / F.nullif(size, F.lit(0.0))) for v in x]


@dataclass
class Normalizer(Estimator):
    """Each row divided by its l1, l2 or max norm; a row of zeros stays."""

    norm: str = "l2"

    def validate(self) -> None:
        if self.norm not in ("l1", "l2", "max"):
            raise InvalidConfig("norm must be l1, l2 or max")

    def _fit(self, df: DataFrame, cols: list[str], target: str | None) -> NormalizerModel:
        return NormalizerModel(cols, self.norm)


@dataclass
class KBinsModel(Model):
    """Bins by edges; with encode "onehot" a 0/1 column for each bin."""

    edges: list[list[float]] = per_column(finite=True)
    encode: str = "ordinal"

    def check(self) -> None:
        super().check()
        if any(not e or any(a > b for a, b in itertools.pairwise(e)) for e in self.edges):
            raise InvalidInput("edges must be sorted")

    def n_bins(self) -> list[int]:
        return [max(1, len(e) - 1) for e in self.edges]

    def names_out(self) -> list[str]:
        if self.encode == "ordinal":
            return list(self.cols)
        return [f"{c}_bin{b}" for c, n in zip(self.cols, self.n_bins(), strict=True) for b in range(n)]

    def _bins(self) -> list[Column]:
        out = []
        for c, edges in zip(self.cols, self.edges, strict=True):
            x, n = finite(c), len(edges) - 1
            if n < 1:
                out.append((x * 0.0).cast("int"))
                continue
            inner = edges[1:-1]
            # Edges at or under x, also of empty bins, as the upper bound in sorted edges counts them.
            if len(inner) <= 16:
                count = sum((F.when(x >= e, 1).otherwise(0) for e in inner), F.lit(0))
            else:
                count = F.aggregate(F.array(*map(F.lit, inner)), F.lit(0), lambda n, e: n + F.when(e <= x, 1).otherwise(0))
            out.append(F.when(x >= edges[-1], n - 1).when(x <= edges[0], 0).otherwise(count))
        return out

    def outputs(self) -> list[Column]:
        if self.encode == "ordinal":
            return [b.cast("double") for b in self._bins()]
        return [F.when(b == i, 1.0).otherwise(0.0) for b, n in zip(self._bins(), self.n_bins(), strict=True) for i in range(n)]


@dataclass
class KBinsDiscretizer(Estimator):
    """Bins of equal width, of equal counts, or around 1-D cluster centres."""

    n_bins: int = 5
    strategy: str = "quantile"
    encode: str = "ordinal"

    def validate(self) -> None:
        if self.n_bins < 2 or self.strategy not in ("uniform", "quantile", "kmeans") or self.encode not in ("ordinal", "onehot"):
            raise InvalidConfig("n_bins of 2 or more, strategy uniform, quantile or kmeans, and encode ordinal or onehot are needed")

    def ask(self, plan: FitPlan, cols: list[str]) -> None:
        plan.guard(*cols)
        for c in cols:
            plan.ask(f"min:{c}", F.min(_c(c)))
            plan.ask(f"max:{c}", F.max(_c(c)))
            if self.strategy != "uniform":
                k = self.n_bins if self.strategy == "quantile" else self.n_bins - 1
                plan.ask_quantiles(c, [i / k for i in range(k + 1)])

    def build(self, plan: FitPlan, cols: list[str], df: DataFrame) -> KBinsModel:
        edges = []
        for c in cols:
            low, high = plan[f"min:{c}"], plan[f"max:{c}"]
            if abs(high - low) < EPSILON:
                edges.append([low])
            elif self.strategy == "uniform":
                edges.append([low + (high - low) / self.n_bins * i for i in range(self.n_bins + 1)])
            elif self.strategy == "quantile":
                edges.append([plan.quantile(c, i / self.n_bins) for i in range(self.n_bins + 1)])
            else:
                edges.append(self._centres(plan, c, df, low, high))
        return KBinsModel(cols, edges, self.encode)

    def _centres(self, plan: FitPlan, c: str, df: DataFrame, low: float, high: float) -> list[float]:
        """Lloyd's algorithm from quantiles, at most 50 rounds; each is one aggregate of sums and counts by centre."""
        k = min(self.n_bins, plan["rows"])
        # Fewer rows than bins seed with their own quantiles.
        seeds = [plan.quantile(c, i / (self.n_bins - 1)) for i in range(self.n_bins)] if k == self.n_bins else list(df.agg(F.percentile(_c(c), F.array(*(F.lit(i / max(1, k - 1)) for i in range(k))))).first()[0])
        centres = [s for i, s in enumerate(sorted(seeds)) if i == 0]
        for s in sorted(seeds)[1:]:
            if abs(s - centres[-1]) >= EPSILON:
                centres.append(s)
        if len(centres) < 2:
            return [low]
        values = df.select(_c(c).alias("x")).persist()
        try:
            for _ in range(50):
                apart = F.transform(F.array(*map(F.lit, centres)), lambda m: F.abs(F.col("x") - m))
                near = F.array_position(apart, F.array_min(apart)) - 1
                means = {r["g"]: r["m"] for r in values.groupBy(near.alias("g")).agg(F.avg("x").alias("m")).collect()}
                after = [means.get(i, m) for i, m in enumerate(centres)]
                still = all(abs(a - b) <= 1e-12 for a, b in zip(after, centres, strict=True))
                centres = after
                if still:
                    break
        finally:
            values.unpersist()
        centres.sort()
        return [low, *((a + b) / 2 for a, b in itertools.pairwise(centres)), high]


@dataclass
class QuantileModel(Model):
    references: list[list[float]] = per_column(finite=True)
    distribution: str = "uniform"

    def outputs(self) -> list[Column]:
        out = []
        for c, refs in zip(self.cols, self.references, strict=True):
            x, n = finite(c), len(refs)
            if n == 1:
                p = x * 0.0 + 0.5
            else:
                # One pair of neighbouring references holds x: the last at or under it, and the next. It is looked for
                # in the last block that begins at or under x.
                steps = [F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), F.lit(i).alias("i")) for i, (a, b) in enumerate(itertools.pairwise(refs))]
                wide = max(1, math.isqrt(len(steps)))
                starts = F.array(*(F.lit(float(refs[i])) for i in range(0, len(steps), wide)))
                blocks = F.array(*(F.array(*steps[i : i + wide]) for i in range(0, len(steps), wide)))
                block = F.get(blocks, F.size(F.filter(starts, lambda a: a <= x)) - 1)
                within = F.get(F.filter(block, lambda s: (s["a"] <= x) & (x < s["b"])), F.lit(0))
                width = within["b"] - within["a"]
                share = F.when(width < EPSILON, 0.5).otherwise((x - within["a"]) / F.nullif(width, F.lit(0.0)))
                p = F.when(x <= refs[0], 0.0).when(x >= refs[-1], 1.0).otherwise(within["i"] / F.lit(float(n - 1)) + share / F.lit(float(n - 1)))
            p = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
            out.append(p if self.distribution == "uniform" else inverse_normal(F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))))
        return out


@dataclass
class QuantileTransformer(Estimator):
    """Values to their empirical percentiles, by up to n_quantiles exact references, or to normal scores of these."""

    n_quantiles: int = 1000
    distribution: str = "uniform"

    def validate(self) -> None:
        if self.n_quantiles < 1 or self.distribution not in ("uniform", "normal"):
            raise InvalidConfig("n_quantiles of 1 or more and distribution uniform or normal are needed")

    def _fit(self, df: DataFrame, cols: list[str], target: str | None) -> QuantileModel:
        plan = FitPlan()
        plan.guard(*cols)
        n = min(self.n_quantiles, plan.run(df)["rows"])
        qs = [i / max(1, n - 1) for i in range(n)]
        plan = FitPlan()
        for c in cols:
            plan.ask_quantiles(c, qs)
        plan.run(df)
        return QuantileModel(cols, [[plan.quantile(c, q) for q in qs] for c in cols], self.distribution)


@dataclass
class PowerModel(Model):
    lambdas: list[float] = per_column(finite=True)
    mean: list[float] = per_column(finite=True)
    std: list[float] = per_column(finite=True)
    method: str = "yeo-johnson"
    standardize: bool = True
    #: Whether Box-Cox takes 0 too, where lambda is positive: its limit there, -1 / lambda.
    zero: bool = False

    def _raw(self, c: str, lam: float) -> Column:
        x = finite(c)
        if self.method == "box-cox":
            return box_cox(F.when(x >= 0 if self.zero and lam >= 1e-8 else x > 0, x).otherwise(F.raise_error(F.lit(f"InvalidInput: column {c} must be positive")).cast("double")), lam)
        return yeo_johnson(x, lam)

    def outputs(self) -> list[Column]:
        raw = [self._raw(c, lam) for c, lam in zip(self.cols, self.lambdas, strict=True)]
        return [(r - m) / F.lit(s) for r, m, s in zip(raw, self.mean, self.std, strict=True)] if self.standardize else raw

    def inverse(self) -> list[Column]:
        back = box_cox_inverse if self.method == "box-cox" else yeo_johnson_inverse
        return [back(finite(c) * s + m if self.standardize else finite(c), lam) for c, lam, m, s in zip(self.cols, self.lambdas, self.mean, self.std, strict=True)]


@dataclass
class PowerTransformer(Estimator):
    """Box-Cox or Yeo-Johnson with the most likely lambda, then standardised.

    The search looks at a grid from -5 to 5, then at ever finer ones around the best, down to 1e-7; every pass evaluates
    the candidates of all columns in one scan. The Jacobian term of Yeo-Johnson counts ln(1 + |x|) for either sign.
    """

    method: str = "yeo-johnson"
    standardize: bool = True

    def validate(self) -> None:
        if self.method not in ("yeo-johnson", "box-cox"):
            raise InvalidConfig("method must be yeo-johnson or box-cox")

    def _fit(self, df: DataFrame, cols: list[str], target: str | None) -> PowerModel:
        plan = FitPlan()
        plan.guard(*cols)
        for c in cols:
            plan.ask(f"min:{c}", F.min(_c(c)))
            plan.ask(f"mean:{c}", F.avg(_c(c)))
            plan.ask(f"jacobian:{c}", F.sum(F.when(_c(c) > 0, F.ln(_c(c))) if self.method == "box-cox" else F.ln(F.abs(_c(c)) + 1.0)))
        plan.run(df)
        if self.method == "box-cox" and (low := [c for c in cols if plan[f"min:{c}"] <= 0]):
            raise InvalidInput(f"Box-Cox needs positive values; columns {low} have others")
        n, jacobian, middle = plan["rows"], [plan[f"jacobian:{c}"] for c in cols], [plan[f"mean:{c}"] for c in cols]

        def losses(candidates: list[list[float]]) -> list[list[float]]:
            """Minus the log-likelihood of each column's candidates."""
            variance = _power_variances(df, cols, candidates, self.method, middle)
            return [[n / 2 * (math.log(v) if v > 0 else -math.inf) - (lam - 1) * j for v, lam in zip(vs, lams, strict=True)] for vs, lams, j in zip(variance, candidates, jacobian, strict=True)]

        grids = [[i / 10 for i in range(-50, 51)] for _ in cols]
        for step in range(2, 9):
            lambdas = [grid[int(np.nanargmin(loss))] for grid, loss in zip(grids, losses(grids), strict=True)]
            grids = [[b + i / 10**step for i in range(-12, 13)] for b in lambdas]
        power = box_cox if self.method == "box-cox" else yeo_johnson
        row = df.agg(*(f(power(_c(c), lam)).alias(f"{k}{i}") for i, (c, lam) in enumerate(zip(cols, lambdas, strict=True)) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
        std = [row[f"s{i}"] for i in range(len(cols))]
        return PowerModel(cols, lambdas, [row[f"m{i}"] for i in range(len(cols))], [1.0 if s < 1e-12 else s for s in std], self.method, self.standardize)


def _power_variances(df: DataFrame, cols: list[str], candidates: list[list[float]], method: str, middle: list[float]) -> list[list[float]]:
    """Population variance of each column under each of its candidate powers: one scan of sums in numpy, one row a task and column.

    101 candidates a column would be a thousand aggregate expressions, more than generated code takes. Sums are of
    what exceeds the power of the column's mean, so that squares don't cancel.
    """
    import pandas as pd

    shift = [[float(_power(np.array([m]), lam, method)[0]) for lam in lams] for m, lams in zip(middle, candidates, strict=True)]

    def sums(batches):
        total = [np.zeros((2, len(lams))) for lams in candidates]
        rows = 0
        for batch in batches:
            rows += len(batch)
            for i, c in enumerate(cols):
                x = batch[c].to_numpy(dtype=float)
                for k, lam in enumerate(candidates[i]):
                    t = _power(x, lam, method) - shift[i][k]
                    total[i][0, k] += t.sum()
                    total[i][1, k] += t @ t
        if rows:
            yield pd.DataFrame([(i, float(rows), t[0].tolist(), t[1].tolist()) for i, t in enumerate(total)], columns=["c", "n", "s", "q"])

    parts = df.select(*(_c(c).alias(c) for c in cols)).mapInPandas(sums, "c int, n double, s array<double>, q array<double>")
    cells = parts.select("c", "n", F.posexplode(F.arrays_zip("s", "q")).alias("k", "x"))
    out = [[0.0] * len(k) for k in candidates]
    for r in cells.groupBy("c", "k").agg(F.sum("n").alias("n"), F.sum("x.s").alias("s"), F.sum("x.q").alias("q")).collect():
        out[r["c"]][r["k"]] = max(0.0, r["q"] / r["n"] - (r["s"] / r["n"]) ** 2)
    return out


def _power(x: np.ndarray, lam: float, method: str) -> np.ndarray:
    if method == "box-cox":
        return np.log(x) if abs(lam) < 1e-8 else (x**lam - 1) / lam
    out = np.empty_like(x)
    up = x >= 0
    out[up] = np.log1p(x[up]) if abs(lam) < 1e-8 else ((x[up] + 1) ** lam - 1) / lam
    out[~up] = -np.log1p(-x[~up]) if abs(lam - 2) < 1e-8 else -((1 - x[~up]) ** (2 - lam) - 1) / (2 - lam)
    return out


@dataclass
class PolynomialModel(Model):
    degree: int = 2
    interaction_only: bool = False
    bias: bool = True

    def _terms(self) -> list[tuple[str, ...]]:
        choose = itertools.combinations if self.interaction_only else itertools.combinations_with_replacement
        return [*([()] if self.bias else []), *(t for d in range(1, self.degree + 1) for t in choose(self.cols, d))]

    def names_out(self) -> list[str]:
        def name(term: tuple[str, ...]) -> str:
            powers = [(c, term.count(c)) for c in dict.fromkeys(term)]
            return " ".join(c if k == 1 else f"{c}^{k}" for c, k in powers) or "1"

        return [name(t) for t in self._terms()]

    def outputs(self) -> list[Column]:
        def product(term: tuple[str, ...]) -> Column:
            out = F.lit(1.0)
            for i, c in enumerate(term):
                out = finite(c) if i == 0 else out * finite(c)
            return out

        return [product(t) for t in self._terms()]


@dataclass
class PolynomialFeatures(Estimator):
    """All products of up to `degree` columns, by degree, then in column order."""

    degree: int = 2
    interaction_only: bool = False
    bias: bool = True

    def validate(self) -> None:
        if self.degree < 0 or self.degree == 0 and not self.bias:
            raise InvalidConfig("degree 0 has only the bias")

    def _fit(self, df: DataFrame, cols: list[str], target: str | None) -> PolynomialModel:
        return PolynomialModel(cols, self.degree, self.interaction_only, self.bias)


@dataclass
class FunctionModel(Model):
    """A callable over Columns, with an optional inverse; callables aren't stored and must be set again after loading."""

    function: Callable[[list[Column]], list[Column]] | None = field(default=None, metadata={"stored": False})
    inverse_function: Callable[[list[Column]], list[Column]] | None = field(default=None, metadata={"stored": False})
    out: list[str] | None = None

    def names_out(self) -> list[str]:
        return list(self.out or self.cols)

    def outputs(self) -> list[Column]:
        if self.function is None:
            raise InvalidConfig("the function isn't set")
        return self.function([finite(c) for c in self.cols])

    def inverse(self) -> list[Column]:
        if self.inverse_function is None:
            raise InvalidConfig("the inverse function isn't set")
        return self.inverse_function([finite(c) for c in self.names_out()])


@dataclass
class FunctionTransformer(Estimator):
    """Any function from the fitted Columns to new ones."""

    function: Callable[[list[Column]], list[Column]]
    inverse_function: Callable[[list[Column]], list[Column]] | None = None
    out: list[str] | None = None

    def _fit(self, df: DataFrame, cols: list[str], target: str | None) -> FunctionModel:
        return FunctionModel(cols, self.function, self.inverse_function, self.out)
