"""Pipelines and mixed-type column transformers."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame

from ..errors import InvalidConfig, NotFitted
from ..plans.fitplan import FitPlan
from .base import Estimator, Model
from .encoders import OneHotEncoder


@dataclass
class PipelineModel(Model):
    """Fitted steps in order; their projections collapse into one in the plan."""

    names: list[str] = field(default_factory=list)
    steps: list[Model] = field(default_factory=list)

    def names_out(self) -> list[str]:
        return self.steps[-1].names_out() if self.steps else list(self.cols)

    def transform(self, df: DataFrame) -> DataFrame:
        for s in self.steps:
            df = s.transform(df)
        return df

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        raise InvalidConfig("a pipeline has no inverse")

    def score(self, df: DataFrame, target: str) -> float:
        for s in self.steps[:-1]:
            df = s.transform(df)
        return self.steps[-1].score(df, target)

    predict = transform


@dataclass
class Pipeline(Estimator):
    """Named steps; each is fitted to what the steps before make of the data, and sees the target if it asks for one."""

    steps: list[tuple[str, Estimator]] = field(default_factory=list)

    def validate(self) -> None:
        names = [n for n, _ in self.steps]
        if not names or len(set(names)) != len(names):
            raise InvalidConfig("a pipeline needs steps of distinct names")
        for _, s in self.steps:
            s.validate()

    def push(self, name: str, step: Estimator) -> Pipeline:
        return Pipeline([*self.steps, (name, step)])

    def insert(self, at: int, name: str, step: Estimator) -> Pipeline:
        return Pipeline([*self.steps[:at], (name, step), *self.steps[at:]])

    def remove(self, name: str) -> Pipeline:
        self.get(name)
        return Pipeline([s for s in self.steps if s[0] != name])

    def replace(self, name: str, step: Estimator) -> Pipeline:
        self.get(name)
        return Pipeline([(n, step if n == name else s) for n, s in self.steps])

    def get(self, name: str) -> Estimator:
        for n, s in self.steps:
            if n == name:
                return s
        raise InvalidConfig(f"no step {name}")

    def with_estimator(self, estimator: Estimator, name: str = "estimator") -> Pipeline:
        """The supervised pipeline: these steps, then a model with predictions and a score."""
        return self.push(name, estimator)

    def _fit(self, df: DataFrame, cols: list[str], target: str | None) -> PipelineModel:
        now, models = cols, []
        for _, step in self.steps:
            model = step.fit(df, now, target if step.supervised else None)
            models.append(model)
            df, now = model.transform(df), model.names_out()
        return PipelineModel(cols, [n for n, _ in self.steps], models)


@dataclass
class ColumnTransformerModel(Model):
    """Fitted blocks side by side in one projection, in the order they were given, then what was passed through."""

    blocks: list[Model] = field(default_factory=list)
    passed: list[str] = field(default_factory=list)
    #: Keep other columns of the DataFrame (row ids, targets) before the outputs.
    keep: list[str] = field(default_factory=list)

    def names_out(self) -> list[str]:
        return [n for b in self.blocks for n in b.names_out()] + self.passed

    def outputs(self) -> list[Column]:
        from ..functions.exprs import finite

        return [c for b in self.blocks for c in b.outputs()] + [finite(c) for c in self.passed]

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.sql import functions as F

        self.need(df, [*self.cols, *self.keep])
        names = self.names_out()
        if len(set(names)) != len(names):  # the same column in several blocks
            seen: dict[str, int] = {}
            for i, n in enumerate(names):
                seen[n] = seen.get(n, 0) + 1
                names[i] = n if seen[n] == 1 else f"{n}__{seen[n]}"
        return df.select(*(F.col(f"`{k}`") for k in self.keep), *(c.alias(n) for c, n in zip(self.outputs(), names, strict=True)))


@dataclass
class ColumnTransformer(Estimator):
    """Different transformers for different columns.

    specs: (name, estimator, columns). Blocks that need plain aggregates share one pass over the data. remainder
    "passthrough" appends unused numeric columns as they are, then the one-hot cells of unused categorical ones;
    columns that only a supervised encoder uses count as unused.
    """

    specs: list[tuple[str, Estimator, list[str]]] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    remainder: str = "drop"
    keep: list[str] = field(default_factory=list)

    def validate(self) -> None:
        if self.remainder not in ("drop", "passthrough"):
            raise InvalidConfig("remainder is drop or passthrough")
        names = [n for n, _, _ in self.specs]
        if len(set(names)) != len(names):
            raise InvalidConfig("names of specs must be distinct")
        for group in ({"numeric"}, {"categorical"}):
            known = self.numeric if "numeric" in group else self.categorical
            used = [c for _, e, cols in self.specs if not e.supervised for c in cols if c in known]
            if len(set(used)) != len(used):
                raise InvalidConfig("a column belongs to one spec of its kind")
        for _, e, cols in self.specs:
            if not cols or len(set(cols)) != len(cols):
                raise InvalidConfig("a spec needs columns, each once")
            e.validate()

    def fit(self, df: DataFrame, cols: list[str] | None = None, target: str | None = None) -> ColumnTransformerModel:
        return super().fit(df, cols or [*self.numeric, *self.categorical], target)

    def _fit(self, df: DataFrame, cols: list[str], target: str | None) -> ColumnTransformerModel:
        if target is None and any(e.supervised for _, e, _ in self.specs):
            raise NotFitted("supervised specs need a target column")
        plan, shared = FitPlan(), []
        for i, (_, e, own) in enumerate(self.specs):
            if type(e)._fit is Estimator._fit:
                e.ask(plan, own)
                shared.append(i)
        if shared:
            plan.run(df)
        blocks = [e.build(plan, own, df) if i in shared else e.fit(df, own, target if e.supervised else None) for i, (_, e, own) in enumerate(self.specs)]
        passed: list[str] = []
        if self.remainder == "passthrough":
            used = {c for _, e, own in self.specs if not e.supervised for c in own}
            passed = [c for c in self.numeric if c not in used]
            if rest := [c for c in self.categorical if c not in used]:
                # One-hot cells follow the numeric columns; the model keeps them as a last block of their own.
                return _WithRest(cols, blocks, passed, self.keep, OneHotEncoder(handle_unknown="ignore").fit(df, rest))
        return ColumnTransformerModel(cols, blocks, passed, self.keep)


@dataclass
class _WithRest(ColumnTransformerModel):
    rest: Any = None

    def names_out(self) -> list[str]:
        return super().names_out() + self.rest.names_out()

    def outputs(self) -> list[Column]:
        return super().outputs() + self.rest.outputs()
