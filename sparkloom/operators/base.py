"""Estimators and models: fitting asks a FitPlan for aggregates, a model is a projection of fitted constants."""

from __future__ import annotations

import dataclasses
import json
import math
from dataclasses import dataclass
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidConfig, InvalidInput, NotFitted, ShapeMismatch
from ..plans.fitplan import FitPlan

MODELS: dict[str, type[Model]] = {}


def _plain(value: Any) -> Any:
    """A value as JSON can hold it: numbers that JSON has no sign for become strings."""
    if isinstance(value, float) and not math.isfinite(value):
        return {"float": repr(value)}
    if isinstance(value, dict):
        return {"map": [[_plain(k), _plain(v)] for k, v in value.items()]}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, Model):
        return {"model": json.loads(value.to_json())}
    return value


def _real(value: Any) -> Any:
    if isinstance(value, dict):
        if "float" in value:
            return float(value["float"])
        if "model" in value:
            return Model.from_json(json.dumps(value["model"]))
        return {_real(k): _real(v) for k, v in value["map"]}
    return [_real(v) for v in value] if isinstance(value, list) else value


@dataclass
class Model:
    """Fitted state. transform() replaces the fitted columns by outputs(); all other columns stay."""

    cols: list[str]
    #: Whether transform() fails on null and non-finite values.
    guards: ClassVar[bool] = True

    def __init_subclass__(cls, **kw: Any) -> None:
        super().__init_subclass__(**kw)
        MODELS[cls.__name__] = cls

    def __post_init__(self) -> None:
        self.check()

    def check(self) -> None:
        """Raise InvalidInput if the state is inconsistent."""
        for f in dataclasses.fields(self):
            v = getattr(self, f.name)
            if f.metadata.get("per_column") and len(v) != len(self.cols):
                raise InvalidInput(f"{type(self).__name__}: {f.name} has {len(v)} entries for {len(self.cols)} columns")
            if f.metadata.get("finite") and not all(math.isfinite(x) for x in _flat(v)):
                raise InvalidInput(f"{type(self).__name__}: {f.name} must be finite")

    def need(self, df: DataFrame, cols: list[str] | None = None) -> None:
        missing = [c for c in cols or self.cols if c not in df.columns]
        if missing:
            raise ShapeMismatch(f"{type(self).__name__} was fitted to columns that are missing: {missing}")

    def names_out(self) -> list[str]:
        return list(self.cols)

    def outputs(self) -> list[Column]:
        raise NotImplementedError

    def inverse(self) -> list[Column]:
        raise InvalidConfig(f"{type(self).__name__} has no inverse")

    def transform(self, df: DataFrame) -> DataFrame:
        self.need(df)
        return self._put(df, self.cols, self.outputs(), self.names_out())

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        columns = self.inverse()
        self.need(df, self.names_out())
        return self._put(df, self.names_out(), columns, self.cols)

    @staticmethod
    def _put(df: DataFrame, gone: list[str], columns: list[Column], names: list[str]) -> DataFrame:
        """df with new columns in the place of the first of those that go."""
        new = [c.alias(n) for c, n in zip(columns, names, strict=True)]
        at = min((df.columns.index(c) for c in gone), default=len(df.columns))
        rest = [F.col(f"`{c}`") for c in df.columns if c not in gone]
        before = sum(c not in gone for c in df.columns[:at])
        return df.select(*rest[:before], *new, *rest[before:])

    def to_json(self) -> str:
        fields = {f.name: _plain(getattr(self, f.name)) for f in dataclasses.fields(self) if f.metadata.get("stored", True)}
        return json.dumps({"model": type(self).__name__, "state": fields})

    @staticmethod
    def from_json(text: str) -> Model:
        try:
            held = json.loads(text)
            kind = MODELS[held["model"]]
            return kind(**{k: _real(v) for k, v in held["state"].items()})
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise InvalidInput(f"not a stored model: {e}") from e


def _flat(v: Any):
    if isinstance(v, (list, tuple)):
        for x in v:
            yield from _flat(x)
    elif isinstance(v, dict):
        for x in v.values():
            yield from _flat(x)
    elif isinstance(v, (int, float)):
        yield v


def per_column(finite: bool = False, default: Any = dataclasses.MISSING) -> Any:
    """A field with an entry for each fitted column."""
    meta = {"per_column": True, "finite": finite}
    return dataclasses.field(metadata=meta) if default is dataclasses.MISSING else dataclasses.field(metadata=meta, default_factory=default)


@dataclass
class Estimator:
    """Parameters of a fit. ask() puts what it needs to know on a plan; build() makes the model of the answers."""

    #: Whether fitting looks at a target column.
    supervised: ClassVar[bool] = False

    def validate(self) -> None:
        """Raise InvalidConfig if the parameters make no sense."""

    def ask(self, plan: FitPlan, cols: list[str]) -> None:
        raise NotImplementedError

    def build(self, plan: FitPlan, cols: list[str], df: DataFrame) -> Model:
        raise NotImplementedError

    def fit(self, df: DataFrame, cols: list[str], target: str | None = None) -> Model:
        cols = list(cols)
        self.validate()
        if not cols:
            raise InvalidConfig("no columns to fit to")
        for c in [*cols, *([target] if target else [])]:
            if c not in df.columns:
                raise ShapeMismatch(f"no column {c}")
        return self._fit(df, cols, target)

    def _fit(self, df: DataFrame, cols: list[str], target: str | None) -> Model:
        plan = FitPlan()
        self.ask(plan, cols)
        return self.build(plan.run(df), cols, df)

    def fit_transform(self, df: DataFrame, cols: list[str], target: str | None = None) -> DataFrame:
        return self.fit(df, cols, target).transform(df)

    def get_params(self) -> dict[str, Any]:
        return {f.name: getattr(self, f.name) for f in dataclasses.fields(self)}

    def set_params(self, **params: Any) -> Estimator:
        """A copy with other parameters, unfitted."""
        unknown = set(params) - set(self.get_params())
        if unknown:
            raise InvalidConfig(f"{type(self).__name__} has no parameters {sorted(unknown)}")
        new = dataclasses.replace(self, **params)
        new.validate()
        return new

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotFitted(f"{type(self).__name__}: fit() returns the model that transforms")
