"""One aggregate for all that several estimators need to know of a DataFrame."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EmptyInput, InvalidInput
from ..functions.exprs import is_bad
from .quantiles import exact_quantiles


class FitPlan:
    """Collects named aggregates and quantiles, runs them together, and answers by name.

    Equal requests are computed once. Aggregates share one scan and one partial aggregation; quantiles of all
    columns share theirs.
    """

    def __init__(self) -> None:
        self.aggregates: dict[str, Column] = {}
        self.quantiles: dict[str, set[float]] = {}
        self.guarded: set[str] = set()
        self.found: dict[str, Any] = {}

    def ask(self, key: str, aggregate: Column) -> str:
        self.aggregates.setdefault(key, aggregate)
        return key

    def ask_quantiles(self, column: str, qs: list[float]) -> None:
        self.quantiles.setdefault(column, set()).update(qs)

    def guard(self, *columns: str) -> None:
        """Fail if any value of these columns is null, NaN or infinite."""
        self.guarded.update(columns)

    def run(self, df: DataFrame) -> FitPlan:
        asks = {"rows": F.count(F.lit(1)), **self.aggregates}
        asks |= {f"bad:{c}": F.sum(is_bad(F.col(f"`{c}`").cast("double")).cast("long")) for c in sorted(self.guarded)}
        names = list(asks)
        row = df.agg(*(asks[k].alias(f"a{i}") for i, k in enumerate(names))).first()
        self.found = dict(zip(names, row, strict=True))
        if not self.found["rows"]:
            raise EmptyInput("no rows to fit to")
        for c in sorted(self.guarded):
            if self.found[f"bad:{c}"]:
                raise InvalidInput(f"column {c} has {self.found[f'bad:{c}']} null or non-finite values")
        if self.quantiles:
            asked = {c: sorted(qs) for c, qs in self.quantiles.items()}
            for c, values in exact_quantiles(df, asked, self.found["rows"]).items():
                self.found |= {f"q:{c}:{q!r}": v for q, v in zip(asked[c], values, strict=True)}
        return self

    def __getitem__(self, key: str) -> Any:
        return self.found[key]

    def quantile(self, column: str, q: float) -> float:
        return self.found[f"q:{column}:{q!r}"]
