"""Regression and classification metrics over a DataFrame of truths and predictions."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EmptyInput, InvalidConfig, InvalidInput, UnknownLabel


def _c(name: str) -> Column:
    return F.col(f"`{name}`").cast("double")


def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: n, mse, rmse, mae, r2, max_error, explained_variance.

    Without spread in the truth r2 and explained_variance are 1 if nothing is left unexplained, else 0.
    """
    d = _c(y) - _c(p)
    got = df.agg(
        F.count(F.lit(1)).alias("n"), F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"), F.max(F.abs(d)).alias("max_error"),
        F.var_pop(_c(y)).alias("vy"), F.var_pop(d).alias("vd"),
    )

    def share(left: str) -> Column:
        return F.when(F.col("vy") == 0, F.when(F.col(left) == 0, 1.0).otherwise(0.0)).otherwise(1.0 - F.col(left) / F.nullif("vy", F.lit(0.0)))

    return got.select("n", "mse", F.sqrt("mse").alias("rmse"), "mae", share("mse").alias("r2"), "max_error", share("vd").alias("explained_variance"))


@dataclass
class LabelSpace:
    """Sorted distinct labels and their positions."""

    labels: list[float]

    @staticmethod
    def fit(df: DataFrame, *columns: str) -> LabelSpace:
        from .linear import labels

        return LabelSpace(sorted({v for c in columns for v in labels(df, c)}))

    def encode(self, c: Column) -> Column:
        return F.array_position(F.array(*map(F.lit, self.labels)), c.cast("double") + 0.0) - 1

    def decode(self, c: Column) -> Column:
        return F.get(F.array(*map(F.lit, self.labels)), c.cast("int"))


def confusion_matrix(df: DataFrame, y: str, p: str, labels: list[float] | None = None) -> DataFrame:
    """Counts (truth, predicted, n) for each pair of labels, 0 included; labels of either column, or those given."""
    cells = df.groupBy((_c(y) + 0.0).alias("truth"), (_c(p) + 0.0).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    if labels is None:
        labels = LabelSpace.fit(df, y, p).labels
    spark = df.sparkSession
    pairs = spark.createDataFrame([(float(a), float(b)) for a in labels for b in labels], "truth double, predicted double")
    return pairs.join(cells, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


@dataclass
class Classification:
    """All metrics that follow from a confusion matrix; it is collected once and has a cell for each pair of labels."""

    cells: dict[tuple[float, float], int]
    labels: list[float]

    @staticmethod
    def of(df: DataFrame, y: str, p: str) -> Classification:
        got = df.groupBy((_c(y) + 0.0).alias("t"), (_c(p) + 0.0).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        if not got:
            raise EmptyInput("no rows to score")
        cells = {(r["t"], r["p"]): r["n"] for r in got}
        found = sorted({x for pair in cells for x in pair if x is not None})
        if any(None in pair for pair in cells) or any(not math.isfinite(x) or x < 0 or x != int(x) for x in found):
            raise UnknownLabel("class labels are whole numbers of 0 or more")
        return Classification(cells, found)

    @cached_property
    def total(self) -> int:
        return sum(self.cells.values())

    def support(self, c: float) -> int:
        return sum(n for (t, _), n in self.cells.items() if t == c)

    def called(self, c: float) -> int:
        return sum(n for (_, p), n in self.cells.items() if p == c)

    def hits(self, c: float) -> int:
        return self.cells.get((c, c), 0)

    def accuracy(self) -> float:
        return sum(self.hits(c) for c in self.labels) / self.total

    def _ratio(self, a: float, b: float, what: str, zero: str) -> float:
        if b:
            return a / b
        if zero == "error":
            raise InvalidInput(f"{what} is undefined")
        return 0.0

    def of_class(self, c: float, zero: str = "zero") -> tuple[float, float, float]:
        """Precision, recall and F1 of a class; an undefined one is 0, or an error."""
        precision = self._ratio(self.hits(c), self.called(c), "precision", zero)
        recall = self._ratio(self.hits(c), self.support(c), "recall", zero)
        return precision, recall, self._ratio(2 * precision * recall, precision + recall, "f1", zero)

    def scores(self, average: str = "macro", positive: float = 1.0, zero: str = "zero") -> tuple[float, float, float]:
        """Precision, recall and F1 by average: binary (of the positive label), macro, weighted or micro."""
        if average == "binary":
            if len(self.labels) > 2:
                raise InvalidInput("a binary average of more than two labels")
            return self.of_class(positive, zero)
        if average == "micro":
            return (self.accuracy(),) * 3
        each = [self.of_class(c, zero) for c in self.labels]
        if average == "macro":
            weights = [1 / len(self.labels)] * len(self.labels)
        elif average == "weighted":
            weights = [self.support(c) / self.total for c in self.labels]
        else:
            raise InvalidConfig("average is binary, macro, weighted or micro")
        return tuple(sum(w * e[i] for w, e in zip(weights, each, strict=True)) for i in range(3))

    def report(self) -> list[tuple[float, float, float, float, int]]:
        """(label, precision, recall, f1, support) of each class."""
        return [(c, *self.of_class(c), self.support(c)) for c in self.labels]

    def cohen_kappa(self) -> float:
        chance = sum(self.support(c) * self.called(c) for c in self.labels) / self.total**2
        return 1.0 if 1 - chance < 1e-15 else (self.accuracy() - chance) / (1 - chance)

    def matthews(self) -> float:
        right = sum(self.hits(c) for c in self.labels)
        both = sum(self.support(c) * self.called(c) for c in self.labels)
        called = self.total**2 - sum(self.called(c) ** 2 for c in self.labels)
        true = self.total**2 - sum(self.support(c) ** 2 for c in self.labels)
        return (right * self.total - both) / math.sqrt(called * true) if called and true else 0.0


def classification_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """label, precision, recall, f1, support of each class."""
    rows = Classification.of(df, y, p).report()
    return df.sparkSession.createDataFrame(rows, "label double, precision double, recall double, f1 double, support bigint")


def _two_classes(df: DataFrame, y: str, positive: float) -> None:
    from .linear import labels

    found = labels(df, y)
    if len(found) != 2 or positive not in found:
        raise InvalidInput(f"two classes are needed, {positive} one of them; there are {found}")


def log_loss(df: DataFrame, y: str, p: str, eps: float = 1e-15, positive: float = 1.0) -> float:
    """Mean negative log-likelihood of the positive class's probabilities, kept eps away from 0 and 1."""
    if not 0 < eps < 0.5:
        raise InvalidConfig("eps lies between 0 and 0.5")
    _two_classes(df, y, positive)
    row = df.agg(F.min(_c(p)).alias("lo"), F.max(_c(p)).alias("hi")).first()
    if row["lo"] < 0 or row["hi"] > 1:
        raise InvalidInput("probabilities lie within 0 and 1")
    q = F.least(F.greatest(_c(p), F.lit(eps)), F.lit(1 - eps))
    return df.agg(F.avg(-F.ln(F.when(_c(y) == positive, q).otherwise(1.0 - q)))).first()[0]


def _by_score(df: DataFrame, y: str, s: str, positive: float) -> DataFrame:
    """Positives and negatives at each distinct score: equal scores meet before anything is ordered."""
    hit = (_c(y) == positive).cast("long")
    return df.groupBy(_c(s).alias("s")).agg(F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))


#: Distinct scores that a block of the cumulative sums holds, about.
SCORE_BLOCKS = 256


def _running(groups: DataFrame, descending: bool) -> DataFrame:
    """groups with below_pos and below_neg: sums over all scores before, in score order.

    Scores are dealt out in ranges by sampled quantiles; sums within a range add to those of the ranges before, so
    that no task orders all scores.
    """
    n = groups.count()
    if n <= 50_000:
        before = Window.orderBy(F.desc("s") if descending else F.asc("s")).rowsBetween(Window.unboundedPreceding, -1)
        return groups.select("*", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"below_{c}") for c in ("pos", "neg")))
    cuts = groups.approxQuantile("s", [i / SCORE_BLOCKS for i in range(1, SCORE_BLOCKS)], 0.001)
    cuts = sorted(set(cuts))
    block = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("s")))
    dealt = groups.withColumn("b", -block if descending else block)
    sums = dealt.groupBy("b").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    earlier = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # SCORE_BLOCKS rows
    sums = sums.select("b", F.coalesce(F.sum("bp").over(earlier), F.lit(0)).alias("bp"), F.coalesce(F.sum("bn").over(earlier), F.lit(0)).alias("bn"))
    within = Window.partitionBy("b").orderBy(F.desc("s") if descending else F.asc("s")).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(sums), "b")
    return out.select("s", "pos", "neg", (F.coalesce(F.sum("pos").over(within), F.lit(0)) + F.col("bp")).alias("below_pos"), (F.coalesce(F.sum("neg").over(within), F.lit(0)) + F.col("bn")).alias("below_neg"))


def roc_auc_score(df: DataFrame, y: str, s: str, positive: float = 1.0) -> float:
    """Area under the ROC curve as the chance that a positive outscores a negative, ties counting half."""
    _two_classes(df, y, positive)
    row = _running(_by_score(df, y, s, positive), False).agg(F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    return row["u"] / (row["p"] * row["n"])


def average_precision_score(df: DataFrame, y: str, s: str, positive: float = 1.0) -> float:
    """Sum of precision times the recall gained, from the highest score down, equal scores together."""
    _two_classes(df, y, positive)
    hits, called = F.col("below_pos") + F.col("pos"), F.col("below_pos") + F.col("pos") + F.col("below_neg") + F.col("neg")
    row = _running(_by_score(df, y, s, positive), True).agg(F.sum(F.col("pos") * hits / called).alias("a"), F.sum("pos").alias("p")).first()
    return row["a"] / row["p"]
