"""Deterministic splits and folds over row numbers (rid, from 0), and cross-validation."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidConfig, InvalidInput
from .stats import with_rid

_MASK = (1 << 64) - 1
#: Rows up to which a shuffle is the exact permutation, made on the driver.
MOST_SHUFFLED = 2_000_000


class Xorshift:
    """The xorshift64 generator with shifts 13, 7 and 17; equal seeds give equal sequences."""

    def __init__(self, seed: int) -> None:
        self.state = (seed & _MASK) or 0x9E3779B97F4A7C15

    def next(self) -> int:
        x = self.state
        x ^= (x << 13) & _MASK
        x ^= x >> 7
        x ^= (x << 17) & _MASK
        self.state = x
        return x

    def unit(self) -> float:
        return (self.next() >> 11) / (1 << 53)

    def below(self, n: int) -> int:
        return int(self.unit() * n) if n else 0

    def normal(self) -> float:
        radius = math.sqrt(-2.0 * math.log(max(self.unit(), 1e-300)))
        return radius * math.cos(2.0 * math.pi * self.unit())

    def permutation(self, n: int) -> list[int]:
        """0..n-1 shuffled, from the last place down."""
        out = list(range(n))
        for i in range(n - 1, 0, -1):
            j = self.below(i + 1)
            out[i], out[j] = out[j], out[i]
        return out


def _places(df: DataFrame, n: int, shuffle: bool, seed: int, rid: str) -> DataFrame:
    """df with __place: the row's place in the (shuffled) order."""
    if not shuffle:
        return df.withColumn("__place", F.col(rid).cast("bigint"))
    if n > MOST_SHUFFLED:
        raise InvalidInput(f"shuffles are exact up to {MOST_SHUFFLED} rows; use hash_split() beyond")
    order = df.sparkSession.createDataFrame(list(enumerate(Xorshift(seed).permutation(n))), "__place bigint, __rid bigint")
    return df.join(order, F.col(rid) == F.col("__rid")).drop("__rid")


def train_test_split(df: DataFrame, test_size: float = 0.25, shuffle: bool = True, seed: int = 0, rid: str = "rid") -> tuple[DataFrame, DataFrame]:
    """(train, test): the first ceil(n * test_size) rows of the order are the test, one of either at least."""
    if not 0 < test_size < 1:
        raise InvalidConfig("test_size lies between 0 and 1")
    n = df.count()
    if n < 2:
        raise InvalidInput("two rows are needed")
    n_test = min(n - 1, max(1, math.ceil(n * test_size)))
    placed = _places(df, n, shuffle, seed, rid)
    return placed.where(F.col("__place") >= n_test).drop("__place"), placed.where(F.col("__place") < n_test).drop("__place")


def hash_split(df: DataFrame, test_size: float = 0.25, seed: int = 0, rid: str = "rid") -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of rid, about test_size of the rows, for any number of rows."""
    unit = F.pmod(F.xxhash64(F.col(rid), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return df.where(unit >= test_size), df.where(unit < test_size)


@dataclass
class KFold:
    """Contiguous folds of the (shuffled) order; the first n % k are one row larger."""

    k: int = 5
    shuffle: bool = False
    seed: int = 0

    def assign(self, df: DataFrame, rid: str = "rid") -> DataFrame:
        """df with the number of the fold in which a row is tested."""
        n = df.count()
        if not 2 <= self.k <= n:
            raise InvalidConfig(f"{self.k} folds of {n} rows")
        size, more = divmod(n, self.k)
        place = F.col("__place")
        edge = more * (size + 1)
        fold = F.when(place < edge, F.floor(place / (size + 1))).otherwise(F.floor((place - edge) / max(1, size)) + more)
        return _places(df, n, self.shuffle, self.seed, rid).withColumn("fold", fold.cast("int")).drop("__place")


@dataclass
class StratifiedKFold:
    """Rows of each class, classes in order, dealt to the folds in turn; the turn goes on from class to class."""

    k: int = 5
    shuffle: bool = False
    seed: int = 0

    def assign(self, df: DataFrame, label: str, rid: str = "rid") -> DataFrame:
        counts = {r["y"]: r["n"] for r in df.groupBy(F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
        if None in counts:
            raise InvalidInput(f"some rows have no {label}")
        if self.k < 2 or min(counts.values(), default=0) < self.k:
            raise InvalidConfig(f"each class needs {self.k} rows")
        if not self.shuffle:  # rows numbered through all classes, so that no task has all of one
            return with_rid(df, [label, rid], "__place").withColumn("fold", F.pmod("__place", F.lit(self.k)).cast("int")).drop("__place")
        if sum(counts.values()) > MOST_SHUFFLED:
            raise InvalidInput(f"shuffles are exact up to {MOST_SHUFFLED} rows")
        rng, dealt, turn = Xorshift(self.seed), [], 0
        for y in sorted(counts):
            rows = [r[0] for r in df.where(F.col(label) == F.lit(y)).select(rid).orderBy(rid).collect()]
            order = list(range(len(rows)))
            for i in range(len(order) - 1, 0, -1):
                j = rng.below(i + 1)
                order[i], order[j] = order[j], order[i]
            for i in order:
                dealt.append((rows[i], turn % self.k))
                turn += 1
        folds = df.sparkSession.createDataFrame(dealt, "__rid bigint, fold int")
        return df.join(folds, F.col(rid) == F.col("__rid")).drop("__rid")


def cross_val_score(estimator, df: DataFrame, cols: list[str], target: str, folds: KFold | None = None, scorer: Callable | None = None, rid: str = "rid") -> list[float]:
    """Score of each fold by a model fitted to the others; the model's own score by default."""
    folds = folds or KFold()
    tagged = folds.assign(df, rid).persist()
    try:
        out = []
        for i in range(folds.k):
            model = estimator.fit(tagged.where(F.col("fold") != i), cols, target)
            test = tagged.where(F.col("fold") == i)
            out.append(scorer(model, test) if scorer else model.score(test, target))
        return out
    finally:
        tagged.unpersist()
