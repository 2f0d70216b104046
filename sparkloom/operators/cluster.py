"""K-means and the silhouette."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidConfig, InvalidInput
from ..functions.exprs import finite, plus_zero
from ..plans.fitplan import FitPlan
from ..plans.folder import need_folder
from .base import Estimator, Model
from .blocks import matrix, sweep
from .distances import MOST_CLUSTERS, MOST_DIMS, codes, sums_by_boxes
from .splits import Xorshift


@dataclass
class KMeansModel(Model):
    centres: list[list[float]] = field(default_factory=list, metadata={"finite": True})
    inertia: float = 0.0
    n_iter: int = 0
    prediction: str = "cluster"
    #: Centres before the last update: training rows were assigned by these.
    assigned_by: list[list[float]] = field(default_factory=list)

    def check(self) -> None:
        super().check()
        if any(len(c) != len(self.cols) for c in self.centres):
            raise InvalidInput("KMeansModel: centres don't fit the columns")

    def _nearest(self, centres: list[list[float]]) -> Column:
        x = [finite(c) for c in self.cols]
        distances = [sum(((v - F.lit(m)) * (v - F.lit(m)) for v, m in zip(x[1:], centre[1:], strict=True)), (x[0] - F.lit(centre[0])) * (x[0] - F.lit(centre[0]))) for centre in centres]
        return F.array_min(F.array(*(F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(distances))))

    def transform(self, df: DataFrame) -> DataFrame:
        """df with the number of the nearest centre, the first of several."""
        self.need(df)
        return df.withColumn(self.prediction, self._nearest(self.centres)["i"])

    predict = transform

    def training_labels(self, df: DataFrame) -> DataFrame:
        """df with the labels that the fit ended with, which precede its last update of the centres."""
        return df.withColumn(self.prediction, self._nearest(self.assigned_by or self.centres)["i"])

    def one_hot(self, df: DataFrame) -> DataFrame:
        """df with a 0/1 column for each cluster instead of the fitted columns."""
        best = self._nearest(self.centres)["i"]
        return self._put(df, self.cols, [F.when(best == i, 1.0).otherwise(0.0) for i in range(len(self.centres))], [f"cluster{i}" for i in range(len(self.centres))])


@dataclass
class KMeans(Estimator):
    """Lloyd's algorithm from k-means++ or random rows; of n_init starts the one of the least inertia.

    A round of all starts is one pass: tasks assign their rows in numpy and return sums and counts by centre. It ends once the mean
    squared shift of the centres is tol or less; a centre without rows stays. Seeding draws by the rows' order of rid
    with a xorshift generator; a draw scans the distances of all rows and returns one row.
    """

    k: int = 8
    init: str = "k-means++"
    max_iter: int = 300
    tol: float = 1e-4
    n_init: int = 10
    seed: int = 0x9E3779B97F4A7C15
    rid: str = "rid"

    def validate(self) -> None:
        if self.k < 1 or self.init not in ("k-means++", "random") or self.max_iter < 1 or self.n_init < 1 or not self.tol >= 0:
            raise InvalidConfig("k, max_iter and n_init of 1 or more, init k-means++ or random, and a tol of 0 or more are needed")

    def _fit(self, df: DataFrame, cols: list[str], target: str | None) -> KMeansModel:
        plan = FitPlan()
        plan.guard(*cols)
        n = plan.run(df)["rows"]
        if n < self.k:
            raise InvalidInput(f"{self.k} clusters of {n} rows")
        rows = df.select(F.col(f"`{self.rid}`").cast("bigint").alias("rid"), *(F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(cols))).persist()
        try:
            rngs = [Xorshift(self.seed + start) for start in range(self.n_init)]
            runs = self.lloyds(rows, self._seeds(rows, n, len(cols), rngs))
            centres, inertia, rounds, before = min(runs, key=lambda run: run[1])  # the first of equals
            return KMeansModel(cols, centres.tolist(), inertia, rounds, assigned_by=before.tolist())
        finally:
            rows.unpersist()

    def fit_from(self, df: DataFrame, cols: list[str], centres: list[list[float]]) -> KMeansModel:
        """A single run from given centres."""
        rows = df.select(*(F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(cols)))
        [(found, inertia, rounds, before)] = self.lloyds(rows, [np.array(centres, dtype=float)])
        return KMeansModel(list(cols), found.tolist(), inertia, rounds, assigned_by=before.tolist())

    def _rows(self, rows: DataFrame, rids: list[int], p: int) -> list[np.ndarray]:
        found = {r["rid"]: np.array([r[f"x{i}"] for i in range(p)]) for r in rows.where(F.col("rid").isin(sorted({int(r) for r in rids}))).collect()}
        return [found[r] for r in rids]

    def _seeds(self, rows: DataFrame, n: int, p: int, rngs: list[Xorshift]) -> list[np.ndarray]:
        """First centres of each start; a draw of all starts takes two scans, and one of a block for each."""
        if self.init == "random":
            return list(np.array(self._rows(rows, [i for rng in rngs for i in rng.permutation(n)[: self.k]], p)).reshape(len(rngs), self.k, p))
        centres = [[c] for c in self._rows(rows, [rng.below(n) for rng in rngs], p)]
        while len(centres[0]) < self.k:
            fixed = [np.array(c) for c in centres]

            def distances(batch: pa.RecordBatch, fixed: list = fixed) -> tuple[np.ndarray, list[np.ndarray]]:
                rid, x = _batch(batch, ["rid"])[0].astype(np.int64), _batch(batch, [f"x{i}" for i in range(p)])
                return rid, [_squares(x, f).min(axis=0) for f in fixed]

            def blocks(batches):
                for batch in batches:
                    rid, d = distances(batch)
                    found, at = np.unique(rid // 4096, return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found), *(pa.array(np.bincount(at, v, len(found))) for v in d)], ["block", *(f"d{i}" for i in range(len(d)))])

            names = [f"d{i}" for i in range(len(rngs))]
            summed = rows.mapInArrow(blocks, f"block bigint, {', '.join(f'{d} double' for d in names)}").groupBy("block").agg(*(F.sum(d).alias(d) for d in names)).toPandas().sort_values("block")
            chosen, inside = [], {}
            for i, rng in enumerate(rngs):
                sums = summed[names[i]].to_numpy()
                reach = np.cumsum(sums)
                if not len(sums) or reach[-1] <= 0:
                    chosen.append(min(len(centres[i]), n - 1))
                    continue
                left = rng.unit() * reach[-1]
                at = int(np.searchsorted(reach, left))
                chosen.append(n - 1)
                if at < len(sums):
                    inside[i] = (int(summed["block"].iloc[at]), left - (reach[at - 1] if at else 0.0))
            if inside:
                held = {b: [] for b, _ in inside.values()}
                for r in rows.where(F.floor(F.col("rid") / 4096).isin(sorted(held))).collect():  # 4096 rows a start at most
                    held[r["rid"] // 4096].append((r["rid"], *(r[f"x{j}"] for j in range(p))))
                for i, (b, left) in inside.items():
                    block = np.array(sorted(held[b]))
                    at = int(np.searchsorted(np.cumsum(_squares(block[:, 1:].T, fixed[i]).min(axis=0)), left))
                    if at < len(block):
                        chosen[i] = int(block[at, 0])
            for c, x in zip(centres, self._rows(rows, chosen, p), strict=True):
                c.append(x)
        return [np.array(c) for c in centres]

    def lloyds(self, rows: DataFrame, starts: list[np.ndarray]) -> list[tuple[np.ndarray, float, int, np.ndarray]]:
        """Centres, inertia, rounds and the centres of the last assignment, of each start; a round of all is one pass."""
        centres, before = list(starts), list(starts)
        rounds, shift = [0] * len(starts), [math.inf] * len(starts)
        while moving := [i for i in range(len(starts)) if rounds[i] < self.max_iter and shift[i] > self.tol]:
            for i, (counts, sums) in zip(moving, _assigned(rows, [centres[i] for i in moving]), strict=True):
                before[i] = centres[i]
                centres[i] = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], before[i])
                shift[i] = float(((centres[i] - before[i]) ** 2).sum()) / len(centres[i])
                rounds[i] += 1
        return list(zip(centres, _inertia(rows, before, centres), rounds, before, strict=True))


def _batch(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return matrix({c: batch.column(batch.schema.get_field_index(c)) for c in names}, names)


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, one row a centre, of the columns of x."""
    return np.array([sum((v - m) ** 2 for v, m in zip(x, centre, strict=True)) for centre in centres])


def _assigned(rows: DataFrame, starts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counts and sums of the rows nearest to each centre, for each start."""
    k, p = starts[0].shape

    def run(batches):
        total = np.zeros((len(starts), k, p + 1))
        for batch in batches:
            x = _batch(batch, [f"x{i}" for i in range(p)])
            for i, centres in enumerate(starts):
                near = _squares(x, centres).argmin(axis=0)
                total[i, :, 0] += np.bincount(near, minlength=k)
                for j in range(p):
                    total[i, :, j + 1] += np.bincount(near, x[j], k)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], ["s"])

    total = np.zeros(len(starts) * k * (p + 1))
    parts = rows.mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    for r in parts.collect():
        total[r["i"]] = r["v"]
    return [(t[:, 0], t[:, 1:]) for t in total.reshape(len(starts), k, p + 1)]


def _inertia(rows: DataFrame, assigned_by: list[np.ndarray], centres: list[np.ndarray]) -> list[float]:
    """Squared distances of rows to the centres they were assigned to, for each start."""
    p = centres[0].shape[1]

    def run(batches):
        total = [0.0] * len(centres)
        for batch in batches:
            x = _batch(batch, [f"x{i}" for i in range(p)])
            for i, (before, now) in enumerate(zip(assigned_by, centres, strict=True)):
                total[i] += float(((x - now[_squares(x, before).argmin(axis=0)].T) ** 2).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["t"])

    return list(rows.mapInArrow(run, "t array<double>").agg(*(F.sum(F.col("t")[i]) for i in range(len(centres)))).first())


def silhouette_samples(df: DataFrame, cols: list[str], label: str, rid: str = "rid") -> DataFrame:
    """(rid, silhouette) of each row by Euclidean distance; a cluster of one row scores 0.

    Equal rows count once, with their number. With two columns that vary and 64 clusters at most, time is in proportion
    to the different rows, by sums over boxes (distances.py). Beyond that each is compared with every other, in blocks: a block
    keeps its sum of distances to each cluster while all stream past. That time is quadratic in the different rows;
    memory is not, but holds a number a cluster and row of a block.
    """
    p = len(cols)
    kept = df.select(F.col(f"`{rid}`").cast("bigint").alias("rid"), F.col(f"`{label}`").cast("string").alias("label"), *(plus_zero(finite(c)).alias(f"x{i}") for i, c in enumerate(cols)))
    counts, low, high = {}, np.full(p, np.inf), np.full(p, -np.inf)
    for r in kept.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.min(f"x{i}") for i in range(p))).alias("low"), F.array(*(F.max(f"x{i}") for i in range(p))).alias("high")).collect():
        counts[r["label"]], low, high = r["n"], np.minimum(low, r["low"]), np.maximum(high, r["high"])
    if None in counts:
        raise InvalidInput("a row has no cluster")
    if not 2 <= len(counts) < sum(counts.values()):
        raise InvalidInput("two clusters and fewer than rows are needed")
    names = sorted(counts)
    sizes = np.array([counts[n] for n in names])
    number = {n: i for i, n in enumerate(names)}
    xs = [f"x{i}" for i in range(p)]
    schema = f"label string, {', '.join(f'{x} double' for x in xs)}, silhouette double"
    points = kept.groupBy("label", *xs).agg(F.count(F.lit(1)).cast("double").alias("w"))
    half = (high / 2 - low / 2) * (1 + 1e-9)
    varied = np.flatnonzero(half > 0)
    wide = half[varied].min(initial=np.inf) > 1e-200  # else codes would leave the range of doubles

    def scores(own, sums):
        rows = np.arange(len(own))
        a = sums[rows, own] / np.maximum(sizes[own] - 1, 1)
        means = sums / sizes
        means[rows, own] = np.inf
        b = means.min(axis=1)
        top = np.maximum(a, b)
        return np.where((sizes[own] > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1.0), 0.0)

    if 1 <= len(varied) <= MOST_DIMS and wide and len(names) <= MOST_CLUSTERS:
        some = [f"x{i}" for i in varied]

        def coded(batches):
            for batch in batches:
                yield pd.DataFrame({"own": batch["label"].map(number).astype("int32"), **{f"x{j}": batch[x] for j, x in enumerate(some)}, "w": batch["w"], "code": codes(batch[some].to_numpy(dtype=float), low[varied], half[varied])})

        def scored(batches):
            for batch in batches:
                own = batch["own"].to_numpy()
                found = scores(own, np.stack(batch["sums"].to_numpy()))
                place = {x: batch[f"x{some.index(x)}"] if x in some else low[i] for i, x in enumerate(xs)}
                yield pd.DataFrame({"label": [names[o] for o in own], **place, "silhouette": found})

        need_folder(df.sparkSession)
        held = ", ".join(f"x{j} double" for j in range(len(some)))
        points = points.mapInPandas(coded, f"own int, {held}, w double, code bigint").repartitionByRange("code").checkpoint()
        found = sums_by_boxes(points, points.count(), len(some), len(names), low[varied], half[varied]).mapInPandas(scored, schema)
    else:

        def block(columns):
            return matrix(columns, xs), np.array([number[n] for n in columns["label"].to_pylist()], dtype=int)

        def start(columns):
            x, own = block(columns)
            return columns, x, own, np.zeros((len(own), len(names)))

        def meet(state, columns):
            _, x, _, sums = state
            y, own = block(columns)
            order = np.argsort(own, kind="stable")
            present, firsts = np.unique(own[order], return_index=True)
            squares = np.zeros((x.shape[1], y.shape[1]))
            for mine, other in zip(x, y[:, order], strict=True):
                squares += (mine[:, None] - other[None, :]) ** 2
            sums[:, present] += np.add.reduceat(np.sqrt(squares) * matrix(columns, ["w"])[0, order], firsts, axis=1)

        def finish(state):
            columns, _, own, sums = state
            yield pa.RecordBatch.from_arrays([*(columns[c] for c in ("label", *xs)), pa.array(scores(own, sums))], ["label", *xs, "silhouette"])

        found = sweep(points.drop("w"), points, "label", start, meet, finish, schema)
    return kept.join(found, ["label", *xs]).select("rid", "silhouette")


def silhouette_score(df: DataFrame, cols: list[str], label: str, rid: str = "rid") -> float:
    return silhouette_samples(df, cols, label, rid).agg(F.avg("silhouette")).first()[0]
