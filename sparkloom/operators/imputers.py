"""Imputers. NaN counts as missing like null; infinities are refused."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce
from typing import ClassVar

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from ..errors import AllMissing, InvalidConfig, InvalidInput
from ..functions.exprs import num, plus_zero
from ..plans.fitplan import FitPlan
from ..plans.folder import need_folder
from .base import Estimator, Model, per_column
from .blocks import matrix, sweep
from .distances import boxes, codes, leaves_of
from .stats import with_rid


def _infinite(c: str) -> Column:
    return F.sum((F.abs(num(c)) == float("inf")).cast("long"))


@dataclass
class FillModel(Model):
    guards: ClassVar[bool] = False
    fill: list[float] = per_column(finite=True)

    def outputs(self) -> list[Column]:
        return [F.coalesce(num(c), F.lit(f)) for c, f in zip(self.cols, self.fill, strict=True)]


@dataclass
class SimpleImputer(Estimator):
    """Missing values by the column's mean, median, most frequent value (ties to the smallest) or a constant."""

    strategy: str = "mean"
    fill_value: float = 0.0

    def validate(self) -> None:
        if self.strategy not in ("mean", "median", "most_frequent", "constant") or not math.isfinite(self.fill_value):
            raise InvalidConfig("strategy is mean, median, most_frequent or constant, with a finite fill_value")

    def ask(self, plan: FitPlan, cols: list[str]) -> None:
        for c in cols:
            plan.ask(f"inf:{c}", _infinite(c))
            if self.strategy == "mean":
                plan.ask(f"mean?:{c}", F.avg(num(c)))
            elif self.strategy == "median":
                plan.ask_quantiles(c, [0.5])

    def build(self, plan: FitPlan, cols: list[str], df: DataFrame) -> FillModel:
        if bad := [c for c in cols if plan[f"inf:{c}"]]:
            raise InvalidInput(f"columns {bad} have infinite values")
        if self.strategy == "constant":
            fill = [self.fill_value] * len(cols)
        elif self.strategy == "mean":
            fill = [plan[f"mean?:{c}"] for c in cols]
        elif self.strategy == "median":
            fill = [plan.quantile(c, 0.5) for c in cols]
        else:
            fill = [_mode(df, c) for c in cols]
        if empty := [c for c, f in zip(cols, fill, strict=True) if f is None]:
            raise AllMissing(f"columns {empty} have no values")
        return FillModel(cols, fill)


def _mode(df: DataFrame, c: str) -> float | None:
    """The most frequent value, the smallest of several: counts by value, then a top-1, so that no buffer holds all values."""
    row = df.select(num(c).alias("v")).where("v is not null").groupBy("v").count().orderBy(F.desc("count"), "v").first()
    return None if row is None else row["v"]


def _by_all_pairs(asked: DataFrame, ref: DataFrame, p: int, k: int, weights: str) -> DataFrame:
    """_nearest_fills() by comparing all asked rows with all of the reference, block by block."""

    def start(columns):
        x = matrix(columns, [f"__x{i}" for i in range(p)])
        none = np.zeros(0)
        # Of the nearest so far: their row in the block, distance and values; by row, distance, place in the reference.
        return {"columns": columns, "x": x, "row": none.astype(int), "d": none, "r": np.zeros((p, 0))}

    def meet(state, columns):
        x, r = state["x"], matrix(columns, [f"r{i}" for i in range(p)])
        shared, squares = np.zeros((x.shape[1], r.shape[1])), np.zeros((x.shape[1], r.shape[1]))
        for mine, other in zip(x, r, strict=True):
            both = ~np.isnan(mine)[:, None] & ~np.isnan(other)[None, :]
            shared += both
            squares += np.where(both, (mine[:, None] - other[None, :]) ** 2, 0.0)
        d = np.where(shared > 0, squares * (p / np.maximum(shared, 1)), np.nan)
        held = np.bincount(state["row"], minlength=len(d))
        worst = np.full(len(d), np.inf)
        full = np.flatnonzero(held == k)
        worst[full] = state["d"][np.cumsum(held)[full] - 1]
        kth = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(d), np.nan)
        # A later row has to be nearer than the worst of k; of this block the k nearest count, with all ties.
        some = (shared > 0) & ~(d > kth[:, None]) & ((held < k)[:, None] | (d < worst[:, None]))
        row, at = np.nonzero(some)
        row, dist = np.concatenate([state["row"], row]), np.concatenate([state["d"], d[some]])
        values = np.concatenate([state["r"], r[:, at]], axis=1)
        order = np.lexsort((dist, row))
        row = row[order]
        firsts = np.searchsorted(row, np.arange(len(d)))
        keep = np.arange(len(row)) - firsts[row] < k
        order = order[keep]
        state.update(row=row[keep], d=dist[order], r=values[:, order])

    def finish(state):
        row, n = state["row"], state["x"].shape[1]
        w = np.ones(len(row)) if weights == "uniform" else 1.0 / np.maximum(state["d"], 1e-12)
        fills = []
        for r in state["r"]:
            there = ~np.isnan(r)
            total = np.bincount(row[there], w[there], minlength=n)
            sums = np.bincount(row[there], (r * w)[there], minlength=n)
            fills.append(pa.array(sums / np.where(total > 0, total, 1.0), mask=~(total > 0)))
        kept = pa.array(np.flatnonzero(np.bincount(row, minlength=n)))
        columns = [*state["columns"].values(), pa.array(np.ones(n, dtype=bool)), *fills]
        yield pa.RecordBatch.from_arrays([c.take(kept) for c in columns], names)

    schema = StructType([*asked.schema, StructField("__found", BooleanType()), *(StructField(f"__f{i}", DoubleType()) for i in range(p))])
    names = schema.fieldNames()
    return sweep(asked, ref, "place", start, meet, finish, schema)


#: Jobs, pairs of leaves and reference rows of a task up to which the search goes by boxes; beyond, by all pairs.
MOST_JOBS, MOST_PAIRS, MOST_MET = 64, 1_000_000, 250_000


def _mask(columns: list[str]) -> Column:
    """The bits of the columns that have a value."""
    return reduce(lambda acc, c: acc.bitwiseOR(c), (F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(columns)), F.lit(0))


def _in_boxes(points: DataFrame, jobs: list[tuple[int, int]], p: int) -> tuple[DataFrame, dict] | None:
    """points (job, s0..., ...) with their leaf, and bounds and numbers of rows of the leaves by job; None if ranges leave doubles' reach."""
    ss = [f"s{i}" for i in range(p)]
    lows, halves, rows = {}, {}, {}
    for r in points.groupBy("job").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.min(s) for s in ss)).alias("low"), F.array(*(F.max(s) for s in ss)).alias("high")).collect():
        varied = [i for i in range(p) if jobs[r["job"]][1] >> i & 1 and r["high"][i] > r["low"][i]]
        low, high = np.array([r["low"][i] for i in varied]), np.array([r["high"][i] for i in varied])
        half = (high / 2 - low / 2) * (1 + 1e-9)
        if not np.isfinite([v for v in (*r["low"], *r["high"]) if v is not None]).all() or (len(half) and not (half.min() > 1e-200 and half.max() < 1e200)):
            return None
        lows[r["job"]], halves[r["job"]], rows[r["job"]] = (low, varied), half, r["n"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)

    def coded(batches):
        for batch in batches:
            code = np.zeros(len(batch), dtype=np.int64)
            for job in batch["job"].unique():
                low, varied = lows[job]
                if varied:
                    at = (batch["job"] == job).to_numpy()
                    code[at] = codes(batch.loc[at, [ss[i] for i in varied]].to_numpy(dtype=float), low, halves[job])
            yield batch.assign(code=code)

    points = points.mapInPandas(coded, f"{schema}, code bigint").checkpoint()
    firsts = {j: leaves_of(boxes(points.where(F.col("job") == j), n, lows[j][0], halves[j]))[1] if lows[j][1] else np.zeros(1, dtype=np.int64) for j, n in rows.items()}

    def placed(batches):
        for batch in batches:
            leaf = np.zeros(len(batch), dtype=np.int64)
            for job in batch["job"].unique():
                at = (batch["job"] == job).to_numpy()
                leaf[at] = np.searchsorted(firsts[job], batch["code"].to_numpy()[at], side="right") - 1
            yield batch.drop(columns="code").assign(leaf=leaf)

    points = points.mapInPandas(placed, f"{schema}, leaf bigint")
    bounds: dict = {j: [] for j in rows}
    for r in points.groupBy("job", "leaf").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.min(s) for s in ss)).alias("low"), F.array(*(F.max(s) for s in ss)).alias("high")).collect():
        bounds[r["job"]].append((r["leaf"], r["n"], np.array(r["low"], dtype=float), np.array(r["high"], dtype=float)))
    return points, bounds


def _near_leaves(asked: dict, held: dict, jobs: list[tuple[int, int]], k: int) -> list[tuple[int, int, int]] | None:
    """(job, leaf, asked leaf): the leaves of the reference that may hold one of the k nearest of a row asked; None if they are too many."""
    out: list = []
    for job, leaves in asked.items():
        dims = [i for i in range(len(leaves[0][2])) if jobs[job][1] >> i & 1]
        number, n = np.array([r[0] for r in held[job]]), np.array([r[1] for r in held[job]])
        low, high = np.array([r[2][dims] for r in held[job]]), np.array([r[3][dims] for r in held[job]])
        for leaf, _, a, b in leaves:
            a, b = a[dims], b[dims]
            least = (np.maximum(np.maximum(low - b, a - high), 0.0) ** 2).sum(axis=1)
            most = (np.maximum(b - low, high - a) ** 2).sum(axis=1)
            order = np.argsort(most)
            enough = int(np.searchsorted(np.cumsum(n[order]), k))
            reach = most[order[enough]] * (1 + 1e-9) if enough < len(order) else np.inf
            near = np.flatnonzero(least <= reach)
            if n[near].sum() > MOST_MET or len(out) + len(near) > MOST_PAIRS:
                return None
            out.extend((job, int(number[i]), leaf) for i in near)
    return out


def _nearest_fills(asked: DataFrame, ref: DataFrame, p: int, k: int, weights: str) -> DataFrame:
    """__x0..., __found, __f0... of each asked row that shares a column with a reference row: the means of its k nearest.

    A job is a set of columns that asked rows have, and those of them that reference rows have too; each job searches
    the different values of the latter. Of reference rows with equal values the first k can be among the nearest. Leaves
    of asked rows meet the leaves of the reference that reach as near as k of its rows must be.
    """
    xs, rs, ss = ([f"{c}{i}" for i in range(p)] for c in ("__x", "r", "s"))
    need_folder(asked.sparkSession)
    asked = asked.withColumn("mask", _mask(xs)).checkpoint()
    ref = with_rid(ref.withColumn("mask", _mask(rs)).where("mask > 0"), ["ref"], "place").drop("ref")
    have = sorted(r["mask"] for r in asked.select("mask").distinct().collect())
    there = sorted(r["mask"] for r in ref.select("mask").distinct().collect())
    jobs = sorted({(o, o & r) for o in have for r in there if o & r})

    def by_all_pairs() -> DataFrame:
        return _by_all_pairs(asked.drop("mask"), ref.drop("mask"), p, k, weights)

    if not 0 < len(jobs) <= MOST_JOBS:
        return by_all_pairs()

    def dealt(df: DataFrame, names: list[str], of: dict[int, list[int]]) -> DataFrame:
        """df once for each job that its mask takes part in, with the job's columns."""
        lists = F.create_map(*(x for m, found in of.items() for x in (F.lit(m), F.array(*map(F.lit, found)).cast("array<int>"))))
        df = df.select("*", F.explode(F.element_at(lists, F.col("mask"))).alias("job"))
        used = [[j for j, (_, s) in enumerate(jobs) if s >> i & 1] for i in range(p)]
        return df.withColumns({s: F.when(F.col("job").isin(u), F.col(c)) for s, c, u in zip(ss, names, used, strict=True)})

    queries = dealt(asked, xs, {o: [j for j, job in enumerate(jobs) if job[0] == o] for o in have})
    first = Window.partitionBy("job", *ss).orderBy("place")
    held = dealt(ref, rs, {r: [j for j, job in enumerate(jobs) if job[0] & r == job[1]] for r in there})
    held = held.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k).select("job", *ss, "place", *rs)
    left = _in_boxes(queries.select("job", *ss).distinct(), jobs, p)
    right = _in_boxes(held, jobs, p) if left else None
    pairs = _near_leaves(left[1], right[1], jobs, k) if right else None
    if pairs is None:
        return by_all_pairs()
    met = right[0].join(F.broadcast(asked.sparkSession.createDataFrame(pairs, "job int, leaf bigint, into bigint")), ["job", "leaf"]).drop("leaf")

    def nearest(mine: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return pd.DataFrame(columns=["job", *ss, "d", "place", *rs])
        other = other.sort_values("place")
        dims = [i for i in range(p) if jobs[mine["job"].iloc[0]][1] >> i & 1]
        x, y = mine[ss].to_numpy(dtype=float), other[ss].to_numpy(dtype=float)
        rows, at, ds = [], [], []
        step = max(1, 2_000_000 // max(1, len(y)))
        for a in range(0, len(x), step):
            d = np.zeros((len(x[a : a + step]), len(y)))
            for i in dims:
                d += (x[a : a + step, i][:, None] - y[:, i][None, :]) ** 2
            d *= p / len(dims)
            row, col = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1][:, None]) if len(y) > k else np.indices(d.shape).reshape(2, -1)
            dist = d[row, col]
            order = np.lexsort((dist, row))  # stable: of equal distances the first place first
            row, col, dist = row[order], col[order], dist[order]
            keep = np.arange(len(row)) - np.searchsorted(row, np.arange(len(d)))[row] < k
            rows.append(row[keep] + a)
            at.append(col[keep])
            ds.append(dist[keep])
        rows, at = np.concatenate(rows), np.concatenate(at)
        out = mine[["job", *ss]].iloc[rows].reset_index(drop=True)
        return pd.concat([out.assign(d=np.concatenate(ds)), other[["place", *rs]].iloc[at].reset_index(drop=True)], axis=1)

    doubles = lambda names: ", ".join(f"{n} double" for n in names)
    got = left[0].groupBy("job", "leaf").cogroup(met.groupBy("job", "into")).applyInPandas(nearest, f"job int, {doubles(ss)}, d double, place bigint, {doubles(rs)}")
    # Missing values pass pandas as NaN.
    got = got.select("job", *(F.nanvl(s, F.lit(None).cast("double")).alias(s) for s in ss), F.struct("d", "place", *(F.nanvl(r, F.lit(None).cast("double")).alias(r) for r in rs)).alias("near"))
    got = got.groupBy("job", *ss).agg(F.collect_list("near").alias("near"))  # k of each
    same = reduce(lambda acc, s: acc & F.col(f"q.{s}").eqNullSafe(F.col(f"g.{s}")), ss, F.col("q.job") == F.col("g.job"))
    merged = queries.alias("q").join(got.alias("g"), same).groupBy(*(F.col(f"q.{x}").alias(x) for x in xs)).agg(F.flatten(F.collect_list("g.near")).alias("near"))
    merged = merged.withColumn("near", F.slice(F.array_sort("near"), 1, k))

    def mean(r: str) -> Column:
        some = F.filter("near", lambda v: v[r].isNotNull())
        weigh = (lambda v: F.lit(1.0)) if weights == "uniform" else (lambda v: 1.0 / F.greatest(v["d"], F.lit(1e-12)))
        total = F.aggregate(some, F.lit(0.0), lambda acc, v: acc + weigh(v))
        return F.when(total > 0, F.aggregate(some, F.lit(0.0), lambda acc, v: acc + v[r] * weigh(v)) / total)

    return merged.select(*xs, F.lit(True).alias("__found"), *(mean(r).alias(f"__f{i}") for i, r in enumerate(rs)))


@dataclass
class KnnModel(Model):
    """Reference rows stay a DataFrame; what to_json() keeps is the parameters."""

    guards: ClassVar[bool] = False
    k: int = 5
    weights: str = "uniform"
    rid: str = "rid"
    reference: DataFrame | None = field(default=None, metadata={"stored": False})

    def transform(self, df: DataFrame) -> DataFrame:
        """The different values of rows that lack something are searched for among the reference's; their fills are joined to the rows."""
        self.need(df, [*self.cols, self.rid])
        p = len(self.cols)
        ref = self.reference.select(F.col(f"`{self.rid}`").alias("ref"), *(num(c).alias(f"r{i}") for i, c in enumerate(self.cols)))
        x = [num(c) for c in self.cols]
        lacking = x[0].isNull()
        for c in x[1:]:
            lacking = lacking | c.isNull()
        asked = df.where(lacking).select(*(plus_zero(c).alias(f"__x{i}") for i, c in enumerate(x))).distinct()
        found = _nearest_fills(asked, ref, p, self.k, self.weights)
        same = reduce(lambda acc, s: acc & s, (c.eqNullSafe(F.col(f"__x{i}")) for i, c in enumerate(x)))
        out = df.join(found, same, "left")
        unmatched = F.col("__found").isNull() & lacking
        wrong = F.raise_error(F.lit("AllMissing: a row shares no observed column with any reference row")).cast("double")
        columns = [F.when(unmatched, wrong).otherwise(F.coalesce(c, F.col(f"__f{i}"))) for i, c in enumerate(x)]
        return self._put(out, self.cols, columns, self.cols).drop("__found", *(f"__{v}{i}" for v in "xf" for i in range(p)))


@dataclass
class KnnImputer(Estimator):
    """Missing values by the mean of the k nearest reference rows that have one.

    Distance is squared Euclidean over the columns both rows have, scaled up by how many that are; a row of the
    reference is its own neighbour; of equal distances the smaller rid counts first; weights "distance" weigh by
    1 / squared distance. Neighbours that lack the value are left out, not replaced; without any it stays null.
    """

    k: int = 5
    weights: str = "uniform"
    rid: str = "rid"

    def validate(self) -> None:
        if self.k < 1 or self.weights not in ("uniform", "distance"):
            raise InvalidConfig("k of 1 or more and weights uniform or distance are needed")

    def _fit(self, df: DataFrame, cols: list[str], target: str | None) -> KnnModel:
        plan = FitPlan()
        for c in cols:
            plan.ask(f"inf:{c}", _infinite(c))
        plan.run(df)
        if bad := [c for c in cols if plan[f"inf:{c}"]]:
            raise InvalidInput(f"columns {bad} have infinite values")
        return KnnModel(cols, self.k, self.weights, self.rid, df)
