"""Exact quantiles, interpolated linearly at q * (n - 1), at any size.

Small inputs use Spark's percentile(), whose buffer holds every distinct value. Larger ones find order statistics by
refinement: each pass counts values by bin within the intervals that still matter, with partial aggregation and
no shuffle of the rows; the next interval is the least to the largest value of the bin that holds the rank. Very
many ranks are read off a range-partitioned sort instead.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import num
from .folder import need_folder

#: Rows up to which percentile() is used; ranks of a column up to which intervals are refined; bins of a pass.
SMALL, MOST_RANKS, BINS = 20_000, 40, 1024


def interpolate(n: int, q: float, at: dict[int, float]) -> float:
    """The quantile from order statistics `at`, which has those of _ranks()."""
    pos = q * (n - 1)
    low, high = math.floor(pos), math.ceil(pos)
    if low == high:
        return at[low]
    part = pos - low
    return at[low] * (1.0 - part) + at[high] * part


def _ranks(n: int, qs: list[float]) -> set[int]:
    return {f(q * (n - 1)) for q in qs for f in (math.floor, math.ceil)}


def exact_quantiles(df: DataFrame, asked: dict[str, list[float]], rows: int) -> dict[str, list[float | None]]:
    """Quantiles by column, nulls and NaN left out; None for a column without values."""
    if rows <= SMALL:
        names = list(asked)
        row = df.agg(*(F.percentile(num(c), F.array(*map(F.lit, asked[c]))).alias(f"q{i}") for i, c in enumerate(names))).first()
        return {c: list(v) if v is not None else [None] * len(asked[c]) for c, v in zip(names, row, strict=True)}
    out: dict[str, list[float | None]] = {}
    few: dict[str, set[int]] = {}
    counts = df.agg(*(F.count(num(c)).alias(f"n{i}") for i, c in enumerate(asked))).first()
    sizes = dict(zip(asked, counts, strict=True))
    for c, qs in asked.items():
        if not sizes[c]:
            out[c] = [None] * len(qs)
        elif len(ranks := _ranks(sizes[c], qs)) <= MOST_RANKS:
            few[c] = ranks
        else:
            at = _by_sort(df, c, ranks)
            out[c] = [interpolate(sizes[c], q, at) for q in qs]
    for c, at in (order_statistics(df, few) if few else {}).items():
        out[c] = [interpolate(sizes[c], q, at) for q in asked[c]]
    return out


def order_statistics(df: DataFrame, ranks: dict[str, set[int]]) -> dict[str, dict[int, float]]:
    """Values at 0-based ranks of each column's sorted non-null values, by refinement of all columns together."""
    names = list(ranks)
    row = df.agg(*(f(num(c)).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max)))).first()
    # An interval: its least and largest value, how many values are below it, the ranks sought in it.
    todo = {c: [(row[f"lo{i}"], row[f"hi{i}"], 0, sorted(ranks[c]))] for i, c in enumerate(names)}
    found: dict[str, dict[int, float]] = {c: {} for c in names}
    for c in names:
        todo[c] = [i for i in todo[c] if not _settle(i, None, found[c])]
    while any(todo.values()):
        items = [F.struct(F.lit(k).alias("c"), _bin(num(c), todo[c]).alias("b"), num(c).alias("v")) for k, c in enumerate(names) if todo[c]]
        long = df.select(F.explode(F.array(*items)).alias("x")).select("x.*").where("b is not null")
        bins = long.groupBy("c", "b").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        by: dict[int, list] = {}
        for r in bins:
            by.setdefault(r["c"], []).append(r)
        for k, c in enumerate(names):
            after = []
            for j, (_, _, below, wanted) in enumerate(todo[c]):
                for r in sorted((r for r in by.get(k, []) if r["b"] // BINS == j), key=lambda r: r["b"]):
                    mine = [x for x in wanted if below <= x < below + r["n"]]
                    interval = (r["lo"], r["hi"], below, mine)
                    if mine and not _settle(interval, r["n"], found[c]):
                        after.append((r["lo"], r["hi"], below, [x for x in mine if x not in found[c]]))
                    below += r["n"]
            todo[c] = after
    return found


def _settle(interval: tuple, n: int | None, found: dict[int, float]) -> bool:
    """Note ranks whose value is known: those at the ends, or all if the interval has one value. Whether none is left."""
    low, high, below, wanted = interval
    for x in wanted:
        if low == high or x == below:
            found[x] = low
        elif n is not None and x == below + n - 1:
            found[x] = high
    return all(x in found for x in wanted)


def _bin(v: Column, intervals: list[tuple]) -> Column:
    """Interval number * BINS + bin of a value; null outside all. The bin never falls as the value rises."""
    out = F.lit(None).cast("int")
    for j, (low, high, _, _) in enumerate(intervals):
        width = high - low
        scaled = (v - F.lit(low)) * F.lit(BINS / width) if math.isfinite(BINS / width) and math.isfinite(width) else (v / 2 - F.lit(low / 2)) / F.lit(high / 2 - low / 2) * BINS
        out = F.when(v.between(F.lit(low), F.lit(high)), F.lit(j * BINS) + F.least(F.lit(BINS - 1), F.floor(scaled).cast("int"))).otherwise(out)
    return out


def _by_sort(df: DataFrame, column: str, ranks: set[int]) -> dict[int, float]:
    """Values at ranks from a range-partitioned sort; tasks return those that fall to them."""
    import pandas as pd

    spark = df.sparkSession
    need_folder(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.select(num(column).alias("v")).where("v is not null").repartitionByRange(n, "v").sortWithinPartitions("v").checkpoint()
    sizes = {r["p"]: r["n"] for r in ordered.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    begin, at = {}, 0
    for p in sorted(sizes):
        begin[p], at = at, at + sizes[p]
    wanted = sorted(ranks)

    def pick(batches):
        from pyspark import TaskContext

        position = begin.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            mine = [r for r in wanted if position <= r < position + len(batch)]
            yield pd.DataFrame({"r": pd.Series(mine, dtype="int64"), "v": batch["v"].to_numpy()[[r - position for r in mine]]})
            position += len(batch)

    return {r["r"]: r["v"] for r in ordered.mapInPandas(pick, "r bigint, v double").collect()}

