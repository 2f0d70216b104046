"""Sums of Euclidean distances from every point to each cluster, in time in proportion to the points.

Boxes of points far from each other act through Chebyshev interpolation of the distance, of as many nodes as leave an
error of the order of a double's rounding; near ones are summed pair by pair.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns and clusters up to which sums go by boxes.
MOST_DIMS, MOST_CLUSTERS = 2, 64
#: Points of a leaf at most; leaves at most about which, beyond that they grow (what they tell each other is broadcast).
LEAF, LEAVES = 1024, 8192
#: Halvings of the box of all points.
DEPTH = 60
#: Two boxes are far apart if the gap is so many times the largest half width of either.
APART = 4.0
#: Exponent of the interpolation's error.
DIGITS = 33.0


@dataclass
class Box:
    level: int
    code: int
    centre: np.ndarray
    half: np.ndarray
    children: list[int] = field(default_factory=list)

    @cached_property
    def nodes(self) -> np.ndarray:
        """Coordinates of its tensor grid, one row a node."""
        axes = [c + h * _nodes(n) for c, h, n in zip(self.centre, self.half, _orders(self.half), strict=True)]
        return np.stack([a.ravel() for a in np.meshgrid(*axes, indexing="ij")], axis=1)


def splits(half: np.ndarray) -> list[int]:
    """The dimension halved at each level: the widest."""
    half, out = half.copy(), []
    for _ in range(DEPTH):
        out.append(int(half.argmax()))
        half[out[-1]] /= 2
    return out


def codes(x: np.ndarray, low: np.ndarray, half: np.ndarray) -> np.ndarray:
    """The path of each row of x to its box of the last level, as an integer of DEPTH bits."""
    order = splits(half)
    bits = np.bincount(order, minlength=len(half))
    at = [np.minimum(np.floor((x[:, d] - low[d]) * (2.0 ** bits[d] / (2 * half[d]))), 2.0 ** bits[d] - 1).astype(np.int64) for d in range(len(half))]
    out = np.zeros(len(x), dtype=np.int64)
    for d in order:
        bits[d] -= 1
        out = (out << 1) | ((at[d] >> bits[d]) & 1)
    return out


def _orders(half: np.ndarray) -> list[int]:
    """Nodes by dimension: the narrower a box is for the gap, the fewer."""
    return [max(2, int(np.ceil(DIGITS / np.arcsinh(APART * half.max() / h)))) for h in half]


def _nodes(n: int) -> np.ndarray:
    return np.cos((2 * np.arange(n) + 1) * np.pi / (2 * n))


def basis(x: np.ndarray, centre: np.ndarray, half: np.ndarray) -> np.ndarray:
    """The box's Lagrange polynomials at each row of x: one column a node."""
    out = np.ones((len(x), 1))
    for d, n in enumerate(_orders(half)):
        scale = np.full(n, 2.0 / n)
        scale[0] = 1.0 / n
        one = (np.polynomial.chebyshev.chebvander((x[:, d] - centre[d]) / half[d], n - 1) * scale) @ np.polynomial.chebyshev.chebvander(_nodes(n), n - 1).T
        out = (out[:, :, None] * one[:, None, :]).reshape(len(x), -1)
    return out


def boxes(points: DataFrame, n: int, low: np.ndarray, half: np.ndarray) -> list[Box]:
    """The tree of boxes that hold points, its root first; leaves have LEAF points at most, if DEPTH halvings do."""
    most, counts, level, heavy = max(LEAF, n // LEAVES), {(0, 0): n}, 0, [0] if n > LEAF else []
    while heavy and level < DEPTH:
        to = min(DEPTH, level + (6 if level else 12))
        held = points
        if level:
            held = points.withColumn("at", F.shiftright("code", DEPTH - level)).join(F.broadcast(points.sparkSession.createDataFrame([(h,) for h in heavy], "at bigint")), "at")
        for r in held.groupBy(F.shiftright("code", DEPTH - to).alias("at")).count().collect():
            for k in range(level + 1, to + 1):
                key = (k, r["at"] >> (to - k))
                counts[key] = counts.get(key, 0) + r["count"]
        heavy = [c for (k, c), m in counts.items() if k == to and m > most]
        level = to
    order = splits(half)
    out = [Box(0, 0, low + half, half)]
    for box in out:  # grows meanwhile
        if counts[box.level, box.code] <= most or box.level == DEPTH:
            continue
        d = order[box.level]
        for bit in (0, 1):
            code = 2 * box.code + bit
            if (box.level + 1, code) in counts:
                less, centre = box.half.copy(), box.centre.copy()
                less[d] /= 2
                centre[d] += less[d] if bit else -less[d]
                box.children.append(len(out))
                out.append(Box(box.level + 1, code, centre, less))
    return out


def leaves_of(tree: list[Box]) -> tuple[list[int], np.ndarray]:
    """The leaves and their least codes of DEPTH bits, by these."""
    leaves = sorted((i for i, b in enumerate(tree) if not b.children), key=lambda i: tree[i].code << (DEPTH - tree[i].level))
    return leaves, np.array([tree[i].code << (DEPTH - tree[i].level) for i in leaves])


def _lists(tree: list[Box], leaf: int) -> tuple[list[int], list[int]]:
    """Leaves near a leaf, and the largest boxes far from it that hold all others."""
    near, far, open_ = [], [], [0]
    mine = tree[leaf]
    while open_:
        i = open_.pop()
        gap = np.maximum(np.abs(tree[i].centre - mine.centre) - tree[i].half - mine.half, 0.0)
        if float(gap @ gap) ** 0.5 >= APART * max(tree[i].half.max(), mine.half.max()):
            far.append(i)
        elif tree[i].children:
            open_.extend(tree[i].children)
        else:
            near.append(i)
    return near, far


def _between(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.subtract.outer(x[:, 0], y[:, 0])
    out *= out
    for d in range(1, x.shape[1]):
        more = np.subtract.outer(x[:, d], y[:, d])
        more *= more
        out += more
    return np.sqrt(out, out=out)


def _spread(own: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Weights in the column of each point's cluster."""
    out = np.zeros((len(own), k))
    out[np.arange(len(own)), own] = weights
    return out


def sums_by_boxes(points: DataFrame, n: int, p: int, k: int, low: np.ndarray, half: np.ndarray) -> DataFrame:
    """own, x0..., sums (an array by cluster) of each of the n points: rows of own (0 to k - 1), x0..., w and code.

    The rows have to be partitioned by ranges of code. Boxes tell each other k numbers a node; what a task gets are the
    points of a few leaves that follow each other, and of the leaves near these.
    """
    tree = boxes(points, n, low, half)
    leaves, firsts = leaves_of(tree)
    numbers = np.array(leaves)
    xs = [f"x{d}" for d in range(p)]
    spark = points.sparkSession

    def located(batch: pd.DataFrame) -> np.ndarray:
        return numbers[np.searchsorted(firsts, batch["code"].to_numpy(), side="right") - 1]

    shapes = {i: (tree[i].centre, tree[i].half) for i in leaves}

    def moments(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            leaf, x = located(batch), batch[xs].to_numpy(dtype=float)
            w = _spread(batch["own"].to_numpy(), batch["w"].to_numpy(dtype=float), k)
            for i in np.unique(leaf):
                at = leaf == i
                found[i] = found.get(i, 0.0) + basis(x[at], *shapes[i]).T @ w[at]
        if found:
            yield pd.DataFrame({"leaf": list(found), "m": [m.ravel().tolist() for m in found.values()]})

    told: list = [None] * len(tree)
    if len(tree) > 1:
        for r in points.mapInPandas(moments, "leaf bigint, m array<double>").toLocalIterator():
            m = np.array(r["m"]).reshape(-1, k)
            told[r["leaf"]] = m if told[r["leaf"]] is None else told[r["leaf"]] + m
        for i in range(len(tree) - 1, -1, -1):
            if tree[i].children:
                told[i] = sum(basis(tree[c].nodes, tree[i].centre, tree[i].half).T @ told[c] for c in tree[i].children)

    lists = {i: _lists(tree, i) for i in leaves}
    size = min(16, max(1, len(leaves) // 96))
    group = {i: j // size for j, i in enumerate(leaves)}
    sent = sorted({(s, group[i]) for i in leaves for s in lists[i][0]})
    shared = spark.sparkContext.broadcast((tree, told, lists, group))

    def placed(batches):
        for batch in batches:
            yield batch[["own", *xs, "w"]].assign(leaf=located(batch))

    def sums(part: pd.DataFrame) -> pd.DataFrame:
        tree, told, lists, group = shared.value
        g = int(part["group"].iloc[0])
        part = part.sort_values(["leaf", *xs, "own"])
        x, own, leaf = part[xs].to_numpy(dtype=float), part["own"].to_numpy(), part["leaf"].to_numpy()
        w = _spread(own, part["w"].to_numpy(dtype=float), k)
        ids, starts = np.unique(leaf, return_index=True)
        spans = {int(i): slice(a, b) for i, a, b in zip(ids, starts, [*starts[1:], len(leaf)], strict=True)}
        found = []
        for i, span in spans.items():
            if group[i] != g:
                continue
            near, far = lists[i]
            mine = x[span]
            total = np.zeros((len(mine), k))
            for s in near:
                for a in range(spans[s].start, spans[s].stop, 1024):
                    to = slice(a, min(a + 1024, spans[s].stop))
                    for b in range(0, len(mine), 256):
                        total[b : b + 256] += _between(mine[b : b + 256], x[to]) @ w[to]
            direct = len(mine) <= len(tree[i].nodes)
            at = mine if direct else tree[i].nodes
            value = np.zeros((len(at), k))
            for s in far:
                value += _between(at, tree[s].nodes) @ told[s]
            total += value if direct else basis(mine, tree[i].centre, tree[i].half) @ value
            found.append(pd.DataFrame(mine, columns=xs).assign(own=own[span], sums=list(total)))
        return pd.concat(found)[["own", *xs, "sums"]]

    columns = ", ".join(f"{x} double" for x in xs)
    rows = points.mapInPandas(placed, f"own int, {columns}, w double, leaf bigint")
    near = F.broadcast(spark.createDataFrame(sent, "leaf bigint, group bigint"))
    return rows.join(near, "leaf").groupBy("group").applyInPandas(sums, f"own int, {columns}, sums array<double>")
