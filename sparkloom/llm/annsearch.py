"""Approximate nearest neighbours by inner product (operator 4): a hierarchical k-means tree, best bin first.

The tree is fitted to a bounded sample and broadcast; every vector is filed under a leaf. A query walks the tree with a
priority queue of branches, by a bound of what they can hold: the product with the centre, and a part of the branch's
reach. It visits leaves from the best bound down to what the sample already offers it, so that a query among close
clusters sees few leaves and one between them many. The part of the reach is calibrated: it widens the visits until
queries whose true neighbours are known find enough of them; the whole reach would make the search exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import parts_for, stage

#: Neighbours, and every how manieth vec_id is a query of op4.
NEAREST, QUERY_EVERY = 20, 20
#: Vectors that the tree is fitted to, at most; vectors for each leaf, about; branches of a node; leaves at most.
SAMPLE, LEAF, BRANCHES, MOST_LEAVES = 20_000, 200, 8, 4096
#: Queries for calibration, recall they must reach (with a margin over what is promised), recall promised.
TRIALS, AIM, PROMISED = 200, 0.95, 0.9
#: Vectors that one task compares with queries: neighbouring leaves together, or a part of a large one; queries of a block that go to one task.
BLOCK, ASKING = 4000, 50_000
SEED = 7


@dataclass
class Tree:
    """Nodes in an array: children of each (empty for a leaf), their centres, the number of a leaf, how far each goes.

    reach: a leaf's own is the distance of its farthest row times the calibrated part; an inner node's covers its
    children's, so that no child's bound is above its parent's.
    """

    children: list[list[int]]
    centres: np.ndarray
    leaf: np.ndarray
    reach: np.ndarray = field(default_factory=lambda: np.empty(0))

    @property
    def n_leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def ends(self) -> np.ndarray:
        """The node of each leaf."""
        out = np.empty(self.n_leaves, dtype=np.int64)
        out[self.leaf[self.leaf >= 0]] = np.flatnonzero(self.leaf >= 0)
        return out

    def file(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: at every node the nearest centre's branch."""
        out = np.zeros(len(vectors), dtype=np.int32)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            kids = np.array(self.children[node])
            near = np.argmin(_distances(vectors[rows], self.centres[kids]), axis=1)
            todo += [(int(kids[j]), rows[near == j]) for j in range(len(kids)) if (near == j).any()]
        return out

    def widen(self, farthest: np.ndarray, part: float) -> None:
        """Set reach by the farthest row of each leaf and the part of it that counts."""
        self.reach = np.zeros(len(self.children))
        for node in reversed(range(len(self.children))):  # children come after their parent
            kids = self.children[node]
            if kids:
                self.reach[node] = (np.linalg.norm(self.centres[kids] - self.centres[node], axis=1) + self.reach[kids]).max()
            else:
                self.reach[node] = part * farthest[self.leaf[node]]

    def visits(self, query: np.ndarray, enough: float, sizes: np.ndarray, least: int) -> list[int]:
        """Leaves for a query, best bound first: all whose bound reaches `enough`, and further ones until their sizes sum to `least`."""
        size = float(np.linalg.norm(query))
        queue, found, held = [(-np.inf, 0)], [], 0
        while queue and (-queue[0][0] >= enough or held < least):
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not kids:
                found.append(int(self.leaf[node]))
                held += int(sizes[found[-1]])
                continue
            for bound, kid in zip((self.centres[kids] @ query + size * self.reach[kids]).tolist(), kids, strict=True):
                heapq.heappush(queue, (-bound, kid))
        return found


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, but for a part that is the same for all centres."""
    return (centres * centres).sum(axis=1)[None, :] - 2 * (x @ centres.T)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.argmin(_distances(x, centres), axis=1)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def fit_tree(sample: np.ndarray, leaves: int, seed: int = SEED) -> Tree:
    """Split the sample by k-means again and again, until each part has its share of the leaves."""
    rng = np.random.default_rng(seed)
    children: list[list[int]] = [[]]
    centres = [sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])]
    target = max(2, len(sample) // max(1, leaves))
    todo = [(0, sample)]
    while todo:
        node, x = todo.pop()
        k = min(BRANCHES, len(x) // target)
        if k < 2:
            continue
        split = _kmeans(x, k, rng)
        near = np.argmin(_distances(x, split), axis=1)
        parts = [j for j in range(k) if (near == j).any()]
        if len(parts) < 2:  # copies of one vector
            continue
        for j in parts:
            children[node].append(len(children))
            todo.append((len(children), x[near == j]))
            children.append([])
            centres.append(split[j])
    leaf = np.full(len(children), -1, dtype=np.int32)
    ends = [i for i, kids in enumerate(children) if not kids]
    leaf[ends] = np.arange(len(ends))
    return Tree(children, np.array(centres), leaf)


def _rows(column) -> np.ndarray:
    """An Arrow column of equally long lists, or a Series of them, as a matrix."""
    if isinstance(column, pa.ListArray):
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))
    lists = column.to_numpy()
    return np.stack(lists).astype(np.float64) if len(lists) else np.empty((0, 0))


def nearest(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best vectors for each query, its own id left out; asked: which vectors count for which query.

    Ties go to the smaller id. A fast product finds all that can be among the best; those few are summed from the first
    component to the last, so that equal vectors score equally.
    """
    out = []
    longest = float(np.sqrt((vectors * vectors).sum(axis=1).max())) if len(vectors) else 0.0
    for i in range(0, len(query_ids), 256):
        q, some = queries[i : i + 256], query_ids[i : i + 256]
        scores = q @ vectors.T
        if asked is not None:
            scores[~asked[i : i + 256]] = -np.inf
        scores[some[:, None] == ids[None, :]] = -np.inf
        least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(q), -np.inf)
        slack = 1e-11 * longest * np.sqrt((q * q).sum(axis=1))
        row, at = np.nonzero((scores >= (least - slack)[:, None]) & (scores > -np.inf))
        exact = np.zeros(len(row))
        for d in range(q.shape[1]):
            exact += q[row, d] * vectors[at, d]
        order = np.lexsort((ids[at], -exact, row))
        row, at, exact = row[order], at[order], exact[order]
        first = np.searchsorted(row, np.arange(len(q)))
        top = np.arange(len(row)) - first[row] < k
        out.append((some[row[top]], ids[at[top]], exact[top]))
    if not out:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec) of rows with an id and a vector that takes part: of finite components, not all zero."""
    vec = F.col("embedding").cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select(F.col("vec_id").cast("bigint"), vec.alias("vec")).where("vec_id is not null and vec is not null").where(finite & F.exists("vec", lambda x: x != 0))


def top_k(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of each query; tasks send k of each at most."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def brute_force(vectors: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """Exact neighbours of a few queries over all of (vec_id, vec): each batch returns k a query of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = nearest(query_ids, queries, batch.column(0).to_numpy(), _rows(batch.column(1)), k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["query_id", "vec_id", "score"])

    return top_k(vectors.mapInArrow(run, "query_id bigint, vec_id bigint, score double"), k)


def offered(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """Score of the k-th best row of the sample for each query: all the true neighbours reach it. -inf where the sample has fewer."""
    out = np.full(len(query_ids), -np.inf)
    for i in range(0, len(query_ids), 256):
        scores = queries[i : i + 256] @ sample.T
        scores[query_ids[i : i + 256, None] == ids[None, :]] = -np.inf
        if len(ids) >= k:
            out[i : i + 256] = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
    size = np.sqrt((queries * queries).sum(axis=1)) * (np.sqrt((sample * sample).sum(axis=1).max()) if len(sample) else 0.0)
    return out - 1e-11 * size


def calibrate(tree: Tree, vectors: DataFrame, filed: DataFrame, is_query, farthest: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int, aim: float) -> tuple[float, float]:
    """The part of the leaves' reach by which TRIALS queries find the share `aim` of their true neighbours, and that share.

    True neighbours come from all rows; each tells what part its leaf needs to be visited.
    """
    trials = vectors.where(is_query).orderBy(F.xxhash64("vec_id", F.lit(SEED))).limit(TRIALS).toPandas()
    if trials.empty:
        return 1.0, 1.0
    ids, queries = trials["vec_id"].to_numpy(), _rows(trials["vec"])
    truth = brute_force(vectors, ids, queries, k)
    where = truth.join(filed.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").toPandas()
    if where.empty:
        return 1.0, 1.0
    row = {q: i for i, q in enumerate(ids.tolist())}
    at, leaf = np.array([row[q] for q in where["query_id"]]), where["leaf"].to_numpy()
    short = offered(ids, queries, sample_ids, sample, k)[at] - (queries[at] * tree.centres[tree.ends()[leaf]]).sum(axis=1)
    size = np.linalg.norm(queries[at], axis=1) * farthest[leaf]
    needed = np.sort(np.where(short <= 0, np.minimum(0.0, short / np.maximum(size, 1e-300)), short / np.maximum(size, 1e-300)))
    needed = np.clip(needed, -1.0, 1.0 + 1e-9)
    part = float(needed[min(len(needed) - 1, int(np.ceil(aim * len(needed))) - 1)]) + 1e-9
    return part, float((needed <= part).mean())


def _blocks(sizes: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(leaf, first block, number of blocks): small neighbouring leaves share a block, a large leaf has several."""
    out, block, held = [], 0, 0
    for leaf, n in sizes:
        parts = -(-n // BLOCK)
        if held and held + n > BLOCK:
            block, held = block + 1, 0
        out.append((leaf, block, parts))
        block, held = (block + parts, 0) if parts > 1 else (block, held + n)
    return out


def nearest_neighbours(vectors: DataFrame, is_query=None, k: int = NEAREST, aim: float = AIM) -> DataFrame:
    """The k nearest found for each query: query_id, rank, vec_id, score, part, recall.

    vectors: vec_id and embedding (array of numbers). is_query: a condition on vec_id, all rows by default. Nearness
    is the inner product of the vectors as they are, in double precision; ties go to the smaller vec_id; a
    query's own row is no candidate. part and recall tell the calibration; a query whose leaves hold fewer than k
    candidates visits more, so that it gets k rows wherever there are as many.

    The tree has a leaf for LEAF rows, up to MOST_LEAVES, and is fitted to SAMPLE rows, those of the smallest hashes
    of vec_id; every row is filed. Leaves are dealt out in blocks of BLOCK rows, so one that holds very many rows
    (copies of a vector, say) is searched by as many tasks; a task holds one block, past which the queries that visit
    any of its leaves stream, each sent once. Blocks that more than ASKING queries visit go to several tasks.

    Vectors that are null, zero or hold a null or non-finite component take no part, nor do rows without vec_id, nor
    vectors of another length than that of the smallest vec_id. A repeated vec_id is several candidates, and one query
    of the first of its vectors. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    is_query = F.lit(True) if is_query is None else is_query
    schema = "query_id bigint, rank int, vec_id bigint, score double, part double, recall double"
    rows = usable(vectors)
    total, width = rows.agg(F.count(F.lit(1)), F.min_by(F.size("vec"), F.struct("vec_id", F.size("vec")))).first()
    if not total:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("vec") == width)
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    sample_ids, sample = picked["vec_id"].to_numpy(), _rows(picked["vec"])
    tree = fit_tree(sample, min(MOST_LEAVES, max(1, total // LEAF)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = tree.centres[tree.ends()]
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column(1))
                leaf = tree.file(x)
                off = np.linalg.norm(x - centres[leaf], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf, pa.int32()), pa.array(off)], ["vec_id", "vec", "leaf", "off"])

    filed = stage(rows.mapInArrow(assign, "vec_id bigint, vec array<double>, leaf int, off double"), "filed")
    leaves = filed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.max("off").alias("off")).collect()  # MOST_LEAVES at most
    held, farthest = np.zeros(tree.n_leaves, dtype=np.int64), np.zeros(tree.n_leaves)
    for r in leaves:
        held[r["leaf"]], farthest[r["leaf"]] = r["n"], r["off"]
    part, recall = calibrate(tree, rows, filed, is_query, farthest, sample_ids, sample, k, aim)
    tree.widen(farthest, part)
    blocks = _blocks(sorted((r["leaf"], r["n"]) for r in leaves))
    first, several = np.zeros(tree.n_leaves, dtype=np.int64), np.zeros(tree.n_leaves, dtype=np.int64)
    for leaf, block, parts in blocks:
        first[leaf], several[leaf] = block, parts

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for every block that holds rows of its leaves, with these leaves."""
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x, own = batch.column(0).to_numpy(), _rows(batch.column(1)), batch.column(2).to_pylist()
            enough = offered(ids, x, sample_ids, sample, k)
            at, block, wanted = [], [], []
            for i in range(len(ids)):
                asked: dict[int, list[int]] = {}
                for leaf in tree.visits(x[i], enough[i], held, k + own[i]):
                    for b in range(first[leaf], first[leaf] + several[leaf]):
                        asked.setdefault(b, []).append(leaf)
                at += [i] * len(asked)
                block += asked
                wanted += asked.values()
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), batch.column(0).take(take), batch.column(1).take(take), pa.array(wanted, pa.list_(pa.int32()))], ["block", "id", "vec", "leaves"])

    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("vec").alias("vec"), F.count(F.lit(1)).alias("own"))
    asks = stage(asked.mapInArrow(walk, "block int, id bigint, vec array<double>, leaves array<int>"), "asks")
    tasks = asks.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / ASKING).cast("int").alias("tasks")).collect()  # no more blocks than leaves and rows / BLOCK
    share = spark.createDataFrame([(r["block"], r["tasks"]) for r in tasks], "block int, tasks int")
    few = spark.createDataFrame(blocks, "leaf int, first int, parts int")
    stored = filed.join(F.broadcast(few), "leaf").select((F.col("first") + F.pmod(F.xxhash64("vec_id"), "parts")).cast("int").alias("block"), F.col("vec_id").alias("id"), "vec", F.array("leaf").alias("leaves"))
    stored = stored.join(F.broadcast(share), "block").select("block", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(0).alias("kind"), "id", "vec", "leaves")
    asking = asks.join(F.broadcast(share), "block").select("block", F.pmod(F.xxhash64("id"), "tasks").cast("int").alias("task"), F.lit(1).alias("kind"), "id", "vec", "leaves")
    n = parts_for(vectors, 8_000_000, least=max(r["tasks"] for r in tasks) if tasks else None)
    both = stored.unionByName(asking).repartition(max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), "block", "task").sortWithinPartitions("block", "task", "kind")
    found = both.mapInArrow(_search(k), "query_id bigint, vec_id bigint, score double")
    return top_k(found, k).withColumns({"part": F.lit(part), "recall": F.lit(recall)})


def _search(k: int):
    """Rows sorted by (block, task, kind) to the k best of a block for each query, of the leaves that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                group, kind, part = tuple(key[a, :2]), key[a, 2], batch.slice(a, b - a)
                if group != now:
                    now, held, block = group, [], None
                if kind == 0:
                    held.append((part.column(3).to_numpy(), _rows(part.column(4)), part.column(5).flatten().to_numpy()))
                    continue
                if block is None and held:
                    block = tuple(np.concatenate(x) for x in zip(*held, strict=True))
                if block is None:
                    continue
                ids, vectors, leaf = block
                names, number = np.unique(leaf, return_inverse=True)
                lists = part.column(5)
                wanted = np.zeros((part.num_rows, len(names)), dtype=bool)
                owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                flat = lists.flatten().to_numpy()
                place = np.minimum(np.searchsorted(names, flat), len(names) - 1)
                there = names[place] == flat
                wanted[owner[there], place[there]] = True
                for i in range(0, part.num_rows, 1024):  # a matrix of 1024 * BLOCK at most
                    some = slice(i, i + 1024)
                    out = nearest(part.column(3).to_numpy()[some], _rows(part.column(4).slice(i, 1024)), ids, vectors, k, wanted[some][:, number])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["query_id", "vec_id", "score"])

    return run


def op4_query(spark, sf_dir: str) -> DataFrame:
    """op4: the 20 nearest found for every vec_id divisible by 20."""
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % QUERY_EVERY == 0)
