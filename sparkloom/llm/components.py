"""Connected components by alternating large and small stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage, unstage


def hub_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """left inner join right on keys, which are unique in right; weight: how many rows of left have a key, `total` all together.

    Keys of more than their share of left are broadcast, of which there can't be more than SHARES (or 4 a partition);
    their rows of left are dealt out by a hash of the whole row, so that no task has all rows of a key.
    """
    shares = max(1024, 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    heavy = total // shares
    values = [c for c in right.columns if c not in keys]
    hubs = right.where(F.col(weight) > heavy).select(*(F.col(k).alias(f"__{k}") for k in keys), *(F.col(c).alias(f"__{c}") for c in values), F.lit(1).alias("__hub"))
    on = [F.col(k) == F.col(f"__{k}") for k in keys]
    salt = F.when(F.col("__hub").isNotNull(), F.pmod(F.xxhash64(*left.columns), F.lit(1024)) + 1).otherwise(F.lit(0))
    salted = left.join(F.broadcast(hubs), on, "left").withColumn("__salt", salt)
    # 0, but no literal: one would be taken out of the join's keys, and the salt with it.
    none = F.coalesce(F.pmod(F.xxhash64(*keys), F.lit(1)), F.lit(0))
    light = right.where(F.col(weight) <= heavy).withColumns({"__salt": none, "__light": F.lit(1)})
    both = salted.join(light, [*keys, "__salt"], "left").where("__hub is not null or __light is not null")
    return both.select(*left.columns, *(F.when(F.col("__hub").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in values))


def _stars(edges: DataFrame, small: bool, total: int) -> DataFrame:
    """One round over `total` edges (a, b): each node links its neighbours to the smallest of them and itself.

    Large stars move only neighbours above the node; small stars all of those not above it. Minima are taken
    with map-side combining, so that a node of very many neighbours is one row of the shuffle per task, and it
    gives its minimum to them by broadcast.
    """
    if small:
        directed = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("near"))
    else:
        directed = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("near")))
    least = directed.groupBy("node").agg(F.min("near").alias("least"), F.count(F.lit(1)).alias("n")).select("node", F.least("node", "least").alias("least"), "n")
    linked = hub_join(directed, least, ["node"], "n", total * (1 if small else 2))
    if small:
        moved = linked.select(F.col("near").alias("a"), F.col("least").alias("b")).unionByName(least.select(F.col("node").alias("a"), F.col("least").alias("b")))
    else:
        moved = linked.where("near > node").select(F.col("near").alias("a"), F.col("least").alias("b"))
    return moved.where("a != b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether edges (a, b) are stars around their b: each a has one edge and is no other's b."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("x"))
    return ends.groupBy("x.node").agg(F.sum("x.up").alias("up"), F.max("x.down").alias("down")).where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def connected_components(edges: DataFrame) -> DataFrame | None:
    """Rows (node, component) for every node of edges (a, b); component is the smallest node. None without edges.

    Every round shuffles the edges and writes them to the shared folder; rounds grow with the logarithm of the
    longest path. Nulls and loops are ignored; repeated edges and both directions count once.
    """
    now = stage(edges.select("a", "b").where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    count = now.count()
    if not count:
        unstage(now)
        return None
    while not _settled(now):
        large = stage(_stars(now, False, count), "edges")
        after = stage(_stars(large, True, 2 * count), "edges")  # a node's edge to its minimum and one for each of the large star's
        unstage(now)
        unstage(large)
        now, count = after, after.count()
    # Stars at last: each node has one edge, to the smallest node of its component.
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
