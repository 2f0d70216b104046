"""Shared folder, staged tables and positions of regular-expression matches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words, as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a local session gets a folder of its own; on a cluster that is an error, as a
    machine-local folder would lose data with its executor.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Folders of the staged tables that are still there, oldest first.
_STAGED: list[str] = []


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts lineage and survives lost executors.

    The table stays until unstage() or settled() remove it, as lazy results read it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def settled(df: DataFrame, name: str, since: int) -> DataFrame:
    """stage(df), then remove the tables staged from number `since` on that it was made from."""
    out = stage(df, name)
    for path in _STAGED[since:-1]:
        _remove(df.sparkSession, path)
    del _STAGED[since:-1]
    return out


def staged() -> int:
    """How many staged tables there are."""
    return len(_STAGED)


def lay_out(df: DataFrame, n: int, key: str) -> DataFrame:
    """df in n partitions by key, checkpointed: later groupings by key alone find their rows in place.

    The checkpoint takes over the partitioning only of a plan that is fixed beforehand, hence not adaptive.
    """
    spark = df.sparkSession
    shared_folder(spark)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.repartition(n, key).checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def unstage(df: DataFrame) -> None:
    """Remove the files of a staged table that nothing lazy reads any more."""
    files = df.inputFiles()
    if files:
        path = files[0].rsplit("/", 1)[0]
        _remove(df.sparkSession, path)
        _STAGED[:] = [p for p in _STAGED if p.rsplit("/", 1)[1] != path.rsplit("/", 1)[1]]


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that df is made from, by Catalyst's statistics; those of unknown size count as nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)


def parts_for(df: DataFrame, each: int, least: int | None = None) -> int:
    """Partitions so that each holds about `each` bytes of df, spark.sql.shuffle.partitions at least."""
    least = least or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(1_000_000, -(-input_bytes(df) // each)))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, with underscores behind those that df has columns of already, in whatever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def own(df: DataFrame) -> list[Column]:
    """All columns of df by their exact names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def held(value: Column) -> Column:
    """value as it is, but as the optimizer mustn't move it: a filter above would else copy it, expressions within
    expressions, wherever it is used."""
    return F.when(F.spark_partition_id() >= 0, value)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def offsets(lengths: Column) -> Column:
    """Start of each match from an array of (gap before it, own length), in order.

    Prefix sums go in two levels, so that a text of very many matches doesn't take quadratic time.
    """
    block = 256

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["gap"]
        return F.struct((at + x["own"]).alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

    def run(items: Column, first: Column) -> Column:
        return F.aggregate(items, F.struct(first.cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out")), step)

    def join(acc: Column, items: Column) -> Column:
        return let(run(items, acc["at"]), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    none = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<array<bigint>>").alias("out"))

    def split_up(items: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / block).cast("int")), lambda b: F.slice(items, b * block + 1, F.lit(block)))
        return F.when(F.size(items) <= block, run(items, F.lit(0))["out"]).otherwise(F.flatten(F.aggregate(blocks, none, join)["out"]))

    return let(lengths, split_up)


#: Type of an array of spans.
SPANS = "array<struct<start:bigint,order:int,end:bigint,kind:string,value:string,score:double>>"


def blocks_of(items: Column, size: int = 128) -> Column:
    """An array cut into arrays of up to `size` items; none for an empty one."""
    return F.when(F.size(items) == 0, F.slice(F.array(items), 1, 0)).otherwise(
        F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int")), lambda b: F.slice(items, b * size + 1, F.lit(size)))
    )


def around(text: Column, placed: Column, near: int, value) -> Column:
    """value(span, what is within `near` code points before and after it) for each of the sorted spans.

    Substrings are counted from the start of their text, so they are taken of sections for some spans each: a long
    text with very many spans doesn't take quadratic time.
    """

    def block(some: Column) -> Column:
        begin = F.greatest(F.get(some, F.lit(0))["start"] - near, F.lit(0))
        section = F.substr(text, (begin + 1).cast("int"), (F.element_at(some, -1)["end"] + near - begin).cast("int"))

        def each(part: Column) -> Column:
            def one(s: Column) -> Column:
                at = s["start"] - part["begin"]
                before = F.substr(part["section"], (F.greatest(at - near, F.lit(0)) + 1).cast("int"), F.least(at, F.lit(near)).cast("int"))
                after = F.substr(part["section"], (s["end"] - part["begin"] + 1).cast("int"), F.lit(near))
                return value(s, F.concat(before, F.lit(" "), after))

            return F.transform(some, one)

        return let(F.struct(begin.alias("begin"), section.alias("section")), each)

    return F.flatten(F.transform(blocks_of(placed), block))


def apart_from(known: Column, more: Column) -> Column:
    """Those of the spans `more` that overlap none of the sorted spans `known`, which are looked through by blocks."""

    def clear(blocks: Column) -> Column:
        def touches(s: Column):
            return lambda b: (b["low"] < s["end"]) & (b["high"] > s["start"]) & F.exists(b["items"], lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"]))

        return F.filter(more, lambda s: ~F.exists(blocks, touches(s)))

    def bounded(b: Column) -> Column:
        return F.struct(F.get(b, F.lit(0))["start"].alias("low"), F.array_max(F.transform(b, lambda k: k["end"])).alias("high"), b.alias("items"))

    return F.when((F.size(known) == 0) | (F.size(more) == 0), more).otherwise(let(F.transform(blocks_of(known), bounded), clear))


def spans(text: Column, pattern: str, kind: str, order: int, keep=None) -> Column:
    """Array of (start, order, end, kind, value, score): the leftmost non-overlapping matches of pattern in text.

    start and end count code points, end exclusive; the score is 1. keep(value) drops matches, without another try
    for what they cover. The pieces between matches come from split() by the same pattern, so match i starts after
    the pieces and matches before it.
    """

    def place(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        lengths = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).cast("bigint").alias("gap"), F.length(m).cast("bigint").alias("own")))
        return F.zip_with(
            offsets(lengths),
            found,
            lambda at, m: F.struct(at.alias("start"), F.lit(order).alias("order"), (at + F.length(m)).alias("end"), F.lit(kind).alias("kind"), m.alias("value"), F.lit(1.0).alias("score")),
        )

    def kept(placed: Column) -> Column:
        return placed if keep is None else F.filter(placed, lambda s: keep(s["value"]))

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m: F.when(F.size(m) > 0, kept(place(m))).otherwise(F.array().cast(SPANS)))


def listed(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined, in their order."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def number_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("bigint")
