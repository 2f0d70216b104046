"""Mixing sources to target weights by Poisson replication (operator 2, SQL only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, let, own, parts_for, stage

#: Weights of sources without one of their own go by their share of characters to this power, so that small
#: sources are repeated and large ones thinned.
ALPHA = 0.7
#: Characters out for each character in.
VOLUME = 1.0
SEED = 20240
#: Rates are broadcast while sources have up to this many steps and 64-bit words of other columns together; beyond,
#: they are joined by shuffle. A rare source in a large corpus has a high rate, and so thousands of steps.
BROADCAST_STEPS = 1_000_000
#: Input bytes of a partition of the result.
PART = 8_000_000


def identity(doc_id: Column, text: Column) -> Column:
    """What hashes go by: doc_id, or the text's MD5 where there is none, so that such rows are not all alike."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of seed and key."""
    return F.conv(F.substr(F.md5(F.concat_ws(":", F.lit(str(seed)), key)), F.lit(1), F.lit(13)), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def poisson_steps(mean: Column) -> Column:
    """The distribution function of Poisson(mean) at 0, 1, 2, ... far into its tail; a uniform inverts to how many of these it reaches.

    Probabilities go by their logarithms, so that large means don't underflow, and in blocks, so that the many
    steps of a large mean don't take quadratic time.
    """
    block = 256
    last = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")

    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.ln(mean) - F.ln(k.cast("double"))
        return let(F.struct(log_p.alias("log_p"), (acc["sum"] + F.exp(log_p)).alias("sum")), lambda now: F.struct(now["log_p"].alias("log_p"), now["sum"].alias("sum"), F.concat(acc["out"], F.array(now["sum"])).alias("out")))

    def join(acc: Column, b: Column) -> Column:
        start = F.struct(acc["log_p"].alias("log_p"), acc["sum"].alias("sum"), F.array().cast("array<double>").alias("out"))
        run = F.aggregate(F.sequence(b * block + 1, F.least(b * block + block, last)), start, step)
        return let(run, lambda r: F.struct(r["log_p"].alias("log_p"), r["sum"].alias("sum"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    first = F.struct((-mean).alias("log_p"), F.exp(-mean).alias("sum"), F.array(F.array(F.exp(-mean))).alias("out"))
    steps = F.aggregate(F.sequence(F.lit(0), F.floor((last - 1) / block).cast("int")), first, join, lambda acc: F.flatten(acc["out"]))
    return F.when(mean > 0, steps).otherwise(F.array(F.lit(1.0)))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, volume: float = VOLUME) -> DataFrame:
    """Mean repetitions of each source: source, n_docs, n_chars, weight, rate.

    rate is weight * volume * (all characters) / (characters of the source), with weights that sum to 1. Given
    weights leave out all other sources. A null source is one of its own; sources without a character have rate 0.
    """
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("bigint")).alias("n_chars"))
    if weights is None:
        raw = F.pow(F.col("n_chars").cast("double"), F.lit(alpha))
    else:
        raw = F.lit(0.0)
        for source, weight in weights.items():
            raw = F.when(F.col("source") == source, F.lit(float(weight))).otherwise(raw)
        raw = F.when(F.col("n_chars") > 0, raw).otherwise(F.lit(0.0))
    sizes = stage(sizes.withColumn("raw", raw), "sizes")
    chars, parts = sizes.agg(F.sum("n_chars"), F.sum("raw")).first()
    weight = F.col("raw") / F.lit(float(parts)) if parts else F.lit(0.0)
    rate = F.when(F.col("n_chars") > 0, F.col("weight") * volume * F.lit(int(chars or 0)) / F.nullif("n_chars", F.lit(0))).otherwise(F.lit(0.0))
    return sizes.withColumn("weight", weight).select("source", "n_docs", "n_chars", "weight", rate.alias("rate"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, volume: float = VOLUME, seed: int = SEED) -> DataFrame:
    """Repeat each document a Poisson number of times and shuffle all copies: docs' columns, copy (from 0) and shuffle_key.

    The count inverts the Poisson distribution of its source's rate at a uniform number hashed from seed and
    doc_id, so that it doesn't depend on partitions, retries or other documents of the source. The result is in
    the order of shuffle_key, a hash of seed, doc_id and copy: a global random order. As the hash is uniform, its
    leading bits name the partition: there is no sampling pass over the texts and no partition is larger by plan.

    Null sources form a source, null texts have no characters but are repeated as their source is; rows of the
    same doc_id get the same count, those without one a count by their text; an empty table gives an empty result;
    columns beyond doc_id, text and source are carried, and copy and shuffle_key get underscores behind their names where
    docs has such columns. A source may hold most rows: sizes are summed before the shuffle, rates are broadcast
    while they are small, and else joined with the documents' side split by the adaptive skew join.
    """
    copy, order, source, steps, n, part = fresh(docs, "copy", "shuffle_key", "__source", "__steps", "__n", "__part")
    rates = source_rates(docs, weights, alpha, volume).select(F.col("source").alias(source), poisson_steps(F.col("rate")).alias(steps))
    size = rates.agg(F.sum(F.size(steps) + F.octet_length(F.coalesce(source, F.lit(""))) / 8 + 8)).first()[0]
    few = (size or 0) <= BROADCAST_STEPS
    joined = docs.join(F.broadcast(rates) if few else rates, F.col("source").eqNullSafe(F.col(source)))
    who = identity(F.col("doc_id"), F.col("text"))
    count = let(uniform(who, seed), lambda u: F.size(F.filter(steps, lambda c: c <= u)))
    copies = joined.withColumn(n, count).where(F.col(n) > 0).select(*own(docs), F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(copy))
    keyed = copies.withColumn(order, F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("order"), who, F.col(copy).cast("string"))))
    parts = parts_for(docs, int(PART / max(volume, 1.0)))
    leading = F.conv(F.substr(F.col(order), F.lit(1), F.lit(8)), 16, 10).cast("bigint")
    dealt = keyed.repartitionById(parts, F.floor(leading * parts / float(1 << 32)).cast("int"))
    return dealt.sortWithinPartitions(order, "doc_id", copy)


def op2_query(spark, sf_dir: str) -> DataFrame:
    """op2: all documents mixed to the production weights."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_WHO = "coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))"

OP2_SQL = f"""
WITH sizes AS (
  SELECT source, sum(coalesce(length(text), 0))::BIGINT AS n_chars FROM documents GROUP BY source
), weighed AS (
  SELECT source, n_chars, CASE WHEN n_chars > 0 THEN pow(n_chars::DOUBLE, {ALPHA}) ELSE 0 END AS raw FROM sizes
), rates AS (
  SELECT source, CASE WHEN n_chars > 0 THEN raw / sum(raw) OVER () * {VOLUME} * sum(n_chars) OVER () / n_chars ELSE 0 END::DOUBLE AS rate FROM weighed
), ks AS (
  SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 20)::BIGINT + 1)) AS k FROM rates
), steps AS (
  SELECT source, k, sum(CASE WHEN rate > 0 THEN exp(k * ln(rate) - rate - lgamma(k + 1)) WHEN k = 0 THEN 1 ELSE 0 END)
           OVER (PARTITION BY source ORDER BY k) AS reached FROM ks
), cdf AS (
  SELECT source, list(reached ORDER BY k) AS reached FROM steps GROUP BY source
), drawn AS (
  SELECT d.*, {_WHO} AS who, len(list_filter(reached, lambda x: x <= ('0x' || substr(md5('{SEED}:' || {_WHO}), 1, 13))::BIGINT / 4503599627370496.0)) AS n
  FROM documents d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source
), copies AS (
  SELECT * EXCLUDE (n), unnest(range(0, n))::INTEGER AS "copy" FROM drawn
)
SELECT * EXCLUDE (who), md5('{SEED}:order:' || who || ':' || "copy"::VARCHAR) AS shuffle_key FROM copies
"""
