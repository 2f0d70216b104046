"""Jaccard join of documents by word n-grams (operator 7): MinHash, Bayesian candidate pruning, exact verification.

Exact copies fold into one representative first. Representatives that agree in a band of MinHash values are
candidates; a pair is compared a few values at a time and dropped once the posterior probability that its
similarity reaches the threshold is under the tolerance. What is left forms clusters, within which every pair is
verified on the full sets of n-grams. Neither stage emits a row for each pair: tasks return spanning edges and a
link count for each document, and groups too large for a task are dealt out in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, hub_join
from .shared import fresh, own, parts_for, stage, unstage
from .words import mix, normal, range_hashes, words_of, WORD_BASE

#: Words of an n-gram, and the least similarity, in fifths.
NGRAM, FIFTHS = 5, 4
#: Bands and MinHash values in each: a pair at the threshold is missed by all bands once in 300 000 times.
BANDS, ROWS = 32, 5
VALUES = BANDS * ROWS
#: Posterior probability under which a pair is dropped, and values compared at a time.
TOLERANCE, STEP = 1e-6, 32
#: Candidates of a band, documents of a cluster, and n-grams of a cluster, that one task compares.
BAND_BLOCK, CLUSTER_BLOCK, GRAM_BLOCK = 8192, 1024, 4_000_000
#: Groups up to this size are compared pair by pair, many groups at a time.
SMALL = 24
#: Bytes of words hashed at a time.
CHUNK = 2_000_000

MULTIPLIERS = mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


@cache
def least_matches() -> dict[int, int]:
    """Matches, by values compared, under which a pair is dropped.

    After k matches of n and a flat prior the similarity has a Beta(k + 1, n - k + 1) distribution; its mass from
    the threshold on equals the chance of at most k successes in n + 1 trials.
    """
    p, out = FIFTHS / 5, {}
    for n in range(STEP, VALUES + 1, STEP):
        mass, k = 0.0, -1
        while True:
            mass += comb(n + 1, k + 1) * p ** (k + 1) * (1 - p) ** (n - k)
            if mass >= TOLERANCE:
                break
            k += 1
        out[n] = k + 1
    return out


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' n-grams, end to end, and where each text's begin; fewer words than NGRAM are one n-gram."""
    w = words_of(texts)
    counts = np.diff(w.doc_first)
    size = np.where(counts >= NGRAM, NGRAM, counts)
    per = np.where(counts > 0, np.maximum(counts - NGRAM + 1, 1), 0)
    begin = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(per, out=begin[1:])
    doc = np.repeat(np.arange(len(texts)), per)
    start = np.arange(begin[-1]) - begin[doc] + w.doc_first[doc]
    return range_hashes(w.hashes, start, start + size[doc], WORD_BASE), begin


def signatures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """16 bits of each of the VALUES MinHash values of each text (row), for texts that have words, and n-grams of each text."""
    grams, begin = ngrams(texts)
    full = np.flatnonzero(np.diff(begin))
    out = np.empty((len(full), VALUES), dtype=np.uint16)
    if len(full):
        product = np.empty_like(grams)
        for k in range(VALUES):
            np.multiply(grams, MULTIPLIERS[k], out=product)
            out[:, k] = (mix(np.minimum.reduceat(product, begin[full])) >> np.uint64(48)).astype(np.uint16)
    return out, np.diff(begin)


def _chunks(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows whose second field is a normal text, some MB at a time."""
    now: list[tuple] = []
    size = 0
    for row in rows:
        now.append(row)
        size += len(row[1])
        if size >= CHUNK:
            yield now
            now, size = [], 0
    if now:
        yield now


def _digest(text: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(text, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


SIGNED = "doc_id bigint, raw string, d1 bigint, d2 bigint, size bigint, sig binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to SIGNED for texts that have words: digests of the text as it is and of its words, n-grams, MinHash."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if words := normal(text):
                    yield i, words, hashlib.md5(text, usedforsecurity=False).hexdigest()

    for chunk in _chunks(rows()):
        sig, sizes = signatures([t for _, t, _ in chunk])
        digests = [_digest(t) for _, t, _ in chunk]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([c[0] for c in chunk], pa.int64()), pa.array([c[2] for c in chunk]), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()),
                pa.array(sizes), pa.array([s.tobytes() for s in sig], pa.binary()),
            ],
            ["doc_id", "raw", "d1", "d2", "size", "sig"],
        )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, sig) to (key, rep), a row for each band."""
    for batch in batches:
        if batch.num_rows:
            rep = batch.column("rep").to_numpy()
            sig = _matrix(batch.column("sig")).astype(np.uint64).reshape(len(rep), BANDS, ROWS)
            key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(rep), 1))
            for r in range(ROWS):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(rep, BANDS))], ["key", "rep"])


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, VALUES)


def _groups(batches: Iterator[pa.RecordBatch], keys: int, least_rows: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows with where their groups (equal first `keys` columns) begin: whole groups, least_rows rows or the rest at a time."""
    held: list[pa.RecordBatch] = []
    n = 0

    def cut(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, dtype=bool)
        new[:1] = True
        for i in range(keys):
            c = table.column(i).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= least_rows:
            table = pa.Table.from_batches(held).combine_chunks()
            heads = cut(table)
            if len(heads) > 1:
                yield table.slice(0, heads[-1]), heads[:-1]
                table = table.slice(heads[-1])
            held, n = table.combine_chunks().to_batches(), table.num_rows
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, cut(table)


def surviving(sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) of rows of sig stay when compared STEP values at a time."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int32)
    for n, least in least_matches().items():
        x, y = a[alive], b[alive]
        matches = matches + np.count_nonzero(sig[x, n - STEP : n] == sig[y, n - STEP : n], axis=1)
        ok = matches >= least
        alive, matches = alive[ok], matches[ok]
    out = np.zeros(len(a), dtype=bool)
    out[alive] = True
    return out


class Forest:
    """Union-find over integers that keeps the edges which joined two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        top = x
        while (p := self.up.get(top, top)) != top:
            top = p
        while x != top:
            self.up[x], x = top, self.up.get(x, x)
        return top

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((x, y))


def spanning(sig: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what surviving pairs of rows connect, without comparing pairs already connected.

    A row is compared with all rows of other components; then it needs no further look. Once all rows outside one
    component have been, every pair across components has been compared.
    """
    n = len(sig)
    part, done, out = np.arange(n), np.zeros(n, dtype=bool), []
    while True:
        values, sizes = np.unique(part, return_counts=True)
        todo = np.flatnonzero(~done & (part != values[np.argmax(sizes)])) if len(values) < n else np.flatnonzero(~done)
        if not len(todo):
            return out
        x = todo[0]
        others = np.flatnonzero(part != part[x])
        near = others[surviving(sig, np.full(len(others), x), others)]
        _, one = np.unique(part[near], return_index=True)
        out += [(int(x), int(y)) for y in near[one]]
        part[np.isin(part, part[near])] = part[x]
        done[x] = True


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, tile, rep, sig), sorted by key and tile, to spanning edges (a, b) of the pairs that stay."""
    for table, heads in _groups(batches, 2):
        rep, sig = table.column(2).to_numpy(), _matrix(table.column(3))
        sizes = np.diff(heads, append=len(rep))
        group = np.repeat(np.arange(len(heads)), sizes)
        small = (sizes <= SMALL)[group]
        pairs = []
        for d in range(1, SMALL):
            i = np.flatnonzero((group[d:] == group[:-d]) & small[d:])
            if not len(i):
                break
            pairs.append(np.stack([i, i + d], axis=1))
        forest = Forest()
        if pairs:
            both = np.concatenate(pairs)
            ends = np.sort(rep[both], axis=1)
            _, one = np.unique(ends, axis=0, return_index=True)
            both = both[one]
            both = both[surviving(sig, both[:, 0], both[:, 1])]
            for x, y in rep[both].tolist():
                forest.join(x, y)
        for g in np.flatnonzero(sizes > SMALL):
            own = slice(heads[g], heads[g] + sizes[g])
            for x, y in spanning(sig[own]):
                forest.join(int(rep[own][x]), int(rep[own][y]))
        if forest.edges:
            a, b = zip(*forest.edges, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(component, n, grams, copies, node, text) to the same with the set of n-grams for the text."""
    for batch in batches:
        texts = [normal(t) for t in batch.column(5).cast(pa.binary()).to_pylist()]
        for some in _chunks(enumerate(texts)):
            grams, begin = ngrams([t for _, t in some])
            sets = [np.unique(grams[s:e]).tobytes() for s, e in zip(begin[:-1], begin[1:], strict=True)]
            part = batch.slice(some[0][0], len(some))
            yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(sets, pa.binary())], ["component", "n", "grams", "copies", "node", "set"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share.

    Elements of many sets go through a product of matrices, all others through the pairs of sets that hold them.
    """
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    counts = np.diff(heads, append=len(values))
    out = np.zeros((n, n), dtype=np.int64)
    common = np.flatnonzero(counts > 16)
    for i in range(0, len(common), 4096):
        some = common[i : i + 4096]
        at = np.repeat(heads[some] - np.concatenate([[0], np.cumsum(counts[some])[:-1]]), counts[some]) + np.arange(counts[some].sum())
        has = np.zeros((n, len(some)), dtype=np.float32)
        has[owner[at], np.repeat(np.arange(len(some)), counts[some])] = 1
        out += (has @ has.T).astype(np.int64)
    rare = np.flatnonzero((counts > 1) & (counts <= 16))
    for c in np.unique(counts[rare]):
        rows = owner[heads[rare[counts[rare] == c]][:, None] + np.arange(c)]
        for i in range(c):
            for j in range(i + 1, c):
                np.add.at(out, (rows[:, i], rows[:, j]), 1)
                np.add.at(out, (rows[:, j], rows[:, i]), 1)
    out[np.arange(n), np.arange(n)] = [len(s) for s in sets]
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(component, tile, side, copies, node, set), sorted by component and tile, to rows (a, b, links).

    Without b: how many documents a is linked to here, copies included; with b: a spanning edge. In a tile of two
    sides only pairs across count.
    """
    for table, heads in _groups(batches, 2, 256):
        ends = np.append(heads[1:], table.num_rows)
        side, copies, node = (table.column(i).to_numpy() for i in (2, 3, 4))
        grams = table.column(5)
        nodes: list[int] = []
        links: list[int] = []
        forest = Forest()
        for s, e in zip(heads, ends, strict=True):
            _, one = np.unique(node[s:e], return_index=True)  # repeated rows
            at = s + one
            if len(at) < 2:
                continue
            sets = [np.frombuffer(grams[int(i)].as_py(), dtype=np.uint64) for i in at]
            shared = overlaps(sets)
            size = np.diag(shared)
            linked = 5 * shared >= FIFTHS * (size[:, None] + size[None, :] - shared)
            np.fill_diagonal(linked, False)
            sides = side[at]
            if sides.min() != sides.max():
                linked &= sides[:, None] != sides[None, :]
            total = linked @ copies[at]
            some = np.flatnonzero(total)
            nodes += node[at[some]].tolist()
            links += total[some].tolist()
            part = np.arange(len(at))
            for x in some:  # each row joins the components it links to
                near = np.flatnonzero(linked[x] & (part != part[x]))
                _, one = np.unique(part[near], return_index=True)
                for y in near[one]:
                    forest.join(int(node[at[x]]), int(node[at[y]]))
                part[np.isin(part, part[near])] = part[x]
        a = nodes + [x for x, _ in forest.edges]
        b = [None] * len(nodes) + [y for _, y in forest.edges]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links + [0] * len(forest.edges), pa.int64())], ["a", "b", "links"])


def _tiled(df: DataFrame, blocks, item: str) -> DataFrame:
    """Deal groups that need several blocks into them, and rows to a tile for each pair of their block with another.

    Adds tile and side (the row's block). A group of one block has the one tile 0.
    """
    own_block = F.pmod(F.xxhash64(item), F.col("__blocks"))
    df = df.withColumn("__blocks", blocks.cast("bigint")).withColumn("side", own_block.cast("bigint"))
    df = df.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__blocks") - 1)))
    return df.withColumn("tile", F.least("side", "__other") * F.col("__blocks") + F.greatest("side", "__other")).drop("__blocks", "__other")


def _row():
    """A row of the documents: its doc_id, null last, and the digest of its text."""
    return F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "raw")


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(doc_id, raw, d1, d2) of documents with words; class of each distinct text (d1, d2, copies, first, links); staged tables these read.

    first is the least row of the class. Texts are known by numbers of their own, not by doc_id, which may be
    missing or stand for several texts.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = parts_for(docs, 16_000_000)
    signed = stage(docs.mapInArrow(_sign, SIGNED), "signed")
    distinct = signed.groupBy("d1", "d2").agg(F.min(_row()).alias("first"), F.count(F.lit(1)).alias("copies"), F.max("size").alias("size"), F.max("sig").alias("sig"))
    reps = stage(distinct.withColumn("rep", F.monotonically_increasing_id()), "reps")
    n_reps = reps.count()

    entries = reps.select("rep", "sig").mapInArrow(_bands, "key bigint, rep bigint")
    several = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = _tiled(hub_join(entries, several, ["key"], "n", BANDS * n_reps), F.ceil(F.col("n") / BAND_BLOCK), "rep")
    # A document is in most bands of its neighbours: what it sends along is its signature, not its text.
    tiles = dealt.join(reps.select("rep", "sig"), "rep").select("key", "tile", "rep", "sig")
    edges = tiles.repartition(n, "key", "tile").sortWithinPartitions("key", "tile").mapInArrow(_candidates, "a bigint, b bigint")
    clusters = connected_components(edges)
    used = [signed, reps]
    found = docs.sparkSession.createDataFrame([], "a bigint, b bigint, links bigint")
    if clusters is not None:
        found = stage(_verified(docs, reps, clusters, n, n_reps), "links")
        used += [found, clusters]
    classes = connected_components(found.select("a", "b"))
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    of_rep = reps.select("d1", "d2", "rep", "copies", "first").join(links, "rep", "left").withColumn("links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    if classes is None:
        return signed, of_rep.drop("rep"), used
    used.append(classes)
    named = of_rep.join(classes.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")).drop("rep")
    first = named.groupBy("component").agg(F.min("first").alias("of_class"), F.count(F.lit(1)).alias("n"))
    of_rep = hub_join(named, first, ["component"], "n", n_reps)
    return signed, of_rep.select("d1", "d2", "copies", F.col("of_class").alias("first"), "links"), used


def link_documents(docs: DataFrame) -> DataFrame:
    """Near copies by Jaccard similarity of 0.8 or more on sets of five-word n-grams: doc_id, class_id, n_links.

    Words are what stands between spaces and characters 9 to 13, unchanged; texts of one to four words have one
    n-gram. class_id is the smallest doc_id that the document is connected to through links; n_links counts the
    other documents it is linked to, exact copies included. Links between different texts are all verified and
    counted; one may be missed with the chance that all bands differ or the pruning errs, about 1e-5 at the
    threshold and vanishing above.

    Documents without words, null texts among them, are linked to nothing. Every row gives a row: those without
    doc_id (their class_id is null where no member has one), repeated rows, which count as copies, and different
    texts of one doc_id, each in its own class. Extra columns are ignored; an empty table gives an empty result.
    """
    signed, of_rep, _ = _linked(docs)
    named = of_rep.select("d1", "d2", "copies", F.col("first.doc_id").alias("class_id"), F.col("links").alias("n_links"))
    linked = hub_join(signed.select("doc_id", "d1", "d2"), named, ["d1", "d2"], "copies", signed.count()).select("doc_id", "class_id", "n_links")
    blank = docs.where(_blank(docs)).select(F.col("doc_id").cast("bigint"), F.col("doc_id").cast("bigint").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return linked.unionByName(blank)


def _blank(docs: DataFrame):
    return ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def _verified(docs: DataFrame, reps: DataFrame, clusters: DataFrame, n: int, n_reps: int) -> DataFrame:
    nodes = clusters.join(reps.select(F.col("rep").alias("node"), "first", "copies", "size"), "node")
    sums = nodes.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("grams"))
    members = hub_join(nodes, sums, ["component"], "n", n_reps)
    # One row of the documents for each distinct text, whatever stands for it.
    texts = docs.select(F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("raw"), "text").where(~_blank(docs))
    at = members.select("component", "n", "grams", "copies", "node", F.col("first.doc_id").alias("id"), F.col("first.raw").alias("raw"))
    wanted = texts.join(at, texts["id"].eqNullSafe(at["id"]) & (texts["raw"] == at["raw"])).select("component", "n", "grams", "copies", "node", "text")
    sets = wanted.mapInArrow(_sets, "component bigint, n bigint, grams bigint, copies bigint, node bigint, set binary")
    blocks = F.greatest(F.ceil(F.col("n") / CLUSTER_BLOCK), F.ceil(F.col("grams") / GRAM_BLOCK))
    tiles = _tiled(sets, blocks, "node").select("component", "tile", "side", "copies", "node", "set")
    return tiles.repartition(n, "component", "tile").sortWithinPartitions("component", "tile").mapInArrow(_verify, "a bigint, b bigint, links bigint")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs without near copies: of each class the row with the smallest doc_id stays, with all its columns.

    Documents without words stay, all of them. A row without doc_id stays where its class has none with one; of rows
    alike in doc_id and text one stays; different texts of one doc_id are judged apart. Columns of any name are
    carried; an empty table gives an empty result.
    """
    signed, of_rep, used = _linked(docs)
    firsts = of_rep.select("first").distinct().select("first.doc_id", "first.raw")
    kept = stage(firsts, "kept")
    rows_of = signed.select("doc_id", "raw").join(kept.select(F.col("doc_id").alias("id"), F.col("raw").alias("r")), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("raw") == F.col("r")), "left_semi")
    repeated = rows_of.count() > kept.count()
    for table in used:
        unstage(table)
    key, text, blank = fresh(docs, "__id", "__raw", "__blank")
    known = docs.select(*own(docs), F.col("doc_id").cast("bigint").alias(key), F.md5(F.col("text").cast("binary")).alias(text), _blank(docs).alias(blank))
    right = kept.select(F.col("doc_id").alias("__kept_id"), F.col("raw").alias("__kept_raw"))
    full = known.where(~F.col(blank)).join(right, F.col(key).eqNullSafe(F.col("__kept_id")) & (F.col(text) == F.col("__kept_raw")), "left_semi")
    if repeated:
        full = full.dropDuplicates([key, text])
    return full.unionByName(known.where(F.col(blank))).select(*own(docs))


def op7_query(spark, sf_dir: str) -> DataFrame:
    """op7: class and number of links of every document."""
    return link_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
