"""Packing documents into token sequences (operator 10): shortest-pack-first over the length histogram."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pieces import tokenizer_for
from .shared import stage

MAX_TOKENS = 2048
#: Id after each document's own.
END_ID = 1
#: Characters tokenized at a time.
CHUNK = 3_000_000


def vocabulary() -> str:
    """The production tokenizer's file, as public_tokenizers names it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def _cut(path: str | None, size: int):
    """(doc_id, text) to pieces of at most `size` tokens: PIECE, with salt, a number of the piece in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, made = tokenizer_for(path or vocabulary()), 0
        for batch in batches:
            docs = batch.column(0).to_pylist()
            texts = [t.decode("utf-8", "replace") if t else "" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            begin = 0
            while begin < len(docs):
                end, chars = begin, 0
                while end < len(docs) and (end == begin or chars + len(texts[end]) <= CHUNK):
                    chars += len(texts[end])
                    end += 1
                out = pieces(docs[begin:end], *tokenizer.encode(texts[begin:end]), size)
                yield out.append_column("salt", pa.array(np.arange(made, made + out.num_rows)))
                begin, made = end, made + out.num_rows

    def pieces(docs: list, ids: np.ndarray, counts: np.ndarray, size: int) -> pa.RecordBatch:
        stops = np.cumsum(counts)
        with_end = np.insert(ids, stops, END_ID).astype("<u4")  # after each document's last
        tokens = counts + 1
        first = np.cumsum(tokens) - tokens
        n = -(-tokens // size)
        doc = np.repeat(np.arange(len(docs)), n)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * size
        length = np.minimum(tokens[doc] - start, size)
        at = first[doc] + start
        crc = [zlib.crc32(with_end[a : a + k]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
        columns = [pa.array(docs, pa.int64()).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(tokens[doc])]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pack_histogram(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences have each, for counts of pieces by length.

    Lengths are placed longest first, each into the shortest packs that take it, of as many packs at a time as there
    are; pieces that fit nowhere open packs. The work depends on the number of lengths and patterns, not of pieces.
    """
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            most = max((r for r in room if r >= length), default=None)
            if most is None:
                # Full new packs of this length, and one with what is left.
                each = min(size // length, left)
                packs = left // each
                room.setdefault(size - each * length, []).append(((length,) * each, packs))
                left -= packs * each
                continue
            pattern, n = room[most].pop()
            if not room[most]:
                del room[most]
            used = min(n, left)
            if n > used:
                room.setdefault(most, []).append((pattern, n - used))
            room.setdefault(most - length, []).append(((*pattern, length), used))
            left -= used
    return sorted(((p, n) for packs in room.values() for p, n in packs), reverse=True)


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length the slots that patterns have for it: first rank, first sequence, offset in the sequence."""
    taken: dict[int, int] = {}
    slots: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            rank = taken.get(length, 0)
            slots.setdefault(length, []).append((rank, sequence, offset))
            taken[length] = rank + n
            offset += length
        sequence += n
    return {k: tuple(np.array(v, dtype=np.int64).T) for k, v in slots.items()}


def _place(slots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """Pieces with their rank among those of their length to pieces with sequence_id and offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for k in np.unique(length).tolist():
                mine = np.flatnonzero(length == k)
                first, base, at = slots[k]
                slot = np.searchsorted(first, rank[mine], side="right") - 1
                sequence[mine], offset[mine] = base[slot] + rank[mine] - first[slot], at[slot]
            keep = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, path: str | None = None, size: int = MAX_TOKENS) -> DataFrame:
    """Pack all documents into sequences of at most `size` tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids, then END_ID; it is cut every `size` tokens. path: a byte-level BPE file of the
    tokenizers library, the production one by default. Sequences are numbered from 0 without gaps and filled from
    offset 0. Token ids go no further than the task that makes them; a piece has their CRC-32.

    The driver sees the counts by length (`size` at most) and the patterns made of them; pieces get their rank among
    those of their length in blocks by hash, so that no task has all pieces of a frequent length.

    A null or empty text has END_ID alone; null and repeated doc_ids are packed like any other, row by row; extra
    columns are ignored; an empty table gives an empty result.
    """
    cut = stage(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_cut(path, size), f"{PIECE}, salt bigint"), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    # About as many blocks of a length as each has pieces: neither a block nor the list of blocks is long.
    blocks = docs.sparkSession.createDataFrame([(k, max(1, math.isqrt(n) // 2)) for k, n in histogram.items()], "length bigint, blocks int")
    # salt tells rows apart that are alike in all else, so that very many of them don't meet in a block.
    block = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "salt"), F.col("blocks")).cast("int")
    dealt = cut.join(F.broadcast(blocks), "length").withColumn("block", block)
    within = dealt.withColumn("place", F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "start", "ids_crc32", "salt")))
    counts = dealt.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("length", "block", (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("before"))
    ranked = within.join(before, ["length", "block"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("place") - 1).alias("rank"))
    slots = _slots(pack_histogram(histogram, size))
    return ranked.mapInArrow(_place(slots), f"{PIECE}, sequence_id bigint, offset bigint")


def op10_query(spark, sf_dir: str) -> DataFrame:
    """op10: all documents packed into sequences of 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
