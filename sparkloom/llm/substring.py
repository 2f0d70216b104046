"""Removal of repeated passages (operator 1): fixed-block anchors, probed by every rolling window and extended.

Any repeat of SPAN words holds a whole block of BLOCK words of a grid laid over one of its occurrences, as
SPAN >= 2 * BLOCK - 1. So the blocks of the grid are the index, all rolling windows of BLOCK words are probes, and
windows of SPAN words around a hit are the extension that is confirmed by its own, longer fingerprint. Windows that
are confirmed and overlap join to maximal repeats.

Documents travel in packs of a few MB. A pack sends each distinct hash once, however often it holds it, to the
bucket that owns the hash range, and gets one bit back for each: nothing grows with the number of pairs, and a
passage that is in a third of all documents costs its bucket a few bytes a pack. Where there are many buckets, a
pack sends to ranges of buckets, and relays gather what some hundred packs send to a range before they deal it out to
its buckets, and take the answers back likewise: no pack sends a message to each bucket.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import input_bytes, lay_out, parts_for
from .words import WORD_BASE, Words, normal, words_of

#: A repeat has this many words at least.
SPAN = 35
#: Words of an anchor block.
BLOCK = 18
#: Bytes of words in a pack; input bytes for each bucket of hashes.
PACK, BUCKET = 3_000_000, 8_000_000
#: Buckets that a pack sends to by itself; packs that a relay gathers.
FAN, GATHER = 1024, 256
#: Bits of an anchor's hash: a false hit only costs an extension that isn't confirmed.
ANCHOR_BITS = 48
SECOND_BASE = 0xFF51AFD7ED558CCD


def _shrink(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: the first sorted one as differences, all by planes of bytes of equal weight, compressed."""
    out = [struct.pack("<I", len(arrays))]
    for i, a in enumerate(arrays):
        a = np.ascontiguousarray(np.diff(a, prepend=a.dtype.type(0)) if i == 0 else a)
        planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()
        out.append(struct.pack("<4sQ", a.dtype.str.encode(), len(planes)) + planes)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _grow(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = struct.unpack_from("<I", raw)[0], 4, []
    for i in range(n):
        kind, size = struct.unpack_from("<4sQ", raw, at)
        at += 12
        dtype = np.dtype(kind.rstrip(b"\0").decode())
        a = np.frombuffer(raw, dtype=np.uint8, count=size, offset=at).reshape(dtype.itemsize, -1).T.copy().view(dtype).ravel()
        at += size
        out.append(np.cumsum(a, dtype=dtype) if i == 0 else a)
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to packs: (pack, blob of ids and normal texts)."""
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId(), 0
    ids: list[int] = []
    texts: list[bytes] = []
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal n, ids, texts, size
        head = np.array([-(2**63) if i is None else i for i in ids], dtype=np.int64).tobytes()
        lengths = np.array([len(t) for t in texts], dtype=np.int64).tobytes()
        blob = zstandard.ZstdCompressor(level=1).compress(struct.pack("<Q", len(ids)) + head + lengths + b"".join(texts))
        out = pa.RecordBatch.from_arrays([pa.array([f"{part}:{n}"]), pa.array([blob], pa.binary())], ["pack", "blob"])
        n, ids, texts, size = n + 1, [], [], 0
        return out

    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            text = normal(text)
            ids.append(i)
            texts.append(text)
            size += len(text) + 64
            if size >= PACK:
                yield flush()
    if ids:
        yield flush()


def _unpack(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<Q", raw)
    ids, lengths = np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, n, 8 + 8 * n)
    ends = np.cumsum(lengths) + 8 + 16 * n
    return ids, [raw[e - length : e] for e, length in zip(ends.tolist(), lengths.tolist(), strict=True)]


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, for each whether it is there twice, and the number of each original key among them."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(keys), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    return ordered[heads], np.diff(heads, append=len(keys)) > 1, number


def _anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, hash and whether it lies on its text's grid, of each rolling window of BLOCK words."""
    at, hashes = words.windows(BLOCK)
    doc = np.searchsorted(words.doc_first, at, side="right") - 1
    return at, hashes >> np.uint64(64 - ANCHOR_BITS), (at - words.doc_first[doc]) % BLOCK == 0


@dataclass(frozen=True)
class Ranges:
    """n buckets of an equal part of the hashes each, and the larger ranges of `wide` buckets that packs send to."""

    n: int
    wide: int

    @staticmethod
    def of(n: int) -> Ranges:
        return Ranges(n, 1 if n <= FAN else max(-(-n // FAN), math.isqrt(n)))

    @property
    def count(self) -> int:
        return -(-self.n // self.wide)

    def ends(self, keys: np.ndarray, bits: int, first: int, last: int, step: int) -> np.ndarray:
        """Where in the sorted keys, which lie in buckets first to last, those of each `step` buckets end, with the begin."""
        edges = [-(-(i << bits) // self.n) for i in range(first + step, last, step)]
        return np.concatenate([[0], np.searchsorted(keys, np.array(edges, dtype=np.uint64)), [len(keys)]]).astype(np.int64)


def _probe(n: Ranges):
    """Packs to (bucket, pack, blob of distinct anchor hashes with their flags); the bucket is a range's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, texts = _unpack(blob.as_py())
                _, keys, grid = _anchors(words_of(texts))
                distinct, twice, number = _distinct(keys)
                flags = twice.astype(np.uint8)
                flags[number[grid]] |= 2
                yield _sent(pack, n, distinct, ANCHOR_BITS, flags)

    return run


def _sent(pack: str, n: Ranges, keys: np.ndarray, bits: int, *more: np.ndarray) -> pa.RecordBatch:
    ends = n.ends(keys, bits, 0, n.n, n.wide)
    full = [i for i in range(n.count) if ends[i + 1] > ends[i]]
    blobs = [_shrink(keys[ends[i] : ends[i + 1]], *(m[ends[i] : ends[i + 1]] for m in more)) for i in full]
    return pa.RecordBatch.from_arrays([pa.array([i * n.wide for i in full], pa.int32()), pa.array([pack] * len(full), pa.string()), pa.array(blobs, pa.binary())], ["bucket", "pack", "blob"])


def _packed(bits: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(bits).tobytes())


def _bits(data: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), count=count).astype(bool)


def _several(sent: list[list[np.ndarray]], kind: int) -> list[np.ndarray]:
    """For each list of columns (sorted hashes and their like, flags last) which of its rows occur twice or more in all.

    kind 0: anchors, which must be on the grid somewhere, too. kind 1: fingerprints of SPAN words.
    """
    sizes = [len(s[0]) for s in sent]
    flags = np.concatenate([s[-1] for s in sent])
    columns = [np.concatenate([s[i] for s in sent]) for i in range(len(sent[0]) - 1)]
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    heads = np.flatnonzero(new)
    several = (np.diff(heads, append=len(order)) > 1) | (np.bitwise_or.reduceat(flags[order], heads) & 1 > 0)
    if kind == 0:
        several &= np.bitwise_or.reduceat(flags[order], heads) & 2 > 0
    found = np.empty(len(order), dtype=bool)
    found[order] = several[np.cumsum(new) - 1]
    return np.split(found, np.cumsum(sizes)[:-1])


def _answer(kind: int):
    """All packs' hashes of one bucket to (pack, kind, bucket, bits): which of the hashes sent occur twice or more."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pack")
        bits = [_packed(f) for f in _several([_grow(b) for b in group["blob"]], kind)]
        return pd.DataFrame({"pack": group["pack"].to_numpy(), "kind": kind, "bucket": group["bucket"].to_numpy(), "bits": bits})

    return run


def _relayed(n: Ranges, bits: int):
    """What packs of a relay sent to a range, to (bucket, range, relay, blob): one bundle for each bucket, packs in their order."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pack")
        first = int(group["bucket"].iloc[0])
        last = min(n.n, first + n.wide)
        sent = [_grow(b) for b in group["blob"]]
        ends = [n.ends(s[0], bits, first, last, 1) for s in sent]
        rows = []
        for i in range(last - first):
            parts = [[c[e[i] : e[i + 1]] for c in s] for s, e in zip(sent, ends, strict=True)]
            if any(len(p[0]) for p in parts):
                rows.append((first + i, first, group["relay"].iloc[0], pickle.dumps([_shrink(*p) if len(p[0]) else b"" for p in parts])))
        return pd.DataFrame(rows, columns=["bucket", "range", "relay", "blob"])

    return run


def _answer_relays(kind: int):
    """All bundles of one bucket to (range, relay, bucket, bits): the answers for each pack of a bundle."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("relay")
        bundles = [pickle.loads(b) for b in group["blob"]]
        found = iter(_several([_grow(p) for b in bundles for p in b if p], kind))
        out = [pickle.dumps([(_packed(f := next(found)), len(f)) if p else (b"", 0) for p in b]) for b in bundles]
        return pd.DataFrame({"range": group["range"].to_numpy(), "relay": group["relay"].to_numpy(), "bucket": group["bucket"].to_numpy(), "bits": out})

    return run


def _take_back(kind: int):
    """The packs of a relay and the answers to what it sent for a range, to (pack, kind, bucket, bits), as _answer gives."""

    def run(packs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        names = sorted(packs["pack"])
        got: list[list[np.ndarray]] = [[] for _ in names]
        for bundle in answers.sort_values("bucket")["bits"]:
            for mine, (data, count) in zip(got, pickle.loads(bundle), strict=True):
                if count:
                    mine.append(_bits(data, count))
        first = packs["bucket"].to_numpy()[0]
        return pd.DataFrame({"pack": names, "kind": kind, "bucket": first, "bits": [_packed(np.concatenate(x)) for x in got]})

    return run


def _answered(sent: DataFrame, n: Ranges, parts: int, kind: int, bits: int, n_packs: int) -> DataFrame:
    """Answers (pack, kind, bucket, bits) to what packs sent (bucket, pack, blob)."""
    answer = "pack string, kind int, bucket int, bits binary"
    if n.wide == 1:
        return sent.repartition(parts, "bucket").groupBy("bucket").applyInPandas(_answer(kind), answer).checkpoint()
    sent = sent.withColumn("relay", F.pmod(F.xxhash64("pack"), F.lit(max(1, n_packs // GATHER))).cast("int")).checkpoint()
    relayed = sent.groupBy("bucket", "relay").applyInPandas(_relayed(n, bits), "bucket int, range int, relay int, blob binary")
    answers = relayed.repartition(parts, "bucket").groupBy("bucket").applyInPandas(_answer_relays(kind), "range int, relay int, bucket int, bits binary")
    asked = sent.select("bucket", "relay", "pack").groupBy("bucket", "relay")
    return asked.cogroup(answers.groupBy("range", "relay")).applyInPandas(_take_back(kind), answer).checkpoint()


def _told(answers: pd.DataFrame, kind: int, keys: np.ndarray, bits: int, n: Ranges) -> np.ndarray:
    """The answer for each of a pack's sorted distinct keys."""
    out = np.zeros(len(keys), dtype=bool)
    ends = n.ends(keys, bits, 0, n.n, n.wide)
    mine = answers[answers["kind"] == kind]
    for bucket, packed in zip(mine["bucket"] // n.wide, mine["bits"], strict=True):
        a, b = ends[bucket], ends[bucket + 1]
        out[a:b] = _bits(packed, b - a)
    return out


def _candidates(words: Words, answers: pd.DataFrame, n: Ranges, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and two fingerprints of each window of span words that holds an anchor hit."""
    at, keys, _ = _anchors(words)
    distinct, _, number = _distinct(keys)
    hit = _told(answers, 0, distinct, ANCHOR_BITS, n)[number]
    hits = np.zeros(len(words.first) + 1, dtype=np.int64)
    hits[at[hit] + 1] = 1
    np.cumsum(hits, out=hits)
    start, first = words.windows(span)
    near = hits[start + span - BLOCK + 1] > hits[start]
    start = start[near]
    if not len(start):
        return start, first[:0], first[:0].astype(np.uint32)
    _, second = words.windows(span, SECOND_BASE)
    return start, first[near], (second[near] >> np.uint64(32)).astype(np.uint32)


def _by_both(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs sorted by the first, then the second value, whether they are there twice, and numbers as in _distinct."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    return a[heads], b[heads], np.diff(heads, append=len(order)) > 1, number


def _extend(n: Ranges, span: int):
    """A pack with its anchor answers to (bucket, pack, blob of fingerprints of the windows around hits)."""

    def run(packs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"bucket": pd.Series(dtype="int32"), "pack": pd.Series(dtype=str), "blob": pd.Series(dtype=object)})]
        for pack, blob in zip(packs["pack"], packs["blob"], strict=True):
            start, first, second = _candidates(words_of(_unpack(blob)[1]), answers, n, span)
            if len(start):
                a, b, twice, _ = _by_both(first, second)
                out.append(_sent(pack, n, a, 64, b, twice.astype(np.uint8)).to_pandas())
        return pd.concat(out, ignore_index=True)

    return run


def _finish(n: Ranges, span: int):
    """A pack with all answers to its documents: id, words, words removed, removed ranges, what is left."""

    def run(packs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for blob in packs["blob"]:
            ids, texts = _unpack(blob)
            words = words_of(texts)
            start, first, second = _candidates(words, answers, n, span)
            if len(start):
                a, _, _, number = _by_both(first, second)
                start = start[_told(answers, 1, a, 64, n)[number]]
            change = np.zeros(len(words.first) + 1, dtype=np.int64)
            np.add.at(change, start, 1)
            np.add.at(change, start + span, -1)
            gone = np.cumsum(change)[:-1] > 0
            for i, doc in enumerate(ids.tolist()):
                a, b = words.doc_first[i], words.doc_first[i + 1]
                mine, kept, ranges = gone[a:b], texts[i], []
                if mine.any():
                    edges = np.flatnonzero(np.diff(mine.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                    ranges = edges.tolist()
                    keep = np.concatenate([[0], edges.ravel(), [b - a]]).reshape(-1, 2)
                    kept = b" ".join(words.data[words.first[a + s] : words.last[a + e - 1]].tobytes() for s, e in keep.tolist() if e > s)
                rows.append((None if doc == -(2**63) else doc, int(b - a), int(mine.sum()), ranges, kept))
        return pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "removed", "kept"]).astype({"doc_id": "Int64"})

    return run


def _repeats(docs: DataFrame, span: int) -> tuple[DataFrame, DataFrame, Ranges]:
    """Packs, answers to all their questions, and the buckets."""
    if span < 2 * BLOCK - 1:
        raise ValueError(f"span must be {2 * BLOCK - 1} words at least")
    parts = parts_for(docs, BUCKET)
    n = Ranges.of(max(parts, -(-input_bytes(docs) // BUCKET)))
    packs = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_pack, "pack string, blob binary")
    packs = lay_out(packs, parts, "pack")
    n_packs = packs.count() if n.wide > 1 else 0
    sent = packs.mapInArrow(_probe(n), "bucket int, pack string, blob binary")
    hits = _answered(sent, n, parts, 0, ANCHOR_BITS, n_packs)
    wide = packs.groupBy("pack").cogroup(hits.groupBy("pack")).applyInPandas(_extend(n, span), "bucket int, pack string, blob binary")
    return packs, hits.unionByName(_answered(wide, n, parts, 1, 64, n_packs)), n


def remove_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Cut repeated passages out of every document: doc_id, n_words, n_removed, removed, kept.

    A word goes if it lies in a window of `span` consecutive words that also starts anywhere else, in the same
    document or another; all occurrences go, and windows are judged on the input. Words are what stands between
    spaces and characters 9 to 13; removed has maximal repeats as [first word, end) ranges; kept has the other words,
    joined by single spaces. Windows are compared by 96-bit fingerprints.

    A null text has no words; rows that repeat a document of `span` words or more lose everything; shorter texts
    lose nothing; null or repeated doc_ids are judged as rows of their own; extra columns are ignored; an empty
    table gives an empty result.
    """
    packs, answers, n = _repeats(docs, span)
    schema = "doc_id bigint, n_words bigint, n_removed bigint, removed array<array<bigint>>, kept string"
    return packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInPandas(_decoded(_finish(n, span)), schema)


def _decoded(run):
    def decode(packs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = run(packs, answers)
        out["kept"] = [k.decode("utf-8", "replace") for k in out["kept"]]
        return out

    return decode


def _hashed(run):
    def digest(packs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = run(packs, answers)
        out["kept_sha256"] = [hashlib.sha256(k).hexdigest() for k in out["kept"]]
        return out[["doc_id", "n_words", "n_removed", "kept_sha256"]]

    return digest


def op1_query(spark, sf_dir: str) -> DataFrame:
    """op1: what is left of every document, as counts and a hash, which is taken where the words are."""
    packs, answers, n = _repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), SPAN)
    return packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInPandas(_hashed(_finish(n, SPAN)), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


#: Windows as whole word sequences: the same result by comparing every window with every other.
OP1_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT r, p, md5(array_to_string(w[p:p + {SPAN - 1}], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - {SPAN - 2})) AS p FROM docs)
), twice AS (
  SELECT h FROM windows GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT r, unnest(range(p, p + {SPAN})) AS p FROM windows JOIN twice USING (h)
), words AS (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM docs
), left_over AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id::BIGINT AS doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN left_over USING (r)
"""
