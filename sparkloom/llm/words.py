"""Words of many texts as arrays: splitting and hashing without a Python object per word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Odd multipliers of the polynomial hashes, and one of their inverses modulo 2**64, by name.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1) modulo 2**64."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = ((n >> 18) + 1) << 18
        known = np.full(size, base & _MASK, dtype=np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        _POWERS[base] = known
    return known[:n]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for each range: equal for equal ranges wherever they stand.

    Prefix sums of value * base**i give the sum over a range; it is divided by base**start, base being odd.
    """
    n = len(values)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, n), out=sums[1:])
    out = sums[ends]
    out -= sums[starts]
    out *= powers(pow(base, -1, 1 << 64), n + 1)[starts]
    out += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(out)


@dataclass
class Words:
    """The words of a batch of texts, end to end.

    data: the words of all texts, single spaces between them and one more after each text. first and last: byte
    range of each word. doc_first: number of each text's first word, with one more entry for the end. hashes: of the words.
    """

    data: np.ndarray
    first: np.ndarray
    last: np.ndarray
    doc_first: np.ndarray
    hashes: np.ndarray

    def windows(self, size: int, base: int = WORD_BASE) -> tuple[np.ndarray, np.ndarray]:
        """(start word, hash) of every window of `size` consecutive words within one text."""
        n = len(self.first)
        if n < size:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        whole = np.ones(n - size + 1, dtype=bool)
        for end in self.doc_first[1:-1]:  # windows that begin in the last words of a text run into the next
            whole[max(0, end - size + 1) : end] = False
        at = np.flatnonzero(whole)
        return at, range_hashes(self.hashes, at, at + size, base)


def normal(text: bytes | None) -> bytes:
    """Words of a text joined by single spaces. bytes.split() splits at space and 9 to 13, and nothing else."""
    return b" ".join(text.split()) if text else b""


def words_of(texts: list[bytes], base: int = BYTE_BASE) -> Words:
    """Words of texts that normal() has made."""
    data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    counts = np.fromiter((t.count(b" ") + 1 if t else 0 for t in texts), dtype=np.int64, count=len(texts))
    doc_first = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(counts, out=doc_first[1:])
    last = np.flatnonzero(data == 32)
    first = np.empty_like(last)
    if len(last):
        first[0] = 0
        first[1:] = last[:-1] + 1
    full = last > first  # texts without a word leave empty ranges
    first, last = first[full], last[full]
    hashes = range_hashes(data.astype(np.uint64), first, last, base) if len(first) else np.empty(0, dtype=np.uint64)
    return Words(data, first, last, doc_first, hashes)
