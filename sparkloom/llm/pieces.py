"""Byte-level BPE of many texts: the tokenizer's own model is asked once for each distinct piece of text."""

from __future__ import annotations

import json
from functools import cache

import numpy as np

from .words import range_hashes

LETTER, NUMBER, OTHER, BLANK, END, UNKNOWN = 0, 1, 2, 3, 4, 255
#: Pieces that a worker remembers, about 50 bytes each; then it starts over.
MOST_PIECES = 2_000_000
PIECE_BASE = 0x8CB92BA72F3D8DD7


class PieceTokenizer:
    """Ids as Tokenizer.encode(text, add_special_tokens=False) gives them.

    For files with the common byte-level pre-tokenizer and a BPE model. Its pieces (runs of letters, of numbers or of
    other signs, each with a space before it, blanks, and the endings 's 't 're 've 'm 'll 'd) are found with array
    operations; what class a character has is asked from the pre-tokenizer itself. The ids of a piece don't
    depend on what is around it. Texts that hold the string of an added token, as few do, go through the tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made_of = json.loads(self.tokenizer.to_str())
        splits, model = made_of["pre_tokenizer"] or {}, made_of["model"]
        plain = splits.get("type") == "ByteLevel" and splits.get("use_regex", True) and not splits.get("add_prefix_space")
        whole = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        if not (plain and whole) or made_of["normalizer"] or made_of["truncation"]:
            raise ValueError(f"{path} isn't a byte-level BPE with the common split into words")
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.classes = np.full(0x110000, UNKNOWN, dtype=np.uint8)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow 255
        rest = iter(range(256, 512))
        self.signs = [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]
        self._forget()

    def _forget(self) -> None:
        self.keys = np.empty(0, dtype=np.uint64)
        self.place = np.empty(0, dtype=np.int64)
        self.length = np.empty(0, dtype=np.int64)
        self.ids = np.empty(0, dtype=np.uint32)

    def _class(self, c: str) -> int:
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for kind, sign in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            if len(split(sign + c)) == 1:
                return kind
        return BLANK

    def _starts(self, points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Where pieces begin, and each text's end."""
        before = np.concatenate([[END], kinds[:-1]]).astype(np.uint8)
        after = np.concatenate([kinds[1:], [END]]).astype(np.uint8)
        blank = kinds == BLANK
        space = points == 32
        prior_space = np.concatenate([[False], space[:-1]])
        begin = kinds != before
        begin &= blank | (kinds == END) | ~prior_space  # a space goes with what follows it
        begin |= (kinds == END) | (before == END)
        # The last of several blanks stands alone, or with what follows, unless the text ends.
        begin |= blank & (before == BLANK) & (after != BLANK) & (after != END)
        quote = np.flatnonzero((points == 39) & begin & (kinds == OTHER) & (after == LETTER))
        if len(quote):
            one = points[quote + 1]
            two = points[np.minimum(quote + 2, len(points) - 1)]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            for which, size in ((short, 2), (long & ~short, 3)):
                at = quote[which]
                begin[at + 1] = False
                then = at + size
                begin[then[kinds[then] == LETTER]] = True
        return np.flatnonzero(begin)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and how many each has."""
        special = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        if not special:
            return self._encode(texts)
        plain = list(texts)
        for i in special:
            plain[i] = ""
        ids, counts = self._encode(plain)
        lists = [e.ids for e in self.tokenizer.encode_batch([texts[i] for i in special], add_special_tokens=False)]
        length = [len(x) for x in lists]
        ids = np.insert(ids, np.repeat(np.cumsum(counts)[special], length), np.array([i for x in lists for i in x], dtype=np.uint32))
        counts[special] = length
        return ids, counts

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "\0".join([*texts, ""])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        kinds = self.classes[points]
        if (kinds == UNKNOWN).any():
            for p in np.unique(points[kinds == UNKNOWN]).tolist():
                self.classes[p] = self._class(chr(p))
            kinds = self.classes[points]
        kinds[ends] = END
        bounds = self._starts(points, kinds)
        real = kinds[bounds] != END
        stops = np.append(bounds[1:], len(points))[real]
        starts = bounds[real]
        keys = range_hashes(points.astype(np.uint64), starts, stops, PIECE_BASE)
        known, first, number = np.unique(keys, return_index=True, return_inverse=True)
        slot = self._slots(known, joined, starts[first], stops[first])[number]
        length = self.length[slot]
        total = np.cumsum(length)
        ids = self.ids[np.arange(total[-1] if len(total) else 0) - np.repeat(total - length - self.place[slot], length)]
        upto = np.concatenate([[0], total])[np.searchsorted(starts, ends)]
        return ids, np.diff(upto, prepend=0)

    def _slots(self, keys: np.ndarray, joined: str, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Where each of the sorted keys is remembered, after learning those that aren't."""
        if len(self.keys) > MOST_PIECES:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        new = np.flatnonzero((at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != keys) if len(self.keys) else np.ones(len(keys), dtype=bool))
        if len(new):
            signs, tokenize = self.signs, self.model.tokenize
            lists = [[t.id for t in tokenize("".join([signs[b] for b in joined[s:e].encode("utf-8", "surrogatepass")]))] for s, e in zip(starts[new].tolist(), stops[new].tolist(), strict=True)]
            length = np.array([len(x) for x in lists], dtype=np.int64)
            place = len(self.ids) + np.cumsum(length) - length
            self.ids = np.concatenate([self.ids, np.array([i for x in lists for i in x], dtype=np.uint32)])
            where = at[new]
            self.keys, self.place, self.length = np.insert(self.keys, where, keys[new]), np.insert(self.place, where, place), np.insert(self.length, where, length)
            at = np.searchsorted(self.keys, keys)
        return at


@cache
def tokenizer_for(path: str) -> PieceTokenizer:
    """One for each worker and file."""
    return PieceTokenizer(path)
