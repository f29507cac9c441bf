"""Byte-level BPE by merge ranks: encoding in padded numpy matrices, and decoding.

Words (the matches of the pattern) that aren't yet known are put in matrices by length, one word a row. In each round
every row merges its leftmost pair of least rank; pairs are looked up in a hash table of numpy arrays; rows without a
pair to merge leave the matrix, which is then compacted. Words longer than LONG bytes, for which whole-row rounds
would take quadratic time, do the same merges in the same order from a heap.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from eventloom.llm.common import with_columns_from_text

#: Words longer than this many bytes merge from a heap.
LONG = 512
#: Parts of texts that a worker remembers at most, and the longest, in characters, that it remembers.
REMEMBERED, REMEMBERED_CHARS = 500_000, 64
#: Cells of a matrix at most.
CELLS = 1 << 18
NONE = np.int32(2**31 - 1)
#: Finds a blank before white space or at the end.
ODD_BLANK = re.compile(r" (?:\s|\Z)").search


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and a number."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class PairTable:
    """(left id, right id) -> id of the merged token: open addressing over numpy arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        bits = max(4, (4 * max(1, len(pairs)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ids = np.full(1 << bits, NONE, np.int32)
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        ids = np.fromiter(pairs.values(), np.int32, len(pairs))
        place = self._place(keys)
        while len(keys):
            free = self.keys[place] == -1
            slots, first = np.unique(place[free], return_index=True)
            took = np.flatnonzero(free)[first]
            self.keys[slots], self.ids[slots] = keys[took], ids[took]
            rest = np.ones(len(keys), bool)
            rest[took] = False
            keys, ids, place = keys[rest], ids[rest], place[rest] + 1 & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged ids, NONE where a pair doesn't merge; negative ids merge with nothing."""
        shape = left.shape
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        place = self._place(keys)
        held = self.keys[place]
        out = np.where(held == keys, self.ids[place], NONE)
        out[keys < 0] = NONE
        open_ = np.flatnonzero((held != keys) & (held != -1) & (keys >= 0))
        while len(open_):
            place[open_] = place[open_] + 1 & self.mask
            held = self.keys[place[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.ids[place[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        return out.reshape(shape)


class BytePairs:
    """Encoder and decoder for one rank table and one pattern. ids are ranks; there are no special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.tokens: dict[int, bytes] = {i: b for b, i in ranks.items()}
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the ranks lack {len(missing)} single bytes")
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = {(ranks[t[:i]], ranks[t[i:]]): n for t, n in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.table = PairTable(self.pairs)
        self.known: dict[str, bytes] = {}
        self.spaced_split = r" ?\p{L}+" in pattern and r"\s+(?!\S)" in pattern

    def _matrix(self, words: list[bytes], width: int) -> list[bytes]:
        """The ids, as little-endian bytes, of words with at most width bytes."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        inside = np.arange(width) < lengths[:, None]
        ids = np.full((n, width), -1, np.int32)
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        rank = self.table(ids[:, :-1], ids[:, 1:])
        final, size = ids.copy(), lengths.copy()
        rows = np.arange(n)
        while len(rows):
            at = rank.argmin(1)
            every = np.arange(len(rows))
            least = rank[every, at]
            going = least != NONE
            if not going.all():  # compaction: rows that are done leave
                done = ~going
                final[rows[done], : ids.shape[1]] = ids[done]
                size[rows[done]] = (ids[done] >= 0).sum(1)
                ids, rank, rows, at, least = ids[going], rank[going], rows[going], at[going], least[going]
                every = np.arange(len(rows))
                if not len(rows):
                    break
            columns = np.arange(ids.shape[1] - 1)
            moved = columns + (columns > at[:, None])
            merged = np.take_along_axis(ids, moved, 1)
            merged[every, at] = least
            ids = merged
            if ids.shape[1] == 1:
                final[rows, :1], size[rows] = ids, 1
                break
            columns = columns[:-1]
            rank = np.take_along_axis(rank, columns + (columns > at[:, None]), 1)
            right = np.minimum(at, ids.shape[1] - 2)
            rank[every, right] = np.where(at == right, self.table(ids[every, right], ids[every, right + 1]), rank[every, right])
            left = np.maximum(at - 1, 0)
            rank[every, left] = np.where(at > 0, self.table(ids[every, left], ids[every, left + 1]), rank[every, left])
        flat = final[np.arange(width) < size[:, None]].astype("<u4").tobytes()
        ends = (4 * np.cumsum(size)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _heap(self, word: bytes) -> bytes:
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n, pairs = len(ids), self.pairs
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(pairs[p], i, *p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in pairs]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] >= 0 and (p := (ids[left], ids[after[left]])) in pairs:
                    heapq.heappush(heap, (pairs[p], left, *p))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers; a word that is a token is that token."""
        out: dict[str, bytes] = {}
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            raw = word.encode()
            if (whole := self.ranks.get(raw)) is not None:
                out[word] = whole.to_bytes(4, "little")
            elif len(raw) > LONG:
                out[word] = self._heap(raw)
            else:
                n = len(raw)
                step = 1 << max(0, n.bit_length() - 3)
                by_width.setdefault(-(-n // step) * step, []).append((word, raw))
        for width, pairs in by_width.items():
            rows = max(1, CELLS // width)
            for i in range(0, len(pairs), rows):
                some = pairs[i : i + rows]
                out.update(zip([w for w, _ in some], self._matrix([r for _, r in some], width), strict=True))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers.

        With spaced_split, matches of the pattern never reach over the place before a blank that stands before something
        other than white space. Texts are then cut at these places, and what stands between two blanks is remembered
        with its ids; a text with other blanks, and one's first part, go through the pattern as they are.
        """
        cut = [t.split(" ") if self.spaced_split and not ODD_BLANK(t) else None for t in texts]
        whole = [self.split(t if parts is None else parts[0]) for t, parts in zip(texts, cut, strict=True)]
        seen = set().union(*[parts[1:] for parts in cut if parts])
        new = list(seen.difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, list(seen)
        split = [self.split(" " + part) for part in new]
        words = self.encode_words(list(set().union(*whole, *split)))
        self.known.update(zip(new, [b"".join(map(words.__getitem__, x)) for x in split], strict=True))
        known = self.known.__getitem__
        out = [b"".join(map(words.__getitem__, x)) + (b"".join(map(known, parts[1:])) if parts else b"") for x, parts in zip(whole, cut, strict=True)]
        for part in [x for x in new if len(x) > REMEMBERED_CHARS]:
            del self.known[part]
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids; KeyError for an id that isn't in the vocabulary."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


#: Coders of this process, by rank file and pattern.
_CODERS: dict[tuple[str, str], BytePairs] = {}


def coder(ranks_path: str, pattern: str) -> BytePairs:
    if (ranks_path, pattern) not in _CODERS:
        with open(ranks_path, "rb") as file:
            _CODERS[ranks_path, pattern] = BytePairs(read_ranks(file), pattern)
    return _CODERS[ranks_path, pattern]


OUTPUTS: dict[str, tuple[T.DataType, Callable[[bytes, bytes], object]]] = {
    "ids": (T.ArrayType(T.IntegerType()), lambda ids, raw: np.frombuffer(ids, "<u4").astype(np.int32)),
    "decoded": (T.BinaryType(), lambda ids, raw: raw),
    "n_tokens": (T.LongType(), lambda ids, raw: len(ids) // 4),
    "ids_sha256": (T.StringType(), lambda ids, raw: hashlib.sha256(ids).hexdigest()),
    "decoded_sha256": (T.StringType(), lambda ids, raw: hashlib.sha256(raw).hexdigest()),
}


def token_columns(df: DataFrame, text: str, ranks_path: str, pattern: str, outputs: tuple[str, ...] = ("ids", "n_tokens"), keep: list[str] | None = None) -> DataFrame:
    """Adds ids (array of token ids), decoded (the bytes that the ids stand for), n_tokens and their SHA-256, as named in outputs.

    Every whole text is split by pattern, each match is encoded by itself and nothing is a special token. The rank file
    is a part of the installed tokenizer package, at the same path on every machine. A null text counts as empty and
    has no tokens; a very long word takes time in proportion to n log n; equal texts have equal ids; repeated rows
    stay; an empty table stays empty; columns named as an output are replaced.
    """
    if unknown := set(outputs) - set(OUTPUTS):
        raise ValueError(f"no such outputs: {sorted(unknown)}")
    decodes = bool({"decoded", "decoded_sha256"} & set(outputs))

    def make():
        bpe = coder(ranks_path, pattern)

        def apply(values: pa.Array) -> list:
            ids = bpe.encode([x or "" for x in values.to_pylist()])
            raws = [bpe.decode(x) for x in ids] if decodes else ids
            return [[OUTPUTS[o][1](i, r) for i, r in zip(ids, raws, strict=True)] for o in outputs]

        return apply

    return with_columns_from_text(df, text, [T.StructField(o, OUTPUTS[o][0]) for o in outputs], make, keep)


def decoded_column(df: DataFrame, ids: str, ranks_path: str, pattern: str, into: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Adds the bytes that an array column of token ids stands for. Null ids: null. An unknown id fails the task."""
    def make():
        tokens = coder(ranks_path, pattern).tokens
        return lambda values: [[None if x is None else b"".join(map(tokens.__getitem__, x)) for x in values.to_pylist()]]

    return with_columns_from_text(df, ids, [T.StructField(into, T.BinaryType())], make, keep)
