"""Words and word windows of many texts at once, as numpy arrays of digests."""

from __future__ import annotations

import hashlib

import numpy as np

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Words of at most so many bytes are digested from two integers that hold them, longer ones by BLAKE2b.
SHORT = 15
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Odd numbers without meaning, for the two halves of a digest.
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of unsigned 64-bit integers, one to one, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _digested(low: np.ndarray, high: np.ndarray, a: np.uint64, b: np.uint64) -> np.ndarray:
    """64 bits of pairs of integers. Adding what was mixed makes each step one-way: no partner can be computed for a pair."""
    first = mix(low * a + b) + low
    return mix(first * b + high) + high


def _joined(x: np.ndarray, y: np.ndarray, shift: int) -> np.ndarray:
    """A digest of x at each place and of y `shift` places on; at the last places, of x alone."""
    out = x * _ODD[0]
    if shift < len(y):
        out[: len(y) - shift] += y[shift:]
    return mix(out)


class Words:
    """The words of some texts, text after text; text i has words first[i] ... first[i+1]-1, counts[i] of them."""

    def __init__(self, raws: list[bytes], lower: bool = False):
        data = b" ".join([b"", *raws, bytes([32]) * 16])
        if lower:
            data = data.lower()  # of bytes: A-Z alone
        joined = np.frombuffer(data, np.uint8)
        space = SPACE[joined]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts, ends = edge[::2], edge[1::2]
        offsets = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1) if raws else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.searchsorted(starts, offsets)]).astype(np.int64)
        self.counts = np.diff(self.first)
        size = ends - starts
        eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))  # the eight bytes from each byte on
        low = eight[starts] & _MASKS[np.minimum(size, 8)]
        high = eight[np.minimum(starts + 8, len(data) - 8)] & _MASKS[np.clip(size - 8, 0, 7)]
        high |= size.astype(np.uint64) << np.uint64(56)
        self._pairs = low, high
        self._long = np.flatnonzero(size > SHORT)
        places = zip(starts[self._long].tolist(), ends[self._long].tolist(), strict=True)
        self._digests = np.frombuffer(b"".join([hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in places]), "<u8").reshape(-1, 2)

    def __len__(self) -> int:
        return len(self._pairs[0])

    def half(self, which: int) -> np.ndarray:
        """One half of the digest of every word."""
        out = _digested(*self._pairs, _ODD[2 * which], _ODD[2 * which + 1])
        out[self._long] = self._digests[:, which]
        return out

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, size: int, half: int = 0) -> np.ndarray:
        """A digest of the size words from each word on, also where they run into the next text; see whole().

        Blocks of 1, 2, 4 ... words are joined to `size` of them. No step is linear in the words, and both halves
        together are 128 bits.
        """
        block, made, done, width = self.half(half), None, 0, 1
        while width <= size:
            if size & width:
                made = block if made is None else _joined(made, block, done)
                done += width
            if 2 * width <= size:
                block = _joined(block, block, width)
            width *= 2
        return made

    def whole(self, size: int) -> np.ndarray:
        """Whether the size words from each word on are of one text."""
        inside = np.ones(len(self), bool)
        last, first = self.first[1:], self.first[:-1]
        for j in range(1, size):
            inside[(last - j)[last - j >= first]] = False
        return inside
