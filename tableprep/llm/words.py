"""Words of many texts at once, as hashes in numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes of text that are looked at, and that are hashed, at a time, or one text if that is longer.
PIECE, HASHED = 1 << 20, 1 << 18

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# A word is a polynomial over its bytes modulo 2**64, then mixed.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
SHINGLE_FACTOR = 0xD6E8FEB86659FD93


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ np.uint64(salt & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mixed(np.arange(1, 257, dtype=np.uint64))


def powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass
class Words:
    """Hashes of the words of some texts, and where the words of each text start; ``first[-1]`` is their number."""

    hashes: np.ndarray
    first: np.ndarray


class Hasher:
    """Keeps the powers between pieces."""

    def __init__(self) -> None:
        self.up, self.down = powers(FACTOR, HASHED), powers(INVERSE, HASHED)

    def words(self, texts: list[bytes]) -> Words:
        """ASCII letters in lower case; words end at the space and U+0009 to U+000D."""
        data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        if len(data) > len(self.up):
            self.up, self.down = powers(FACTOR, len(data)), powers(INVERSE, len(data))
        solid = ~BLANK[data]
        edges = np.flatnonzero(solid[1:] != solid[:-1]) + 1
        start, stop = edges[::2], edges[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[LOWER[data]] * self.up[: len(data)], out=sums[1:])
        hashes = mixed((sums[stop] - sums[start]) * self.down[start])
        ends = np.cumsum([len(x) + 1 for x in texts])
        first = np.concatenate(([0], np.searchsorted(start, ends)))
        return Words(hashes, first)

    def shingles(self, texts: list[bytes], width: int) -> Iterator[np.ndarray]:
        """The set of shingles of each text, sorted; with fewer words the whole sequence is one."""
        words = self.words(texts)
        factors = powers(SHINGLE_FACTOR, width)
        n = max(0, len(words.hashes) - width + 1)
        rows = np.zeros(n, np.uint64)
        for i in range(width):
            rows += words.hashes[i : i + n] * factors[i]
        rows = mixed(rows, width)
        for a, b in zip(words.first[:-1], words.first[1:], strict=True):
            if b - a >= width:
                yield np.unique(rows[a : b - width + 1])
            elif b > a:
                whole = words.hashes[a:b] * factors[: b - a]
                yield mixed(whole.sum(dtype=np.uint64, keepdims=True), int(b - a))
            else:
                yield rows[:0]


def pieces(texts: list[bytes], most: int = PIECE) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``most`` bytes, or one longer text, with the place of the first one."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, texts[start:]
