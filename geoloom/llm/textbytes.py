"""Vectorised text work on Arrow batches: bytes, words, n-gram hashes.

A batch of texts is one uint8 array plus offsets. Words are maximal runs of bytes outside 0x20 and
0x09-0x0D, which equals the code-point rule because those are ASCII. Hashes of substrings come from one
prefix sum of a polynomial modulo 2**64; equal strings have equal hashes, different ones collide with
probability about 2**-64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
CHUNK_BYTES = 4 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (the splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, BASE, U64)
    down = np.full(size, pow(BASE, -1, 1 << 64), U64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_kept = _powers(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n; kept for the process and grown to one more than a power of two (a chunk of so many
    bytes needs that), so that small chunks need a small table (the driver, which only fits models, keeps it as well)."""
    global _kept
    if n > len(_kept[0]):
        _kept = _powers((1 << max(0, n - 2).bit_length()) + 1)
    return _kept[0][:n], _kept[1][:n]


def forget_powers() -> None:
    global _kept
    _kept = _powers(1)


class Texts:
    """Some whole texts of a batch: ``data`` their bytes, ``at`` the offsets (one more than texts)."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at = data, at
        self.n = len(at) - 1

    def lowered(self) -> "Texts":
        return Texts(LOWER[self.data], self.at)

    def words(self) -> "Words":
        return Words(self)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value per byte over each text."""
        total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
        np.cumsum(values, out=total[1:])
        return total[self.at[1:]] - total[self.at[:-1]]

    def prefix(self) -> np.ndarray:
        up, _ = powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, U64)
        np.cumsum((self.data.astype(U64) + U64(1)) * up[:-1], out=total[1:])
        return total

    def hashes(self, start: np.ndarray, end: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
        """One well-mixed 64-bit hash for each byte range; empty ranges hash alike."""
        prefix = self.prefix() if prefix is None else prefix
        _, down = powers(len(self.data) + 1)
        return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64))


class Words:
    """Where the words of some texts lie: byte ranges, and ``first``: index of each text's first word."""

    def __init__(self, texts: Texts):
        inside = ~SPACE[texts.data]
        size = len(inside)
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        bounds = texts.at[1:-1]
        bounds = bounds[(bounds > 0) & (bounds < size)]
        opens[bounds] = inside[bounds]
        closes[bounds - 1] = inside[bounds - 1]
        self.texts = texts
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, texts.at)
        self.counts = np.diff(self.first)
        self._hash: np.ndarray | None = None

    def hashes(self) -> np.ndarray:
        """One hash a word, taken in pieces of whole words, so that a very long text needs no longer table of powers than
        its longest word."""
        if self._hash is None:
            self._hash = np.zeros(len(self.start), U64)
            at = 0
            while at < len(self.start):
                from_byte = self.start[at]
                to = max(at + 1, int(np.searchsorted(self.end, from_byte + CHUNK_BYTES, "right")))
                piece = Texts(self.texts.data[from_byte : self.end[to - 1]], self.texts.at[:0])
                self._hash[at:to] = piece.hashes(self.start[at:to] - from_byte, self.end[at:to] - from_byte)
                at = to
        return self._hash

    def windows(self, k: int) -> np.ndarray:
        """The hash of the k words from each word on; those that leave their text mean nothing."""
        words = self.hashes()
        out = np.zeros(len(words), U64)
        for j in range(k):
            out[: len(words) - j] += words[j:] * U64(pow(BASE, 2 * j + 1, 1 << 64))
        return mix(out)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts.n), self.counts)


def chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(from row, to row, their texts): whole texts, together at most max_bytes unless one alone is longer.
    Nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + max_bytes, "right")) - 1)
        to = min(to, len(column))
        yield row, to, Texts(data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row])
        row = to
