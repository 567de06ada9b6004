"""Vectorised work on the bytes of many texts at once, for use inside Arrow tasks.

A slice of texts becomes one byte buffer. Prefix sums of a polynomial hash modulo 2**64 give the hash of any
substring in constant time, so words, shingles and byte windows are hashed without a Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _power(kind: str, n: int) -> np.ndarray:
    """Powers of the base or of its inverse, grown on demand."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n).bit_length())
        step = np.full(size, BASE if kind == "up" else _INVERSE, np.uint64)
        step[0] = 1
        have = _powers[kind] = np.multiply.accumulate(step)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Hasher:
    """Hashes of substrings of one buffer."""

    def __init__(self, values: np.ndarray) -> None:
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * _power("up", len(values)), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal for equal substrings wherever they stand."""
        raw = (self.sums[end] - self.sums[start]) * _power("down", len(self.sums))[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def fixed(self, length: int) -> np.ndarray:
        """The hash of every substring of this length."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[length:] - self.sums[:n]) * _power("down", n))


def byte_hasher(buf: np.ndarray) -> Hasher:
    return Hasher(_TABLE[buf])


def point_hasher(points: np.ndarray) -> Hasher:
    return Hasher(mix(points.astype(np.uint64) + np.uint64(0x1234567)) | np.uint64(1))


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most so many bytes together; a longer text is a run of its own."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def text_slices(column, limit: int = 2_000_000) -> Iterator[tuple[int, int, list[bytes]]]:
    """From an Arrow string column: first row, end row and the texts as bytes (null: empty)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    binary = column.cast(pa.large_binary())
    for a, b in slices(sizes, limit):
        yield a, b, [x or b"" for x in binary.slice(a, b - a).to_pylist()]


class Words:
    """The words of many texts: runs of bytes other than space, tab, and the control characters up to CR."""

    def __init__(self, texts: list[bytes], lower: bool = False) -> None:
        self.n_texts = len(texts)
        buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        if lower:
            buf = LOWER[buf]
        self.buf = buf
        sizes = np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))
        self.text_end = np.cumsum(sizes) - 1
        self.text_start = self.text_end - sizes + 1
        blank = SPACES[buf]
        first = ~blank
        first[1:] &= blank[:-1]
        last = ~blank[:-1] & blank[1:]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.first_word = np.searchsorted(self.start, self.text_start)
        self.n_words = np.diff(np.append(self.first_word, len(self.start)))
        self.text = np.repeat(np.arange(self.n_texts), self.n_words)

    def hashes(self) -> np.ndarray:
        return byte_hasher(self.buf).of(self.start, self.end)


def shingles(words: np.ndarray, text: np.ndarray, n_words: np.ndarray, first_word: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word of every run of k words; a text with 1 to k - 1 words gives its whole sequence."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = np.zeros(max(n - k + 1, 0), np.uint64)
    for i in range(k if len(whole) else 0):
        whole = mix(whole * np.uint64(3) + words[i : i + len(whole)] + np.uint64(i + 1))
    at = np.flatnonzero(text[: len(whole)] == text[k - 1 :]) if len(whole) else np.zeros(0, np.int64)
    got, of = whole[at], text[at]
    for j in np.flatnonzero((n_words > 0) & (n_words < k)):
        x = np.zeros(1, np.uint64)
        for i in range(n_words[j]):
            x = mix(x * np.uint64(3) + words[first_word[j] + i : first_word[j] + i + 1] + np.uint64(i + 1))
        x = mix(x + np.uint64(k * 1000 + n_words[j]))
        got, of, at = np.append(got, x), np.append(of, j), np.append(at, first_word[j])
    return got, of, at


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
