"""Hashed subword embeddings with a linear softmax, trained in numpy.

A word w is the bag of the character n-grams of "<w>" and, if it has at most LONG characters, of "<w>" as a whole, each hashed to a row of
an embedding table; longer runs (text without spaces) are read whole through their n-grams. All words of a text are hashed at
once: n-grams are polynomials of code points, rolled over the text, so there is no cache of words. Because the softmax is linear,
scoring a text is averaging rows.
"""

from __future__ import annotations

import re

import numpy as np

#: Hash buckets (a power of two), embedding width, lengths of the character n-grams.
BUCKETS, WIDTH, GRAMS = 1 << 16, 8, (2, 3, 4)
#: Characters of the longest run that also counts as a word; words hashed at a time; rows of a table summed at a time.
LONG, CHUNK_WORDS, CHUNK_ROWS = 40, 20_000, 1 << 17

_WORDS = re.compile(r"[^\W_]+")
_FACTOR, _TAG = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_POWERS = np.array([pow(_FACTOR, i, 1 << 64) for i in range(LONG + 2)], np.uint64)


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return _WORDS.findall(text.lower())


def _bucket(h: np.ndarray, length: int, buckets: int) -> np.ndarray:
    h = h ^ np.uint64(length * _TAG & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_TAG)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_FACTOR)
    return (h >> np.uint64(65 - buckets.bit_length())).astype(np.int64)


def grams(words: list[str], lengths: tuple[int, ...] = GRAMS, buckets: int = BUCKETS, owned: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """The buckets of all words, and if owned for each bucket the number of its word."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer(f"<{'><'.join(words)}>".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(codes))  # characters of the word from each place on
    of = np.repeat(np.arange(len(words)), sizes) if owned else None
    whole = np.add.reduceat(codes * _POWERS[np.minimum(left - 1, LONG + 1)], ends - sizes)
    short = sizes <= LONG + 2
    rows, owners = [_bucket(whole[short], 0, buckets)], [np.flatnonzero(short)]
    rolled = codes
    for k in range(2, max(lengths) + 1):
        rolled = rolled[:-1] * np.uint64(_FACTOR) + codes[k - 1 :]
        if k in lengths:
            inside = left[: len(rolled)] >= k
            rows.append(_bucket(rolled[inside], k, buckets))
            if owned:
                owners.append(of[: len(rolled)][inside])
    return np.concatenate(rows), np.concatenate(owners) if owned else None


def summed(table: np.ndarray, words: list[str], lengths: tuple[int, ...] = GRAMS) -> tuple[np.ndarray, int]:
    """The sum of the rows of all words of a text, and their number; table has 32-bit floats."""
    total, n = np.zeros(table.shape[1:], np.float64), 0
    for i in range(0, len(words), CHUNK_WORDS):
        rows = grams(words[i : i + CHUNK_WORDS], lengths, len(table))[0]
        n += len(rows)
        for k in range(0, len(rows), CHUNK_ROWS):
            found = table.take(rows[k : k + CHUNK_ROWS], 0)
            total += np.ones(len(found), np.float32) @ found
    return total, n


class Bags:
    """Bags of buckets laid end to end, each bucket with how often it comes: rows, their bags in order, and times."""

    def __init__(self, rows: np.ndarray, of: np.ndarray, times: np.ndarray | None = None) -> None:
        self.rows, self.of = rows.astype(np.int32), of
        self.times = np.ones(len(rows)) if times is None else times.astype(float)
        self.counts = np.bincount(of, self.times)
        self.firsts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))

    def sums(self, table: np.ndarray) -> np.ndarray:
        """By bag, the sum of its rows of a table of one or two dimensions."""
        return np.add.reduceat(table[self.rows] * (self.times if table.ndim == 1 else self.times[:, None]), self.firsts, axis=0)

    def mean(self, table: np.ndarray) -> np.ndarray:
        return self.sums(table) / (self.counts if table.ndim == 1 else self.counts[:, None])


class Adam:
    def __init__(self, rate: float) -> None:
        self.rate, self.state, self.t = rate, {}, 0

    def step(self, **params) -> None:
        """params: name=(array, gradient); arrays change in place."""
        self.t += 1
        for name, (x, g) in params.items():
            m, v = self.state.setdefault(name, (np.zeros_like(x), np.zeros_like(x)))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)
