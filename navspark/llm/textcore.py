"""Vectorised kernels over the byte buffers of Arrow string columns.

A column's texts lie in one buffer, so words, lines, n-grams and their 64-bit hashes are computed for
all texts of a slice at once. Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; every
byte of a multi-byte UTF-8 character lies outside that set, so byte and character words agree.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from navspark.llm.common import string_offsets

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
SPACES = (9, 10, 11, 12, 13, 32)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of the public SplitMix64 generator)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=U) * BASE)


#: Numbers of powers that a worker keeps.
KEPT = (258 << 10, 1025 << 10)


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(int(BASE), -1, 1 << 64)
    up, down = np.full(size, BASE, U), np.full(size, U(inverse), U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, from the exponent 0."""
    for kept in KEPT:
        if size <= kept:
            up, down = _powers(kept)
            return up[:size], down[:size]
    return _powers.__wrapped__(size)  # for one very long text; not kept


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts in them; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    offsets = string_offsets(column).astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """p with p[j] - p[i] = sum of code(byte) * BASE**position over i <= position < j."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_CODE[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings data[start:end], equal for equal strings."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(U))


class Words:
    """start, end: of each word in the buffer. first: words of text i are first[i]:first[i + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n, ink = len(data), ~IS_SPACE[data]
        opens, shuts = ink.copy(), ink.copy()
        if n:
            opens[1:] &= ~ink[:-1]
            shuts[:-1] &= ~ink[1:]
            filled = offsets[1:] > offsets[:-1]
            heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
            opens[heads], shuts[tails] = ink[heads], ink[tails]
        self.ink = ink
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(offsets) - 1), self.count)


def windows(words: Words, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of n words within a text, and the index of each one's first word."""
    if len(hashes) < n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    last = words.first[1:][words.text]
    at = np.flatnonzero(np.arange(len(hashes)) + n <= last)
    out = hashes[at]
    for k in range(1, n):
        out = out * BASE + hashes[at + k]
    return mix(out + U(n)), at


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]]."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
