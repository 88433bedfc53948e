"""Whole texts to token ids by way of their units, the strings between single spaces.

A slice's units are numbered by Arrow's dictionary encoding, so Python sees each distinct unit once. Ids of
units seen lately are remembered in two generations of bounded size; a text's ids are gathered from the
distinct units' ids by one vectorised lookup.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from navspark.llm.common import string_offsets


class Recent:
    """At most twice ``most`` values by key. When the new generation is full it becomes the old one; what is asked for again moves up."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def clear(self) -> None:
        self.new, self.old = {}, {}

    def put(self, key: str, value: bytes) -> None:
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[key] = value

    def look(self, keys: list[str]) -> tuple[list[bytes | None], list[int]]:
        """Each key's value or None, and where the Nones are."""
        out, missing, old = list(map(self.new.get, keys)), [], self.old
        for i, value in enumerate(out):
            if value is None:
                if (value := old.get(keys[i])) is None:
                    missing.append(i)
                else:
                    out[i] = value
                    self.put(keys[i], value)
        return out, missing


def gathered(blobs: list[bytes], sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids (little-endian unsigned 32-bit in blobs) of the units in sequence, and where each unit's end, from 0."""
    sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) >> 2
    flat = np.frombuffer(b"".join(blobs), np.uint32)
    begin = np.cumsum(sizes) - sizes
    lengths = sizes[sequence]
    ends = np.zeros(len(sequence) + 1, np.int64)
    np.cumsum(lengths, out=ends[1:])
    return flat[np.arange(ends[-1]) + np.repeat(begin[sequence] - ends[:-1], lengths)], ends


def words(texts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """The number of each unit, the distinct units, and the first unit of each text (and the end)."""
    split = pc.split_pattern(texts, " ")
    first = np.asarray(split.offsets).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    return coded.indices, coded.dictionary, first - first[0]


#: Latin letters, and marks that a tokenizer's split takes a run of behind them.
LETTERS, MARKS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$", ".,;:!?"


def parted(units: pa.Array, fold: bool = False, marks: str = MARKS) -> tuple[pa.Array, list[str], list[str], np.ndarray, np.ndarray]:
    """Units of letters and the marks behind them, and other ones: distinct letters, others, distinct marks, and each unit's two parts.

    The first part counts in letters + others; the second in the marks, of which the first is none. With ``fold``
    the letters are lower-cased. ``marks`` names ASCII characters.
    """
    letters = pc.utf8_rtrim(units, marks)
    easy = np.asarray(pc.match_substring_regex(letters, LETTERS), dtype=bool)
    hard = np.flatnonzero(~easy)
    plain = letters.filter(pa.array(easy))
    coded = (pc.utf8_lower(plain) if fold else plain).dictionary_encode()
    front, back = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
    front[easy] = np.asarray(coded.indices)
    front[hard] = len(coded.dictionary) + np.arange(len(hard))
    width = np.asarray(pc.subtract(pc.binary_length(units), pc.binary_length(letters))).astype(np.int64)
    data, ends = np.frombuffer(units.buffers()[2] or b"", np.uint8), string_offsets(units)[1:]
    one, more = easy & (width == 1), np.flatnonzero(easy & (width > 1))
    tails = {"": 0} | {mark: k + 1 for k, mark in enumerate(marks)}
    place = np.zeros(256, np.int64)
    place[list(marks.encode())] = np.arange(len(marks)) + 1
    back[one] = place[data[ends[one] - 1]]
    back[more] = [tails.setdefault(u[-w:], len(tails)) for u, w in zip(units.take(pa.array(more)).to_pylist(), width[more].tolist(), strict=True)]
    return coded.dictionary, units.take(pa.array(hard)).to_pylist(), list(tails), front, back


def filled(texts: pa.Array) -> pa.Array:
    """Null texts as empty ones."""
    return pc.fill_null(texts, "") if texts.null_count else texts
