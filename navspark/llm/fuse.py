"""A static approximate-membership filter: three-wise binary fuse with 16-bit fingerprints.

Construction peels keys in rounds: all slots that hold exactly one key give theirs up together, and the
rounds are undone in reverse. A query reads three slots, and a key of the set is never denied.
"""

from __future__ import annotations

import struct

import numpy as np

from navspark.llm.textcore import U, mix

HEAD = struct.Struct("<QII")


def _geometry(n: int) -> tuple[int, int]:
    """Segment length (a power of two) and number of segments for n keys."""
    if n <= 1:
        return 4, 3
    length = 1 << min(18, int(np.floor(np.log(n) / np.log(3.33) + 2.25)))
    size = int(np.ceil(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))))
    return length, max(3, -(-size // length) + 2)


def _slots(keys: np.ndarray, seed: int, length: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(keys ^ mix(np.array([seed], U)))
    first = ((h >> U(32)) * U(segments - 2) >> U(32)) * U(length)
    low = mix(h + U(1))
    inside = [(low >> U(20 * k)) & U(length - 1) for k in range(3)]
    return np.stack([first + U(length * k) + inside[k] for k in range(3)]).astype(np.int64), (h & U(0xFFFF)).astype(np.uint16)


def build(keys: np.ndarray) -> bytes:
    """A filter over the distinct 64-bit keys."""
    keys = np.unique(keys.astype(U))
    length, segments = _geometry(len(keys))
    for seed in range(1, 200):
        slots, prints = _slots(keys, seed, length, segments)
        size = length * segments
        count = np.zeros(size, np.int32)
        which = np.zeros(size, np.int64)  # the exclusive or of the indices of the keys in a slot
        index = np.arange(len(keys))
        for k in range(3):
            np.add.at(count, slots[k], 1)
            np.bitwise_xor.at(which, slots[k], index)
        rounds, left = [], len(keys)
        alone = np.flatnonzero(count == 1)
        while len(alone):
            key, at = np.unique(which[alone], return_index=True)
            rounds.append((alone[at], key))
            left -= len(key)
            for k in range(3):
                np.subtract.at(count, slots[k, key], 1)
                np.bitwise_xor.at(which, slots[k, key], key)
            touched = np.unique(slots[:, key])
            alone = touched[count[touched] == 1]
        if not left:
            table = np.zeros(size, np.uint16)
            for slot, key in reversed(rounds):
                table[slot] = 0
                table[slot] = prints[key] ^ table[slots[0, key]] ^ table[slots[1, key]] ^ table[slots[2, key]]
            return HEAD.pack(seed, length, segments) + table.tobytes()
    raise RuntimeError("no seed gives a filter for these keys")


def contains(filter_: bytes, keys: np.ndarray) -> np.ndarray:
    """For each 64-bit key, whether the set may hold it (always true for members)."""
    seed, length, segments = HEAD.unpack_from(filter_)
    table = np.frombuffer(filter_, np.uint16, offset=HEAD.size)
    slots, prints = _slots(keys.astype(U), seed, length, segments)
    return (table[slots[0]] ^ table[slots[1]] ^ table[slots[2]]) == prints
