"""An adaptive context-mixing range coder for token ids.

Ids are cut into blocks; each starts from a reset model and carries a checksum, so any block decodes
alone. A block is dealt out over lanes, runs of consecutive ids that are coded in step by a range coder
each and share one model, so every operation below is a vector over lanes. A step's probabilities mix
three orders: the id that the last two ids predict, the id that the last one predicts, and adaptive
frequencies of single ids (order 0). The weights of the two predictions are learnt by how sure both are
(how often each came true lately) and whether they agree; order 0 has the rest of the probability.
Predictions and weights adapt after each step, frequencies after the steps that REBUILT names.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK, LANES = 1 << 22, 16384
#: Steps that a lane has at least, unless one lane holds the whole block.
LANE_STEPS = 256
#: Bits of a step's whole probability, and of that of order 0 before it is scaled to its share.
WHOLE, PART = 26, 22
#: Places of order-2 contexts; greatest sureness of a prediction.
PLACES, SURE = 1 << 18, 7
#: Contexts of the weights: both surenesses, and which of the orders predict. Bits of a stretch of order 0.
CONTEXTS, STRETCH = 256, 6
#: Order 0 forgets half of its counts beyond this many; weights do beyond so many trials.
FORGET, TRIALS = 1 << 19, 1 << 14
U64 = np.uint64
#: Bits of a written word; a lane whose width is below a word's range writes one.
WORD, BOTTOM = U64(32), U64(1 << 32)
#: Stands for a change of a place that takes the id that came.
NEW = SURE + 1


def changes(sure: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """What is added to a place: a prediction that came true is surer; one that didn't is half as sure, and one that wasn't sure goes."""
    return np.where(hit, sure < SURE, np.where(sure, -(sure + 1 >> 1), NEW))


#: The changes of the places of orders 2 and 1, by context and whether each came true.
MET = np.arange(4 * CONTEXTS)
CHANGE2, CHANGE1 = changes(MET >> 7, MET >> 1 & 1), changes(MET >> 4 & 7, MET & 1)


def rebuilt(step: int) -> bool:
    """Whether order 0 takes in the ids up to this step: after 1, 2, 4 and 8 steps, then after every 16."""
    return step in (1, 2, 4, 8) or step % 16 == 0


class Model:
    """The adaptive state of a block of ``lanes`` lanes over ids below ``size``.

    A place of ``one`` and ``two`` holds the id that its context predicts and how sure that is, id << 3 | sureness.
    """

    def __init__(self, lanes: int, size: int):
        self.size = size
        self.one, self.two = np.full(size, -8, np.int64), np.full(PLACES, -8, np.int64)
        self.tries = np.full((2, CONTEXTS), 8, np.int64)
        self.hits = np.full((2, CONTEXTS), 3, np.int64)
        self.count = np.zeros(size, np.int64)
        self.before, self.last = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.recent: list[np.ndarray] = []
        self.met: list[np.ndarray] = []
        self.step = 0
        self._weigh()
        self._rebuild()

    def _weigh(self) -> None:
        """Shares of both predictions by context, of the whole and of what the first leaves; order 0 keeps a 16th at least."""
        share = np.minimum((self.hits << WHOLE) // self.tries, np.array([[7 << WHOLE - 3], [1 << WHOLE - 1]]))
        second = ((1 << WHOLE) - share[0]) * (share[1] >> 4) >> WHOLE - 4
        kinds = np.arange(CONTEXTS) & 3  # 0: both predict, 1: both the same, 2: order 2 doesn't, 3: neither does
        alone = share[1] >> 4 << 4
        self.end2 = np.where(kinds < 2, share[0], 0)
        self.end1 = np.where(kinds == 0, share[0] + second, np.where(kinds == 1, share[0], np.where(kinds == 2, alone, 0)))

    def _rebuild(self) -> None:
        """Where each id's part of order 0 begins (every id has some), and the id at the beginning of each stretch of 2**STRETCH."""
        self.begin = np.zeros(self.size + 1, np.int64)
        np.cumsum(1 + self.count * ((1 << PART) - self.size) // max(1, int(self.count.sum())), out=self.begin[1:])
        self.begin[-1] = 1 << PART
        stretches = (1 << PART - STRETCH) + 1
        self.first = np.cumsum(np.bincount(self.begin[:-1] + (1 << STRETCH) - 1 >> STRETCH, minlength=stretches)[:stretches]) - 1

    def find(self, value: np.ndarray) -> np.ndarray:
        """The ids whose parts of order 0 hold these values."""
        stretch = value >> STRETCH
        low, high = self.first[stretch], self.first[stretch + 1]
        todo = np.flatnonzero(low < high)
        while len(todo):
            a, b = low[todo], high[todo]
            middle = a + b + 1 >> 1
            beyond = self.begin[middle] > value[todo]
            low[todo] = a = np.where(beyond, a, middle)
            high[todo] = b = np.where(beyond, middle - 1, b)
            todo = todo[a < b]
        return low

    def predict(self) -> tuple[np.ndarray, ...]:
        """By lane: ids that orders 2 and 1 predict (-1: none), where their shares end, and the share of order 0."""
        self.at = (self.last * 40503 ^ self.before * 2654435761) >> 7 & PLACES - 1
        self.w2, self.w1 = self.two.take(self.at, mode="clip"), self.one.take(self.last, mode="clip")
        c2, c1 = self.w2 >> 3, self.w1 >> 3
        kind = (c2 < 0).view(np.int8) << 1 | (c1 == c2).view(np.int8)
        self.context = ((self.w2 & 7) << 3 | self.w1 & 7) << 2 | kind
        end1 = self.end1.take(self.context, mode="clip")
        return c2, c1, self.end2.take(self.context, mode="clip"), end1, (1 << WHOLE) - end1

    def update(self, ids: np.ndarray, c2: np.ndarray, c1: np.ndarray) -> None:
        met = self.context << 2 | ((ids == c2).view(np.int8) << 1 | (ids == c1).view(np.int8))
        change2, change1, new = CHANGE2.take(met, mode="clip"), CHANGE1.take(met, mode="clip"), ids << 3
        self.two[self.at] = np.where(change2 == NEW, new, self.w2 + change2)
        self.one[self.last] = np.where(change1 == NEW, new, self.w1 + change1)
        self.met.append(met)
        self.before, self.last = self.last, ids
        self.recent.append(ids)
        self.step += 1
        if self.step % 4 == 0 or self.step < 4:
            seen = np.bincount(np.concatenate(self.met), minlength=4 * CONTEXTS).reshape(-1, 4)
            self.met.clear()
            self.tries[0] += seen.sum(1)
            self.hits[0] += seen[:, 2] + seen[:, 3]
            self.tries[1] += seen[:, 0] + seen[:, 1]  # what order 2 leaves
            self.hits[1] += seen[:, 1]
            many = self.tries > TRIALS
            self.tries[many] >>= 1
            self.hits[many] >>= 1
            self._weigh()
        if rebuilt(self.step):
            self.count += np.bincount(np.concatenate(self.recent), minlength=self.size)
            self.recent.clear()
            if self.count.sum() > FORGET:
                self.count -= self.count >> 1
            self._rebuild()


def settled(low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The widths, cut where the bits above a word would change."""
    return np.where((low ^ (low + width)) < BOTTOM, width, (~low + U64(1)) & (BOTTOM - U64(1)))


def encode_block(ids: np.ndarray) -> bytes:
    """A block: steps, least size of a vocabulary, lanes, each lane's length in 32-bit words, and the words."""
    size = int(ids.max()) + 1
    if size >= 1 << PART - 1:
        raise ValueError("ids are too large for the coder")
    steps = -(-len(ids) // min(LANES, max(1, len(ids) // LANE_STEPS)))
    lanes = -(-len(ids) // steps)
    table = np.full(lanes * steps, ids[-1], np.int64)  # the last lane is filled up with the last id
    table[: len(ids)] = ids
    table = np.ascontiguousarray(table.reshape(lanes, steps).T)
    model = Model(lanes, size)
    low, width = np.zeros(lanes, U64), np.full(lanes, (1 << 64) - 1, U64)
    out_lanes: list[np.ndarray] = []
    out_words: list[np.ndarray] = []
    for now in table:
        c2, c1, end2, end1, rest = model.predict()
        is2 = now == c2
        is1 = (now == c1) & ~is2
        begin = end1 + (model.begin.take(now, mode="clip") * rest >> PART)
        end = end1 + (model.begin.take(now + 1, mode="clip") * rest >> PART)
        begin = np.where(is2, 0, np.where(is1, end2, begin))
        end = np.where(is2, end2, np.where(is1, end1, end))
        unit = width >> U64(WHOLE)
        low += unit * begin.view(U64)
        width = unit * (end - begin).view(U64)
        model.update(now, c2, c1)
        which = np.flatnonzero(width < BOTTOM)
        a = low[which]
        out_lanes.append(which.astype(np.uint16))
        out_words.append((a >> WORD).astype("<u4"))
        low[which], width[which] = a << WORD, settled(a, width[which]) << WORD
    for shift in (WORD, U64(0)):
        out_lanes.append(np.arange(lanes, dtype=np.uint16))
        out_words.append((low >> shift).astype("<u4"))
    lane, word = np.concatenate(out_lanes), np.concatenate(out_words)
    order = np.argsort(lane, kind="stable")  # of 16 bits numpy sorts by radix; LANES has fewer
    return struct.pack("<III", steps, size, lanes) + np.bincount(lane, minlength=lanes).astype("<u4").tobytes() + word[order].tobytes()


def decode_block(n: int, data: bytes) -> np.ndarray:
    steps, size, lanes = struct.unpack_from("<III", data)
    words_of = np.frombuffer(data, "<u4", lanes, 12).astype(np.int64)
    word = np.frombuffer(data[12 + 4 * lanes :] + b"\0" * 8, "<u4")
    at = np.cumsum(words_of) - words_of
    model = Model(lanes, size)
    low, width, code = np.zeros(lanes, U64), np.full(lanes, (1 << 64) - 1, U64), np.zeros(lanes, U64)
    for _ in range(2):
        code = code << WORD | word[at]
        at += 1
    table = np.zeros((steps, lanes), np.int64)
    for t in range(steps):
        c2, c1, end2, end1, rest = model.predict()
        unit = width >> U64(WHOLE)
        goal = np.minimum(((code - low) // unit).view(np.int64), (1 << WHOLE) - 1)
        is2 = goal < end2
        is1 = (goal < end1) & ~is2
        other = np.flatnonzero(goal >= end1)
        now = np.where(is2, c2, c1)
        begin, end = np.where(is2, 0, end2), np.where(is2, end2, end1)
        share, base = rest[other], end1[other]
        found = model.find((((goal[other] - base + 1) << PART) - 1) // share)
        now[other] = found
        begin[other] = base + (model.begin[found] * share >> PART)
        end[other] = base + (model.begin[found + 1] * share >> PART)
        table[t] = now
        low += unit * begin.view(U64)
        width = unit * (end - begin).view(U64)
        # An id that is predicted can come by order 0 as well, but the writer never codes it so.
        model.update(now, c2, c1)
        which = np.flatnonzero(width < BOTTOM)
        a, place = low[which], at[which]
        low[which], width[which] = a << WORD, settled(a, width[which]) << WORD
        code[which] = code[which] << WORD | word[place]
        at[which] = place + 1
    return table.T.ravel()[:n]


def encode(ids: np.ndarray, block: int = BLOCK) -> list[tuple[int, int, bytes]]:
    """For each block in order: number of ids, crc32 of the ids as little-endian 32-bit integers, coded bytes."""
    blocks = [ids[k : k + block] for k in range(0, len(ids), block)]
    return [(len(b), zlib.crc32(b.astype("<u4").tobytes()), encode_block(b)) for b in blocks]


def decode(blocks: list[tuple[int, int, bytes]]) -> np.ndarray:
    found = [np.zeros(0, "<u4")]
    for n, crc, data in blocks:
        ids = decode_block(n, data).astype("<u4")
        if len(ids) != n or zlib.crc32(ids.tobytes()) != crc:
            raise ValueError("a block of ids is damaged")
        found.append(ids)
    return np.concatenate(found)


MAGIC = b"NSIDS003"


def pack(doc_ids: np.ndarray, missing: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file: documents (ids, which of them are null, lengths), blocks of ids, and a directory at its end."""
    import zstandard

    docs = zstandard.ZstdCompressor().compress(np.diff(doc_ids, prepend=0).astype("<i8").tobytes() + counts.astype("<i8").tobytes() + missing.astype(np.uint8).tobytes())
    blocks = encode(ids)
    directory = b"".join(struct.pack("<III", n, crc, len(data)) for n, crc, data in blocks)
    tail = struct.pack("<QQQI", len(doc_ids), len(docs), len(blocks), zlib.crc32(docs + directory))
    return MAGIC + docs + b"".join(b[-1] for b in blocks) + directory + tail


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, missing, counts, ids of a file."""
    import zstandard

    n, size, count, crc = struct.unpack_from("<QQQI", data, len(data) - 28)
    directory = data[len(data) - 28 - 12 * count : len(data) - 28]
    docs = data[len(MAGIC) : len(MAGIC) + size]
    if data[: len(MAGIC)] != MAGIC or zlib.crc32(docs + directory) != crc:
        raise ValueError("a file of ids is damaged")
    raw = zstandard.ZstdDecompressor().decompress(docs)
    blocks, at = [], len(MAGIC) + size
    for k in range(count):
        ids, check, length = struct.unpack_from("<III", directory, 12 * k)
        blocks.append((ids, check, data[at : at + length]))
        at += length
    doc_ids = np.cumsum(np.frombuffer(raw, "<i8", n))
    return doc_ids, np.frombuffer(raw, np.uint8, n, 16 * n).astype(bool), np.frombuffer(raw, "<i8", n, 8 * n), decode(blocks)
