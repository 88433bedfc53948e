"""Byte-level BPE encoding and decoding over segment trees.

A piece's byte positions are the leaves of a segment tree whose nodes hold the rank of the lowest pair
below, the leftmost among equals. The root names the next merge; a merge updates the pairs of the two
live neighbours, each a walk from a leaf to the root. Pieces of similar length are merged in step, one
merge each per step, so every walk is a vectorised operation over all of them.

Null texts are encoded as empty ones: no ids. Texts and pieces of any length are encoded whole; there
are no special tokens. Rows are independent, so repeated rows, null doc_ids and an empty table need no care.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from navspark.llm.common import claim, documents_view, table, text_slices
from navspark.llm.textcore import U, mix
from navspark.llm.units import Recent, filled, gathered, parted, words

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Encoded units and pieces that a generation of a worker's memory holds.
REMEMBERED = 60_000
#: The characters of the Unicode property White_Space, which \s means in the libraries' pattern.
WHITE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Bytes of text that are encoded together.
ENCODE_BYTES = 1 << 20
#: A space beside white space or at a text's ends may not begin a match.
UNEVEN = "^ | $| [{0}]|[{0}] ".format("".join(c for c in map(chr, range(0x3001)) if re.match(f"[{WHITE_SPACE}]", c)))
NONE = np.int64(1 << 40)  # no pair
#: Of fewer pieces than this, each is merged by itself, and so is a piece of more than 2**WIDEST bytes.
FEW, WIDEST = 32, 12


class Ranks:
    """A vocabulary: bytes by rank, and the rank of each pair of adjacent tokens that forms a token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = {v: k for k, v in self.rank.items()}
        self.text = [str(i) for i in range(max(self.bytes, default=0) + 1)]
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        pairs = [((a << 20) | b, r) for t, r in self.rank.items() for k in range(1, len(t)) if (a := self.rank.get(t[:k])) is not None and (b := self.rank.get(t[k:])) is not None]
        keys, ranks = np.array([p[0] for p in pairs], U), np.array([p[1] for p in pairs], np.int64)
        self.bits = U(64 - int(np.ceil(np.log2(4 * len(pairs)))))
        size = 1 << (64 - int(self.bits))
        self.key, self.value = np.zeros(size, U), np.full(size, NONE)
        self.mask = size - 1
        at = (mix(keys) >> self.bits).astype(np.int64)
        todo, self.steps = np.arange(len(keys)), 0
        while len(todo):  # each round, of the keys that want a free slot, one gets it and the others go on to the next slot
            free = self.value[at[todo]] == NONE
            self.key[at[todo[free]]] = keys[todo[free]]
            won = free & (self.key[at[todo]] == keys[todo])
            self.value[at[todo[won]]] = ranks[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & self.mask
            self.steps += 1

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of left + right, or NONE."""
        keys = (left.astype(U) << U(20)) | right.astype(U)
        at = (mix(keys) >> self.bits).astype(np.int64)
        out = np.full(len(keys), NONE)
        todo = np.arange(len(keys))
        while len(todo):
            key, value = self.key[at[todo]], self.value[at[todo]]
            hit = (key == keys[todo]) & (value != NONE)
            out[todo[hit]] = value[hit]
            todo = todo[~hit & (value != NONE)]
            at[todo] = (at[todo] + 1) & self.mask
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece."""
        return [np.frombuffer(ids, np.uint32).tolist() for ids in self.encode_bytes(pieces)]

    def encode_bytes(self, pieces: list[bytes]) -> list[bytes]:
        """The same as little-endian unsigned 32-bit integers."""
        rank = self.rank
        out: list = [rank.get(p) for p in pieces]
        by_class: dict[int, list[int]] = {}
        for i, r in enumerate(out):
            if r is not None:
                out[i] = r.to_bytes(4, "little")
            elif pieces[i]:
                by_class.setdefault(max(2, (len(pieces[i]) - 1).bit_length()), []).append(i)
            else:
                out[i] = b""
        for bits, members in by_class.items():
            if len(members) < FEW or bits > WIDEST:
                for i in members:
                    out[i] = np.array(self._merge_one(pieces[i]), np.uint32).tobytes()
                continue
            step = max(FEW, (1 << 16) >> bits)
            for k in range(0, len(members), step):
                part = members[k : k + step]
                for i, ids in zip(part, self._merge([pieces[i] for i in part], bits), strict=True):
                    out[i] = ids
        return out

    def _merge_one(self, piece: bytes) -> list[int]:
        """The same over one tree, for a piece with few others of its length."""
        n, rank, none = len(piece), self.rank, (1 << 60)
        width = 1 << max(1, (n - 1).bit_length())
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]
        tree = [none] * (2 * width)
        for i in range(n - 1):
            if (r := rank.get(piece[i : i + 2])) is not None:
                tree[width + i] = (r << 32) | i
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def update(node: int, value: int) -> None:
            tree[node] = value
            while node > 1:
                other = tree[node ^ 1]
                value = value if value < other else other
                node >>= 1
                if tree[node] == value:
                    return
                tree[node] = value

        def join(i: int) -> int:
            """What the leaf of the pair that begins at i holds."""
            j = after[i]
            r = rank.get(piece[i : end[j]]) if j >= 0 else None
            return none if r is None else (r << 32) | i

        while tree[1] < none:
            at = tree[1] & 0xFFFFFFFF
            gone = after[at]
            end[at], after[at] = end[gone], after[gone]
            if after[at] >= 0:
                before[after[at]] = at
            update(width + gone, none)
            update(width + at, join(at))
            if before[at] >= 0:
                update(width + before[at], join(before[at]))
        ids, i = [], 0
        while i >= 0:
            ids.append(rank[piece[i : end[i]]])
            i = after[i]
        return ids

    def _merge(self, pieces: list[bytes], bits: int) -> list[bytes]:
        """Trees of 2**bits leaves each, one a row of flat arrays, all merged in step."""
        n, width = len(pieces), 1 << bits
        kind = np.int32 if len(self.text).bit_length() + bits <= 30 else np.int64
        none = kind(1 << (30 if kind is np.int32 else 60))
        length = np.fromiter(map(len, pieces), np.int64, n)
        place = np.arange(width)
        token = self.single[np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8)]
        inside = place < length[:, None]
        token[~inside.ravel()] = -1
        after = np.where(place + 1 < length[:, None], place + 1, -1).ravel()  # next live position
        before = np.broadcast_to(place - 1, (n, width)).ravel().copy()
        # A node holds rank << bits | position, so the least is the lowest rank and of equals the leftmost.
        tree = np.full((n, 2 * width), none, kind)
        pairs = np.flatnonzero(after >= 0)
        ranks = self.pair(token[pairs], token[pairs + 1])
        some = ranks < NONE
        pairs, ranks = pairs[some], ranks[some]
        tree[pairs >> bits, width + (pairs & width - 1)] = ranks << bits | (pairs & width - 1)
        for level in range(bits - 1, -1, -1):
            a, b = 1 << level, 2 << level
            tree[:, a:b] = np.minimum(tree[:, 2 * a : 2 * b : 2], tree[:, 2 * a + 1 : 2 * b : 2])
        tree = tree.ravel()
        live = np.arange(n)

        def leaf(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            """What the leaves of the pairs of live places (left, right) hold."""
            rank = self.pair(token[left], token[right])
            return np.where(rank < NONE, rank << bits | (left & width - 1), none).astype(kind)

        while True:
            best = tree[2 * width * live + 1]
            some = best < none
            if not some.all():
                live, best = live[some], best[some].astype(np.int64)
            if not len(live):
                break
            row = live << bits
            at = row + (best & width - 1)
            gone = row + after[at]
            token[at] = best >> bits
            token[gone] = -1
            beyond = after[gone]
            after[at] = beyond
            tree[width + at + row] = none
            tree[width + gone + row] = none
            has = np.flatnonzero(beyond >= 0)
            here, following = at[has], row[has] + beyond[has]
            before[following] = here & width - 1
            tree[width + here + row[has]] = leaf(here, following)
            prior = before[at]
            has = np.flatnonzero(prior >= 0)
            left = row[has] + prior[has]
            tree[width + left + row[has]] = leaf(left, at[has])
            # The changed leaves' paths to the root, level by level for all of them.
            node = width + np.concatenate([at, gone, left]) + np.concatenate([row, row, row[has]])
            root = 2 * np.concatenate([row, row, row[has]])
            node -= root
            for _ in range(bits):
                node >>= 1
                child = root + 2 * node
                tree[root + node] = np.minimum(tree[child], tree[child + 1])
        kept = token >= 0
        data, ends = token[kept].astype(np.uint32).tobytes(), 4 * np.cumsum(kept.reshape(n, width).sum(1))
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


@cache
def load(path: str) -> Ranks:
    return Ranks(path)


class Encoder:
    """Whole texts to ids, remembering the ids of units and of pieces seen lately.

    A space between two characters that aren't white space always begins a match of the pattern, so the
    matches of a text are those of its units, each taken with the space before it. A text in which a space
    stands elsewhere is split by the pattern as a whole.
    """

    def __init__(self, path: str, pattern: str):
        self.ranks = load(path)
        own = pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\S", f"[^{WHITE_SPACE}]").replace(r"\s", f"[{WHITE_SPACE}]")
        self.find = regex.compile(own).findall
        self.pieces, self.whole = Recent(REMEMBERED), Recent(REMEMBERED // 5)

    def clear(self) -> None:
        self.pieces.clear()
        self.whole.clear()

    def _pieces(self, texts: list[str]) -> list[bytes]:
        """The ids of matches of the pattern."""
        values, missing = self.pieces.look(texts)
        if missing:
            for i, ids in zip(missing, self.ranks.encode_bytes([texts[i].encode() for i in missing]), strict=True):
                values[i] = ids
                self.pieces.put(texts[i], ids)
        return values

    def _whole(self, units: list[str]) -> list[bytes]:
        """The ids of any strings, each split by the pattern."""
        values, missing = self.whole.look(units)
        if missing:
            split = [self.find(units[i]) for i in missing]
            fresh = list({p for ps in split for p in ps})
            of = dict(zip(fresh, self._pieces(fresh), strict=True))
            for i, ps in zip(missing, split, strict=True):
                values[i] = ids = b"".join([of[p] for p in ps])
                self.whole.put(units[i], ids)
        return values

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts, not in the texts' order, and where each text's begin and end."""
        texts = filled(texts)
        odd = np.asarray(pc.or_(pc.match_substring_regex(texts, UNEVEN), pc.equal(texts, "")), dtype=bool)
        plain = np.flatnonzero(~odd)
        number, units, first = words(texts.take(pa.array(plain)))
        number = np.asarray(number).astype(np.int64)
        heads = units.take(pa.array(number[first[:-1]])).to_pylist()
        split = [self.find(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        letters, others, marks, front, back = parted(units)
        blobs = self._pieces([" " + u for u in letters.to_pylist()]) + self._whole([" " + u for u in others])
        nothing = len(blobs)
        back += nothing
        blobs += self._pieces(marks)
        whole: dict[str, int] = {}
        other = np.array([whole.setdefault(u, len(whole)) for us in (heads, *split) for u in us], np.int64) + len(blobs)
        blobs += self._whole(list(whole))
        sequence = np.stack([front[number], back[number]], 1)
        sequence[first[:-1], 0], sequence[first[:-1], 1] = other[: len(heads)], nothing
        ids, ends = gathered(blobs, np.concatenate([sequence.ravel(), other[len(heads) :]]))
        begin, end = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        begin[plain], end[plain] = ends[2 * first[:-1]], ends[2 * first[1:]]
        rest = sequence.size + np.cumsum([0, *map(len, split)])
        begin[odd], end[odd] = ends[rest[:-1]], ends[rest[1:]]
        return ids, begin, end


@cache
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode_ids(texts: list[str], path: str, pattern: str) -> list[list[int]]:
    """The ids of each text."""
    ids, begin, end = encoder(path, pattern).encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]


def decode_ids(ids: list[int], path: str) -> bytes:
    back = load(path).bytes
    return b"".join([back[i] for i in ids])


class Spelling:
    """What each id is written as: its decimal digits and a comma, and the bytes that it decodes to."""

    def __init__(self, ranks: Ranks):
        self.digits = pa.array([f"{t}," for t in ranks.text], pa.large_string())
        self.bytes = pa.array([ranks.bytes.get(i, b"") for i in range(len(ranks.text))], pa.large_binary())

    @staticmethod
    def sha256(spelt: pa.Array, ids: np.ndarray, begin: np.ndarray, end: np.ndarray, last: int) -> list[str]:
        """Of each text, the digest of its ids' spellings one after another without the last bytes of the last."""
        taken = spelt.take(pa.array(ids))
        offsets = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
        data = memoryview(taken.buffers()[2] or b"") if len(taken) else memoryview(b"")
        return [hashlib.sha256(data[a : max(a, b - last)]).hexdigest() for a, b in zip(offsets[begin].tolist(), offsets[end].tolist(), strict=True)]


@cache
def spelling(path: str) -> Spelling:
    return Spelling(load(path))


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        path = public_tokenizers.path(vocabulary)
        of, spelt = encoder(path, public_tokenizers.PATTERN), spelling(path)
        claim("byte-level BPE", of.clear)
        for batch in text_slices(batches, "text", ENCODE_BYTES):
            ids, begin, end = of.encode(batch.column(1))
            digits, back = spelt.sha256(spelt.digits, ids, begin, end, 1), spelt.sha256(spelt.bytes, ids, begin, end, 0)
            del ids
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(end - begin), pa.array(digits, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents_view(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
