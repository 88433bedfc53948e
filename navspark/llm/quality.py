"""Quality rules: fixed base rules and a calibrated classifier over hashed word and character n-grams.

Base rules fail a text with fewer than MIN_WORDS words, or with more than REPEAT_PERCENT per cent of its
words in five-word windows that it holds twice or more. The classifier is a logistic regression over the
mean weight of a text's word n-grams (1, 2) and byte n-grams (3, 4), each hashed to 2**HASH_BITS places. It is
trained here on labelled rows (label 1: good), on a bounded sample: of each class the SAMPLE / 2 labelled
documents of least seeded hash. A quarter of each is held out and Platt scaling fits probabilities on it
(on the training rows where that leaves a class without rows). A text
that passes the base rules is kept when its probability of being good is at least THRESHOLD.

Null texts have no words and fail. doc_ids may be null or repeat; a null doc_id has no label, and of
contradicting labels the greater counts. With no labels of one of the classes the base rules alone
decide. An empty table gives an empty result. Texts are read whole; words are runs of characters other
than 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navspark.llm.common import claim, documents_view, small_batches, table, text_slices, trim, written
from navspark.llm.textcore import BASE, BYTE_CODE, U, Words, buffers, mix, prefix_hash, span_hash, sums, windows

MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
HASH_BITS, SAMPLE, ROUNDS, THRESHOLD, SEED = 18, 2_000, 150, 0.5, 11
#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(SYMBOLS)] = True
#: Bytes of text that are judged together; features of a part of the training rows, about.
SCORE_BYTES, PART_FEATURES = 256 << 10, 1 << 20
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of five found twice or more."""
    seen: dict[tuple, int] = {}
    grams = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    marks = np.zeros(len(words) + 1, np.int64)
    for i, g in enumerate(grams):
        if seen[g] > 1:
            marks[i] += 1
            marks[min(len(words), i + WINDOW)] -= 1
    return int((np.cumsum(marks) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line.split():
            n += line in seen
            seen.add(line)
    return n


def _repeats(group: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Groups that hold some hash twice."""
    if len(hashes) < 2:
        return np.zeros(0, np.int64)
    joint = mix(hashes ^ mix(group.astype(U) + U(1)))
    order = np.argsort(joint)
    twin = np.flatnonzero(joint[order][1:] == joint[order][:-1])
    return np.unique(group[order[twin]])


class Slice:
    """What the base rules and the classifier need of a slice of texts."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = data, offsets = buffers(column)
        self.words = words = Words(data, offsets)
        self.prefix = prefix_hash(data)
        self.hashes = span_hash(self.prefix, words.start, words.end)

    def measures(self) -> dict[str, np.ndarray]:
        data, offsets, words = self.data, self.offsets, self.words
        chars = self.words.ink & ((data & 0xC0) != 0x80)
        grams, at = windows(words, self.hashes, WINDOW)
        repeat = np.zeros(len(words.count), np.int64)
        for i in _repeats(words.text[at], grams).tolist():  # equal hashes only name the texts to count exactly
            repeat[i] = repeated_words(data[offsets[i] : offsets[i + 1]].tobytes().split())
        breaks = np.flatnonzero(data == 10)
        start = np.union1d(offsets[:-1], breaks + 1)
        start = start[start < len(data)]
        line_of = np.searchsorted(offsets, start, side="right") - 1
        end = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, start)], offsets[line_of + 1])
        inked = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
        hashes = span_hash(self.prefix, start[inked], end[inked])
        lines = np.zeros(len(words.count), np.int64)
        for i in _repeats(line_of[inked], hashes).tolist():
            lines[i] = duplicate_lines(data[offsets[i] : offsets[i + 1]].tobytes())
        return dict(zip(MEASURES, (words.count.astype(np.int64), sums(chars, offsets), sums(IS_SYMBOL[data], offsets), lines, repeat), strict=True))

    def families(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each n-gram family: hashed features, and where each text's begin."""
        yield (self.hashes >> U(64 - HASH_BITS)).astype(np.int64), self.words.first
        pairs, at = windows(self.words, self.hashes, 2)
        yield (pairs >> U(64 - HASH_BITS)).astype(np.int64), np.searchsorted(at, self.words.first)
        code = BYTE_CODE[self.data]
        for n in (3, 4):
            m = max(0, len(code) - n + 1)
            h = code[:m].copy()
            for k in range(1, n):
                h *= BASE
                h += code[k : k + m]
            # A text's last n - 1 starts would reach into the next text.
            first = np.minimum(self.offsets, m)
            yield (mix(h) >> U(64 - HASH_BITS)).astype(np.int64), first, n


def _bounds(family: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """features, begin, end of each text."""
    features, first = family[0], family[1]
    begin, end = first[:-1], first[1:]
    if len(family) == 3:
        end = np.maximum(begin, end - (family[2] - 1)) if len(features) else begin
    return features, begin, end


def score(part: Slice, weights: np.ndarray, bias: float) -> np.ndarray:
    """Log-odds before calibration; weights has a row for each family."""
    out = np.full(len(part.words.count), bias)
    for k, family in enumerate(part.families()):
        features, begin, end = _bounds(family)
        total = np.zeros(len(features) + 1)
        np.cumsum(weights[k][features], out=total[1:])
        out += (total[end] - total[begin]) / np.maximum(1, end - begin)
    return out


def _sparse(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct features, over all families, and their shares."""
    out: list[list] = [[] for _ in range(len(column))]
    for k, family in enumerate(Slice(column).families()):
        features, begin, end = _bounds(family)
        for i, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
            if b > a:
                found, count = np.unique(features[a:b], return_counts=True)
                out[i].append(((found + (k << HASH_BITS)).astype(np.int32), (count / (b - a)).astype(np.float32)))
    return [(np.concatenate([f for f, _ in x]), np.concatenate([c for _, c in x])) if x else (np.zeros(0, np.int32), np.zeros(0, np.float32)) for x in out]


def fit(texts: pa.Array, good: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float, float, float]:
    """weights, bias, and slope and shift of the calibration."""
    held = np.zeros(len(good), bool)
    for of in (0, 1):  # every fourth row of each class
        held[np.flatnonzero(good == of)[3::4]] = True
    one = pa.RecordBatch.from_arrays([texts], ["text"])
    sparse = [x for part in text_slices([one], "text", SCORE_BYTES) for x in _sparse(part.column(0))]
    keep = np.flatnonzero(~held)
    index, share = [sparse[i][0] for i in keep], [sparse[i][1] for i in keep]
    y = good[keep].astype(float)
    rate = np.clip(np.array([1 - y.mean(), y.mean()]), 1e-3, 1)
    cost = np.where(y > 0, 0.5 / rate[1], 0.5 / rate[0])
    cost /= cost.sum()
    size = 4 << HASH_BITS
    # Rows are taken in parts of about PART_FEATURES features, so the work space doesn't grow with the texts.
    ends = np.cumsum([len(x) for x in index])
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(PART_FEATURES, ends[-1], PART_FEATURES)) + 1, [len(index)]]))
    parts = [(a, b, np.concatenate(index[a:b]), np.concatenate(share[a:b]), np.repeat(np.arange(b - a, dtype=np.int32), [len(x) for x in index[a:b]])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    del index, share
    # Adagrad over the whole sample; features are shares, so steps are large.
    w, b0, gw, gb = np.zeros(size), 0.0, np.full(size, 1e-12), 1e-12
    used = np.zeros(size, bool)
    for _, _, at, _, _ in parts:
        used[at] = True
    for _ in range(rounds):
        g, total = np.zeros(size), 0.0
        for a, b, at, part, row in parts:
            z = np.bincount(row, w[at] * part, b - a) + b0
            r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[a:b]) * cost[a:b]
            g += np.bincount(at, (r[row] * part).astype(np.float32), size)
            total += r.sum()
        g = np.where(used, g + 1e-9 * w, 0)
        gw += g * g
        gb += total**2
        w -= g / np.sqrt(gw)
        b0 -= 0.1 * total / np.sqrt(gb)
    # With no row of a class held out, the training rows calibrate.
    of = np.flatnonzero(held) if 0 < good[held].sum() < held.sum() else keep
    z = np.array([w[sparse[i][0]] @ sparse[i][1] + b0 for i in of])
    slope, shift = platt(z, good[of])
    return w.reshape(4, -1), b0, slope, shift


def platt(z: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift with P(good) = sigmoid(slope * z + shift), by Newton steps on smoothed targets."""
    n1, n0 = good.sum(), (1 - good).sum()
    y = np.where(good > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(1e-9, np.abs(z).mean())
    x, v = np.stack([z / scale, np.ones(len(z))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(v @ x, -30, 30)))
        g = x @ (p - y) + 1e-3 * v
        h = (x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        v = v - step / max(1, np.abs(step).max())
    return float(max(v[0], 1e-6) / scale), float(v[1])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, seed: int = SEED) -> bytes | None:
    """The model, or None if one of the classes has no labelled text. One task trains on at most ``sample`` rows, half of each class."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(label).cast("int").alias("good"))
    # The sample is drawn among the ids first, so only its texts are moved.
    ids = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("id")).distinct()
    known = known.join(ids, "id", "left_semi")
    half = [known.where(F.col("good") == of).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample // 2) for of in (0, 1)]
    drawn = written(half[0].unionByName(half[1]), "quality-sample")
    view = documents_view(docs).where("text is not null")
    texts = view.join(F.broadcast(drawn), view["doc_id"] == drawn["id"]).groupBy("id", "good").agg(F.min("text").alias("text"))

    def run(rows: pa.Table) -> pa.Table:
        claim("quality", lambda: None)
        rows = rows.combine_chunks().sort_by("id")
        good = rows.column("good").to_numpy()
        if good.min() == good.max():
            return pa.table({"model": pa.array([], pa.binary())})
        text = rows.column("text").combine_chunks()
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        weights, bias, slope, shift = fit(text, good)
        trim()
        return pa.table({"model": pa.array([np.array([bias, slope, shift]).tobytes() + weights.astype(np.float32).tobytes()], pa.binary())})

    found = texts.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(run, "model binary").collect()  # one row of fixed size
    return bytes(found[0]["model"]) if found else None


class Judge:
    """Measures and verdicts of texts under a model."""

    def __init__(self, blob: bytes | None):
        self.blob = blob
        if blob:
            (self.bias, self.slope, self.shift), self.weights = np.frombuffer(blob[:24]), np.frombuffer(blob, np.float32, offset=24).reshape(4, -1)

    def of(self, column: pa.Array) -> list[pa.Array]:
        """The measures, base_failed, probability, kept."""
        part = Slice(column)
        m = part.measures()
        failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])
        p = 1 / (1 + np.exp(-np.clip(self.slope * score(part, self.weights, self.bias) + self.shift, -30, 30))) if self.blob else np.ones(len(column))
        return [*(pa.array(m[k]) for k in MEASURES), pa.array(failed), pa.array(p), pa.array(~failed & (p >= THRESHOLD))]


def judged(docs: DataFrame, model: bytes | None) -> DataFrame:
    """doc_id, the measures, base_failed, probability, kept of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality", lambda: None)
        judge = Judge(shared.value)
        for batch in text_slices(batches, "text", SCORE_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), *judge.of(batch.column(1))], NAMES)

    return documents_view(docs).mapInArrow(run, SCHEMA)


NAMES = ("doc_id", *MEASURES, "base_failed", "probability", "kept")
SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES) + ", base_failed boolean, probability double, kept boolean"


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns. A row goes to a worker and back once, its text as a part of it."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality", lambda: None)
        judge = Judge(shared.value)
        for batch in batches:
            rows = batch.column(0)
            text = pa.RecordBatch.from_struct_array(rows).column(at).cast(pa.string())
            kept = [judge.of(part.column(0))[-1] for part in text_slices([pa.RecordBatch.from_arrays([text], ["text"])], "text", SCORE_BYTES)]
            if kept:
                yield pa.RecordBatch.from_arrays([rows.filter(pa.concat_arrays(kept))], ["row"])

    packed = docs.select(F.struct("*").alias("row"))
    return packed.mapInArrow(run, packed.schema).select("row.*")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(docs, train(docs, table(spark, sf_dir, "labels")))
