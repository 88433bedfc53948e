"""Runs of repeated words: every lag of a text's word ids is compared, and long stretches of equality become runs.

A run is a stretch of at least max(LEAST, 2 * period) words in which words a period apart are identical,
which can't be extended and has no smaller period. For each lag q up to half the words, the id array is compared with
itself shifted by q; a stretch of true of s words is a run of s + q words if that suffices. Of stretches
with the same first and last word the least lag is the smallest period, as the period of a string of
at least twice its length divides the others. A stretch of s words can't lie between two of every s-th place, so a lag is
looked at there first, by hashes of the GRAM words from each place on, and compared in full only in the texts where
one is equal; the hashes only say where to compare.

Texts of up to SPLIT bytes are one range of lags. A longer one is dealt out over several machines, a range of lags
each; its runs meet by (text, start, length) with their least lag, and join the text again.

Ids number a text's different words, so equality is that of words. ``altered`` puts the repetition into a
text that the query's contract asks for; a null doc_id leaves a text as it is. Null and wordless texts have no
runs. Rows that repeat doc_id and text get the same answer each; doc_ids may repeat with other texts. Other columns are
ignored, and an empty table gives an empty result. Whole texts are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navspark.llm.common import claim, documents_view, same, table, text_slices, written
from navspark.llm.exact_dedup import raw_hash
from navspark.llm.textcore import BASE, U, mix

#: Words of the shortest run; words of a hash; lags below this are compared in full at once.
LEAST, GRAM, DENSE = 12, 8, 24
#: Bytes of text whose lags are one range, and words of a range of lags of a longer text, about.
SPLIT, RANGE = 1 << 20, 1 << 16
FIELDS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []  # bytes split at 0x20 and 0x09-0x0D


def altered(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, those of a tenth of the doc_ids with a repetition from some place on."""
    if doc_id is None or not words:
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    n, a = len(words), g % len(words)
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, equal for equal words of one text only, and where each text's begin."""
    out, base = [], 0
    for words in texts:
        known = {w: k for k, w in enumerate(dict.fromkeys(words), base)}
        out.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        base += len(known)
    return np.concatenate(out) if out else np.zeros(0, np.int64), np.cumsum([0, *map(len, texts)])


def stretches(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches of true of at least ``least`` places."""
    if not len(equal):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(equal[1:] != equal[:-1]) + 1
    begin, end = (edge[1::2], edge[::2]) if equal[0] else (edge[::2], edge[1::2])
    if equal[0]:
        begin = np.append(0, begin)
    if equal[-1]:
        end = np.append(end, len(equal))
    long = end - begin >= least
    return begin[long], end[long]


def repeats(ids: np.ndarray, first: np.ndarray, low: int = 1, high: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, lag) of all stretches that suffice, for the lags low <= lag < high; texts are in order of falling size."""
    sizes = np.diff(first)
    grams = mix(ids.astype(U))
    single = grams.copy()
    for k in range(1, GRAM):  # places at a text's end reach into the next, whose ids differ
        m = max(0, len(ids) - k)
        grams[:m] = grams[:m] * BASE + single[k:]
    found: list[tuple] = []
    most = int(sizes.max(initial=0)) // 2
    for lag in range(low, min(most, high - 1 if high else most) + 1):
        size = max(LEAST, 2 * lag)
        texts = int(np.searchsorted(-sizes, -size, side="right"))  # those with at least so many words
        if not texts:
            break
        end = first[texts]
        need = size - lag
        if lag < DENSE:
            begin, stop = stretches(ids[: end - lag] == ids[lag:end], need)
        else:
            step = need - GRAM + 1
            front = grams[step - 1 : end - lag : step]
            hits = np.flatnonzero(front == grams[step - 1 + lag : end : step][: len(front)])
            if not len(hits):
                continue
            begin, stop = [], []
            for t in np.unique(np.searchsorted(first, hits * step + step - 1, side="right") - 1).tolist():
                a, b = first[t], first[t + 1]
                x, y = stretches(ids[a : b - lag] == ids[a + lag : b], need)
                begin.append(x + a)
                stop.append(y + a)
            begin, stop = np.concatenate(begin), np.concatenate(stop)
        if len(begin):
            text = np.searchsorted(first, begin, side="right") - 1
            found.append((text, begin - first[text], stop - begin + lag, np.full(len(begin), lag)))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def least_lags(text: np.ndarray, start: np.ndarray, length: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, ...]:
    """One row, that of the least lag, for each (text, start, length), by text, start and period."""
    order = np.lexsort((lag, length, start, text))
    text, start, length, lag = (x[order] for x in (text, start, length, lag))
    keep = np.ones(len(text), bool)
    keep[1:] = (np.diff(text) != 0) | (np.diff(start) != 0) | (np.diff(length) != 0)
    text, start, length, lag = (x[keep] for x in (text, start, length, lag))
    order = np.lexsort((lag, start, text))
    return tuple(x[order] for x in (text, start, length, lag))


def digest(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple:
    """The result's FIELDS for a text's words and its runs by start and period."""
    if not len(start):
        return 0, None, None, None, None, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()
    best = np.lexsort((period, start, -length))[0]
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, start + period, 1)
    np.add.at(marks, start + length, -1)
    kept = np.flatnonzero(np.cumsum(marks)[:-1] == 0)
    text = b" ".join([words[i] for i in kept.tolist()])
    s, n, q = int(start[best]), int(length[best]), int(period[best])
    return len(start), s, n, q, 1000 * n // q, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest()


def _rows(doc_ids: pa.Array, out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([doc_ids, *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds))], ["doc_id", *FIELDS])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("runs", lambda: None)
    for batch in text_slices(batches, "text"):
        texts = [altered(words_of(t), i) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        text, start, length, lag = least_lags(*repeats(*numbered([texts[i] for i in order])))
        cut = np.searchsorted(text, np.arange(len(texts) + 1))
        out: list = [None] * len(texts)
        for k, i in enumerate(order):
            a, b = cut[k], cut[k + 1]
            out[i] = digest(texts[i], start[a:b], length[a:b], lag[a:b])
        yield _rows(batch.column(0), out)


def _in_ranges(docs: DataFrame, words: int) -> DataFrame:
    """The result for long texts, a range of lags in each task's share; docs: doc_id, th, text."""
    ranges = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / F.lit(8 * words))).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("runs", lambda: None)
        for batch in batches:
            for doc, th, text, nth, all_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, first = numbered([altered(words_of(text), doc)])
                # A lag's work falls with the lag: ranges of lags grow so that each has as much.
                most = len(ids) // 2
                cuts = [int(len(ids) - (len(ids) ** 2 - (len(ids) ** 2 - (len(ids) - most) ** 2) * k / all_) ** 0.5) for k in (nth, nth + 1)]
                low, high = 1 + (cuts[0] if nth else 0), 1 + (cuts[1] if nth + 1 < all_ else most)
                _, start, length, lag = least_lags(*repeats(ids, first, low, high))
                n = len(start)
                yield pa.RecordBatch.from_arrays([pa.array([doc] * n, pa.int64()), pa.array([th] * n, pa.int64()), pa.array(start), pa.array(length), pa.array(lag)], ["doc_id", "th", "start", "length", "period"])

    each = docs.select("doc_id", "th", "text").dropDuplicates(["doc_id", "th"])
    dealt = each.select("doc_id", "th", "text", F.explode(F.sequence(F.lit(0), ranges - 1)).alias("nth"), ranges.alias("all")).repartition("doc_id", "th", "nth")
    found = dealt.mapInArrow(run, "doc_id long, th long, start long, length long, period long")
    least = found.groupBy("doc_id", "th", "start", "length").agg(F.min("period").alias("period"))
    lists = written(least.groupBy(F.col("doc_id").alias("l_id"), F.col("th").alias("l_th")).agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs")), "runs-lists")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                doc, text, runs = (c[0].as_py() for c in row.columns)
                of = lambda k, runs=runs: np.array([r[k] for r in runs or ()], np.int64)
                yield _rows(row.column(0), [digest(altered(words_of(text), doc), of("start"), of("length"), of("period"))])

    met = docs.join(lists, same(docs, lists, {"doc_id": "l_id", "th": "l_th"}), "left").select("doc_id", "text", "runs")
    return met.mapInArrow(finish, SCHEMA)


def runs(docs: DataFrame, split: int = SPLIT, words: int = RANGE) -> DataFrame:
    """doc_id and FIELDS of every row."""
    view = documents_view(docs, raw_hash("text").alias("th"))
    long = F.coalesce(F.octet_length("text") > split, F.lit(False))
    out = view.where(~long).select("doc_id", "text").mapInArrow(_whole, SCHEMA)
    rest = view.where(long)
    return out if rest.isEmpty() else out.unionByName(_in_ranges(rest, words))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(table(spark, sf_dir, "documents"))
