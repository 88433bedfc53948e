"""Removal of repeated byte strings by a range-partitioned sparse suffix array.

Every byte covered by a string of LENGTH bytes that also starts earlier (smaller doc_id, or earlier in the
same document) is removed; all strings are judged on the input. Texts are UTF-8 bytes; null counts as
empty; matches never cross documents. A null doc_id is smaller than any; of equal doc_ids the text with
the smaller digest is the earlier; rows that repeat doc_id and text are copies of one of them. Copies of
an earlier text are removed whole (if they have LENGTH bytes) without being searched. An empty table
gives no rows; other columns are ignored.

Not all suffixes are sorted. A string of LENGTH bytes holds W grams of GRAM bytes; the one of least hash,
the leftmost of equals, is its anchor, which depends on the string alone. So equal strings have equal
anchors at equal offsets, and only the suffixes at anchors, one of 35 bytes or so, can lead a repeat.

1. Texts are packed into slices, stored once and never shuffled: later steps join small tables to the
   bucketed slices. Per slice, the distinct anchor hashes go to hash ranges, which tell which occur twice.
2. Anchors that do are emitted with the bytes around them, range-partitioned by sampled splitters over
   their leading GRAM bytes (then by document order, so a frequent suffix is spread over partitions),
   and sorted there. Within a group of equal leading bytes the strings around the anchors are compared.
3. Groups at the edge of a partition may go on in the next: the first occurrences of their strings are
   compared across boundaries by an aggregation.
4. The repeated strings' intervals are joined to the slices, which gives what is left of each text.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navspark.llm.common import checked, same, scratch, table, text_slices, written
from navspark.llm.textcore import U, buffers, mix, prefix_hash, span_hash

LENGTH, GRAM = 100, 32
W = LENGTH - GRAM + 1
#: Distinct anchor hashes of all slices that a hash range takes, about; bytes of a partition of suffixes.
RANGE_KEYS, SORT_BYTES = 500_000, 16 << 20
FIRST = -(1 << 63)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each window of this width."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


class Anchors:
    """of a slice: at (place), low, high (first and last start of the strings it stands for), hash, doc."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.at = self.low = self.high = self.doc = np.zeros(0, np.int64)
        self.hash = np.zeros(0, U)
        size = np.diff(offsets)
        long = size >= LENGTH
        if not long.any():
            return
        prefix = prefix_hash(data)
        n = len(data) - GRAM + 1
        grams = span_hash(prefix, np.arange(n), np.arange(GRAM, GRAM + n))
        least = sliding_least((grams & U(0xFFFFFFFF00000000)) | np.arange(n, dtype=U), W)
        marks = np.zeros(len(data) + 1, np.int8)
        np.add.at(marks, offsets[:-1][long], 1)
        np.add.at(marks, offsets[1:][long] - LENGTH + 1, -1)
        starts = np.flatnonzero(np.cumsum(marks, dtype=np.int8)[: len(least)])
        anchor = (least[starts] & U(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(new)
        self.at, self.low, self.high = anchor[first], starts[first], starts[np.append(first[1:], len(starts)) - 1]
        self.hash = grams[self.at]
        self.doc = np.searchsorted(offsets, self.low, side="right") - 1


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(slice, ords, digests, offsets, data, further columns) of each slice row."""
    for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        slice_, n, meta, data, *more = row
        ords, offsets = np.frombuffer(meta, np.int64, n), np.frombuffer(meta, np.int64, n + 1, 8 * n)
        digests = np.frombuffer(meta, "V16", n, 16 * n + 8)
        yield slice_, ords, digests, offsets, np.frombuffer(data, np.uint8), more


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to slices: n documents, their orders, offsets and digests, and the bytes."""
    part, k = TaskContext.get().partitionId(), 0
    for batch in text_slices(batches, "text"):
        data, offsets = buffers(batch.column(1))
        meta = batch.column(0).to_numpy().astype(np.int64).tobytes() + offsets.tobytes() + b"".join(batch.column(2).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([(part << 24) | k], pa.int64()), pa.array([batch.num_rows], pa.int32()), pa.array([meta], pa.binary()), pa.array([data.tobytes()], pa.binary())], ["slice", "n", "meta", "data"])
        k += 1


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> U(32)) * U(ranges) >> U(32)).astype(np.int64)


def _send(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slice_, _, _, offsets, data, _ in _unpacked(batch):
                hashes, counts = np.unique(Anchors(data, offsets).hash, return_counts=True)
                into = range_of(hashes, ranges)
                used, begin = np.unique(into, return_index=True)
                ends = np.append(begin[1:], len(hashes))
                low, twice = (hashes & U(0xFFFFFFFF)).astype(np.uint32), counts > 1
                keys = [low[a:b].tobytes() for a, b in zip(begin, ends, strict=True)]
                flags = [np.packbits(twice[a:b]).tobytes() for a, b in zip(begin, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([slice_] * len(used), pa.int64()), pa.array(keys, pa.binary()), pa.array(flags, pa.binary())], ["range", "slice", "keys", "twice"])

    return run


def _meet(rows: pa.Table) -> pa.Table:
    """Which keys of each slice occur in another slice or twice in their own."""
    keys = [np.frombuffer(x, np.uint32) for x in rows.column("keys").to_pylist()]
    twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for x, k in zip(rows.column("twice").to_pylist(), keys, strict=True)])
    every = np.concatenate(keys)
    _, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
    marked = np.bincount(inverse, weights=twice) > 0
    found = ((counts > 1) | marked)[inverse]
    masks = [np.packbits(x).tobytes() for x in np.split(found, np.cumsum([len(k) for k in keys])[:-1])]
    return pa.table({"range": rows.column("range"), "slice": rows.column("slice"), "mask": pa.array(masks, pa.binary())})


def _emit(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slice_, ords, digests, offsets, data, (masks,) in _unpacked(batch):
                anchors = Anchors(data, offsets)
                hashes, inverse = np.unique(anchors.hash, return_inverse=True)
                sizes = np.bincount(range_of(hashes, ranges), minlength=1)
                repeated = np.concatenate([np.zeros(0, np.uint8), *(np.unpackbits(np.frombuffer(m["mask"], np.uint8), count=sizes[m["range"]]) for m in sorted(masks, key=lambda m: m["range"]))])
                chosen = np.flatnonzero(repeated[inverse])
                tie = digests.view(np.int64)[::2]
                for k in range(0, len(chosen), 4096):
                    pick = chosen[k : k + 4096]
                    low, high, at, doc = anchors.low[pick], anchors.high[pick], anchors.at[pick], anchors.doc[pick]
                    size = high - low + LENGTH
                    ends = np.append(0, np.cumsum(size))
                    bytes_ = data[np.arange(ends[-1]) + np.repeat(low - ends[:-1], size)]
                    around = pa.BinaryArray.from_buffers(pa.binary(), len(pick), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(bytes_)])
                    columns = [pa.array(ords[doc]), pa.array(tie[doc]), pa.array(np.full(len(pick), slice_)), pa.array(doc.astype(np.int32)), pa.array((low - offsets[doc]).astype(np.int32)), pa.array((at - low).astype(np.int32)), around]
                    yield pa.RecordBatch.from_arrays(columns, ["ord", "tie", "slice", "doc", "low", "at", "around"])

    return run


NAMES = ["edge", "key", "ord", "tie", "start", "stop", "slice", "doc"]
SCHEMA = "edge boolean, key binary, ord long, tie long, start int, stop int, slice long, doc int"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats within the sorted suffixes of a partition: intervals [start, stop) of bytes, and the first strings of edge groups."""
    held: list[pa.RecordBatch] = []
    state: dict[str, bytes | None] = {"first": None, "split": None}

    def grams(batch: pa.RecordBatch) -> list[bytes]:
        return [x[a : a + GRAM] for x, a in zip(batch.column("around").to_pylist(), batch.column("at").to_pylist(), strict=True)]

    def work(part: pa.RecordBatch, names: list[bytes], last: bool) -> Iterator[pa.RecordBatch]:
        """part: whole groups, or the next piece of a group too large to hold."""
        data, offsets = buffers_of(part.column("around"))
        sizes = np.diff(offsets) - LENGTH + 1
        row = np.repeat(np.arange(len(sizes)), sizes)
        begin = np.append(0, np.cumsum(sizes))
        within = np.arange(begin[-1]) - begin[row]
        start = offsets[row] + within
        group = np.unique(np.array([hash_of(x) for x in names], U), return_inverse=True)[1]
        hashes = span_hash(prefix_hash(data), start, start + LENGTH) ^ mix(group[row].astype(U))
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        again = first[inverse] != np.arange(len(hashes))
        low = part.column("low").to_numpy()[row] + within
        # A run of repeats within a row is one interval.
        opens = again.copy()
        opens[1:] &= ~(again[:-1] & (row[1:] == row[:-1]))
        shuts = again.copy()
        shuts[:-1] &= ~(again[1:] & (row[1:] == row[:-1]))
        a, b = np.flatnonzero(opens), np.flatnonzero(shuts)
        take = lambda name, at: part.column(name).take(pa.array(row[at]))
        none = lambda n: pa.array([None] * n, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), bool)), none(len(a)), take("ord", a), take("tie", a), pa.array(low[a].astype(np.int32)), pa.array((low[b] + LENGTH).astype(np.int32)), take("slice", a), take("doc", a)], NAMES)
        edges = {state["first"], state["split"]} | ({names[-1]} if last else set())
        at_edge = np.array([x in edges for x in names])
        e = np.flatnonzero(at_edge[row] & ~again)
        if len(e):
            strings = [data[i : i + LENGTH].tobytes() for i in start[e]]
            key = pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in strings], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(e), bool)), key, take("ord", e), take("tie", e), pa.array(low[e].astype(np.int32)), pa.array((low[e] + LENGTH).astype(np.int32)), take("slice", e), take("doc", e)], NAMES)

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        """Works on all whole groups held; the last group stays unless nothing follows or it alone is large."""
        table_ = pa.Table.from_batches(held).combine_chunks().to_batches()
        held.clear()
        if not table_:
            return
        part = table_[0]
        names = grams(part)
        if state["first"] is None:
            state["first"] = names[0]
        if last:
            yield from work(part, names, True)
            return
        cut = len(names)
        while cut and names[cut - 1] == names[-1]:
            cut -= 1
        if cut == 0:  # one group fills it: its pieces are compared like those of several partitions
            state["split"] = names[0]
            yield from work(part, names, True)
            return
        yield from work(part.slice(0, cut), names[:cut], False)
        held.append(part.slice(cut))

    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= 20_000:
            yield from flush(False)
            rows = sum(b.num_rows for b in held)
            if rows >= 20_000:
                rows = 0
    if held:
        yield from flush(True)


def hash_of(x: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(x)


def buffers_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, ords, digests, offsets, data, (runs,) in _unpacked(batch):
            of: dict[int, list[tuple[int, int]]] = {}
            for r in runs or []:
                of.setdefault(r["doc"], []).append((r["start"], r["stop"]))
            out = []
            for i in range(len(ords)):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                spans: list[list[int]] = []
                for a, b in sorted(of.get(i, ())):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                kept, at = [], 0
                for a, b in spans:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                out.append((sum(b - a for a, b in spans), len(spans), hashlib.sha256(b"".join(kept)).hexdigest(), [x for s in spans for x in s]))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(ords), pa.array([d.tobytes() for d in digests], pa.binary()), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.list_(pa.int32()))], ["r_ord", "r_digest", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_strings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (begins and ends of the removed runs) of every row."""
    spark = docs.sparkSession
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    view = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("text"), F.unhex(F.md5(F.encode(body, "UTF-8"))).alias("digest"))
    view = view.withColumn("ord", F.coalesce("doc_id", F.lit(FIRST)))
    units = view.groupBy("ord", "digest").agg(F.max("doc_id").alias("doc_id"), F.max(F.octet_length("text")).alias("n_bytes"), F.max(F.when(F.octet_length("text") < LENGTH, F.sha2("text", 256))).alias("own"), F.count(F.lit(1)).alias("rows"))
    units = written(units, "strings-units")
    earliest = units.groupBy("digest").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("e_digest"), "first")
    units = units.join(earliest, units["digest"] == earliest["e_digest"], "left").withColumn("is_first", F.coalesce(F.col("ord") == F.col("first"), F.lit(True))).drop("e_digest", "first")
    units = written(units, "strings-units")
    later = units.where(~F.col("is_first")).select(F.col("ord").alias("l_ord"), F.col("digest").alias("l_digest"))
    searched = view.where(F.octet_length("text") >= LENGTH)
    searched = searched.join(checked(later), same(searched, later, {"ord": "l_ord", "digest": "l_digest"}), "left_anti")
    # Of rows that repeat doc_id and text one is searched, else each would lose the strings of the other.
    again = units.where(F.col("is_first") & (F.col("rows") > 1) & (F.col("n_bytes") >= LENGTH)).select(F.col("ord").alias("l_ord"), F.col("digest").alias("l_digest"))
    n_again = again.count()
    if n_again:
        repeated = same(searched, again, {"ord": "l_ord", "digest": "l_digest"})
        one = searched.join(checked(again, n_again), repeated, "left_semi").dropDuplicates(["ord", "digest"])
        searched = searched.join(checked(again, n_again), repeated, "left_anti").unionByName(one)

    total = units.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("b")).first()["b"]
    ranges = max(1, total // (35 * RANGE_KEYS))
    buckets = int(min(4096, max(8, total // (24 << 20))))
    name, path = f"navspark_slices_{uuid.uuid4().hex}", scratch(spark, "slices")
    packed = searched.select("ord", "text", "digest").mapInArrow(_pack, "slice long, n int, meta binary, data binary")
    packed.write.bucketBy(buckets, "slice").option("path", path).option("compression", "zstd").saveAsTable(name)
    slices = spark.table(name)

    sent = slices.mapInArrow(_send(ranges), "range int, slice long, keys binary, twice binary")
    masks = sent.groupBy("range").applyInArrow(_meet, "range int, slice long, mask binary")
    masks = written(masks.groupBy("slice").agg(F.collect_list(F.struct("range", "mask")).alias("masks")), "strings-masks")
    around = slices.join(masks.hint("merge"), "slice").select("slice", "n", "meta", "data", "masks").mapInArrow(_emit(ranges), "ord long, tie long, slice long, doc int, low int, at int, around binary")
    order = [F.expr(f"substring(around, at + 1, {GRAM})"), "ord", "tie", "low"]
    parts = int(max(8, total // (6 * SORT_BYTES)))
    found = written(around.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_compare, SCHEMA), "strings-found")

    edge = found.where("edge")
    least = edge.groupBy("key").agg(F.min(F.struct("ord", "tie", "start")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    crossing = edge.join(least, "key").where(F.struct("ord", "tie", "start") > F.col("least"))
    runs = found.where("not edge").select("slice", "doc", "start", "stop").unionByName(crossing.select("slice", "doc", "start", "stop"))
    runs = runs.groupBy("slice").agg(F.collect_list(F.struct("doc", "start", "stop")).alias("runs"))
    done = slices.join(runs.hint("merge"), "slice", "left").select("slice", "n", "meta", "data", "runs")
    result = done.mapInArrow(_finish, "r_ord long, r_digest binary, n_removed long, n_spans long, kept_sha256 string, spans array<int>")
    result = written(result, "strings-result").dropDuplicates(["r_ord", "r_digest"])
    spark.sql(f"drop table {name}")

    joined = units.join(result, (units["ord"] == result["r_ord"]) & (units["digest"] == result["r_digest"]), "left")
    each = joined.select("*", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("nth"))
    long, searched_ = F.col("n_bytes") >= LENGTH, F.col("is_first") & (F.col("nth") == 1)
    return each.select(
        "doc_id",
        F.col("n_bytes").cast("long").alias("n_bytes"),
        F.when(~long, F.lit(0)).when(searched_, F.col("n_removed")).otherwise(F.col("n_bytes")).cast("long").alias("n_removed"),
        F.when(~long, F.lit(0)).when(searched_, F.col("n_spans")).otherwise(F.lit(1)).cast("long").alias("n_spans"),
        F.when(~long, F.col("own")).when(searched_, F.col("kept_sha256")).otherwise(F.sha2(F.lit(""), 256)).alias("kept_sha256"),
        F.when(~long, F.array().cast("array<int>")).when(searched_, F.col("spans")).otherwise(F.array(F.lit(0), F.col("n_bytes").cast("int"))).alias("spans"),
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings(table(spark, sf_dir, "documents")).drop("spans")
