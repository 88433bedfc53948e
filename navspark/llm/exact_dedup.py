"""Exact deduplication: filters over immutable snapshots screen a batch, hits are checked byte by byte.

Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of equal texts the
row with the largest doc_id stays (a null doc_id is the smallest). Of rows that repeat both doc_id and
text exactly one stays. An empty table gives an empty result. Other columns are ignored by
``dedup_groups`` and carried unchanged by ``drop_copies``, whatever their names.

1. Every text becomes a SHA-256 digest; digests are grouped within the snapshots, and, separately,
   within the batch, with map-side combining, so a group of copies of any size is one row.
2. Snapshot digests are sharded by value and a binary-fuse filter is built for each shard.
3. The batch's digests are screened by the shard's filter. Positives join the snapshot's exact
   buckets, and the two representatives' texts are compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from navspark.llm import fuse
from navspark.llm.common import checked, claim, documents_view, same, table, text_slices, written

#: Snapshot digests that one filter shard holds, about.
SHARD_KEYS = 250_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, sha binary, th long): digest of the normalised text and a hash of the raw one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("exact dedup", lambda: None)
        for batch in text_slices(batches, "text"):
            texts = batch.column(1).to_pylist()
            sha = [hashlib.sha256((t or "").encode().lower()).digest() for t in texts]  # bytes.lower() is A-Z only
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sha, pa.binary()), batch.column(2)], ["doc_id", "sha", "th"])

    return documents_view(docs, raw_hash("text").alias("th")).mapInArrow(run, "doc_id long, sha binary, th long")


def raw_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")), F.col(text).isNull())


def _keys(sha: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join([x[:8] for x in sha.to_pylist()]), np.uint64)


def _build(group: pa.Table) -> pa.Table:
    return pa.table({"shard": group.column("shard")[:1].combine_chunks(), "filter": pa.array([fuse.build(_keys(group.column("sha")))], pa.binary())})


def _screen(batch: pa.Table, filters: pa.Table) -> pa.Table:
    if not batch.num_rows or not filters.num_rows:
        return batch.select(["sha", "keep_id"]).slice(0, 0)
    return batch.select(["sha", "keep_id"]).filter(pa.array(fuse.contains(filters.column("filter")[0].as_py(), _keys(batch.column("sha")))))


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))


def differing(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The digests of pairs (sha, a, b) whose two documents' normalised texts aren't the same bytes."""
    each = pairs.select("sha", F.lower(F.hex("sha")).alias("h"), F.explode(F.array("a", "b")).alias("id")).distinct()
    ids = written(each.select("id").distinct(), "exact-ids")
    view = documents_view(docs)
    texts = view.join(checked(ids), same(view, ids, {"doc_id": "id"}), "left_semi")
    low = texts.select("doc_id", F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER).alias("t")).withColumn("d", F.sha2("t", 256))
    both = low.join(checked(each), (low["d"] == each["h"]) & low["doc_id"].eqNullSafe(each["id"]))
    return both.groupBy("sha").agg((F.min("t") == F.max("t")).alias("equal")).where(~F.col("equal")).select("sha")


def against_snapshots(docs: DataFrame, rows: DataFrame, is_snapshot: Column) -> DataFrame:
    """(sha, old, new) of all digests: structs keep_id, group_size of the snapshots' rows and of the batch's; new is null where the batch joins the snapshots' group."""
    snapshot, batch = written(_grouped(rows.where(is_snapshot)), "exact-snapshot"), written(_grouped(rows.where(~is_snapshot)), "exact-batch")
    shards = max(1, -(-snapshot.count() // SHARD_KEYS))
    shard = F.pmod(F.xxhash64("sha"), F.lit(shards)).cast("int")
    filters = snapshot.select("sha", shard.alias("shard")).groupBy("shard").applyInArrow(_build, "shard int, filter binary")
    positive = batch.select("sha", "keep_id", shard.alias("shard")).groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(_screen, "sha binary, keep_id long")
    pairs = written(positive.join(snapshot.select("sha", F.col("keep_id").alias("b")), "sha").select("sha", F.col("keep_id").alias("a"), "b"), "exact-pairs")
    apart = differing(docs, pairs).withColumn("side", F.lit(1))
    batch = batch.join(F.broadcast(apart) if apart.limit(2).count() < 2 else apart, "sha", "left")
    both = snapshot.withColumn("side", F.lit(0)).unionByName(batch.withColumn("side", F.coalesce("side", F.lit(0))))
    found = both.groupBy("sha", "side").agg(F.struct(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size")).alias("g"))
    return found.groupBy("sha").agg(F.max(F.when(F.col("side") == 0, F.col("g"))).alias("old"), F.max(F.when(F.col("side") == 1, F.col("g"))).alias("new"))


def default_snapshot() -> Column:
    """Three of four rows, by doc_id, play the snapshots that are already stored; the rest is the new batch."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(4)) < 3


def dedup_groups(docs: DataFrame, is_snapshot: Column | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, th."""
    is_snapshot = default_snapshot() if is_snapshot is None else F.coalesce(is_snapshot, F.lit(False))
    rows = written(digests(docs), "exact-digests")
    groups = against_snapshots(docs, rows, is_snapshot)
    counted = rows.groupBy("doc_id", "sha", "th").agg(F.count(F.lit(1)).alias("copies"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "sha").orderBy("th"))
    counted = counted.withColumn("stored", is_snapshot).withColumn("first", rank == 1)
    own = F.when(F.coalesce("stored", F.lit(False)), F.col("old")).otherwise(F.coalesce("new", "old"))
    joined = counted.join(groups, "sha").withColumn("g", own).select("*", "g.keep_id", "g.group_size")
    each = joined.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("nth"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("first") & (F.col("nth") == 1)
    return each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "th", "copies")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    groups = dedup_groups(docs)
    gone = written(groups.groupBy("doc_id", "th").agg(F.max("kept").alias("kept"), F.max("copies").alias("copies")).where(~F.col("kept") | (F.col("copies") > 1)).select("doc_id", "th", "kept"), "exact-gone")
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), raw_hash("text").alias("th"))
    pair = same(packed, gone, {"doc_id": "doc_id", "th": "th"})
    single = packed.join(checked(gone), pair, "left_anti").select("row.*")
    again = packed.join(checked(gone.where("kept")), same(packed, gone, {"doc_id": "doc_id", "th": "th"}), "left_semi")
    nth = F.row_number().over(Window.partitionBy("doc_id", "th").orderBy(F.xxhash64("row")))
    return single.unionByName(again.withColumn("nth", nth).where("nth = 1").select("row.*"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_groups(table(spark, sf_dir, "documents")).drop("th", "copies")


OP8_SQL = f"""
with t as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as n from documents)
select doc_id, max(doc_id) over (partition by n) as keep_id, count(*) over (partition by n) as group_size,
       doc_id = max(doc_id) over (partition by n) as kept, sha256(n) as text_sha256
from t"""
