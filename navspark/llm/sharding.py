"""Sharding by a two-pass external shuffle, under the law ``rows``: shard sizes differ by one row at most.

Pass one scatters the rows uniformly into memory-sized buckets by a seeded hash and counts each bucket.
Pass two permutes each bucket by a seeded Fisher-Yates shuffle and writes it. A row's place in the whole
is its bucket's offset plus its place in the bucket; place modulo the number of shards is its shard and
the quotient its slot, so shards differ by one row at most and slots have no gaps.

Null texts count as no bytes (checksum 0); null doc_ids, repeated rows and equal texts are rows like any
other and are scattered apart, as a row's number in the scan is hashed too. The input must be a table
scan or another plan that gives its rows in the same order again; a bucket whose count differs between
the passes raises an error. An empty table gives no shards. The whole input row is kept in the struct
column ``document``, so no column name can clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navspark.llm.common import scratch, table

#: UTF-8 bytes of text that a bucket holds, about.
BUCKET_BYTES = 8 << 20
SHARDS, SEED = 24, 20_240_607


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A uniform permutation of range(n): for i from the top, swap place i with a random place up to i."""
    order = list(range(n))
    draws = np.random.Generator(np.random.PCG64(seed)).integers(0, np.arange(1, n + 1)) if n else []
    for i in range(n - 1, 0, -1):
        j = int(draws[i])
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def shard(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes the shards under ``path`` (folders shard=0, ...) and reads them: shard, slot, size, text_crc32, document."""
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("b")).first()["b"]
    buckets = max(1, -(-total // bucket_bytes))
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("document"))
    scattered = numbered.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "rid", "document.doc_id"), F.lit(buckets)).cast("int"))
    counts = {r["bucket"]: r["n"] for r in scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a bucket
    order = sorted(counts)
    offset = dict(zip(order, np.cumsum([0, *(counts[b] for b in order)])[:-1].tolist(), strict=True)) if order else {}

    def permute(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        if rows.num_rows != counts[bucket]:
            raise RuntimeError(f"bucket {bucket} had {counts[bucket]} rows in the first pass and {rows.num_rows} in the second")
        by_number = np.argsort(rows.column("rid").to_numpy(), kind="stable")
        place = offset[bucket] + np.arange(rows.num_rows)
        take = by_number[fisher_yates(rows.num_rows, [seed, bucket])]
        into, slot = place % shards, place // shards
        final = np.lexsort((slot, into))
        out = rows.select(["size", "text_crc32", "document"]).take(pa.array(take[final]))
        return out.add_column(0, "slot", pa.array(slot[final])).add_column(0, "shard", pa.array(into[final].astype(np.int32)))

    document = scattered.schema["document"].dataType.simpleString()
    body = F.coalesce(F.col("document.text").cast("string"), F.lit(""))
    sized = scattered.select("bucket", "rid", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), "document")
    placed = sized.groupBy("bucket").applyInArrow(permute, f"shard int, slot long, size long, text_crc32 long, document {document}")
    placed.write.partitionBy("shard").parquet(path)
    kinds = placed.schema
    return spark.read.schema(kinds).parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard(table(spark, sf_dir, "documents"), scratch(spark, "shards"))
    return rows.select(F.col("document.doc_id").cast("long").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
