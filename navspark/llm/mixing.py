"""Mixing sources to target weights by weighted fair queueing.

A document's size is its number of words (null text: 0). Sources, by code point with null last, weigh
1, 2, 3, repeating; their targets share all sizes by weight and stop at three times the source's size,
the excess being shared again by weight until none is above. Each source's documents are put in a seeded
random order and may be queued up to three times over; a copy's virtual finish time is its source's
words up to and including it, divided by the source's target. All copies are range-sorted by finish time
and taken from the front until the words of all sources are used up, so every source comes near its target.

Rows equal in source, doc_id and text are one unit and are taken alike. Rows without words are taken
0 times. Nulls in doc_id or source are values like any other. An empty table gives an empty result.
No group is held in one task: a source's order is cut into buckets of about BUCKET_ROWS units whose
totals are summed first, and the sorted copies are cut at the one partition in which the budget ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from navspark.llm.common import checked, claim, documents_view, same, table, text_slices, written
from navspark.llm.exact_dedup import raw_hash
from navspark.llm.textcore import Words, buffers

WEIGHTS, MOST, SEED = (1, 2, 3), 3, 77
BUCKET_ROWS = 2_000
SORT_ROWS = 100_000


def waterfill(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> list[float]:
    """Targets of sources of these sizes, in order."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    target, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        share = left / sum(w[i] for i in open_)
        above = [i for i in open_ if share * w[i] > most * sizes[i]]
        if not above:
            for i in open_:
                target[i] = share * w[i]
            break
        for i in above:
            target[i] = float(most * sizes[i])
            left -= target[i]
            open_.remove(i)
    return target


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, th, size of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("mixing", lambda: None)
        for batch in text_slices(batches, "text", 256 << 10):
            size = pa.array(Words(*buffers(batch.column(1))).count.astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), size], ["doc_id", "source", "th", "size"])

    view = documents_view(docs, F.col("source").cast("string").alias("source"), raw_hash("text").alias("th"))
    return view.mapInArrow(run, "doc_id long, source string, th long, size long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """One row a unit: doc_id, source, th, size, rows (that it stands for), source_size, target, times (each row is taken)."""
    spark = docs.sparkSession
    units = measured(docs).groupBy("source", "doc_id", "th").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    units = written(units.withColumn("place", F.xxhash64(F.lit(seed), "doc_id", "th")), "mix-units")
    number = units.count()
    buckets = max(1, -(-number // BUCKET_ROWS))
    amount = F.col("size") * F.col("rows")
    # One row a source; sources are few beside documents.
    found = units.groupBy("source").agg(F.sum(amount).alias("total")).orderBy(F.col("source").asc_nulls_last()).collect()
    shares = waterfill([r["total"] for r in found], weights, most)
    targets = spark.createDataFrame([(r["source"], r["total"], t) for r, t in zip(found, shares, strict=True)], "t_source string, source_size long, target double")
    units = units.join(checked(targets, len(found)), units["source"].eqNullSafe(targets["t_source"])).drop("t_source")

    bucket = F.least(F.lit(buckets - 1), F.floor((F.col("place") / F.lit(float(1 << 64)) + 0.5) * buckets)).cast("int")
    queue = units.where("size > 0 and target > 0").withColumn("bucket", bucket)
    totals = queue.groupBy("source", "bucket").agg(F.sum(amount).alias("in_bucket"))
    ahead = totals.withColumn("ahead", F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    ahead = written(ahead.select(F.col("source").alias("a_source"), F.col("bucket").alias("a_bucket"), F.coalesce("ahead", F.lit(0)).alias("ahead")), "mix-ahead")
    queue = queue.join(checked(ahead), queue["source"].eqNullSafe(ahead["a_source"]) & (queue["bucket"] == ahead["a_bucket"]))
    inside = Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "th").rowsBetween(Window.unboundedPreceding, 0)
    served = F.col("ahead") + F.sum(amount).over(inside)
    queue = queue.withColumn("served", served).withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(most))))
    finish = (F.col("served") + (F.col("turn") - 1) * F.col("source_size")) / F.col("target")
    copies = queue.select("source", "doc_id", "th", amount.alias("words"), finish.alias("finish"), "place", "turn")

    order = ["finish", "source", "place", "doc_id", "th", "turn"]
    parts = max(4, -(-number * most // SORT_ROWS))
    line = copies.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    line = written(line, "mix-line")
    sums = sorted((r["part"], r["words"]) for r in line.groupBy("part").agg(F.sum("words").alias("words")).collect())  # one row a partition
    budget, before, cut = sum(r["total"] for r in found), 0, None
    for part, words in sums:
        if before + words > budget:
            cut = part
            break
        before += words
    taken = line if cut is None else line.where(F.col("part") < cut)
    taken = taken.select("source", "doc_id", "th")
    if cut is not None:
        last = line.where(F.col("part") == cut).withColumn("used", F.sum("words").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
        taken = taken.unionByName(last.where(F.col("used") <= budget - before).select("source", "doc_id", "th"))
    times = taken.groupBy("source", "doc_id", "th").agg(F.count(F.lit(1)).cast("int").alias("times"))
    times = times.select(*(F.col(c).alias(f"x_{c}") for c in ("source", "doc_id", "th")), "times")
    out = units.join(times, same(units, times, {"source": "x_source", "doc_id": "x_doc_id", "th": "x_th"}), "left")
    return out.select("doc_id", "source", "th", "size", "rows", "source_size", "target", F.coalesce("times", F.lit(0)).alias("times"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all their columns."""
    plan = mix(docs).where("times > 0").select(F.col("source").alias("m_source"), F.col("doc_id").alias("m_doc_id"), F.col("th").alias("m_th"), "times")
    plan = written(plan, "mix-plan")
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), raw_hash("text").alias("th"), F.col("source").cast("string").alias("source"))
    both = packed.join(checked(plan), same(packed, plan, {"doc_id": "m_doc_id", "th": "m_th", "source": "m_source"}))
    return both.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix(table(spark, sf_dir, "documents"))
    each = plan.select("*", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("nth"))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))
