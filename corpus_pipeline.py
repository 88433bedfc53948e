"""A corpus pipeline over documents: quality rules, exact dedup, near dedup, mixing, tokenisation.

Each stage's function takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but
the last return the columns of documents. A row that the quality rules reject goes; of equal texts and
of near copies (five-word shingles, similarity 0.8 or more) one row stays; the mix repeats a row as often
as it takes it; the last stage encodes every row that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from navspark.llm.bpe import encoded
from navspark.llm.common import table, written
from navspark.llm.exact_dedup import drop_copies
from navspark.llm.minhash import drop_near_copies
from navspark.llm.mixing import mixed_rows
from navspark.llm.quality import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_rows(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encoded(docs)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("mixing", mixing), ("byte-level BPE", byte_bpe)]
#: Learnt rules, similarity classes and tokenisation aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
