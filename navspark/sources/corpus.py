"""Corpora as (path, text, size, hash, language): tables, file trees and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navspark.functions.paths import EXTENSIONS, MAX_BYTES, extension, language, under
from navspark.sources.upkeep import skip_reason


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_as_files(docs: DataFrame) -> DataFrame:
    path = F.concat(F.lit("docs/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select("doc_id", path.alias("path"), "text").withColumns({"language": language(F.col("path")), "size": F.octet_length("text").cast("long"), "hash": F.sha2("text", 256)})


def tree(spark: SparkSession, root: str, prefix: str = "", rules: dict[str, list[str]] | None = None) -> DataFrame:
    """Every regular file under root with the reason for leaving it out (null: indexed), and the text of the others; rules are ignore files' lines by name."""
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), f"^{base}/", "")
    rows = raw.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content").where(under(F.col("path"), prefix))
    reason = (
        F.when(skip_reason(F.col("path"), rules).isNotNull(), skip_reason(F.col("path"), rules))
        .when(~extension(F.col("path")).isin(EXTENSIONS), "extension")
        .when(F.col("size") > MAX_BYTES, "too_large")
    )
    # Contents are looked at only where path and size let a file through; latin-1 keeps every byte a character.
    binary = F.contains(F.decode("content", "ISO-8859-1"), F.lit("\x00"))
    rows = rows.withColumn("skip_reason", reason).withColumn("skip_reason", F.when(F.col("skip_reason").isNull() & binary, "binary").otherwise(F.col("skip_reason")))
    text = F.when(F.col("skip_reason").isNull(), F.col("content").cast("string"))
    return rows.select("path", "size", "modified", "skip_reason", text.alias("text"), F.when(F.col("skip_reason").isNull(), F.sha2("content", 256)).alias("hash"), language(F.col("path")).alias("language"))


def merge(old: DataFrame, new: DataFrame, complete: bool = True) -> DataFrame:
    """path and action (insert, update, keep, delete) that take an index from old to new; nothing is deleted after an incomplete scan."""
    a, b = old.select("path", F.col("hash").alias("old_hash")), new.select("path", F.col("hash").alias("new_hash"))
    action = F.when(F.col("old_hash").isNull(), "insert").when(F.col("new_hash").isNull(), "delete" if complete else "keep").when(F.col("old_hash") != F.col("new_hash"), "update").otherwise("keep")
    return a.join(b, "path", "full_outer").select("path", action.alias("action"))


def usage_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of JSON lines in ``value`` and a one-row count of the malformed: not an object, or ts or command missing."""
    kind = "ts string, command string, repo_key string, outcome string, latency_ms double, query string, result_count int, top_score double, stale boolean, cap_hit boolean, approve boolean, resolved_path string, results array<struct<path:string,score:double>>"
    rows = lines.where(F.trim("value") != "").select(F.from_json("value", kind, {"mode": "PERMISSIVE"}).alias("e"))
    good = F.col("e").isNotNull() & F.col("e.ts").isNotNull() & F.col("e.command").isNotNull()
    return rows.where(good).select("e.*"), rows.where(~good | good.isNull()).agg(F.count(F.lit(1)).alias("malformed"))
