"""The event log as a stream: de-duplicated hourly, sliding and session windows with a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navspark.sources.corpus import table


def once(events: DataFrame) -> DataFrame:
    """event_id, at, user_id, event_type: one row an event; a stream waits a day for late ones."""
    rows = events.select("event_id", F.col("ts").cast("timestamp").alias("at"), "user_id", "event_type")
    if events.isStreaming:
        return rows.withWatermark("at", "1 day").dropDuplicatesWithinWatermark(["event_id"])
    return rows.dropDuplicates(["event_id"])


def hourly(events: DataFrame, length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """hour, event_type, n: works alike on a batch and on a stream; with ``slide``, windows begin that often and overlap."""
    window = F.window("at", length, slide) if slide else F.window("at", length)
    return once(events).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "15 minutes") -> DataFrame:
    """user_id, first, last, n: a user's events that follow each other in less than the gap; events without a time have none.

    A stream gives a session once, when the watermark, a day behind the latest event, has passed its end; a row that comes later than that counts for none.
    """
    rows = once(events).where("at is not null").groupBy("user_id", F.session_window("at", gap).alias("w"))
    return rows.agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n")).select("user_id", "first", "last", "n")


def followed(events: DataFrame, first: str = "view", then: str = "purchase", within: str = "1 hour") -> DataFrame:
    """first_id, then_id, user_id, lag_us: events of one kind that a user's event of another follows in time; a join of two streams or of two tables.

    Both sides carry a watermark and the join bounds their times, so a stream drops the state of events that can't be joined any more.
    """
    side = lambda kind, name: once(events).where(F.col("event_type") == kind).select(F.col("event_id").alias(f"{name}_id"), F.col("user_id").alias(f"{name}_user"), F.col("at").alias(f"{name}_at"))
    on = F.expr(f"then_user = first_user and then_at >= first_at and then_at <= first_at + interval {within}")
    rows = side(first, "first").join(side(then, "then"), on)
    return rows.select("first_id", "then_id", F.col("first_user").alias("user_id"), (F.unix_micros("then_at") - F.unix_micros("first_at")).alias("lag_us"))


def append_available(stream: DataFrame, root: str) -> DataFrame:
    """Runs a stream of final rows over what is there, and reads what it wrote."""
    stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").option("path", f"{root}/out").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")


def run_available(stream: DataFrame, root: str) -> DataFrame:
    """Runs a stream over what is there; each trigger's changed rows replace earlier ones of the same window."""
    spark = stream.sparkSession
    path = f"{root}/out"

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("trigger", F.lit(number)).write.mode("overwrite").parquet(f"{path}/trigger={number}")

    stream.writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").foreachBatch(save).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{path}/*")
    return rows.groupBy("hour", "event_type").agg(F.max_by("n", "trigger").alias("n"))


def event_stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The events as a stream, and a new folder for its state."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or "/tmp/navspark-checkpoints"
    path = f"{sf_dir}/event[s].parquet"  # a pattern: the source takes a single file only so
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(path), f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def streamed(spark: SparkSession, sf_dir: str, length: str, slide: str | None = None) -> DataFrame:
    events, root = event_stream(spark, sf_dir)
    out = run_available(hourly(events, length, slide), root)
    return out.select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n")


def q_followed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, root = event_stream(spark, sf_dir)
    return append_available(followed(events), root)


def q_hourly_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamed(spark, sf_dir, "1 hour")


def q_sliding_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamed(spark, sf_dir, "1 day", "6 hours")


def q_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return sessions(table(spark, sf_dir, "events")).select("user_id", text("first"), text("last"), "n")


def q_sessions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions that a stream of the events has closed when it has read them all."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    events, root = event_stream(spark, sf_dir)
    return append_available(sessions(events), root).select("user_id", text("first"), text("last"), "n")


QUERIES = {"sessions_stream": q_sessions_stream, "hourly_stream": q_hourly_stream, "sliding_stream": q_sliding_stream, "sessions": q_sessions, "followed_stream": q_followed_stream}
_SESSIONS = """
with o as (select distinct on (event_id) event_id, user_id, ts from events where ts is not null),
     g as (select user_id, ts, coalesce(ts - lag(ts) over (partition by user_id order by ts) < interval '15 minutes', false) as joined from o),
     s as (select user_id, ts, sum(case when joined then 0 else 1 end) over (partition by user_id order by ts rows unbounded preceding) as nth from g)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as first, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') as last, count(*) as n from s group by user_id, nth"""
SQL = {
    "followed_stream": """
with o as (select distinct on (event_id) event_id, user_id, ts, event_type from events where ts is not null)
select a.event_id as first_id, b.event_id as then_id, a.user_id, epoch_us(b.ts) - epoch_us(a.ts) as lag_us from o a join o b
 on a.user_id = b.user_id and a.event_type = 'view' and b.event_type = 'purchase' and b.ts >= a.ts and b.ts <= a.ts + interval '1 hour'""",
    "hourly_stream": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as hour, event_type, count(distinct event_id) as n from events group by all",
    "sliding_stream": """
with w as (select event_id, event_type, time_bucket(interval '6 hours', ts) - to_hours(6 * unnest(range(4))) as s from events where ts is not null)
select strftime(s, '%Y-%m-%d %H:%M:%S') as hour, event_type, count(distinct event_id) as n from w group by all""",
    "sessions": _SESSIONS,
    "sessions_stream": f"{_SESSIONS} having max(ts) + interval '15 minutes' <= (select max(ts) from events) - interval '1 day'",
}
