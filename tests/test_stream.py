"""Sessions as a stream: equal to the batch for what is closed, over a restart and with a late row."""

from __future__ import annotations

from datetime import datetime, timedelta

from navspark.streaming.usage_stream import append_available, sessions

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"
START = datetime(2024, 1, 1)


def put(spark, folder, name, rows):
    spark.createDataFrame([(i, START + timedelta(minutes=m), u, "view") for i, m, u in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def run(spark, folder, root):
    stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/*")
    return sorted((r.user_id, r["first"], r["last"], r.n) for r in append_available(sessions(stream), root).collect())


def test_sessions_over_a_restart(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "run")
    day = 24 * 60
    put(spark, folder, "a", [(1, 0, 7), (2, 10, 7), (3, 24, 7), (4, 60, 7), (2, 10, 7), (5, 5, 8), (6, 2 * day, 9)])
    at = lambda m: START + timedelta(minutes=m)
    first = run(spark, folder, root)
    # Closed: what ended a day before the latest event; a repeated event counts once.
    assert first == [(7, at(0), at(24), 3), (7, at(60), at(60), 1), (8, at(5), at(5), 1)]
    # The stream goes on: its open session grows, a late row joins none, and what was given isn't given again.
    put(spark, folder, "b", [(7, 2 * day + 10, 9), (8, 30, 7), (9, 2 * day + 40, 9), (10, 4 * day, 9)])
    again = run(spark, folder, root)
    assert again == first + [(9, at(2 * day), at(2 * day + 10), 2), (9, at(2 * day + 40), at(2 * day + 40), 1)]
    batch = spark.read.parquet(f"{folder}/*").where("event_id <> 8")
    closed = sorted((r.user_id, r["first"], r["last"], r.n) for r in sessions(batch).collect() if r["last"] < at(3 * day))
    assert again == closed
