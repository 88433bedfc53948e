"""Reminders: a stream with timers gives what the batch does, over a restart, with a late row and a bridge between sessions."""

from __future__ import annotations

from datetime import datetime, timedelta

from navspark.streaming.reminders import merged, reminders, rocks
from navspark.streaming.usage_stream import append_available

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"
START = datetime(2024, 1, 1)
DAY = 24 * 60


def put(spark, folder, name, rows):
    spark.createDataFrame([(i, None if m is None else START + timedelta(minutes=m), u, kind) for i, m, u, kind in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def plain(rows):
    return sorted((r.user_id, r["first"], r["last"], r.n, r.asked, r.reminded_id, r.clicked, r.purchased) for r in rows.collect())


def run(spark, folder, root):
    with rocks(spark):
        return plain(append_available(reminders(spark.readStream.schema(SCHEMA).parquet(f"{folder}/*")), root))


def test_stream_equals_batch(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "run")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    put(spark, folder, "a", [(1, 0, 7, "click"), (2, 10, 7, "view"), (2, 10, 7, "view"), (3, 20, 7, "click"), (4, 12, 7, "view"), (5, 60, 7, "purchase"), (6, 2 * DAY, 9, "view"), (7, None, 7, "view"), (8, 5, None, "view")])
    at = lambda m: START + timedelta(minutes=m)
    first = run(spark, folder, root)
    assert first == [(7, at(0), at(20), 4, 2, 2, True, False), (7, at(60), at(60), 1, 0, None, False, False)]
    # After a restart: two open sessions, 24 minutes apart, become one by a row that comes between them; a late row joins none.
    put(spark, folder, "b", [(9, 2 * DAY + 24, 9, "purchase"), (10, 30, 7, "view")])
    assert run(spark, folder, root) == first
    put(spark, folder, "c", [(11, 2 * DAY + 12, 9, "click"), (12, 2 * DAY + 40, 9, "view")])
    assert run(spark, folder, root) == first
    put(spark, folder, "d", [(13, 5 * DAY, 1, "view")])
    again = run(spark, folder, root)
    assert again == first + [(9, at(2 * DAY), at(2 * DAY + 24), 3, 1, 6, True, True), (9, at(2 * DAY + 40), at(2 * DAY + 40), 1, 1, 12, False, False)]
    batch = spark.read.parquet(f"{folder}/*").where("event_id <> 10")
    assert again == [r for r in plain(reminders(batch)) if r[2] < at(4 * DAY)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    assert reminders(batch.limit(0)).count() == 0


def test_summaries_merge_in_any_order():
    one = lambda m, k: (m * 60_000_000, m * 60_000_000, 1, int(k == "v"), *((m, m) if k == "v" else (None, None)), m if k == "c" else None, m if k == "p" else None)
    rows = [one(0, "v"), one(14, "c"), one(29, "p"), one(45, "v"), one(59, "v")]
    whole = merged(rows)
    assert [(s[0] // 60_000_000, s[1] // 60_000_000, s[2]) for s in whole] == [(0, 29, 3), (45, 59, 2)]
    for k in range(5):
        assert merged([*merged(rows[k:][::-1]), *merged(rows[:k])]) == whole
