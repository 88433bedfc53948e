"""Reminders once a session and the gates a session passes: a stateful operator with timers, and its batch form.

A session is a user's events that follow each other in GAP or less. The first event of the kind that
``asks`` is reminded, later ones of the session aren't. A gate is passed when an event of its kind comes at
or after the session's first asking one. Events without a time or a user are in no session.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from navspark.sources.corpus import table
from navspark.streaming.usage_stream import append_available, event_stream, once

ASKS, GATES, GAP_MINUTES = "view", ("click", "purchase"), 15
GAP = GAP_MINUTES * 60_000_000
#: A session's summary: times in microseconds; asked_us, asked_id: of the first asking event; past: the last event of each gate.
STATE = "last long, n long, asked long, asked_us long, asked_id long, past1 long, past2 long"
OUT = "user_id long, first_us long, last_us long, n long, asked long, reminded_id long, clicked boolean, purchased boolean"
#: Users are dealt out over so many groups that share a state and a timer: a call costs milliseconds, however few rows it has. Another number needs a new state.
GROUPS = 2048
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _least(a: tuple, b: tuple) -> tuple:
    return min((x for x in (a, b) if x[0] is not None), default=(None, None))


def _latest(a: int | None, b: int | None) -> int | None:
    return max((x for x in (a, b) if x is not None), default=None)


def merged(spans: list[tuple]) -> list[tuple]:
    """Summaries (first, *STATE) in order, with those no farther apart than GAP made one."""
    out: list[tuple] = []
    for s in sorted(spans, key=lambda s: s[0]):
        if out and s[0] - out[-1][1] <= GAP:
            o = out[-1]
            out[-1] = (o[0], max(o[1], s[1]), o[2] + s[2], o[3] + s[3], *_least(o[4:6], s[4:6]), _latest(o[6], s[6]), _latest(o[7], s[7]))
        else:
            out.append(s)
    return out


class Reminders(StatefulProcessor):
    """Keeps a summary of each open session of a group of users and gives it when the watermark passes its end.

    The state is as large as the sessions that the watermark still leaves open, whatever number of events they have.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("sessions", f"user_id long, first long, {STATE}")

    def _spans(self) -> dict[int, list[tuple]]:
        """The group's open sessions by user; a list is read and put whole, in batches."""
        out: dict[int, list[tuple]] = {}
        for user, *span in self.open.get():
            out.setdefault(user, []).append(tuple(span))
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        spans = self._spans()
        for batch in rows:
            new: dict[int, list[tuple]] = {}
            for user, event, us, kind in zip(batch["user_id"].tolist(), batch["event_id"].tolist(), batch["us"].tolist(), batch["event_type"].tolist(), strict=True):
                ask = kind == ASKS
                new.setdefault(user, []).append((us, us, 1, int(ask), us if ask else None, event if ask else None, *(us if kind == g else None for g in GATES)))
            for user, more in new.items():
                spans[user] = merged([*spans.get(user, ()), *more])
        self._keep([(user, *s) for user, of in spans.items() for s in of])
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        before = [(user, *s) for user, of in self._spans().items() for s in of]
        done = sorted((s for s in before if s[2] + GAP <= limit), key=lambda s: s[:2])
        self._keep([s for s in before if s[2] + GAP > limit])
        past = lambda s, k: s[5] is not None and s[k] is not None and s[k] >= s[5]
        columns = {"user_id": [s[0] for s in done], "first_us": [s[1] for s in done], "last_us": [s[2] for s in done], "n": [s[3] for s in done], "asked": [s[4] for s in done]}
        yield pd.DataFrame(columns | {"reminded_id": pd.array([s[6] for s in done], dtype="Int64"), "clicked": [past(s, 7) for s in done], "purchased": [past(s, 8) for s in done]})

    def _keep(self, spans: list[tuple]) -> None:
        if spans:
            self.open.put(spans)
        else:
            self.open.clear()
        wanted = {min(-(-(s[2] + GAP) // 1000) for s in spans)} if spans else set()  # one timer a group: the next end
        there = set(self.handle.listTimers())
        for t in there - wanted:
            self.handle.deleteTimer(t)
        for t in wanted - there:
            self.handle.registerTimer(t)

    def close(self) -> None:
        pass


def _events(events: DataFrame) -> DataFrame:
    return once(events).where("at is not null and user_id is not null")


def _named(rows: DataFrame) -> DataFrame:
    return rows.select("user_id", F.timestamp_micros("first_us").alias("first"), F.timestamp_micros("last_us").alias("last"), "n", "asked", "reminded_id", "clicked", "purchased")


def reminders(events: DataFrame) -> DataFrame:
    """user_id, first, last, n, asked, reminded_id, clicked, purchased of every session.

    A stream gives a session once, when the watermark, a day behind the latest event, has passed its end; rows that come later count for none.
    """
    rows = _events(events).withColumn("us", F.unix_micros("at"))
    if events.isStreaming:
        return _named(rows.withColumn("group", F.pmod(F.hash("user_id"), F.lit(GROUPS))).groupBy("group").transformWithStateInPandas(Reminders(), OUT, "Append", "EventTime"))
    asks, kind = F.col("event_type") == ASKS, F.col("event_type")
    first, past = F.min(F.when(asks, F.col("us"))), [F.max(F.when(kind == g, F.col("us"))) for g in GATES]
    found = rows.groupBy("user_id", F.session_window("at", f"{GAP_MINUTES} minutes").alias("w")).agg(
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(asks).alias("asked"),
        F.min(F.when(asks, F.struct("us", "event_id")))["event_id"].alias("reminded_id"),
        *(F.coalesce(p >= first, F.lit(False)).alias(name) for p, name in zip(past, ("clicked", "purchased"), strict=True)),
    )
    return _named(found)


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The store that keeps state by key and timers, for the streams that begin within."""
    before = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER[0], before)


def _shown(rows: DataFrame) -> DataFrame:
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return rows.select("user_id", text("first"), text("last"), "n", "asked", "reminded_id", "clicked", "purchased")


def q_reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(reminders(table(spark, sf_dir, "events")))


def q_reminders_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions that a stream of the events has closed when it has read them all."""
    events, root = event_stream(spark, sf_dir)
    with rocks(spark):
        return _shown(append_available(reminders(events), root))


QUERIES = {"session_reminders": q_reminders, "session_reminders_stream": q_reminders_stream}
_SESSIONS = """
with o as (select distinct on (event_id) event_id, user_id, ts, event_type from events where ts is not null and user_id is not null),
     g as (select *, coalesce(ts - lag(ts) over (partition by user_id order by ts) <= interval '15 minutes', false) as joined from o),
     s as (select *, sum(case when joined then 0 else 1 end) over (partition by user_id order by ts rows unbounded preceding) as nth from g)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as first, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') as last, count(*) as n,
 count(*) filter (where event_type = 'view') as asked, first(event_id order by ts, event_id) filter (where event_type = 'view') as reminded_id,
 coalesce(max(ts) filter (where event_type = 'click') >= min(ts) filter (where event_type = 'view'), false) as clicked,
 coalesce(max(ts) filter (where event_type = 'purchase') >= min(ts) filter (where event_type = 'view'), false) as purchased
from s group by user_id, nth"""
SQL = {
    "session_reminders": _SESSIONS,
    "session_reminders_stream": f"{_SESSIONS} having max(ts) + interval '15 minutes' <= (select max(ts) from events) - interval '1 day'",
}
