"""The usage log's sink: appends, a job that dies, generations, malformed lines, and recorded operations."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from navspark.sources.corpus import usage_lines
from navspark.sources.usage_log import NotApproved, append, generations, log_lines, publish, recorded

SCHEMA = "ts string, command string, latency_ms double"


def events(spark, *names):
    return spark.createDataFrame([("2024-01-01T00:00:00Z", n, 1.5) for n in names], SCHEMA).repartition(3)


def commands(spark, path, **more):
    return sorted(r.command for r in usage_lines(log_lines(spark, path, **more))[0].collect())


def test_append_and_failure(spark, tmp_path):
    path = str(tmp_path / "log")
    assert log_lines(spark, path).count() == 0
    append(events(spark, "search", "context", "index"), path)
    append(events(spark, "status"), path)
    append(events(spark).limit(0), path)
    assert commands(spark, path) == ["context", "index", "search", "status"] and len(generations(path)) == 1
    before = sorted(os.listdir(f"{path}/data"))
    assert all(os.stat(f"{path}/data/{f}").st_mode & 0o777 == 0o600 for f in before)
    # One task of the job fails after others have written: no line of it is read.
    bad = spark.range(0, 4, 1, 4).select(F.lit("t").alias("ts"), F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise("half").alias("command"))
    with pytest.raises(Exception, match="lost"):
        append(bad, path)
    assert commands(spark, path) == ["context", "index", "search", "status"] and len(os.listdir(f"{path}/commits")) == 2
    with pytest.raises(Exception, match="only appended"):
        events(spark, "x").write.format("usage_log").option("path", path).mode("overwrite").save()


def test_generations(spark, tmp_path):
    path = str(tmp_path / "log")
    for name in "abcdefg":
        append(events(spark, name), path, cap=70)
    # A line has about 65 bytes: the second append still finds no more than the cap, the third does.
    assert [len(g) for g in generations(path, 70)] == [2, 1]
    assert commands(spark, path, cap=70) == ["g"] and commands(spark, path, cap=70, previous=True) == ["e", "f", "g"]
    assert len(os.listdir(f"{path}/data")) == len(os.listdir(f"{path}/commits")) == 3


def test_malformed_lines(spark, tmp_path):
    path = str(tmp_path / "log")
    append(events(spark, "search"), path)
    with open(f"{path}/data/other.jsonl", "w") as f:
        f.write('{"ts":"t","command":"context"}\n{"ts":"t","comm\n\n[1]\n{"ts":"t"}\n')
    with open(f"{path}/data/unseen.jsonl", "w") as f:
        f.write('{"ts":"t","command":"never committed"}\n')
    publish(path, [("data/other.jsonl", 60)])
    good, bad = usage_lines(log_lines(spark, path))
    assert sorted(r.command for r in good.collect()) == ["context", "search"] and bad.first().malformed == 3


def test_recorded(spark, tmp_path):
    path = str(tmp_path / "log")
    assert recorded(spark, path, "search", lambda: [1], root="/r/a", adapter="cli", fields=lambda r: {"result_count": len(r), "query": "q"}) == [1]
    assert recorded(spark, path, "search", list, outcome=lambda r: "ok" if r else "empty") == []

    def fail(error):
        raise error

    error = KeyError("k")
    with pytest.raises(KeyError) as seen:
        recorded(spark, path, "index", lambda: fail(error))
    assert seen.value is error
    with pytest.raises(NotApproved):
        recorded(spark, path, "status", lambda: fail(NotApproved("no")))
    got = sorted((r.command, r.outcome, r.query, r.result_count, r.repo_key is not None) for r in usage_lines(log_lines(spark, path))[0].collect())
    assert got == [("index", "error", None, None, False), ("search", "empty", None, None, False), ("search", "ok", "q", 1, True), ("status", "not_approved", None, None, False)]
    # A log that can't be written changes nothing.
    (tmp_path / "file").write_text("x")
    assert recorded(spark, str(tmp_path / "file"), "search", lambda: 5) == 5
    assert recorded(spark, path, "search", lambda: 6, outcome=lambda r: 1 / 0) == 6
