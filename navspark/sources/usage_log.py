"""The usage log as a sink: JSON lines that become visible all at once, in generations bounded in bytes.

``df.write.format("usage_log").option("path", folder).mode("append").save()`` appends a frame's rows, one JSON
line each without its nulls. Tasks write files of their own below ``data``; the commit names them in one file
that is moved into ``commits``. What no commit names is never read, so a job that dies leaves no lines, and
two jobs that append at once don't meet. A commit that finds more than ``cap`` bytes in the current
generation begins the next one; the generation before it is kept, older ones are removed.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, TypeVar

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from navspark.sources.corpus import table, usage_lines
from navspark.sources.git import repo_key
from navspark.sources.scratch import shared_dir
from navspark.sources.upkeep import LOG_BYTES

#: A commit's name: when, which, and how many bytes its files have.
COMMIT = re.compile(r"(\d{20})-([0-9a-f]{32})-(\d+)\.json")
T = TypeVar("T")


class NotApproved(PermissionError):
    """The repository isn't registered."""


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    local = re.sub(r"^file:/+", "/", path).rstrip("/")
    return (pafs.LocalFileSystem(), local) if local.startswith("/") else pafs.FileSystem.from_uri(path.rstrip("/"))


def _put(path: str, name: str, data: bytes) -> None:
    """A file that only its owner may read, where the file system knows owners."""
    fs, root = _place(path)
    with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
        out.write(data)
    if isinstance(fs, pafs.LocalFileSystem):
        os.chmod(f"{root}/{name}", 0o600)


@dataclass
class Lines(WriterCommitMessage):
    """The files of a task and their bytes."""

    files: list[tuple[str, int]] = field(default_factory=list)


class LogWriter(DataSourceArrowWriter):
    def __init__(self, path: str, cap: int):
        self.path, self.cap = path, cap

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Lines:
        """One file a batch, so that a task holds no more than a batch."""
        out = Lines()
        fs, root = _place(self.path)
        fs.create_dir(f"{root}/data", recursive=True)
        for batch in iterator:
            lines = [json.dumps({k: v for k, v in row.items() if v is not None}, ensure_ascii=False, separators=(",", ":"), default=str) for row in batch.to_pylist()]
            if lines:
                data = ("\n".join(lines) + "\n").encode()
                out.files.append((f"data/{uuid.uuid4().hex}.jsonl", len(data)))
                _put(self.path, *out.files[-1][:1], data)
        return out

    def commit(self, messages: list[Lines | None]) -> None:
        files = [f for m in messages if m for f in m.files]
        if files:
            publish(self.path, files)
            sweep(self.path, self.cap)

    def abort(self, messages: list[Lines | None]) -> None:
        fs, root = _place(self.path)
        for name, _ in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{root}/{name}")


class UsageLog(DataSource):
    """The sink's format; options: path, and cap (bytes of a generation from which the next begins)."""

    @classmethod
    def name(cls) -> str:
        return "usage_log"

    def schema(self) -> str:
        return "ts string, command string"

    def writer(self, schema: Any, overwrite: bool) -> LogWriter:
        if overwrite:
            raise ValueError("a usage log is only appended to")
        return LogWriter(self.options["path"], int(self.options.get("cap", LOG_BYTES)))


def publish(path: str, files: list[tuple[str, int]]) -> None:
    """Makes files (name below the folder, bytes) part of the log, all or none."""
    fs, root = _place(path)
    fs.create_dir(f"{root}/commits", recursive=True)
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex}-{sum(size for _, size in files)}.json"
    _put(path, f"commits/.{name}", json.dumps([n for n, _ in files]).encode())
    fs.move(f"{root}/commits/.{name}", f"{root}/commits/{name}")


def generations(path: str, cap: int = LOG_BYTES) -> list[list[str]]:
    """The names of the commits, oldest first, by generation: a commit that finds more than cap bytes begins a new one."""
    fs, root = _place(path)
    found = fs.get_file_info(pafs.FileSelector(f"{root}/commits", allow_not_found=True))
    out: list[list[str]] = []
    size = 0
    for name in sorted(f.base_name for f in found if COMMIT.fullmatch(f.base_name)):
        if not out or size > cap:
            out.append([])
            size = 0
        out[-1].append(name)
        size += int(COMMIT.fullmatch(name)[3])
    return out


def _files(path: str, commits: list[str]) -> list[str]:
    fs, root = _place(path)
    out = []
    for name in commits:
        with fs.open_input_stream(f"{root}/commits/{name}", compression=None) as file:
            out += json.loads(file.read())
    return out


def sweep(path: str, cap: int = LOG_BYTES) -> int:
    """Removes all generations but the current one and that before; how many commits went. A commit goes before its files."""
    fs, root = _place(path)
    old = [name for g in generations(path, cap)[:-2] for name in g]
    for name in old:
        files = _files(path, [name])
        fs.delete_file(f"{root}/commits/{name}")
        for f in files:
            fs.delete_file(f"{root}/{f}")
    return len(old)


def log_lines(spark: SparkSession, path: str, cap: int = LOG_BYTES, previous: bool = False) -> DataFrame:
    """value: the lines of the current generation, with ``previous`` also of that before; a folder without commits has none.

    The driver holds the names of a generation's files, which its bytes bound.
    """
    commits = [name for g in generations(path, cap)[-2 if previous else -1 :] for name in g]
    files = _files(path, commits)
    if not files:
        return spark.createDataFrame([], "value string")
    scheme = "file://" if _place(path)[1] == re.sub(r"^file:/+", "/", path).rstrip("/") else ""
    base = scheme + re.sub(r"^file:/+", "/", path).rstrip("/")
    return spark.read.text([f"{base}/{f}" for f in files])


def append(events: DataFrame, path: str, cap: int = LOG_BYTES) -> None:
    """Appends events to the log at path."""
    events.sparkSession.dataSource.register(UsageLog)
    events.write.format("usage_log").option("path", path).option("cap", str(cap)).mode("append").save()


def recorded(spark: SparkSession, path: str, command: str, run: Callable[[], T], *, root: str | None = None, adapter: str = "unknown", outcome: Callable[[T], str] | None = None, fields: Callable[[T], dict] | None = None) -> T:
    """run's result or its exception, and one event of it in the log; whatever goes wrong with the log is passed over.

    The outcome is ``ok`` or what ``outcome`` says of the result, ``not_approved`` or ``error`` with the exception's class.
    """
    began = time.time()
    result: Any = None
    caught: BaseException | None = None
    try:
        result = run()
        return result
    except BaseException as error:
        caught = error
        raise
    finally:
        try:
            how = "not_approved" if isinstance(caught, NotApproved) else "error" if caught else outcome(result) if outcome else "ok"
            event = {"v": 1, "ts": time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(began)) + f".{int(began * 1000) % 1000:03d}Z", "command": command, "adapter": adapter, "latency_ms": round((time.time() - began) * 1000, 3), "outcome": how, "repo_root": root, "error_kind": type(caught).__name__ if how == "error" else None}
            if fields and not caught:
                event |= fields(result)
            rows = spark.createDataFrame([json.dumps({k: v for k, v in event.items() if v is not None})], "string")
            kind = spark.range(1).select(F.schema_of_json(F.lit(json.dumps({k: v for k, v in event.items() if v is not None})))).first()[0]
            found = rows.select(F.from_json("value", kind).alias("e")).select("e.*")
            append(found.withColumn("repo_key", repo_key(F.col("repo_root"))) if root else found, path)
        except Exception:  # noqa: BLE001, S110 - measuring never changes what is measured
            pass


def q_usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events written through the sink and read back."""
    path = f"{shared_dir(spark)}/usage-log-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events")
    rows = events.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), F.col("event_type").alias("command"), F.concat(F.lit("u"), "user_id").alias("repo_key"), F.col("value").alias("latency_ms"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('é "\n'), "props")).alias("query"))
    append(rows, path)
    return usage_lines(log_lines(spark, path))[0].select("ts", "command", "repo_key", "latency_ms", "query")


QUERIES = {"src13_usage_log": q_usage_log}
SQL = {
    "src13_usage_log": """
select strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as ts, event_type as command, 'u' || user_id as repo_key, value as latency_ms,
 case when event_id % 3 = 0 then 'é "' || chr(10) || props end as query from events where ts is not null and event_type is not null""",
}
