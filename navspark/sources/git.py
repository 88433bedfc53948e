"""What version control says of many repositories at once: changed files, nested worktrees, and the registry of approved roots.

Outputs of commands are rows, so a fleet of repositories is read in one plan; only ``git_outputs`` starts
processes, one task for each root.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from navspark.sources.corpus import table

#: What each read runs in a root.
COMMANDS = {"top": ("rev-parse", "--show-toplevel"), "remote": ("config", "--get", "remote.origin.url"), "head": ("rev-parse", "--verify", "HEAD"), "status": ("status", "--porcelain=v1", "-z"), "worktrees": ("worktree", "list", "--porcelain")}


def git_outputs(roots: DataFrame) -> DataFrame:
    """root and one column for each of COMMANDS; null where git isn't there, the root is none or the command says nothing.

    The roots must be on a file system that the executors share.
    """

    def said(root: str, command: tuple[str, ...]) -> str | None:
        try:
            out = subprocess.run(["git", *command], cwd=root, capture_output=True, check=True).stdout.decode("utf-8", "replace")
        except (OSError, ValueError, subprocess.CalledProcessError):
            return None
        return (out if "-z" in command else out.strip()) or None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for root in batch["root"]:
                yield pd.DataFrame([{"root": root} | {name: said(root, c) if root else None for name, c in COMMANDS.items()}])

    return roots.select("root").mapInPandas(run, "root string, " + ", ".join(f"{name} string" for name in COMMANDS))


def status_of(code: Column) -> Column:
    """The word for a two-letter code: the first letter of D, M, A, R, C that it has."""
    out = F.when(code.contains("D"), "deleted")
    for letter, word in (("M", "modified"), ("A", "added"), ("R", "renamed"), ("C", "copied")):
        out = out.when(code.contains(letter), word)
    return out.when(code == "??", "untracked").otherwise("changed")


def changed_files(outputs: DataFrame, key: str = "root", output: str = "status") -> DataFrame:
    """key, path, status, code of the entries in NUL-parted status outputs; null and empty outputs have none, a repeated row has its entries again.

    A rename or copy is followed by the path it came from, which is no entry of its own. Entries that look like a
    rename in a row are entries and origins by turns, so whether one counts follows from how far the last other entry lies back.
    """
    whole = outputs.groupBy(key, F.col(output).alias("all")).agg(F.count(F.lit(1)).alias("times")).withColumn("of", F.sha2("all", 256))
    rows = whole.select(key, "of", "times", F.posexplode(F.split("all", "\x00")).alias("at", "entry"))
    code, path = F.substring("entry", 1, 2), F.expr("substring(entry, 4)")
    rows = rows.withColumn("code", code).withColumn("path", path)
    pair = (F.col("path") != "") & F.substring("code", 1, 1).isin("R", "C")
    before = Window.partitionBy(key, "of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    back = F.col("at") - F.coalesce(F.max(F.when(~pair, F.col("at"))).over(before), F.lit(-1))
    kept = rows.withColumn("back", back).where((F.col("back") % 2 == 1) & (F.col("path") != ""))
    return kept.withColumn("nth", F.explode(F.sequence(F.lit(1), "times"))).select(key, "path", status_of(F.col("code")).alias("status"), "code")


def canonical(path: Column) -> Column:
    """An absolute path without empty, ``.`` and ``..`` parts; links aren't followed."""
    step = lambda done, part: F.when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def nested_worktrees(outputs: DataFrame, output: str = "worktrees") -> DataFrame:
    """root, nested: the worktrees of a listing (root and the command's output) that lie below the root, relative to it.

    The root itself and trees outside of it don't count; nor do submodules and unrelated repositories, which the listing doesn't have.
    """
    lines = outputs.select("root", canonical(F.col("root")).alias("own"), F.explode(F.split(output, "\r?\n")).alias("line")).where(F.col("line").startswith("worktree "))
    trees = lines.withColumn("tree", canonical(F.trim(F.expr("substring(line, 10)"))))
    prefix = F.when(F.col("own") == "/", F.lit("/")).otherwise(F.concat("own", F.lit("/")))
    return trees.where((F.col("tree") != F.col("own")) & F.col("tree").startswith(prefix)).select("root", F.expr("substring(tree, length(own) + if(own = '/', 1, 2))").alias("nested"))


def outside_worktrees(files: DataFrame, nested: DataFrame) -> DataFrame:
    """files (root, path, ...) without those in a nested worktree of their root: a file's folders are looked up, so the join is by equality."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    hit = files.select("root", "path", F.explode(folders).alias("nested")).join(nested, ["root", "nested"], "left_semi").select("root", "path").distinct()
    return files.join(hit, ["root", "path"], "left_anti")


def repo_key(root: Column) -> Column:
    """The first 24 hex digits of the SHA-256 of a root's canonical path."""
    return F.substring(F.sha2(canonical(root), 256), 1, 24)


def registered(log: DataFrame) -> DataFrame:
    """key, root, remote, approved_at, approval_source, updated_at: what a log of approvals and removals leaves registered.

    log has root, at, seq (of entries at one time, the order), action (``approve`` or ``remove``), remote and source. An approval of a
    registered root renews remote, source and updated_at and leaves approved_at; after a removal it begins anew.
    """
    rows = log.where(F.col("root").isNotNull()).withColumn("key", repo_key(F.col("root"))).withColumn("when", F.struct("at", "seq"))
    gone = rows.where("action = 'remove'").groupBy("key").agg(F.max("when").alias("gone"))
    lasting = rows.where("action = 'approve'").join(gone, "key", "left").where("gone is null or when > gone")
    last = lambda c: F.max_by(c, "when").alias(c)
    out = lasting.groupBy("key").agg(last("root"), last("remote"), F.min("when")["at"].alias("approved_at"), F.max_by("source", "when").alias("approval_source"), F.max("when")["at"].alias("updated_at"))
    return out.select("key", F.col("root"), "remote", "approved_at", "approval_source", "updated_at")


#: How many documents a made status output has.
FILES = 100


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status outputs of the documents as changed files: one of each FILES ids, with renames, copies and empty paths."""
    k = F.col("doc_id") % 7
    code = F.element_at(F.array(*(F.lit(c) for c in (" M", "R ", "??", "D ", "C ", "AM", "UU"))), (k + 1).cast("int"))
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("-"), F.col("doc_id"))
    entry = F.concat(code, F.lit(" "), path, F.when(k.isin(1, 4), F.concat(F.lit("\x00R  old/"), path)).otherwise(""))
    rows = table(spark, sf_dir, "documents").where("doc_id is not null and source is not null and lang is not null")
    lines = rows.groupBy(F.expr("doc_id div 100").alias("root")).agg(F.sort_array(F.collect_list(F.struct("doc_id", entry.alias("entry")))).alias("all"))
    return lines.select("root", F.concat(F.array_join(F.col("all.entry"), "\x00"), F.lit("\x00")).alias("status"))


def q_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed_files(_outputs(spark, sf_dir))


def q_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry after all events: each user is a root, signups remove it and other events approve it."""
    root = F.concat(F.lit("/work/./u"), F.col("user_id"), F.lit("/"))
    action = F.when(F.col("event_type") == "signup", "remove").otherwise("approve")
    log = table(spark, sf_dir, "events").where("ts is not null").select(root.alias("root"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), action.alias("action"), F.concat(F.lit("r"), F.col("event_id") % 3).alias("remote"), F.col("event_type").alias("source"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return registered(log).select("key", "root", "remote", text("approved_at"), "approval_source", text("updated_at"))


QUERIES = {"src09_status": q_status, "src12_registry": q_registry}
SQL = {
    "src09_status": """
with f as (select doc_id // 100 as root, doc_id, list_extract([' M', 'R ', '??', 'D ', 'C ', 'AM', 'UU'], cast(doc_id % 7 + 1 as bigint)) as code, source || '/' || lang || '-' || doc_id as path
  from documents where doc_id is not null and source is not null and lang is not null)
select root, path, case when code like '%D%' then 'deleted' when code like '%M%' then 'modified' when code like '%A%' then 'added' when code like '%R%' then 'renamed'
 when code like '%C%' then 'copied' when code = '??' then 'untracked' else 'changed' end as status, code from f""",
    "src12_registry": """
with l as (select '/work/./u' || user_id || '/' as root, substr(sha256('/work/u' || user_id), 1, 24) as key, ts, event_id, event_type from events where ts is not null and user_id is not null),
     g as (select key, max(row(ts, event_id)) as gone from l where event_type = 'signup' group by key),
     a as (select l.* from l left join g using (key) where event_type <> 'signup' and (gone is null or row(ts, event_id) > gone))
select key, last(root order by ts, event_id) as root, last('r' || event_id % 3 order by ts, event_id) as remote, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as approved_at,
 last(event_type order by ts, event_id) as approval_source, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') as updated_at from a group by key""",
}
