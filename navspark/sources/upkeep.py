"""Ignore rules of file trees, and the upkeep of state: rotation of logs, collection of what nothing refers to."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folders that are never indexed.
FOLDERS = ".git node_modules dist build target .next coverage vendor .turbo .cache .idea .vscode .venv venv env __pycache__ .pytest_cache .mypy_cache .ruff_cache .tox site-packages .gradle .parcel-cache".split()
#: Names of binary or generated files, and of files that may hold secrets.
BINARY_NAME = r"(?i)\.(min\.js|png|jpe?g|gif|webp|pdf|zip|sqlite(-wal|-shm)?)$"
SECRET_NAME, SECRET_PATH = r"^\.env($|\.)", r"(?i)secret|private[-_]?key"
#: Bytes beyond which a log rotates.
LOG_BYTES = 32 << 20


def rule_pattern(rule: str) -> tuple[str, bool] | None:
    """A regular expression over file paths for one line of an ignore file, and whether it keeps what it matches.

    ``*`` and ``?`` stay within a name, ``**`` crosses; a rule without a slash holds at any depth; a plain
    rule covers all below it, one with wildcards only what it matches, and one that ends with a slash folders.
    """
    text = rule.strip()
    if not text or text.startswith("#"):
        return None
    keeps = text.startswith("!")
    body = text.removeprefix("!").removeprefix("/")
    folder = body.endswith("/")
    body = body.removesuffix("/")
    if not body:
        return None
    wild = bool(re.search(r"[*?]", body))
    translate = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    core = re.sub(r"\*\*/|\*\*|\*|\?|[^*?]+", lambda m: translate.get(m[0]) or re.escape(m[0]), body)
    start = "^" if "/" in body else "(?:^|.*/)"
    if folder:
        end = "(?:/.*)?$"
    elif wild:
        end = "$"
    else:
        # Below a plain rule only from the root; at depth it names the file itself.
        return f"^{core}(?:/.*)?$|{start}{core}$", keeps
    return f"{start}{core}{end}", keeps


def ignored_by(path: Column, rules: list[str]) -> Column:
    """Whether the last rule that matches a path ignores it."""
    out = F.lit(False)
    for pattern, keeps in filter(None, map(rule_pattern, rules)):
        out = F.when(path.rlike(pattern), F.lit(not keeps)).otherwise(out)
    return out


def skip_reason(path: Column, rules: dict[str, list[str]] | None = None) -> Column:
    """Why a file is left out: a folder, its name, a secret, or the ignore file (name: lines) that says so; null if it isn't."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    out = F.when(F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, FOLDERS))), "ignored directory")
    out = out.when(name.rlike(BINARY_NAME), "binary/generated extension").when(name.rlike(SECRET_NAME) | path.rlike(SECRET_PATH), "secret-like file")
    for source, lines in (rules or {}).items():
        out = out.when(ignored_by(path, lines), source)
    return out


def reused_hashes(listing: DataFrame, indexed: DataFrame) -> DataFrame:
    """listing (path, size, modified_ms) with the hash of indexed rows of equal size and rounded time; null: its content must be read."""
    known = indexed.select("path", F.col("size").alias("k_size"), F.round("modified_ms").alias("k_time"), F.col("hash").alias("k_hash"))
    same = (F.col("size") == F.col("k_size")) & (F.round("modified_ms") == F.col("k_time"))
    return listing.join(known, "path", "left").select(*listing.columns, F.when(same, F.col("k_hash")).alias("hash"))


def retained(log: DataFrame, most: int = LOG_BYTES) -> DataFrame:
    """log files (name, bytes) with what rotation does: rotate those over the limit."""
    return log.withColumn("action", F.when(F.col("bytes") > most, "rotate").otherwise("keep"))


def collectable(states: DataFrame, registry: DataFrame, roots: DataFrame) -> DataFrame:
    """key, reason, bytes of states (key, bytes) that may go: no registered key, or a registered root (key, root) not among roots (root)."""
    orphans = states.join(registry, "key", "left_anti").select("key", F.lit("orphan_db").alias("reason"), "bytes")
    gone = registry.join(roots, "root", "left_anti").join(states, "key", "left")
    return orphans.unionByName(gone.select("key", F.lit("missing_root").alias("reason"), F.coalesce("bytes", F.lit(0)).alias("bytes")))


def usage_filter(events: DataFrame, repo: str | None = None, since: str | None = None) -> DataFrame:
    """Events of one repository, named by key, root or the first 24 hex digits of the root's SHA-256, from a time on."""
    import hashlib

    out = events
    if repo:
        out = out.where(F.col("repo_key").isin(repo, hashlib.sha256(repo.encode()).hexdigest()[:24]) | (F.col("repo_root") == repo))
    return out.where(F.col("ts") >= since) if since else out
