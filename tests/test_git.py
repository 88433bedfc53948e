"""Changed files, worktrees and the registry: hand-made outputs, and a repository made for the test."""

from __future__ import annotations

import hashlib
import subprocess
from collections import Counter

import pytest

from navspark.sources.git import canonical, changed_files, git_outputs, nested_worktrees, outside_worktrees, registered, repo_key


def test_changed_files(spark):
    z = "\x00".join
    outputs = [
        ("a", z([" M src/x.ts", "R  new name.ts", "old.ts", "?? é.md", "UU both.c", ""])),
        # What a rename came from may look like an entry, also like a rename; a last one may lack its origin.
        ("b", z(["R  b", "C  looks like one", "R  c", "R  d", " D gone", "C  e", "f", "AM g", "MD h", "R  last"])),
        ("b", z([" M twice"])), ("b", z([" M twice"])),
        ("c", ""), ("d", None), (None, z(["A  n", "", "T  t", "R  ", "M  m"])),
    ]
    got = Counter((r.root, r.path, r.status, r.code) for r in changed_files(spark.createDataFrame(outputs, "root string, status string")).collect())
    want = [
        ("a", "src/x.ts", "modified", " M"), ("a", "new name.ts", "renamed", "R "), ("a", "é.md", "untracked", "??"), ("a", "both.c", "changed", "UU"),
        ("b", "b", "renamed", "R "), ("b", "c", "renamed", "R "), ("b", "gone", "deleted", " D"), ("b", "e", "copied", "C "), ("b", "g", "modified", "AM"), ("b", "h", "deleted", "MD"), ("b", "last", "renamed", "R "),
        ("b", "twice", "modified", " M"), ("b", "twice", "modified", " M"),
        (None, "n", "added", "A "), (None, "t", "changed", "T "), (None, "m", "modified", "M "),
    ]
    assert got == Counter(want)


def test_worktrees(spark):
    listing = "worktree /w/main\nHEAD 1\nbranch refs/heads/main\n\nworktree /w/main/trees/one\r\nHEAD 2\n\nworktree /w/main/./deep//x/../two \n\nworktree /w/mainly\nworktree /elsewhere\n"
    rows = spark.createDataFrame([("/w/main/", listing), ("/w/main/trees/one", listing), ("/", "worktree /t\n"), ("/none", None)], "root string, worktrees string")
    nested = nested_worktrees(rows)
    assert sorted((r.root, r.nested) for r in nested.collect()) == [("/", "t"), ("/w/main/", "deep/two"), ("/w/main/", "trees/one")]
    files = spark.createDataFrame([("/w/main/", p) for p in ("a.ts", "trees/one/a.ts", "trees/one.ts", "trees/oneself/b", "deep/two/x/y.c")] + [("/other", "trees/one/a.ts")], "root string, path string")
    assert sorted((r.root, r.path) for r in outside_worktrees(files, nested).collect()) == [("/other", "trees/one/a.ts"), ("/w/main/", "a.ts"), ("/w/main/", "trees/one.ts"), ("/w/main/", "trees/oneself/b")]
    from pyspark.sql import functions as F

    paths = spark.createDataFrame([("/a/../../b/./c//",), ("/",), (None,)], "p string")
    assert [r[0] for r in paths.select(canonical(F.col("p"))).collect()] == ["/b/c", "/", None]


def test_registry(spark):
    rows = [
        ("/r/a", 1, 1, "approve", None, "cli"), ("/r/./a/", 3, 2, "approve", "git@x", "mcp"),
        ("/r/b", 1, 3, "approve", None, "cli"), ("/r/b", 2, 4, "remove", None, None), ("/r/b", 2, 5, "approve", "y", "tool"),
        ("/r/c", 1, 6, "approve", None, "cli"), ("/r/c", 1, 7, "remove", None, None), (None, 1, 8, "approve", None, "cli"),
    ]
    log = spark.createDataFrame(rows, "root string, at long, seq long, action string, remote string, source string")
    key = lambda p: hashlib.sha256(p.encode()).hexdigest()[:24]
    got = sorted(tuple(r) for r in registered(log).collect())
    assert got == sorted([(key("/r/a"), "/r/./a/", "git@x", 1, "mcp", 3), (key("/r/b"), "/r/b", "y", 2, "tool", 2)])
    from pyspark.sql import functions as F

    assert log.select(repo_key(F.col("root"))).first()[0] == key("/r/a") and registered(log.limit(0)).count() == 0


def test_commands(spark, tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    git = lambda *a: subprocess.run(["git", "-c", "user.email=a@b", "-c", "user.name=n", *a], cwd=root, capture_output=True, check=True)
    try:
        git("init", "-q")
    except (OSError, subprocess.CalledProcessError):
        pytest.skip("no git here")
    (root / "a b.txt").write_text("one\n" * 20)
    (root / "c.txt").write_text("c")
    git("add", ".")
    git("commit", "-qm", "first")
    git("worktree", "add", "-q", "-b", "side", str(root / "trees" / "side"))
    git("mv", "a b.txt", "moved.txt")
    (root / "c.txt").write_text("changed")
    (tmp_path / "bare").mkdir()
    roots = spark.createDataFrame([(str(root),), (str(tmp_path / "bare"),), ("/not/there",), (None,)], "root string")
    out = git_outputs(roots)
    by = {r.root: r for r in out.collect()}
    assert by[str(root)].top == str(root) and len(by[str(root)].head) == 40 and by[str(root)].remote is None
    assert all(by[r].head is None and by[r].status is None for r in (str(tmp_path / "bare"), "/not/there", None))
    assert sorted((r.path, r.status) for r in changed_files(out).collect()) == [("c.txt", "modified"), ("moved.txt", "renamed"), ("trees/", "untracked")]
    assert [(r.root, r.nested) for r in nested_worktrees(out).collect()] == [(str(root), "trees/side")]
