"""The positional index's boolean model, the stored index's versions and commits, and search over it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from navspark.operators.match import expression, matches, phrase, phrase_hits, positional, query_tokens
from navspark.operators.search import Tables, budgets, package
from navspark.plans.query_plan import parts, plan
from navspark.sources.stored_index import Conflict, StoredIndex, Version, rebuilt_texts

ROWS = [
    ("src/query-plan.ts", "the plan holds terms"),
    ("src/other.ts", "Naïve café, and a naive plan"),
    ("docs/cafe.md", "plan the query; query plan"),
    ("lib/x.ts", "planner plans"),
    ("lib/empty.ts", None),
]


@pytest.fixture(scope="module")
def index(spark):
    rows = spark.createDataFrame(ROWS, "path string, text string")
    return positional(rows, ["path"], ["path", "text"]).cache()


CASES = [
    ("all", [phrase("naïve café")], {"src/other.ts"}),  # folded, as the index is
    ("all", [phrase("query-plan.ts"), phrase("holds")], {"src/query-plan.ts"}),  # a dotted name is a phrase; AND across columns
    ("all", [phrase("query plan")], {"src/query-plan.ts", "docs/cafe.md"}),
    ("all", [phrase("plan query")], set()),  # consecutive, in order
    ("all", [phrase("ts the")], set()),  # not from one column into the next
    ("all", [phrase("plan", True)], {r[0] for r in ROWS[:4]}),
    ("any", [phrase("planner"), phrase("holds")], {"lib/x.ts", "src/query-plan.ts"}),
    ("all", [phrase("query pl", True)], {"src/query-plan.ts", "docs/cafe.md"}),
    ("all", [phrase("--")], set()),  # no token: matches nothing by itself
    ("all", [phrase("--"), phrase("holds")], {"src/query-plan.ts"}),  # and is left out beside others
    ("all", [phrase("plan"), phrase("plan")], {"src/query-plan.ts", "src/other.ts", "docs/cafe.md"}),
]


def test_boolean_model(index):
    asked = [expression(mode, phrases) for mode, phrases, _ in CASES]
    found = matches(index, ["path"], asked, 5, 40).collect()
    for k, (_, _, want) in enumerate(CASES):
        assert {r["path"] for r in found if r["query"] == k} == want
    assert all(r["score"] > 0 for r in found)
    assert matches(index.limit(0), ["path"], asked, 0, 0).count() == 0


def test_phrase_hits_of_a_table_of_queries(spark, index):
    wanted = spark.createDataFrame([(1, 0, 0, "query", False, 2), (1, 0, 1, "plan", False, 2), (2, 0, 0, "pla", True, 1)], "query int, phrase int, place int, term string, prefix boolean, size int")
    got = {(r["query"], r["path"]): r["hits"] for r in phrase_hits(index, ["path"], wanted).collect()}
    assert got == {(1, "src/query-plan.ts"): 1, (1, "docs/cafe.md"): 1, (2, "src/query-plan.ts"): 2, (2, "src/other.ts"): 1, (2, "docs/cafe.md"): 2, (2, "lib/x.ts"): 2}


def test_terms():
    assert query_tokens("Ångström query-plan.ts") == ("angstrom", "query", "plan", "ts")
    assert parts("utf8") == ["utf8", "utf8"] and parts("v2Handler") == ["v2handler", "v2", "handler"] and parts("HTTPServer") == ["httpserver", "http", "server"]
    assert plan("utf8 sha256sum").expanded == ["utf8", "sha256sum"]
    tiers = [(t.mode, t.terms) for t in plan("query-plan.ts holds").tiers]
    assert tiers[0] == ("all", ["query-plan.ts", "holds"]) and ("prefix", ["query-plan.ts", "query", "plan", "ts", "holds"]) in tiers


def test_budgets(spark):
    """Later tiers shrink as earlier ones give rows; the quota for code comes on top."""
    rows = [("path_match", -1, 0, "a.md", 0.0)] * 3
    rows += [("symbol_fts", 0, n, f"s{n}.ts", 1.0) for n in range(1, 8)] + [("chunk_fts", 0, n, f"d{n}.md", 1.0) for n in range(1, 11)]
    rows += [("chunk_fts", 1, n, f"c{n}.{'ts' if n > 2 else 'md'}", 0.1 if n == 5 else 0.5) for n in range(1, 15)]
    found = spark.createDataFrame(rows, "source string, tier int, nth int, path string, coverage double")
    got = budgets(found, 2, 4).groupBy("source", "tier").agg(F.count("*").alias("n"), F.collect_list("path").alias("paths")).collect()
    of = {(r["source"], r["tier"]): r for r in got}
    # 3 of 8 are taken: 5 are left, so 3 symbols and 5 chunks; then the limit.
    assert {k: r["n"] for k, r in of.items()} == {("path_match", -1): 3, ("symbol_fts", 0): 3, ("chunk_fts", 0): 5, ("chunk_fts", 1): 4, ("code_quota", 1): 6}
    assert sorted(of["code_quota", 1]["paths"]) == ["c3.ts", "c4.ts", "c6.ts", "c7.ts", "c8.ts", "c9.ts"]


FILES = {
    "src/a.ts": "import { b } from './b'\nexport function alpha() {\n  return b\n}\n",
    "src/b.ts": "export const b = 1\n",
    "docs/x.md": "# Alpha\n\nAbout alpha.\n",
}


def state(spark, files, time=1.0):
    language = {"ts": "typescript", "md": "markdown"}
    rows = [(p, language[p.split(".")[-1]], len(t), str(hash(t)), time, t) for p, t in files.items()]
    return spark.createDataFrame(rows, "path string, language string, size long, hash string, modified_ms double, text string")


def stored(index):
    return {t: sorted(map(str, index.table(t).drop("indexed_at").collect())) for t in ("files", "chunks", "symbols", "chunk_terms", "symbol_terms", "references", "edges")}


def test_updates(spark, tmp_path):
    index = StoredIndex(spark, str(tmp_path / "index"))
    assert index.status()["readiness"] == "not_indexed" and index.table("files").count() == 0
    assert index.update(state(spark, FILES), head="h1", buckets=3) == {"indexed": 3, "removed": 0, "version": 1}
    assert [(r.src, r.dst) for r in index.table("edges").collect()] == [("src/a.ts", "src/b.ts")]
    # An unchanged tree writes nothing.
    before = index._names("data")
    assert index.update(state(spark, FILES), head="h1")["version"] == 1 and index._names("data") == before
    # A changed file takes its chunks, symbols and postings with it; a file that went, its edges.
    later = {"src/a.ts": FILES["src/a.ts"].replace("alpha", "omega"), "docs/x.md": FILES["docs/x.md"]}
    old = index.current()
    assert index.update(state(spark, later), complete=False)["removed"] == 0  # an incomplete scan deletes nothing
    assert index.update(state(spark, later), head="h2") == {"indexed": 0, "removed": 1, "version": 3}
    fresh = StoredIndex(spark, str(tmp_path / "fresh"))
    fresh.update(state(spark, later), buckets=3)
    assert stored(index) == stored(fresh)
    assert {r.name for r in index.table("symbols").collect()} == {"omega", "Alpha"} and index.table("edges").count() == 0
    # Readers of the version before still see it.
    assert {r.path for r in index.table("files", old).collect()} == set(FILES)
    # Below a prefix only its files are touched, and a rounded time counts as a change.
    assert index.update(state(spark, {"docs/x.md": FILES["docs/x.md"]}, 1.4), prefix="docs")["indexed"] == 0
    assert index.update(state(spark, {"docs/x.md": FILES["docs/x.md"]}, 9.0), prefix="docs", head="h3")["indexed"] == 1
    assert index.status("docs", "h3")["indexed_head"] == "h3" and index.status("", "h2")["stale"] is False
    known = index.status("", "h9")
    assert known["stale"] and known["warnings"] == ["Git HEAD changed since last index."] and known["files"] == 2
    drift = index.drift(state(spark, {"docs/x.md": "other", "new.md": "x"}), dirty=state(spark, {"src/a.ts": "", "log.md": ""}), head="h2").first()
    assert (drift.changed, drift.missing, drift.deleted, drift.dirty, drift.head_changed, drift.stale) == (1, 1, 1, 1, False, True)
    assert index.vacuum(keep=1) > 0 and {r.path for r in index.table("files").collect()} == set(later)


def test_commit(spark, tmp_path, monkeypatch):
    """What dies between stage and commit leaves the version before; of two that began alike the second fails."""
    index = StoredIndex(spark, str(tmp_path / "index"))
    index.update(state(spark, FILES), buckets=2)
    kept = stored(index)

    def dies(self, version, place):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(StoredIndex, "_commit", dies)
        with pytest.raises(KeyboardInterrupt):
            index.update(state(spark, {"src/b.ts": "export const c = 2\n"}))
    assert index.versions() == [1] and stored(index) == kept
    with pytest.raises(Conflict):
        index._commit(Version(1, 2), "late")
    assert stored(index) == kept and index.vacuum() == 1
    assert index.update(state(spark, {"src/b.ts": "export const c = 2\n"}))["version"] == 2


def test_search_of_an_index(spark, tmp_path):
    index = StoredIndex(spark, str(tmp_path / "index"))
    index.update(state(spark, FILES), head="h", buckets=2)
    got = package(index, "alpha", head="h")
    assert [r["path"] for r in got["results"]] == ["src/a.ts", "docs/x.md"] and got["stale"] is False and got["confidence"][0] in ("high", "low")
    assert [r["path"] for r in package(index, "alpha", prefix="docs")["results"]] == ["docs/x.md"]
    assert Tables.of_index(index).counts["files"] == 3


def test_rebuilt_texts(spark):
    rows = [("a", 0, 1, 3, "1\n2\n3"), ("a", 1, 3, 4, "other\n4"), ("a", 2, 7, 8, "7\r\n8\nmore"), ("b", 0, 1, 1, ""), ("c", 0, 2, 4, "x")]
    got = rebuilt_texts(spark.createDataFrame(rows, "path string, ordinal long, start_line long, end_line long, text string")).collect()
    assert {r.path: r.text for r in got} == {"a": "1\n2\n3\n4\n\n\n7\n8", "b": "", "c": "\nx\n\n"}
