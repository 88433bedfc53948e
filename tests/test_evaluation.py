"""Read plans and evaluation on small cases with known results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from navspark.operators.evaluation import MISS_CLASSES, assess, budget, drift, episodes, gate, lexical_scores, miss_counts, misses, mode_delta, mode_summary, paired, symbol_truth
from navspark.plans import read_plan

REASONS = "array<struct<kind:string,target:string>>"


def frames(spark, search, context):
    hits = [(case, p, i + 1) for case, paths in search.items() for i, p in enumerate(paths)]
    near = [(case, p, i + 1, reasons) for case, rows in context.items() for i, (p, reasons) in enumerate(rows)]
    return spark.createDataFrame(hits, "case string, path string, rank long"), spark.createDataFrame(near, f"case string, path string, rank long, reasons {REASONS}")


def test_read_plan(spark):
    search = {
        "plain": ["src/a.ts", "src/b.ts", "docs/archive/x.md", "test/b.test.ts", "test/z.test.ts", "src/c.ts", "src/a.ts"],
        "import": ["src/a.ts", "src/b.ts"],
        "route": ["web/app/api/users/route.ts", "src/other.ts"],
    }
    context = {
        "plain": [("src/c.ts", [("reverse_import", None)]), ("docker-compose.yml", [("near_config", None)]), ("test/a.test.ts", [("reverse_test", None)]), ("src/i.ts", [("import", None)]), ("q.test.ts", [("sibling_test", "src/b.ts")]), ("README.md", [("related_doc", None)])],
        "import": [("src/i.ts", [("import", None)]), ("src/j.ts", [("import", None)])],
        "route": [("lib/a.ts", [("import", None)]), ("lib/users/store.ts", [("import", None)]), ("lib/users.test.ts", [("sibling_test", "lib/users/store.ts")]), ("docker-compose.dev.yaml", [("near_config", None)])],
        "only": [("x.ts", None)],
    }
    plan = read_plan.explain(*frames(spark, search, context), 4)
    got = {}
    for r in plan.orderBy("case", "rank").collect():
        got.setdefault(r.case, []).append((r.path, r.bucket))
        assert r.selected == (r.rank <= 4)
    assert got["plain"] == [
        ("src/a.ts", "first_search"),
        ("src/b.ts", "visible_search_pair"),
        ("test/b.test.ts", "visible_search_pair"),
        ("test/z.test.ts", "uncovered_visible_test"),
        ("docker-compose.yml", "prioritized_config"),
        ("test/a.test.ts", "prioritized_test"),
        ("q.test.ts", "prioritized_test"),
        ("src/c.ts", "context_backed_search"),
        ("src/i.ts", "remaining_context"),
        ("README.md", "remaining_context"),
        ("docs/archive/x.md", "archived_search"),
    ]
    assert got["import"] == [("src/a.ts", "first_search"), ("src/i.ts", "direct_import"), ("src/b.ts", "active_search"), ("src/j.ts", "remaining_context")]
    assert got["route"] == [
        ("web/app/api/users/route.ts", "first_search"),
        ("lib/users/store.ts", "route_direct_import"),
        ("lib/users.test.ts", "route_direct_import_test"),
        ("src/other.ts", "active_search"),
        ("docker-compose.dev.yaml", "prioritized_config"),
        ("lib/a.ts", "remaining_context"),
    ]
    assert got["only"] == [("x.ts", "remaining_context")]
    assert {r.case: (r.available, r.selected, r.dropped) for r in read_plan.budget(plan).collect()}["plain"] == (11, 4, 7)
    assert read_plan.merged(*frames(spark, search, context), 0).count() == 0


@pytest.fixture(scope="module")
def assessed(spark):
    rows = [
        ("1", "a", "e.ts", ["r.ts"], ["no.ts"], ["e.ts", "r.ts"], "find it", False, {}, 1.0, 400),
        ("1", "b", "e.ts", ["r.ts"], ["no.ts"], ["e.ts", "no.ts"], "find it", False, {}, 3.0, 402),
        ("2", "a", "src/handler.ts", ["t/x.test.ts", "src/m.ts", "lib/find.ts"], [], [], "findHandler", False, {"src/m.ts": ["alias"]}, 2.0, 0),
        ("2", "b", "src/z.ts", [], [], ["q"], "orders", True, {}, 4.0, 8),
    ]
    schema = "case string, mode string, entry string, required array<string>, forbidden array<string>, selected array<string>, query string, stale boolean, hints map<string,array<string>>, latency double, bytes_read long"
    return assess(spark.createDataFrame(rows, schema))


def test_assess(assessed):
    got = {(r.case, r.mode): (round(r.expected_recall, 3), r.context_recall, r.success) for r in assessed.collect()}
    assert got == {("1", "a"): (1.0, 1.0, True), ("1", "b"): (0.5, 0.0, False), ("2", "a"): (0.0, 0.0, False), ("2", "b"): (0.0, 1.0, False)}


def test_summary_and_delta(assessed):
    summary = mode_summary(assessed)
    a = {r["mode"]: r for r in summary.collect()}["a"]
    assert (a.cases, a.success_rate, a.expected_recall, a.tokens, a.latency_avg, a.latency_p95) == (2, 0.5, 0.5, 50, 1.5, 2.0)
    assert {r.measure: r.delta for r in mode_delta(summary, "a", "b", ["success_rate", "forbidden_rate"]).collect()} == {"success_rate": 0.5, "forbidden_rate": -0.5}
    assert [(r["mode"], r.metric) for r in gate(summary, {"success_rate": 0.5, "context_recall": 0.5}).collect()] == [("b", "success_rate")]


def test_misses(assessed):
    found = misses(assessed)
    assert {(r["case"], r["mode"], r.file, r["class"]) for r in found.collect()} == {
        ("1", "b", "no.ts", "noise"), ("1", "b", "r.ts", "query_formulation"), ("2", "a", "src/handler.ts", "missing_symbol"),
        ("2", "a", "t/x.test.ts", "convention"), ("2", "a", "src/m.ts", "alias"), ("2", "a", "lib/find.ts", "unknown"), ("2", "b", "src/z.ts", "staleness"),
    }
    assert [r["class"] for r in miss_counts(found).collect()] == MISS_CLASSES
    assert {r.n for r in miss_counts(found.where("false")).collect()} == {0}


def test_paired(spark):
    rows = spark.createDataFrame([("1", "x", 1.0), ("1", "y", 0.5), ("2", "x", 0.5), ("2", "y", 0.5), ("3", "x", 0.0), ("3", "y", 0.75), ("4", "x", 1.0)], "task string, mode string, value double")
    assert tuple(paired(rows, "x", "y").first()) == (1, 1, 1, 0.75)
    assert tuple(paired(rows.where("false"), "x", "y").first()) == (0, 0, 0, 0.0)


def test_lexical(spark):
    files = spark.createDataFrame([("src/order.ts", "order orders"), ("a", None), ("b", "aaaa")], "path string, text string")
    assert {r.path: r.score for r in lexical_scores(files, "Order aa ORDER x").collect()} == {"src/order.ts": 6, "b": 2}


def test_drift_and_budget(spark):
    old, new = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("d", "1")], "path string, hash string"), spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("e", "1")], "path string, hash string")
    assert {r.state: r.n for r in drift(old, new).collect()} == {"same": 2, "changed": 1, "deleted": 1, "missing": 1}
    fields = spark.createDataFrame([("t", "12345"), ("t", None), ("u", "1234")], "tool string, text string")
    assert {r.tool: (r.fields, r.tokens) for r in budget(fields).collect()} == {"t": (2, 2), "u": (1, 1), None: (3, 3)}


def test_episodes_and_truth(spark):
    calls = spark.createDataFrame([("e", 1, "grep", False, True), ("e", 2, "search", True, False), ("e", 3, "grep", False, True), ("f", 1, "grep", False, True)], "episode string, seq long, tool string, wanted boolean, raw boolean")
    assert {r.episode: tuple(r)[1:] for r in episodes(calls).collect()} == {"e": (3, "grep", 2, 1), "f": (1, "grep", None, 1)}
    hits = spark.createDataFrame([("f", "a", 1), ("f", "a", 1), ("f", "b", 1), ("g", "a", 2)], "name string, path string, line long")
    assert {r.name: (r.paths, r.repeated) for r in symbol_truth(hits).collect()} == {"f": (["a", "b"], 1), "g": (["a"], 0)}
    assert hits.select(F.lit(1)).count() == 4


def test_search_quality(spark):
    from navspark.operators.evaluation import above, search_quality

    pairs = lambda rows: spark.createDataFrame(rows, "case string, path string")
    results = spark.createDataFrame([("a", "x", 1), ("a", "bad", 2), ("b", "q", 1), ("b", "y", 2), ("c", "q", 1), ("c", "z", 6), ("d", "bad", 1)], "case string, path string, rank long")
    got = search_quality(pairs([("a", "x"), ("a", "x2"), ("b", "y"), ("c", "z")]), pairs([("a", "bad"), ("c", "z"), ("b", "other")]), results)
    row = got.first()
    assert (row.cases, row.top1_accuracy, row.recall, row.expected_coverage, row.mrr) == (3, 0.333333, 0.666667, 0.5, 0.5)
    assert (row.misses, row.partial_misses, row.excluded_hits, row.false_positive_rate) == (1, 1, 1, 0.333333)
    assert [(r.metric, r.value) for r in above(got, {"false_positive_rate": 0.2, "misses": 1}).collect()] == [("false_positive_rate", 0.333333)]
    assert search_quality(pairs([]), pairs([]), results).first().cases == 0
