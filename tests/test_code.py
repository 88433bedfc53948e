"""Code structure, planning and search on a small inline repository."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from navspark.functions.paths import normalize_prefix, roles
from navspark.operators.code import file_graph, read_first, sections, symbols
from navspark.operators.graph import components, distances
from navspark.operators.search import confidence, debug, match_snippet, penalties, search, with_file_coverage
from navspark.plans.query_plan import plan
from navspark.sources.corpus import merge, usage_lines

REPO = {
    "src/orders/service.ts": "import { rate } from './rate.js'\nexport class OrderService {\n  total() { return rate }\n}\n",
    "src/orders/rate.ts": "import '../orders/service'\nexport const rate = 3\n",
    "src/orders/service.test.ts": "import { OrderService } from './service'\n",
    "pkg/mod.py": "from . import util as u\nfrom .sub.deep import x\n\nclass Thing:\n    def run(self):\n        pass\n",
    "pkg/util.py": "def helper():\n    return 1\n",
    "pkg/sub/deep.py": "x = 1\n",
    "lib/a.c": '#include "a.h"\nint main() { return 0; }\n',
    "lib/a.h": "int f();\n",
    "README.md": "# Orders\n\nWhat the order service does.\n",
}
LANGUAGE = {"ts": "typescript", "py": "py", "c": "c", "h": "c", "md": "markdown"}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(p, t, LANGUAGE[p.rsplit(".", 1)[1]], len(t)) for p, t in REPO.items()], "path string, text string, language string, size long")


def test_references(files):
    found = {(r.src, r.dst) for r in file_graph(files).collect()}
    assert found == {("src/orders/service.ts", "src/orders/rate.ts"), ("src/orders/rate.ts", "src/orders/service.ts"), ("src/orders/service.test.ts", "src/orders/service.ts"), ("pkg/mod.py", "pkg/util.py"), ("pkg/mod.py", "pkg/sub/deep.py"), ("lib/a.c", "lib/a.h")}


def test_cycles_and_distances(spark, files):
    edges = file_graph(files).select("src", "dst")
    groups: dict = {}
    for r in components(files.select(files["path"].alias("node")), edges).collect():
        groups.setdefault(r.component, set()).add(r.node)
    assert [g for g in groups.values() if len(g) > 1] == [{"src/orders/service.ts", "src/orders/rate.ts"}]
    start = spark.createDataFrame([("src/orders/service.test.ts",)], "node string")
    assert {r.node: r.hops for r in distances(start, edges, 2).collect()} == {"src/orders/service.test.ts": 0, "src/orders/service.ts": 1, "src/orders/rate.ts": 2}


def test_symbols(files):
    found = {(r.path, r.name, r.kind, r.line) for r in symbols(files).collect()}
    assert {("src/orders/service.ts", "OrderService", "class", 2), ("pkg/mod.py", "Thing", "class", 4), ("pkg/mod.py", "run", "function", 5), ("README.md", "Orders", "heading", 1)} <= found


def test_read_first(files):
    got = [(r.path, r.reason) for r in read_first(files, file_graph(files), "src/orders/service.ts").orderBy("rank").collect()]
    assert got[:3] == [("src/orders/service.ts", "target"), ("src/orders/rate.ts", "import"), ("src/orders/service.test.ts", "importer")]


def test_search_prefers_code(files):
    got = [r.path for r in search(files, "order service").collect()]
    assert "src/orders/service.ts" in got[:2]


def test_search_limits_and_report(files):
    every = search(files, "order service", 50).collect()
    assert [r.path for r in search(files, "order service", 0).collect()] == [every[0].path]
    report = debug(files, "order service", 1).collect()
    chosen = [r for r in report if r.decision == "selected"]
    assert [(r.path, r.rank) for r in chosen] == [(every[0].path, 1)]
    assert {r.path for r in report if r.decision == "outside_limit"} == {r.path for r in every[1:]}
    assert all(r["rank"] is None for r in report if r.decision != "selected")
    assert all(any(w in r.snippet.lower() for w in ("order", "service")) for r in every if "order" in r.snippet.lower())


def test_confidence(spark):
    rows = [("a", 10.0), ("b", 9.5), ("c", 1.0)]
    level = lambda part: tuple(confidence(spark.createDataFrame(part, "path string, score double")).first())
    assert level([]) == ("none", 0.0) and level(rows[:1]) == ("single", 1.0)
    assert level(rows) == ("low", 0.05) and level([rows[0], rows[2]]) == ("high", 0.9)


@pytest.mark.parametrize(
    "path, query, want",
    [("tests/a.ts", "function lock", 3.0), ("tests/a.ts", "where implemented", 8.0), ("src/a.test.ts", "implementation", 8.0), ("src/latest.ts", "implementation", 0.0), ("src/test", "function", 0.0), ("docs/x.md", "function lock", 6.0), ("README", "class lock", 6.0), ("docs/x.md", "queue", 0.0), ("src/a_test.py", "function lock", 3.0), ("test/readme.md", "function lock", 9.0), ("tests/a.ts", "tests implemented", 3.0)],
)
def test_penalties(spark, path, query, want):
    assert spark.createDataFrame([(path,)], "path string").select(penalties(F.col("path"), plan(query))).first()[0] == want


def test_match_snippet(spark):
    texts = ["\n".join("abcdefgh"), "one\ntwo\nthe Lock here\nfour\nfive\nsix", "lock\r\n2\n3\n4", "", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", match_snippet(F.col("t"), plan("lock")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [texts[0], "one\ntwo\nthe Lock here\nfour\nfive", "lock\n2\n3", "", None]


def test_plan():
    got = plan('where is the "order total" in OrderService.ts')
    assert got.phrases == ["order total"] and got.path_like and {"order", "service"} <= set(got.core)
    assert [t.boost for t in got.tiers][0] == 24
    with pytest.raises(ValueError):
        plan("  !! ")


def test_sections():
    text = "# A\n" + "x\n" * 9 + "```\n# no\n```\n## B\ny"
    assert sections(text) == [(1, 13), (14, 15)]


def test_roles_and_prefix(spark):
    row = spark.sql("select 'src/__tests__/a.test.ts' p, 10L s union all select 'yarn.lock', 5L")
    got = {r.p: r.r for r in row.select("p", roles(row["p"], row["s"]).alias("r")).collect()}
    assert got["src/__tests__/a.test.ts"] == ["tests"] and "lockfile" in got["yarn.lock"]
    assert normalize_prefix(" \\a\\.\\b/ ") == "a/b/" and normalize_prefix(".") == ""


def test_merge(spark):
    old, new = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, hash string"), spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, hash string")
    assert {r.path: r.action for r in merge(old, new).collect()} == {"a": "keep", "b": "update", "c": "delete", "d": "insert"}
    assert {r.path: r.action for r in merge(old, new, complete=False).collect()}["c"] == "keep"


def test_usage_lines(spark):
    lines = ['{"ts":"1","command":"search"}', "", " ", "{bad", "[1]", '{"ts":"2"}', '{"ts":"3","command":"index"}']
    events, bad = usage_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert events.count() == 2 and bad.first().malformed == 3


def test_plan_compounds_and_endpoints():
    got = plan("where is local storage read")
    assert "localstorage" in got.core
    assert "xrays" in plan("the x rays").core and "arays" not in plan("a rays").core
    assert plan("orders list endpoint returns totals").endpoint_terms == ["orders", "list"]
    assert plan("preload data").path_terms == ["retrieval"]
    assert plan("overview").intents == ["overview"] and "overview" not in plan("overview tab cards").intents


def test_search_by_symbol_route_and_role(spark):
    rows = {
        "web/app/api/orders/route.ts": ("typescript", "export async function GET(request: Request) {\n  return list()\n}\n"),
        "web/app/api/users/route.ts": ("typescript", "export async function GET(request: Request) {\n  return people()\n}\n"),
        "lib/stores.py": ("py", "class Nothing:\n    pass\n\n\ndef reconcile():\n    return 0\n"),
        "lib/other.py": ("py", "def reconciled_rows():\n    return 1\n"),
        "setup.py": ("py", "x = 1\n"),
        "empty.py": ("py", ""),
    }
    files = spark.createDataFrame([(p, t, lang, len(t)) for p, (lang, t) in rows.items()], "path string, text string, language string, size long")
    best = search(files, "reconcile").collect()
    assert [r.path for r in best] == ["lib/stores.py", "lib/other.py"]
    assert (best[0].symbol, best[0].start_line, best[0].symbol_score) == ("reconcile", 5, 51.0)
    best = search(files, "orders endpoint handler").collect()
    assert best[0].path == "web/app/api/orders/route.ts" and best[0].symbol == "GET" and best[0].boost >= 34
    assert "setup.py" in [r.path for r in search(files, "prepare everything").collect()]


def test_file_coverage(spark):
    rows = [("a", 0, 9.0, ["x"], True), ("b", 0, 5.0, ["x"], True), ("b", -1, 4.0, ["y"], False)]
    scored = spark.createDataFrame([(*r, 1) for r in rows], "path string, ordinal long, score double, matched array<string>, in_text boolean, start_line int")
    got = with_file_coverage(scored, plan("x1 y1"), 1).orderBy("path", "ordinal").collect()
    assert [(r.path, r.ordinal, r.score) for r in got] == [("a", 0, 9.0), ("b", -1, 4.0), ("b", 0, 6.5)]


def test_aliases_in_the_file_graph(spark):
    rows = {
        "tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*", "gen/*"], "@/ui/*": ["ui/*"], "core": ["src/core/index.ts"], "out/*": ["../*"]}}} // root',
        "web/tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["./app/*"], "only": ["./only.js"]}}}',
        "src/a.ts": "import x from '@/b'\nimport y from '@/ui/button'\nimport z from 'core'\nimport r from 'react'\nimport o from 'out/x'\nimport u from 'https://x/y'\n",
        "src/b.ts": "import d from './data'\nimport '@/lib'\n",
        "src/data.yaml": "a: 1",
        "src/core/index.ts": "import '@/only-in-gen'\n",
        "src/lib/index.tsx": "",
        "gen/only-in-gen.md": "",
        "ui/button.tsx": "",
        "web/p.ts": "import '@/b'\nimport 'only'\nimport 'core'\n",
        "web/app/b.js": "",
        "web/only.ts": "",
    }
    language = {"ts": "typescript", "tsx": "typescript", "js": "javascript"}
    files = spark.createDataFrame([(p, language.get(p.split(".")[-1], ""), t) for p, t in rows.items()], "path string, language string, text string")
    got = {(r.src, r.specifier): r.dst for r in file_graph(files).collect()}
    assert got == {
        ("src/a.ts", "@/b"): "src/b.ts",
        ("src/a.ts", "@/ui/button"): "ui/button.tsx",  # the longest head first
        ("src/a.ts", "core"): "src/core/index.ts",
        ("src/b.ts", "./data"): "src/data.yaml",
        ("src/b.ts", "@/lib"): "src/lib/index.tsx",
        ("src/core/index.ts", "@/only-in-gen"): "gen/only-in-gen.md",  # the second target of a pattern
        ("web/p.ts", "@/b"): "web/app/b.js",  # the deepest project file that fits
        ("web/p.ts", "only"): "web/only.ts",
        ("web/p.ts", "core"): "src/core/index.ts",  # which may be one further up
    }


def test_c_functions_and_java_methods(spark):
    c = ["int add(int a, int b) {", "static void log_it(const char *m) {", "int forward(int a);", "  printf(x)", "double Shape::area() const {", "T max_value(T a, T b) {", "std::vector<int> *all (void)", "Shape::~Shape() {", "if (x) {", "else if (x) {", "return f(x)", "x = call(1)", "unsigned long long f3(", "a.b(c)", "std::map<int, A>& refs()", "main() {"]
    java = ["  public int total(int a) {", "public static <T> List<T> of(T a) {", "private final Map<String,Integer> all() throws IOException, Bad {", "protected void run()", "int hidden() {", "public Shop(int a) {", "public void go(int a);", "public abstract synchronized String[] names (int a)", "public boolean if(x) {", "public void x(String s) { y(); }"]
    files = spark.createDataFrame([("a.c", "c", "\n".join(c)), ("A.java", "java", "\n".join(java))], "path string, language string, text string")
    got = {(r.path, r.line): (r.name, r.kind) for r in symbols(files).collect()}
    assert got == {
        ("a.c", 1): ("add", "function"), ("a.c", 2): ("log_it", "function"), ("a.c", 5): ("area", "method"), ("a.c", 6): ("max_value", "function"),
        ("a.c", 7): ("all", "method"), ("a.c", 11): ("f", "function"), ("a.c", 13): ("f3", "function"), ("a.c", 15): ("refs", "method"),
        ("A.java", 1): ("total", "method"), ("A.java", 3): ("all", "method"), ("A.java", 4): ("run", "method"), ("A.java", 8): ("names", "method"),
    }
