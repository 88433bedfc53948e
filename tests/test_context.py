"""What to read first, for all targets of a small repository at once, against a loop over single targets."""

from __future__ import annotations

import re

import pytest

from navspark.operators.code import file_graph
from navspark.operators.context import context, neighbourhood, read_first, related, resolved_target
from navspark.operators.graph import paths
from navspark.operators.search import Tables
from navspark.operators.structure import structured_chunks

LONG = "\n".join(f"export const v{i} = {i}" for i in range(100))
REPO = {
    "README.md": "# Shop\n",
    "docs/rate.md": "# Rates\n",
    "docs/deep/README.md": "# Deep\n",
    "package.json": "{}",
    "docker-compose.yml": "a: 1\n",
    "src/package-lock.json": "{}",
    "src/orders/rate.ts": "import { base } from './base'\nimport { tax } from '../tax'\nimport { x } from './rate.types'\nexport const rate = base\n",
    "src/orders/base.ts": LONG,
    "src/orders/rate.types.ts": "export type Rate = number\n",
    "src/orders/rate-cache.ts": "import { rate } from './rate'\n",
    "src/orders/rate.config.ts": "export default {}\n",
    "src/orders/rate.test.ts": "import { rate } from './rate'\n",
    "src/orders/rate.generated.ts": "import { rate } from './rate'\n",
    "src/tax.ts": "export const tax = 1\n",
    "src/tax_test.ts": "import { tax } from './tax'\n",
    "tests/base.spec.ts": "import { base } from '../src/orders/base'\n",
    "tests/rate/other.test.ts": "",
    "src/app/api/rates/route.ts": "import { rate } from '../../../orders/rate'\nexport function GET() { return rate }\n",
    "src/app/api/rates/rates.handler.ts": "export function handle() {}\n",
    "lib/a.c": '#include "a.h"\n',
    "lib/a.h": "int f();\n",
    "lib/.env": "A=1",
}
LANGUAGE = {"ts": "typescript", "md": "markdown", "json": "json", "yml": "yml", "c": "c", "h": "c", "env": "env"}


@pytest.fixture(scope="module")
def files(spark):
    rows = [(p, LANGUAGE[p.split(".")[-1]], len(t), t) for p, t in REPO.items()]
    return spark.createDataFrame(rows, "path string, language string, size long, text string").cache()


def folder(p):
    return "/".join(p.split("/")[:-1])


def stem(p):
    return re.sub(r"\.[^.]+$", "", p.split("/")[-1]).lower()


def near(base, paths, most=8):
    def score(p):
        a, b = [x for x in folder(base).split("/") if x], [x for x in folder(p).split("/") if x]
        shared = 0
        while shared < min(len(a), len(b)) and a[shared] == b[shared]:
            shared += 1
        return 10 * shared + 5 * (a == b) - abs(len(a) - len(b))

    return sorted({p for p in paths if p != base}, key=lambda p: (-score(p), p))[:most]


TEST = lambda p: bool(re.search(r"(^|/)(__tests__|tests?|spec)(/|$)", p) or re.search(r"(^|[._-])(test|spec)([._-]|$)", p.split("/")[-1]))
CONFIG = lambda p: p.endswith((".json", ".yml", ".env")) and "lock" not in p or bool(re.search(r"(^|[._-])config([._-]|$)", p.split("/")[-1]))
NOISY = lambda p: "lock" in p or "generated" in p
PROSE = lambda p: p.endswith(".md")
PAIRS = [("lib/a.c", "lib/a.h"), ("src/app/api/rates/route.ts", "src/app/api/rates/rates.handler.ts")]


def sibling_tests(t):
    return near(t, [p for p in REPO if TEST(p) and not NOISY(p) and re.search("test|spec", p) and stem(t) in p.lower()])


def akin(a, b):
    return a != b and (b.startswith((a + ".", a + "-", a + "_")) or a.startswith((b + ".", b + "-", b + "_")))


def wanted(t, edges):
    """Paths in order, weak ones last."""
    imports = [d for s, d, _ in sorted(edges, key=lambda e: (e[2], e[1])) if s == t and not NOISY(d)][:8]
    importers = near(t, [s for s, d, _ in edges if d == t and not NOISY(s)])
    pairs = near(t, [y for a, b in PAIRS for x, y in ((a, b), (b, a)) if x == t])
    tests = sibling_tests(t)
    first = lambda ps: next(([sibling_tests(p)[0]] for p in ps[:2] if sibling_tests(p)), [])
    sources = [p for p in REPO if not (NOISY(p) or CONFIG(p) or TEST(p) or PROSE(p)) and folder(p) == folder(t) and p != t]
    named = [p for p in REPO if PROSE(p) and stem(t) in p.lower()]
    docs = near(t, [p for p in (named or [p for p in REPO if p.lower().endswith("readme.md")]) if not NOISY(p)])
    configs = near(t, [p for p in REPO if CONFIG(p) and not NOISY(p) and (folder(p) == folder(t) or stem(t) in p.split("/")[-1].lower() or p.startswith("docker-compose"))])
    plain = re.sub(r"([._-](test|spec)|(test|spec)[._-])$", "", stem(t))
    test_of = near(t, [p for p in sources if stem(p) == plain]) if TEST(t) else []
    route = [p for p in importers if "/route." in p]
    like = [p for p in importers if p not in route and akin(stem(t), stem(p))]
    other = [p for p in importers if p not in route and p not in like]
    order = [*route[:1], *imports[:2], *pairs, *first([p for p in pairs if not TEST(p)]), *tests[:1], *like[:1], *first(imports), *first([p for p in importers if not TEST(p)]), *other[:1], *test_of[:1], *configs[:1], *docs[:1]]
    order += [*imports[2:], *route[1:], *like[1:], *other[1:], *test_of[1:], *configs[1:], *tests[1:], *docs[1:]]
    strong = [p for p in dict.fromkeys(order) if p != t]
    return strong, [p for p in near(t, [p for p in sources if akin(stem(t), stem(p))]) if p not in strong]


def test_all_targets(spark, files):
    edges = file_graph(files).cache()
    known = [(r.src, r.dst, r.line) for r in edges.collect()]
    targets = spark.createDataFrame([(p,) for p in REPO], "target string")
    got: dict = {}
    for r in related(files, edges, targets).orderBy("target", "rank").collect():
        got.setdefault(r.target, []).append(r)
    for t in REPO:
        strong, weak = wanted(t, known)
        rows = got.get(t, [])
        assert [r.path for r in rows if not r.weak] == strong, (t, [r.path for r in rows if not r.weak], strong)
        assert [r.path for r in rows if r.weak] == weak, t
    reasons = {r.path: r.reasons for r in got["src/orders/rate.ts"]}
    assert reasons["src/orders/rate.test.ts"] == ["sibling_test", "reverse_import", "reverse_test"]
    assert reasons["src/orders/base.ts"] == ["import"] and reasons["docs/rate.md"] == ["related_doc"]
    assert {r.path: r.reasons for r in got["src/orders/rate.test.ts"]}["src/orders/rate.ts"] == ["import", "test_of"]


def test_read_first(spark, files):
    edges, chunks = file_graph(files).cache(), structured_chunks(files).cache()
    targets = spark.createDataFrame([("src/orders/base.ts",), ("nowhere.ts",)], "target string")
    rows = read_first(files, chunks, edges, targets, 99).orderBy("rank").collect()
    assert [r.rank for r in rows] == list(range(1, len(rows) + 1)) and {r.target for r in rows} == {"src/orders/base.ts"}
    assert rows[0].path == "src/orders/base.ts" and rows[0].reasons == ["target"] and rows[0].start_line == 1
    assert rows[-1].path == "src/orders/base.ts" and rows[-1].start_line > 1  # later chunks of the target come last
    assert len({r.path for r in rows}) == len(rows) - sum(r.reasons == ["target"] for r in rows) + 1


def test_target(files):
    assert resolved_target(files, " src/tax.ts ") == ("src/tax.ts", [])
    path, said = resolved_target(files, "rate")
    assert path == "docs/rate.md" and said[0].startswith('Ambiguous target "rate" matched 6 or more indexed files; using docs/rate.md.')
    assert resolved_target(files, "rate", "src/")[0] == "src/orders/rate.ts"


def test_context(files):
    tables = Tables.of_files(files)
    rows, warnings = context(tables, "src/orders/rate.ts", 3)
    got = rows.orderBy("rank").collect()
    assert [r.path for r in got] == ["src/orders/rate.ts", "src/app/api/rates/route.ts", "src/orders/base.ts"] and warnings == []
    rows, warnings = context(tables, "handle rates")
    assert rows.count() > 0 and {tuple(r.reasons) for r in rows.collect()} == {("search_result",)} and "falling back" in warnings[0]


def test_neighbourhood(spark, files):
    edges = file_graph(files)
    targets = spark.createDataFrame([("src/orders/rate.ts",), ("lib/a.c",), ("src/app/api/rates/route.ts",)], "target string")
    got: dict = {}
    for r in neighbourhood(files, edges, targets).orderBy("target", "group", "rank").collect():
        got.setdefault((r.target, r.group), []).append(r.path)
    assert got[("src/orders/rate.ts", "imports")] == ["src/orders/base.ts", "src/tax.ts"]
    assert got[("src/orders/rate.ts", "reverse_imports")] == ["src/app/api/rates/route.ts", "src/orders/rate-cache.ts", "src/orders/rate.test.ts"]  # without what is generated
    assert got[("lib/a.c", "includes")] == ["lib/a.h"] and got[("lib/a.c", "implementation_pair")] == ["lib/a.h"]
    assert got[("src/app/api/rates/route.ts", "implementation_pair")] == ["src/app/api/rates/rates.handler.ts"]
    assert neighbourhood(files, edges, targets, 0).groupBy("target", "group").count().where("count > 1").count() == 0


def test_paths(spark):
    """The path that a queue over sorted steps finds first, for every pair, with edges both ways, twins and a loop."""
    edges = [("a", "b", "imports", "./b", 3), ("a", "c", "imports", None, None), ("b", "d", "includes", "d.h", 1), ("c", "d", "imports", "./d", 2), ("c", "d", "imports", "./d2", 1), ("e", "d", "imports", None, 5), ("e", "f", "imports", None, 6), ("f", "g", "imports", None, 1), ("a", "a", "imports", None, 1), ("b", "a", "imports", "./a", 1), ("x", "y", "imports", None, 1)]
    nodes = sorted({n for e in edges for n in e[:2]})
    rows = sorted((e for e in edges if e[0] != e[1]), key=lambda e: (e[0], e[1], e[2], 2147483647 if e[4] is None else e[4], e[3] or ""))
    beside: dict = {}
    for s, d, k, spec, line in rows:
        beside.setdefault(s, []).append((s, d, k, spec, line))
        beside.setdefault(d, []).append((d, s, f"reverse_{k}", spec, line))

    def walk(start, goal, hops):
        if start == goal:
            return []
        queue, seen = [(start, [])], {start}
        while queue:
            at, steps = queue.pop(0)
            if len(steps) >= hops:
                continue
            for step in beside.get(at, []):
                if step[1] in seen:
                    continue
                if step[1] == goal:
                    return [*steps, step]
                seen.add(step[1])
                queue.append((step[1], [*steps, step]))
        return None

    table = spark.createDataFrame(edges, "src string, dst string, kind string, specifier string, line long")
    pairs = spark.createDataFrame([(a, b) for a in nodes for b in nodes], "src string, dst string")
    for hops, asked in ((4, 9), (2, 2)):
        got = {(r.src, r.dst): [tuple(s) for s in r.steps] for r in paths(pairs, table, asked).collect()}
        assert got == {(a, b): w for a in nodes for b in nodes if (w := walk(a, b, hops)) is not None}
