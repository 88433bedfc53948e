"""Chunks along code, relations of files, aliases, ignore rules, upkeep and shell commands on small inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from navspark.functions.commands import is_broad, searches_broadly, simple_commands
from navspark.operators.code import symbols
from navspark.operators.structure import alias_targets, counterparts, locality, neighbours, pieces, plain_json, related, route_pairs, structured_chunks, windows
from navspark.sources.corpus import tree
from navspark.sources.upkeep import collectable, ignored_by, retained, reused_hashes, skip_reason, usage_filter

SCRIPT = """import x from './x'

export class A<T> {
  run() { return "}" } // }
  re = /[}/]/
}
export const f = async ({ a }) => {
  return `${a} }`
}
const g = (a) =>
  a + 1

const h = (a) => a
function k({ a }, b = {}) { return 1 }
export default () => {
  if (1) {
  } else {
  }
}
tail()"""


def test_script_blocks():
    got = [(k, a, b) for k, a, b, _ in pieces(SCRIPT, "typescript")]
    assert got == [("text", 1, 2), ("class", 3, 6), ("function", 7, 9), ("function", 10, 11), ("text", 12, 12), ("function", 13, 13), ("function", 14, 14), ("function", 15, 19), ("text", 20, 20)]


def test_python_blocks():
    text = "import os\nclass A:\n    def f(self):\n        return 1\n\n    x = 2\n\n\nasync def g():\n  pass\ny = 1"
    assert [(k, a, b) for k, a, b, _ in pieces(text, "py")] == [("text", 1, 1), ("class", 2, 6), ("text", 7, 8), ("function", 9, 10), ("text", 11, 11)]


@pytest.mark.parametrize(("n", "count"), [(0, 1), (1, 1), (80, 1), (81, 2), (150, 2), (151, 3)])
def test_windows(n, count):
    got = windows(n)
    assert len(got) == count and got[-1][1] == n and all(b - a <= 80 for a, b in got)


def test_unclosed_and_empty():
    assert [(k, a, b) for k, a, b, _ in pieces("class A {\n x", "typescript")] == [("class", 1, 1), ("text", 2, 2)]
    assert pieces("", "go") == [("text", 1, 1, "")]


def test_structured_chunks(spark):
    files = spark.createDataFrame([("a.ts", "typescript", SCRIPT), ("b.go", "go", None)], "path string, language string, text string")
    rows = structured_chunks(files).orderBy("path", "ordinal").collect()
    assert [r.ordinal for r in rows if r.path == "a.ts"] == list(range(9)) and rows[-1].text == ""


def test_symbols_by_language(spark):
    texts = {
        "c": "#include <a>\nstruct Node;\nstruct Node {\nint add(int a) {\nvoid Foo::bar(int x)\nint proto(int);\n  if (x) {\n",
        "go": "func (s *T) Run() {\ntype T struct {\nfunc New() *T {\n",
        "java": "public final class A {\n  public int size() {\nenum E { A }\n",
        "kt": "data class P(val x: Int)\nfun <T> id(x: T) = x\nobject O\n",
        "rb": "module M\n  def self.go!\n  class C::D\n",
        "php": "abstract class A {\n public static function f($x) {\nfunction g() {\n",
        "rs": "pub enum E {\npub async fn go() {\ntrait T {\n",
        "typescript": "  match(x: string) {\n if (x) {\nexport type T = 1\n",
        "toml": "class x\n",
    }
    rows = symbols(spark.createDataFrame([(k, k, v) for k, v in texts.items()], "path string, language string, text string")).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.line):
        got.setdefault(r.path, []).append((r.name, r.kind))
    assert got == {
        "c": [("Node", "struct"), ("add", "function"), ("bar", "method")],
        "go": [("Run", "method"), ("T", "class"), ("New", "function")],
        "java": [("A", "class"), ("size", "method"), ("E", "type")],
        "kt": [("P", "class"), ("id", "function"), ("O", "class")],
        "rb": [("M", "module"), ("go!", "method"), ("C::D", "class")],
        "php": [("A", "class"), ("f", "method"), ("g", "function")],
        "rs": [("E", "type"), ("go", "function"), ("T", "interface")],
        "typescript": [("match", "method"), ("T", "type")],
    }


def test_locality(spark):
    pairs = [("a/b/x.ts", "a/b/y.ts", 25), ("a/b/x.ts", "a/c/y.ts", 10), ("a/b/x.ts", "a/y.ts", 9), ("x", "y", 5), ("x", "a/b/c/y", -3), ("a/b/c/x", "b/b/c/y", 0)]
    rows = spark.createDataFrame(pairs, "p string, q string, want long")
    assert all(r.got == r.want for r in rows.select("want", locality(F.col("p"), F.col("q")).alias("got")).collect())


def test_relations(spark):
    files = spark.createDataFrame([("lib/a.c",), ("lib/a.h",), ("lib/b.h",), ("x/a.c",)], "path string")
    assert {tuple(r) for r in counterparts(files).collect()} == {("lib/a.c", "lib/a.h"), ("lib/a.h", "lib/a.c")}
    edges = spark.createDataFrame([("lib/a.c", "lib/b.h", 2, "b.h"), ("lib/a.c", "lib/a.h", 1, "a.h"), ("x/a.c", "lib/b.h", None, "b.h")], "src string, dst string, line long, specifier string")
    got = {(r.path, r.direction, r.rank): r.other for r in neighbours(edges).collect()}
    assert got[("lib/a.c", "outgoing", 1)] == "lib/a.h" and got[("lib/b.h", "incoming", 2)] == "x/a.c"
    assert {r.other: r.reasons for r in related(files, edges).where("path = 'lib/a.c'").collect()} == {"lib/a.h": ["implementation_pair", "import"], "lib/b.h": ["import"]}


def test_route_pairs(spark):
    paths = ["web/app/api/orders/items/route.ts", "src/order/items-handler.ts", "src/orders/handler.ts", "tests/orders/items-handler.ts", "web/app/api/route.ts", "lib/order-item.handler.js", "src/orders-items.ts"]
    pairs = {tuple(r) for r in route_pairs(spark.createDataFrame([(p, 1) for p in paths], "path string, size long")).collect()}
    want = {(paths[0], paths[1]), (paths[0], paths[5])}
    assert pairs == want | {(b, a) for a, b in want}
    assert {r.dst for r in route_pairs(spark.createDataFrame([(p,) for p in paths], "path string"), 1).where(f"src = '{paths[0]}'").collect()} == {paths[1]}
    assert not route_pairs(spark.createDataFrame([], "path string, size long")).collect()


def test_aliases(spark):
    config = '{ // c\n "compilerOptions": {"baseUrl": "./src", "paths": {"@/*": ["*", "gen/*"], "@/ui/*": ["ui/*/index"], "env": ["env.ts",]}, },}'
    configs = spark.createDataFrame([("app/tsconfig.json", config), ("tsconfig.json", '{"compilerOptions": {"paths": {"@/*": ["root/*"]}}}'), ("bad/tsconfig.json", "[")], "path string, text string")
    refs = spark.createDataFrame([("app/src/a.ts", "@/ui/b"), ("lib/c.ts", "@/d"), ("app/src/a.ts", "env"), ("app/src/a.ts", "react")], "src string, specifier string")
    got = {(r.src, r.specifier, r.choice): r.target for r in alias_targets(refs, configs).collect()}
    assert got == {("app/src/a.ts", "@/ui/b", 1): "app/src/ui/b/index", ("app/src/a.ts", "@/ui/b", 2): "app/src/ui/b", ("app/src/a.ts", "@/ui/b", 3): "app/src/gen/ui/b", ("lib/c.ts", "@/d", 1): "root/d", ("app/src/a.ts", "env", 1): "app/src/env.ts"}
    assert plain_json('{"a": "// no", /* x */ "b": [1,],}') == {"a": "// no", "b": [1]}


def test_ignore_rules(spark):
    cases = [
        ("a/b.log", ["*.log"], True), ("a/b.log", ["*.log", "!b.log"], False), ("a/b.log", ["!b.log", "*.log"], True),
        ("tmp/x/y", ["tmp/"], True), ("a/tmp/y", ["tmp/"], True), ("a/tmp/y", ["/tmp"], False), ("a/tmp", ["tmp"], True), ("tmp/y", ["tmp"], True),
        ("a/x/b.ts", ["a/*.ts"], False), ("a/x/b.ts", ["a/**/*.ts"], True), ("a/b.ts", ["a/**/*.ts"], True), ("a/x/b", ["a/x/"], True), ("q", ["# q", "", "?"], True),
    ]
    for path, rules, want in cases:
        assert spark.range(1).select(ignored_by(F.lit(path), rules).alias("x")).first().x is want, (path, rules)
    rows = spark.createDataFrame([("src/a.ts",), ("node_modules/a.ts",), ("a.min.js",), (".env.local",), ("my-secrets/k.ts",), ("x/skip.ts",)], "path string")
    got = {r.path: r.why for r in rows.select("path", skip_reason(F.col("path"), {".gitignore": ["skip.ts"]}).alias("why")).collect()}
    assert got == {"src/a.ts": None, "node_modules/a.ts": "ignored directory", "a.min.js": "binary/generated extension", ".env.local": "secret-like file", "my-secrets/k.ts": "secret-like file", "x/skip.ts": ".gitignore"}


def test_tree(spark, tmp_path):
    for name, body in {"src/a.ts": b"x", "src/b.ts": b"a\0b", "dist/c.ts": b"x", "d.exe": b"x", "e.ts": b"x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    got = {r.path: r.skip_reason for r in tree(spark, str(tmp_path), rules={".gitignore": ["/e.ts"]}).collect()}
    assert got == {"src/a.ts": None, "src/b.ts": "binary", "dist/c.ts": "ignored directory", "d.exe": "extension", "e.ts": ".gitignore"}


def test_upkeep(spark):
    listing = spark.createDataFrame([("a", 1, 10.4), ("b", 1, 10.6), ("c", 2, 1.0)], "path string, size long, modified_ms double")
    indexed = spark.createDataFrame([("a", 1, 10.0, "h"), ("b", 1, 10.0, "h"), ("d", 1, 1.0, "h")], "path string, size long, modified_ms double, hash string")
    assert {r.path: r.hash for r in reused_hashes(listing, indexed).collect()} == {"a": "h", "b": None, "c": None}
    states, registry, roots = spark.createDataFrame([("k1", 5), ("k2", 7)], "key string, bytes long"), spark.createDataFrame([("k2", "/gone"), ("k3", "/here")], "key string, root string"), spark.createDataFrame([("/here",)], "root string")
    assert {(r.key, r.reason, r.bytes) for r in collectable(states, registry, roots).collect()} == {("k1", "orphan_db", 5), ("k2", "missing_root", 7)}
    assert {r.name: r.action for r in retained(spark.createDataFrame([("a", 1), ("b", (32 << 20) + 1)], "name string, bytes long")).collect()} == {"a": "keep", "b": "rotate"}
    events = spark.createDataFrame([("k", "/r", "2"), ("j", "/s", "1")], "repo_key string, repo_root string, ts string")
    assert usage_filter(events, "/r").count() == 1 and usage_filter(events, "j", "2").count() == 0 and usage_filter(events).count() == 2


BROAD = ["rg foo", "rg foo src/", "rg -n foo src", "grep -r foo", "grep -rn foo .", "find . -name x", "find", "git grep foo", "cd a && rg foo", "FOO=1 sudo -n rg foo", "env -i A=1 rg foo", "rg --files", "rg -e a src", "/usr/bin/rg x", "cat x | grep -r y .", "grep foo 'src/*.ts'"]
NARROW = ["rg foo a.ts", "grep foo a.ts", "cat a | grep foo", "grep -e foo a.ts", "find . -delete", "find a.txt", "echo 'rg foo'", "ls", "", "rg -g '*.ts' foo README", "rg -A 3 foo a.ts b/c.py", "git log", "grep foo", "echo \"a; rg b\""]


@pytest.mark.parametrize(("command", "want"), [*((c, True) for c in BROAD), *((c, False) for c in NARROW)])
def test_broad_commands(command, want):
    assert any(map(is_broad, simple_commands(command))) is want


def test_broad_column(spark):
    rows = spark.createDataFrame([("rg x",), (None,), ("rg 'open",)], "c string")
    assert [r.b for r in rows.select(searches_broadly(F.col("c")).alias("b")).collect()] == [True, False, True]
