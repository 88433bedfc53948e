"""Chunks along code structure, and how files relate: counterparts, locality, neighbours, path aliases."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navspark.operators.text_index import ROWS
from navspark.functions.paths import roles
from navspark.operators.code import alias_targets, plain_json, sections  # noqa: F401

#: Lines of a window and lines from one window's start to the next's.
WINDOW, STRIDE = 80, 70
#: What a scan for braces steps over whole, and the braces, semicolons and arrows themselves.
LEXEME = re.compile(
    r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"""
    r"""|(?<=[=(,:\[!&|?{};\n])[ \t]*/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[*])+/|[{};]|=>""",
    re.S,
)
HEADERS, SOURCES = ["h", "hh", "hpp", "hxx"], ["c", "cc", "cpp", "cxx"]
#: Words that name no route, and roles of files that aren't handlers.
ROUTE_NOISE = ["app", "api", "route", "handler", "src", "web", "lib", "server"]
NO_HANDLERS = ["tests", "generated", "build_output", "minified", "lockfile"]


def windows(n: int) -> list[tuple[int, int]]:
    """Half-open line ranges of overlapping windows over n lines."""
    return [(at, min(at + WINDOW, n)) for at in range(0, max(n - (WINDOW - STRIDE), 1), STRIDE)]


class Braces:
    """Where every brace of a text closes, found in one scan."""

    def __init__(self, text: str) -> None:
        self.marks: list[tuple[int, str]] = []
        self.close: dict[int, int] = {}
        line, at, stack = 0, 0, []
        for m in LEXEME.finditer(text):
            line, at = line + text.count("\n", at, m.start()), m.start()
            if m[0] in ("{", "}", ";", "=>"):
                if m[0] == "{":
                    stack.append(len(self.marks))
                elif m[0] == "}" and stack:
                    self.close[stack.pop()] = len(self.marks)
                self.marks.append((line, m[0]))
        self.first: dict[int, int] = {}
        for i, (n, _) in enumerate(self.marks):
            self.first.setdefault(n, i)

    def end(self, lines: list[str], begin: int) -> int:
        """The last line of the block that a declaration at line ``begin`` opens; ``begin`` itself where it opens none."""
        after = next((self.first[n] for n in range(begin, min(begin + 40, len(lines))) if n in self.first), None)
        if re.search(r"=>\s*$", lines[begin]):
            base, last = indent(lines[begin]), begin
            for n in range(begin + 1, len(lines)):
                if not lines[n].strip() or indent(lines[n]) <= base:
                    break
                last = n
            return last
        if after is None or ("=>" in lines[begin] and not any(n == begin and m == "{" for n, m in self.marks[after:])):
            return begin
        while after < len(self.marks) and self.marks[after][1] in ("=>", "}"):
            after += 1
        while after < len(self.marks) and self.marks[after][1] == "{":
            shut = self.close.get(after)
            if shut is None:
                return begin
            following = shut + 1
            while following < len(self.marks) and self.marks[following] == (self.marks[shut][0], "=>"):
                following += 1
            if following < len(self.marks) and self.marks[following] == (self.marks[shut][0], "{"):
                after = following
                continue
            return self.marks[shut][0]
        return begin


def indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def python_end(lines: list[str], begin: int) -> int:
    """The last line that is indented deeper than the declaration, trailing blank lines apart."""
    last = begin
    for n in range(begin + 1, len(lines)):
        if lines[n].strip():
            if indent(lines[n]) <= indent(lines[begin]):
                break
            last = n
    return last


def opens(line: str, python: bool) -> str | None:
    """class or function where a line begins the declaration of one, with or without a name."""
    bare = re.sub(r"^\s*(?:(?:export|default|abstract|async)\s+)*", "", line)
    word = re.match(r"[a-z]*", bare)[0]
    rest = bare[len(word) :]
    if python:
        named = re.match(r"\s+[^\W\d]", rest)
        return {"class": "class", "def": "function"}.get(word) if named else None
    if word == "class" and not re.match(r"[\w$]", rest):
        return "class"
    if word == "function" and "(" in rest and not re.match(r"[\w$]", rest):
        return "function"
    if word == "const":
        # Behind the first equals sign that is no comparison and no arrow.
        value = re.split(r"(?<![=!<>])=(?![=>])", rest, maxsplit=1)
        bare = re.sub(r"^\s*(?:async\b\s*)?(?:<[^=]*>\s*)?", "", value[1]) if len(value) == 2 else ""
    elif not re.match(r"\s*export\s+default\s", line):
        return None
    head, arrow, _ = bare.partition("=>") if bare[:1] != "(" else _closed(bare)
    return "function" if arrow and re.fullmatch(r"\(.*\)|[\w$]+", head.strip(), re.S) else None


def _closed(text: str) -> tuple[str, str, str]:
    """Text that begins with a parenthesis, up to where it closes, and the arrow behind, if there is one."""
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if not depth:
            return text[: i + 1], "=>" if text[i + 1 :].lstrip().startswith("=>") else "", ""
    return text, "", ""


def pieces(text: str, language: str) -> list[tuple[str, int, int, str]]:
    """(kind, first line, last line, text) of a file's chunks: sections of Markdown, blocks of code with windows between, else windows."""
    lines = re.split(r"\r?\n", text)
    flat = lambda a, b: [("text", a + s + 1, a + e, "\n".join(lines[a + s : a + e])) for s, e in windows(b - a)]
    if language == "markdown":
        return [("section", a, b, "\n".join(lines[a - 1 : b])) for a, b in sections(text)]
    python = language in ("py", "python")
    if not python and language not in ("typescript", "javascript", "tsx", "jsx"):
        return flat(0, len(lines))
    braces = None if python else Braces("\n".join(lines))
    out, free, n = [], 0, 0
    while n < len(lines):
        kind = opens(lines[n], python)
        if kind is None:
            n += 1
            continue
        out += flat(free, n) if n > free else []
        last = python_end(lines, n) if braces is None else braces.end(lines, n)
        out.append((kind, n + 1, last + 1, "\n".join(lines[n : last + 1])))
        free = n = last + 1
    return out + (flat(free, len(lines)) if free < len(lines) else [])


def structured_chunks(files: DataFrame, languages: bool = False) -> DataFrame:
    """path, ordinal, kind, start_line, end_line, text, and the language if asked for, of every file (path, language, text); null text counts as empty."""
    more = ["language"] * languages

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), ROWS):
                rows = [(r.path, i, *piece, *[r.language] * languages) for r in part.iloc[at : at + ROWS].itertuples() for i, piece in enumerate(pieces(r.text or "", r.language))]
                yield pd.DataFrame(rows, columns=["path", "ordinal", "kind", "start_line", "end_line", "text", *more])

    return files.select("path", "language", "text").mapInPandas(run, "path string, ordinal long, kind string, start_line long, end_line long, text string" + ", language string" * languages)


def locality(base: Column, path: Column) -> Column:
    """Ten per leading folder in common, five for the same folder, less the difference of depths."""
    a, b = (F.filter(F.split(F.regexp_replace(c, r"/?[^/]*$", ""), "/"), lambda d: d != "") for c in (base, path))
    step = lambda acc, p: F.when(acc["on"] & (p["a"] == p["b"]), F.struct(F.lit(True).alias("on"), (acc["n"] + 1).alias("n"))).otherwise(F.struct(F.lit(False).alias("on"), acc["n"].alias("n")))
    pairs = F.zip_with(a, b, lambda x, y: F.struct(F.coalesce(x, F.lit("")).alias("a"), F.coalesce(y, F.lit("/")).alias("b")))
    shared = F.aggregate(pairs, F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), step)["n"]
    return (10 * shared + F.when(a == b, 5).otherwise(0) - F.abs(F.size(a) - F.size(b))).cast("long")


def counterparts(files: DataFrame) -> DataFrame:
    """src, dst: headers and sources of one stem in one folder, both ways, by one equi-join."""
    rows = files.select("path", F.regexp_replace("path", r"\.[^./]+$", "").alias("stem"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"))
    h, c = rows.where(F.col("ext").isin(HEADERS)), rows.where(F.col("ext").isin(SOURCES))
    pairs = h.select("stem", F.col("path").alias("src")).join(c.select("stem", F.col("path").alias("dst")), "stem").select("src", "dst")
    return pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def path_words(path: Column) -> Column:
    """The distinct words of a path, three letters or more, without a plural's s."""
    words = F.transform(F.split(F.lower(path), "[^a-z0-9]+"), _singular)
    return F.array_distinct(F.filter(words, lambda w: F.char_length(w) >= 3))


def _singular(word: Column) -> Column:
    return F.when(F.endswith(word, F.lit("s")) & (F.char_length(word) > 4), F.substr(word, F.lit(1), F.char_length(word) - 1)).otherwise(word)


def route_pairs(files: DataFrame, limit: int = 4) -> DataFrame:
    """src, dst: routes and the handlers whose paths hold every word of theirs, both ways, the nearest ``limit`` of each.

    A join by set containment: each word of a route (or its singular) meets the handlers' words, and pairs with as many
    of the route's words as it has are kept. Only scripts that are neither tests nor noise (by path and size) take part.
    """
    path, low = F.col("path"), F.lower("path")
    kinds = roles(path, F.col("size") if "size" in files.columns else F.lit(0))
    shut = F.arrays_overlap(kinds, F.array(*map(F.lit, NO_HANDLERS))) | F.regexp_extract(low, "([^/]*)$", 1).rlike(r"(^|[._-])config\.")
    code = files.where(low.rlike(r"\.[cm]?[jt]sx?$") & ~shut).select("path", F.regexp_extract(low, r"(?:^|/)app/api/(.+)/route\.[^./]+$", 1).alias("named"))
    words = F.array_except(path_words(F.col("named")), F.array(*map(F.lit, ROUTE_NOISE)))
    routes = code.where("named <> ''").select(F.col("path").alias("route"), words.alias("words"))
    each = routes.select("route", F.size("words").alias("n"), F.explode("words").alias("w")).select("route", "n", "w", F.explode(F.array_distinct(F.array("w", _singular(F.col("w"))))).alias("word"))
    handlers = code.where((F.col("named") == "") & F.regexp_extract(low, "([^/]*)$", 1).rlike(r"(^|[._-])handler([._-]|$)"))
    held = handlers.select(F.col("path").alias("handler"), F.explode(path_words(path)).alias("word"))
    pairs = each.join(held, "word").groupBy("route", "handler", "n").agg(F.count_distinct("w").alias("met")).where("met = n")
    both = pairs.select(F.col("route").alias("src"), F.col("handler").alias("dst")).unionByName(pairs.select(F.col("handler").alias("src"), F.col("route").alias("dst")))
    near = F.row_number().over(Window.partitionBy("src").orderBy(F.desc(locality(F.col("src"), F.col("dst"))), "dst"))
    return both.withColumn("nth", near).where(F.col("nth") <= limit).drop("nth")


def neighbours(edges: DataFrame, limit: int = 16) -> DataFrame:
    """path, direction, other, rank over edges (src, dst, line, specifier): the first imports by line, the first importers by path."""
    out = edges.select(F.col("src").alias("path"), F.lit("outgoing").alias("direction"), F.col("dst").alias("other"), F.struct(F.col("line").isNull(), "line", "dst", "specifier").alias("o"))
    back = edges.select(F.col("dst").alias("path"), F.lit("incoming").alias("direction"), F.col("src").alias("other"), F.col("src").alias("s"), "line", "specifier")
    rank = lambda *o: F.row_number().over(Window.partitionBy("path").orderBy(*o)).cast("long").alias("rank")
    rows = out.select("path", "direction", "other", rank("o")).unionByName(back.select("path", "direction", "other", rank("s", "line", "specifier")))
    return rows.where(F.col("rank") <= limit)


def related(files: DataFrame, edges: DataFrame, limit: int = 8) -> DataFrame:
    """path, other, reasons, rank: imports, importers and counterparts of every file, each once, the nearest by locality first."""
    parts = [edges.select(F.col("src").alias("path"), F.col("dst").alias("other"), F.lit("import").alias("reason")), edges.select(F.col("dst").alias("path"), F.col("src").alias("other"), F.lit("reverse_import").alias("reason")), counterparts(files).unionByName(route_pairs(files)).select(F.col("src").alias("path"), F.col("dst").alias("other"), F.lit("implementation_pair").alias("reason"))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("path", "other").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    near = Window.partitionBy("path").orderBy(F.desc(locality(F.col("path"), F.col("other"))), "other")
    return rows.select("path", "other", "reasons", F.row_number().over(near).cast("long").alias("rank")).where(F.col("rank") <= limit)
