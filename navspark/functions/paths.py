"""Column functions over paths and texts: language, stem, roles, prefix filters, snippets."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions that are indexed.
EXTENSIONS = "ts tsx js jsx mjs cjs json md mdx txt yml yaml toml sql css scss html py go rs java kt sh bash zsh rb php c cc cpp cxx h hh hpp hxx".split()
#: Extensions whose language has another name.
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "md": "markdown", "mdx": "markdown", "h": "c", "cc": "cpp", "cxx": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp"}
MAX_BYTES, SNIPPET = 1_000_000, 700


def extension(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"\.([^./]+)$", 1)


def language(path: Column) -> Column:
    """The canonical language of a path, '' where its extension isn't indexed."""
    ext = extension(path)
    out = F.when(~ext.isin(EXTENSIONS), F.lit(""))
    for name in sorted(set(LANGUAGES.values())):
        out = out.when(ext.isin([k for k, v in LANGUAGES.items() if v == name]), F.lit(name))
    return out.otherwise(ext)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """Base name without any of its extensions."""
    return F.regexp_replace(basename(path), r"(?<=.)\..*$", "")


def normalize_prefix(prefix: str) -> str:
    clean = prefix.strip().replace("\\", "/").strip("/")
    clean = posixpath.normpath(clean) if clean else ""
    return "" if clean in ("", ".") else clean + "/"


def under(path: Column, prefix: str) -> Column:
    """Whether a path lies under a prefix; letter case of ASCII doesn't count."""
    clean = normalize_prefix(prefix)
    return F.lit(True) if not clean else F.lower(path).startswith(clean.lower())


def snippet(text: Column) -> Column:
    """At most two line breaks in a row, trimmed, cut to SNIPPET characters with an ellipsis."""
    body = F.trim(F.regexp_replace(text, r"\n{3,}", "\n\n"), F.lit(" \n\r\t"))
    return F.when(F.char_length(body) > SNIPPET, F.concat(F.rtrim(F.substring(body, 1, SNIPPET - 1), F.lit(" \n\r\t")), F.lit("…"))).otherwise(body)


def roles(path: Column, size: Column) -> Column:
    """What a file is for, judged by its path and size; a sorted array."""
    low = F.lower(path)
    base = basename(low)
    code = extension(path).isin([e for e in EXTENSIONS if e not in ("json", "md", "mdx", "txt", "yml", "yaml", "toml", "css", "scss", "html")])
    test = low.rlike(r"(^|/)(tests?|__tests__|spec)/|[._-](test|spec)\.[^/]*$|(^|/)test_[^/]*\.py$")
    rules = {
        "agent_instructions": base.isin("agents.md", "claude.md"),
        "build_output": low.rlike(r"(^|/)(dist|build|out)/"),
        "configuration": base.rlike(r"(^|[._-])config\.|^\.[a-z]+rc|\.(toml|ya?ml|json)$"),
        "dependencies": base.isin("pyproject.toml", "package.json", "requirements.txt", "cargo.toml", "go.mod"),
        "provider": low.rlike(r"(^|/)providers/") | base.rlike(r"(^|[._-])provider([._-]|$)"),
        "setup": base.isin("prepare.py", "setup.py"),
        "tooling": low.rlike(r"(^|/)scripts/"),
        "archived_documentation": low.rlike(r"(^|/)docs/archive/"),
        "local_agent_settings": low == ".claude/settings.local.json",
        "decision_record": low.rlike(r"(^|/)(adr|adrs|decisions)/"),
        "documentation": extension(path).isin("md", "mdx", "txt") | low.rlike(r"(^|/)docs?/"),
        "generated": low.rlike(r"(^|/)generated/|\.generated\.|_pb2?\."),
        "implementation": code & ~test,
        "large_json": (extension(path) == "json") & (size >= 64_000),
        "lockfile": base.isin("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "cargo.lock", "gemfile.lock", "composer.lock", "go.sum", "uv.lock"),
        "main": code & base.rlike(r"^(main|index|app|cli|server)\.") & ~test,
        "minified": base.rlike(r"\.min\.(js|css)$"),
        "overview": base.rlike(r"^readme(\.|$)"),
        "tests": test,
    }
    return F.array_sort(F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()])))
