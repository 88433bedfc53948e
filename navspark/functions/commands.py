"""Which shell commands search broadly (grep, rg or find over more than named files)."""

from __future__ import annotations

import re
import shlex

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Options whose value is the next word, by tool.
TAKES_VALUE = {
    "rg": set("-A -B -C -e -f -g -m -t -T --after-context --before-context --context --context-separator --engine --field-context-separator --field-match-separator --glob --iglob --max-count --max-depth --path-separator --pre --regexp --replace --sort --sortr --type --type-add --type-clear".split()),
    "grep": set("-A -B -C -D -d -e -f -m --after-context --before-context --binary-files --context --directories --exclude --exclude-dir --exclude-from --file --include --label --max-count --regexp".split()),
}
#: Options that make a find act on what it finds.
ACTIONS = {"-delete", "-exec", "-execdir", "-ok", "-okdir"}
#: Names of files without an extension.
BARE_FILES = {"AGENTS", "CHANGELOG", "Dockerfile", "LICENSE", "Makefile", "NOTICE", "README", "TODO"}
ASSIGNMENT = re.compile(r"[A-Za-z_]\w*=")


def simple_commands(line: str) -> list[list[str]]:
    """The words of each command between ; | || && and line breaks; an unclosed quote ends with the line."""
    for closing in ("", "'", '"'):
        lexer = shlex.shlex(line + closing, posix=True, punctuation_chars=";|&\n")
        lexer.whitespace, lexer.commenters = " \t\r", ""
        try:
            words = list(lexer)
            break
        except ValueError:
            continue
    else:
        words = line.split()
    out: list[list[str]] = [[]]
    for w in words:
        if w and set(w) <= set(";|&\n") and w != "&":
            out.append([])
        else:
            out[-1].append(w)
    return [c for c in out if c]


def bare(words: list[str]) -> list[str]:
    """A command without assignments and wrappers before it."""
    rest, flags = list(words), False
    while rest:
        if ASSIGNMENT.match(rest[0]) or rest[0] in ("command", "builtin", "noglob"):
            rest.pop(0)
        elif rest[0] in ("env", "sudo"):
            rest.pop(0)
            flags = True
        elif flags and rest[0].startswith("-"):
            rest.pop(0)
        else:
            break
    return rest


def names_file(path: str) -> bool:
    """Whether a path looks like one file rather than a folder or a pattern."""
    if not path or path in (".", "..") or path.endswith("/") or re.search(r"[*?\[\]{}]", path):
        return False
    name = path.rsplit("/", 1)[-1]
    return name in BARE_FILES or bool(re.search(r"\.[A-Za-z0-9][\w-]*$", name))


def operands(tool: str, args: list[str]) -> tuple[list[str], set[str]]:
    """The words that aren't options or options' values, and the options (letters without an attached value)."""
    plain, options, words = [], set(), iter(args)
    for w in words:
        if w == "--":
            plain += list(words)
        elif w.startswith("-"):
            name = w.split("=", 1)[0] if w.startswith("--") else w[:2]
            options.add(name)
            if name in TAKES_VALUE[tool] and "=" not in w and (w.startswith("--") or len(w) == 2):
                next(words, None)
        else:
            plain.append(w)
    return plain, options


def is_broad(words: list[str]) -> bool:
    words = bare(words)
    if not words:
        return False
    tool, args = words[0].rsplit("/", 1)[-1], words[1:]
    recursive = tool == "git" and "grep" in args
    if recursive:
        tool, args = "grep", args[args.index("grep") + 1 :]
    if tool == "find":
        roots = []
        for w in args:
            if w in ("(", ")", "!") or w.startswith("-"):
                break
            roots.append(w)
        return not ACTIONS & set(args) and not all(map(names_file, roots or ["."]))
    if tool not in TAKES_VALUE:
        return False
    plain, options = operands(tool, args)
    given = {"-e", "--regexp"} & options or (tool == "rg" and "--files" in options)
    paths = plain if given else plain[1:]
    if not paths:
        return tool == "rg" or recursive or bool({"-r", "-R", "--recursive"} & options)
    return not all(map(names_file, paths))


def searches_broadly(command: Column) -> Column:
    """Whether any command of a line searches broadly; false for null. Arrow batches, for the words need a shell's quoting."""

    @F.pandas_udf("boolean")
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(lambda line: any(map(is_broad, simple_commands(line or ""))))

    return run(F.coalesce(command, F.lit("")))
