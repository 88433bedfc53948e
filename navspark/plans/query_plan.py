"""A keyword query's plan: terms, intents and the ladder of full-text tiers."""

from __future__ import annotations

from dataclasses import dataclass, field

import regex

from navspark.operators.match import Expression, expression, phrase

#: Fixed values.
STOP_WORDS = set("a an and api by for from get in into of on or post put the to with".split())
CODE_INTENT = set("aggregator class delivery endpoint function handler implemented lock macro method orchestrator pipeline service".split())
MOST_RAW, MOST_TERMS = 12, 16
RAW = regex.compile(r"[\p{L}\p{N}_.$/-]+")
#: Where a term parts: before a capital behind a small letter or digit, before a capitalised word behind capitals, and at these signs.
PARTS = regex.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[.$/\\_-]+", regex.V1)
#: Words and phrases that name a role.
ROLE_WORDS = {
    "overview": {"purpose", "readme", "edit"},
    "agent_instructions": {"agent", "agents", "instructions", "program", "claude", "edit"},
    "implementation": {"implemented", "implementation", "source", "defined", "architecture", "model", "used", "orchestrator", "pipeline", "provider", "run", "main", "entry", "entrypoint"},
    "provider": {"provider", "providers"},
    "configuration": {"config", "configuration"},
    "documentation": {"docs", "doc", "documentation"},
    "decision_record": {"adr", "decision", "scope", "scopes"},
    "tests": {"tests", "test", "testing"},
    "main": {"main", "entry", "entrypoint", "orchestrator", "edit"},
    "setup": {"computed", "data", "setup", "preparation", "prepare"},
    "dependencies": {"dependencies", "dependency", "package", "pyproject"},
}
ROLE_PHRASES = {
    "overview": ["what is this project", "project about", "not be modified", "not modified", "do not modify"],
    "setup": ["not be modified", "not modified", "do not modify"],
}
#: Compounds that count as one name, base names that a term also means, and words that say nothing about an endpoint's path.
COMPOUNDS, PATH_TERMS, ENDPOINT_NOISE = {"localstorage"}, {"preload": ["retrieval"]}, {"return", "returns", "show", "shows", "should"}


#: A term that can be looked for by its beginning.
START = regex.compile(r"[\p{L}\p{N}_]+")


@dataclass
class Tier:
    mode: str
    terms: list[str]
    boost: int

    def expression(self) -> Expression:
        """What the tier asks the index for: each of its terms is a phrase of the index's own tokens."""
        if self.mode == "prefix":
            starts = [found[0] for t in self.terms if (found := START.search(t)) and len(found[0]) > 2]
            return expression("any", [phrase(t, True) for t in starts])
        return expression("any" if self.mode == "any" else "all", [phrase(t) for t in self.terms])


@dataclass
class Plan:
    normalized: str
    path_like: bool
    phrases: list[str]
    raw: list[str]
    expanded: list[str]
    core: list[str]
    intents: list[str]
    code_intent: bool
    path_terms: list[str]
    endpoint_terms: list[str]
    tiers: list[Tier] = field(default_factory=list)


def unique(items: list[str], most: int) -> list[str]:
    return list(dict.fromkeys(items))[:most]


def parts(term: str) -> list[str]:
    """A term in lower case, and the words that letter case and punctuation part; digits stay with their word."""
    return [term.lower(), *(x.lower() for x in PARTS.split(term) if x)]


def compounds(raw: list[str]) -> list[str]:
    """Last words of neighbouring terms as one name, if one of them is a single character or the name is known; a stop word parts them."""
    last, out = [parts(t)[-1] for t in raw], []
    for left, right in zip(last, last[1:], strict=False):
        name = left + right
        usual = 5 <= len(name) <= 32 and regex.fullmatch(r"[\p{L}\p{N}]+", name)
        if usual and not {left, right} & STOP_WORDS and (min(len(left), len(right)) == 1 or name in COMPOUNDS):
            out.append(name)
    return unique(out, len(out))


def endpoint_terms(terms: list[str]) -> list[str]:
    """The two terms before each word "endpoint" and the one behind it, without those that name no path."""
    near = [t for i, x in enumerate(terms) if x == "endpoint" for t in [*terms[max(0, i - 2) : i], *terms[i + 1 : i + 2]]]
    return unique([t for t in near if len(t) > 2 and t not in STOP_WORDS | ENDPOINT_NOISE], len(near))


def roles_meant(normalized: str, core: list[str]) -> list[str]:
    """Roles that words or phrases of the query name; "overview" does so only with at most one other term."""
    alone = {"overview"} if "overview" in core and len(core) <= 2 else set()
    return [k for k, words in ROLE_WORDS.items() if words & set(core) or k in alone or any(p in normalized for p in ROLE_PHRASES.get(k, ()))]


def plan(query: str) -> Plan:
    phrases = [p for p in (x.strip() for x in regex.findall(r'"([^"]+)"', query)) if p]
    every = RAW.findall(query)
    raw = every[:MOST_RAW]
    if not raw and not phrases:
        raise ValueError("the query has no terms")
    normalized = regex.sub(r'^"|"$', "", query.strip()).lower()
    words = [p for t in raw for p in parts(t) if len(p) > 1]
    scope = ["scope"] if {"session", "repo"} <= set(words) else []
    expanded = unique([*words, *scope, *compounds(every)], MOST_TERMS)
    core = [t for t in expanded if t not in STOP_WORDS]
    paths = unique([p for t in core for p in PATH_TERMS.get(t, ())], MOST_TERMS)
    out = Plan(normalized, bool(regex.search(r"[/.\\-]", query.strip())), phrases, raw, expanded, core, roles_meant(normalized, core), bool(CODE_INTENT & set(core)), paths, endpoint_terms(expanded))
    boosted = bool(phrases) or len(expanded) > 1
    broad = expanded if len(raw) > 1 else [t.lower() for t in raw]
    pair = ["session", "repo"] if {"session", "repo"} <= set(core) else []
    ladder = [*(("phrase", [p], 24) for p in phrases), ("all", raw, 18), ("all", core, 16), ("all", pair, 14), ("all", expanded, 12), ("prefix", broad, 8), ("any", broad, 0)]
    seen: dict[str, Tier] = {}
    for mode, terms, boost in ladder:
        tier = Tier(mode, terms, 0)
        if tier.expression().phrases:
            # Tiers of equal wording are one; terms that differ in letter case only stay apart.
            either = len(terms) > 1 and mode in ("any", "prefix")
            tier = seen.setdefault(f"{either} {mode == 'prefix'} {terms}", tier)
            tier.boost = max(tier.boost, boost if boosted else 0)
    out.tiers = list(seen.values())
    return out
