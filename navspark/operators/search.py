"""Ranked search over files: candidates by path, base name and full-text tiers, scored by visible components."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import regex
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from navspark.functions.paths import basename, extension, normalize_prefix, roles, snippet, stem, under
from navspark.operators.code import file_graph
from navspark.operators.match import matches
from navspark.plans.query_plan import Plan, plan
from navspark.sources.corpus import documents_as_files, table
from navspark.sources.scratch import saved, shared_dir
from navspark.sources.stored_index import Conflict, StoredIndex, _state, derived


#: Extensions and base names of texts about code, and the most results that a search gives.
PROSE, PROSE_STEMS, MOST = ["md", "mdx", "rst", "txt"], ["readme", "architecture", "changelog", "todo"], 50
#: Names of a route's handlers, and where routes lie.
VERBS, ROUTE = ["get", "post", "put", "patch", "delete"], r"(^|/)app/api/.+/route\."
#: Chunks of a tier that the quota for code looks through, keeps, and the share of terms that it asks for.
SCAN, KEEP, LEAST = 60, 6, 0.2
#: Languages of code, by extension.
CODE = ["ts", "tsx", "js", "jsx", "mts", "mjs", "cts", "cjs", "mtsx", "mjsx", "ctsx", "cjsx", "py", "go", "rs", "java", "rb", "php", "cs", "cpp", "c", "h", "hpp", "swift", "kt", "scala", "sh", "sql"]


def literals(items: list[str]) -> Column:
    """An array of texts, made at once."""
    quoted = ", ".join("'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in items)
    return F.expr(f"cast(array({quoted}) as array<string>)")


def matched(text: Column, terms: list[str]) -> Column:
    """The terms that stand in the text as words, an array; an underscore parts words."""
    low = F.lower(text)
    return F.filter(literals(terms), lambda t: F.rlike(low, F.concat(F.lit("(^|[^\\p{L}\\p{N}])\\Q"), t, F.lit("\\E($|[^\\p{L}\\p{N}])"))))


def coverage(text: Column, terms: list[str]) -> Column:
    """The share of terms that stand in the text as words."""
    return F.size(matched(text, terms)) / F.lit(float(len(terms))) if terms else F.lit(0.0)


class Tables:
    """The tables that a search reads, by name: those of a stored index's version, or made of files for one search."""

    def __init__(self, read: Callable[[str, list[str] | None], DataFrame], counts: dict[str, int]):
        self.read, self.counts = read, counts

    @staticmethod
    def of_files(files: DataFrame) -> Tables:
        """files: path, language, size, text."""
        known = {c: F.lit(None).cast(kind) for c, kind in (("hash", "string"), ("modified_ms", "double")) if c not in files.columns}
        made = {name: saved(rows, "search") for name, rows in derived(files.withColumns(known) if known else files).items() if name != "references"}
        made["edges"] = file_graph(files)  # not read by a search
        counts = {t: made[t].count() for t in ("chunks", "symbols")} | {t: made[t].agg(F.coalesce(F.sum(F.size("positions")), F.lit(0))).first()[0] for t in ("chunk_terms", "symbol_terms")}
        return Tables(lambda name, paths: made[name], counts)

    @staticmethod
    def of_index(index: StoredIndex, number: int | None = None) -> Tables:
        version = index.current(number)
        return Tables(lambda name, paths: index.table(name, version, None if paths is None else index.bucket_of(paths, version)), version.counts)


def under_path(files: DataFrame, prefix: str) -> DataFrame:
    return files.where(under(F.col("path"), prefix))


def hits(tables: Tables, of: Plan, prefix: str, most: int) -> list[Row]:
    """source, tier, nth, path, ordinal, score: the first ``most`` chunks and symbols that each tier matches; at most 2 * tiers * most rows."""
    asked = [t.expression() for t in of.tiers]
    out = None
    for source, terms, rows in (("symbol_fts", "symbol_terms", "symbols"), ("chunk_fts", "chunk_terms", "chunks")):
        if not asked or not tables.counts.get(rows):
            continue
        found = under_path(matches(tables.read(terms, None), ["path", "ordinal"], asked, tables.counts[rows], tables.counts[terms]), prefix)
        nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "path", "ordinal"))
        part = found.withColumn("nth", nth).where(F.col("nth") <= most).select(F.lit(source).alias("source"), F.col("query").alias("tier"), "nth", "path", "ordinal", "score")
        out = part if out is None else out.unionByName(part)
    return [] if out is None else out.collect()


ROW = "source string, tier int, nth int, path string, ordinal long, start_line long, end_line long, kind string, symbol string, text string, boost double, rank double"


def by_path(tables: Tables, of: Plan, limit: int, prefix: str) -> DataFrame:
    """ROW of the candidates that paths, base names, routes and roles give."""
    files = under_path(tables.read("files", None).select("path", "size"), prefix)
    low = F.lower("path")
    whole = lambda source, rows, boost: rows.select(F.lit(source).alias("source"), F.lit(-1).alias("tier"), F.lit(0).alias("nth"), "path", F.lit(0).cast("long").alias("ordinal"), F.lit(1).cast("long").alias("start_line"), F.lit(1).cast("long").alias("end_line"), F.lit("file").alias("kind"), F.lit(None).cast("string").alias("symbol"), F.col("path").alias("text"), F.lit(float(boost)).alias("boost"), F.lit(0.0).alias("rank"))
    out = files.sparkSession.createDataFrame([], ROW)
    if of.path_like:
        out = out.unionByName(whole("path_match", files.where(F.contains(low, F.lit(of.normalized))).orderBy(F.length("path"), "path").limit(min(limit, 20)), 30))
    names = [t for t in of.path_terms if regex.fullmatch(r"[\p{L}\p{N}_-]{4,}", t)]
    if names:
        out = out.unionByName(whole("basename_term", files.where(F.lower(stem(F.col("path"))).isin(names)), 42))
    if "endpoint" in of.core and of.code_intent and of.endpoint_terms:
        routes = under_path(tables.read("symbols", None), prefix).where(F.lower("name").isin(VERBS) & low.rlike(ROUTE)).orderBy(F.length("path"), "path", "start_line").limit(100)
        routes = routes.where(F.size(matched(F.col("path"), of.endpoint_terms)) > 0)
        out = out.unionByName(routes.select(F.lit("endpoint_route").alias("source"), F.lit(-1).alias("tier"), F.lit(0).alias("nth"), "path", (-F.col("ordinal")).alias("ordinal"), "start_line", "end_line", "kind", F.col("name").alias("symbol"), F.col("signature").alias("text"), F.lit(34.0).alias("boost"), F.lit(0.0).alias("rank")))
    meant = [i for i in of.intents if i != "implementation"]
    if meant:
        kinds = roles(F.col("path"), F.col("size"))
        fits = files.where(F.arrays_overlap(kinds, literals(meant))).orderBy(F.length("path"), "path").limit(500)
        heads = tables.read("chunks", None).where("ordinal = 0").select("path", F.col("text").alias("head"))
        named = heads.join(F.broadcast(fits), "path", "right").withColumn("text", F.coalesce("head", "path"))
        named = named.where(~F.array_contains(kinds, "tests") | (F.size(matched(F.concat_ws("\n", "path", "text"), of.core)) >= 3))
        out = out.unionByName(whole("role_intent", named, 18).drop("text").join(named.select("path", "text"), "path").select(*out.columns))
    return out


def by_terms(tables: Tables, of: Plan, rows: list[Row]) -> DataFrame:
    """ROW of the chunks and symbols among rows of ``hits``; only the buckets of their paths are read."""
    spark = tables.read("files", None).sparkSession
    kinds = "source string, tier int, nth int, path string, ordinal long, boost double, rank double"
    out = spark.createDataFrame([], ROW)
    for source, name, more, shape in (("symbol_fts", "symbols", 4, ("name", "signature", -1)), ("chunk_fts", "chunks", 1, (None, "text", 1))):
        mine = [(r["source"], r["tier"], r["nth"], r["path"], r["ordinal"], float(of.tiers[r["tier"]].boost + more), r["score"]) for r in rows if r["source"] == source]
        if mine:
            paths = sorted({r[3] for r in mine})
            symbol, text, sign = shape
            stored = tables.read(name, paths).where(F.col("path").isin(paths)).select("path", "ordinal", "start_line", "end_line", "kind", (F.col(symbol) if symbol else F.lit(None).cast("string")).alias("symbol"), F.col(text).alias("text"))
            met = stored.join(F.broadcast(spark.createDataFrame(mine, kinds)), ["path", "ordinal"])
            out = out.unionByName(met.withColumn("ordinal", sign * F.col("ordinal")).select(*out.columns))
    return out


def budgets(found: DataFrame, tiers: int, limit: int) -> DataFrame:
    """What a search takes of its scored rows (source, tier, nth, path, coverage): all that paths gave; of each tier's chunks as many as
    are left of twice the limit, the limit at least, and of its symbols half as many; and of its first SCAN chunks the first
    KEEP that are code and hold a share LEAST of the terms, whatever is left (source code_quota, besides chunk_fts).
    """
    code = (F.col("source") == "chunk_fts") & (F.col("nth") <= SCAN) & extension(F.col("path")).isin(CODE) & (F.col("coverage") >= LEAST)
    quota = F.sum(F.when(code, 1).otherwise(0)).over(Window.partitionBy("tier", "source").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = found.withColumn("quota", F.when(code & (quota <= KEEP), True).otherwise(False))
    counts = found.groupBy("tier", "source").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("quota"), 1)).alias("kept")).collect()  # at most two rows a tier
    of = {(r["tier"], r["source"]): (r["n"], r["kept"]) for r in counts}
    taken, left = sum(n for (tier, _), (n, _) in of.items() if tier < 0), []
    for tier in range(tiers):
        remaining = max(2 * limit - taken, limit)
        left.append((tier, remaining))
        n, kept = of.get((tier, "chunk_fts"), (0, 0))
        taken += min(-(-remaining // 2), of.get((tier, "symbol_fts"), (0, 0))[0]) + min(remaining, n) + kept
    rows = found.join(F.broadcast(found.sparkSession.createDataFrame(left, "tier int, remaining int")), "tier", "left")
    fits = F.when(F.col("source") == "symbol_fts", F.col("nth") <= F.ceil(F.col("remaining") / 2)).when(F.col("source") == "chunk_fts", F.col("nth") <= F.col("remaining")).otherwise(True)
    again = rows.where("quota").withColumn("source", F.lit("code_quota"))
    return rows.where(fits).unionByName(again).drop("quota", "remaining")


def symbol_score(of: Plan) -> Column:
    """What a symbol or a chunk of code adds: its text the query, its name the query itself, a term of five letters or more, or most of its beginning; and a route's handler."""
    name = F.coalesce(F.lower("symbol"), F.lit(""))
    named_kind = ~F.col("kind").isin("text", "markdown", "file")
    long = [t for t in of.expanded if len(t) >= 5]
    begins = F.lit(False)
    for t in long:
        begins = begins | (F.startswith(name, F.lit(t)) & (F.lit(len(t)) / F.greatest(F.char_length(name), F.lit(1)) >= 0.55))
    named = name.isin(long) if long else F.lit(False)
    wanted = name.isin([t for t in of.expanded if t in VERBS] or [""]) | (F.size(matched(F.col("path"), of.endpoint_terms)) > 0)
    handler = named_kind & F.lit(of.code_intent) & F.lower("path").rlike(r"(^|/)route\.[cm]?[jt]sx?$") & name.isin(VERBS) & wanted
    score = F.when(named_kind & F.contains(F.lower("text"), F.lit(of.normalized)), 3.0).otherwise(0.0) + F.when(name == of.normalized, 28.0).otherwise(0.0)
    return score + F.when(named, 20.0).when(begins, 10.0).otherwise(0.0) + F.when(handler, 20.0).otherwise(0.0)


def penalties(path: Column, of: Plan) -> Column:
    """What tests lose where code is looked for, and texts about code where the query names a kind of code."""
    low, base = F.lower(path), F.lower(basename(path))
    folders = F.slice(F.split(low, "/"), 1, F.size(F.split(low, "/")) - 1)
    names = F.slice(F.split(base, r"\."), 1, F.size(F.split(base, r"\.")) - 1)
    test = F.arrays_overlap(folders, literals(["test", "tests", "__tests__"])) | F.exists(names, lambda x: F.element_at(F.split(x, "[_-]"), -1) == "test")
    prose = extension(path).isin(PROSE) | F.element_at(F.split(base, r"\."), 1).isin(PROSE_STEMS)
    sought = "implementation" in of.intents and "tests" not in of.intents
    return F.when(test, 8.0 if sought else 3.0 if of.code_intent else 0.0).otherwise(0.0) + F.when(prose, 6.0 if of.code_intent else 0.0).otherwise(0.0)


def match_snippet(text: Column, of: Plan) -> Column:
    """The first line that holds the query, a phrase or a term, with two lines before and behind it; the whole text where none does."""
    lines = F.split(text, r"\r?\n")
    needles = [x.lower() for x in dict.fromkeys([of.normalized, *of.phrases, *of.expanded]) if len(x) > 1]
    holds = F.transform(lines, lambda x: F.exists(literals(needles), lambda n: F.contains(F.lower(x), n))) if needles else F.array(F.lit(False))
    at = F.array_position(holds, F.lit(True)).cast("int")
    begin = F.greatest(at - 2, F.lit(1))
    return snippet(F.when(at > 0, F.array_join(F.slice(lines, begin, F.greatest(at + 3 - begin, F.lit(0))), "\n")).otherwise(text))


def clamped(limit: int) -> int:
    return min(max(limit, 1), MOST)


def noise(path: Column, kinds: Column, of: Plan) -> Column:
    """What lockfiles, generated and built files, large data, archives and agents' files lose, less or nothing where the query names them."""
    said = " ".join([of.normalized, *of.expanded])
    named = lambda pattern: bool(regex.search(pattern, said))
    has = lambda *names: F.arrays_overlap(kinds, literals(list(names)))
    lock = 0 if named(r"\blockfile\b|\b(package-lock|npm-shrinkwrap)\.json\b|\bpnpm-lock\.ya?ml\b|\byarn\.lock\b|\b\S+\.lock\b") else 60
    generated = 8 if of.path_like and named(r"\b(generated|__generated__)\b") else 60
    built = 12 if of.path_like and named(r"(^|[/\\])(dist|build|vendor)([/\\]|$)|\.min\.[cm]?js\b") else 48
    data = 12 if named(r"\.json\b|\blarge json\b") else 36
    agents = "agent_instructions" in of.intents
    local = of.path_like or agents or "configuration" in of.intents
    archive = regex.search(r"\barchive[ds]?\b", of.normalized)
    rules = [(has("agent_instructions"), 0 if agents else 18), (has("local_agent_settings"), 0 if local else 18), (has("lockfile"), lock), (has("generated"), generated), (has("build_output", "minified"), built), (has("large_json"), data), (has("archived_documentation"), 0 if archive else 14)]
    return sum((F.when(rule, float(n)).otherwise(0.0) for rule, n in rules), F.lit(0.0))


def scored_candidates(tables: Tables | DataFrame, query: str, limit: int = 10, prefix: str = "") -> DataFrame:
    """Every candidate with its source, score and the score's components, over a search's tables or files."""
    tables = tables if isinstance(tables, Tables) else Tables.of_files(tables)
    of, limit = plan(query), clamped(limit)
    clean = normalize_prefix(prefix)
    found = by_path(tables, of, limit, clean).unionByName(by_terms(tables, of, hits(tables, of, clean, max(2 * limit, SCAN))))
    found = found.join(tables.read("files", None).select("path", "size"), "path")
    low, base = F.lower("path"), F.lower(basename(F.col("path")))
    q = F.lit(of.normalized)
    depth = F.size(F.split("path", "/")) - 1
    kinds = roles(F.col("path"), F.col("size"))
    lost = noise(F.col("path"), kinds, of)
    both = lambda role: F.array_contains(kinds, role) & F.lit(role in of.intents)
    wanted = F.arrays_overlap(kinds, literals(of.intents)) if of.intents else F.lit(False)
    docs_wanted = bool({"overview", "documentation", "decision_record", "agent_instructions"} & set(of.intents))
    lift = (lost == 0) & F.lit(of.code_intent or not docs_wanted)
    module = F.lower(stem(F.col("path"))).isin([t for t in of.core if len(t) > 1] or [""])
    parts = {
        "path_score": F.when(F.contains(low, q), 6.0).otherwise(0.0) + F.when(F.endswith(low, q), 3.0).otherwise(0.0) + 5 * coverage(F.col("path"), of.core),
        "name_score": 4 * coverage(base, of.core) + F.when(base == q, F.greatest(F.lit(1), 4 - depth)).otherwise(0) + F.when(module, 8.0).otherwise(0.0),
        "text_score": F.when(F.contains(F.lower("text"), q), 4.0).otherwise(0.0) + 3 * coverage(F.col("text"), of.core),
        "role_score": F.when(both("main"), 24.0).when(both("setup"), 22.0).when(wanted, 15.0).otherwise(0.0) + F.when(lift & extension(F.col("path")).isin(CODE), 2.0).otherwise(0.0) + F.when(lift & low.rlike("(^|/)src/"), 4.0).otherwise(0.0),
        "noise": lost,
        "penalty": penalties(F.col("path"), of),
        "fts": F.when(F.col("rank") > 0, 10 + F.least(F.lit(5.0), F.col("rank") * 1e6)).otherwise(0.0),
        "snippet": match_snippet(F.col("text"), of),
        "symbol_score": symbol_score(of),
        "matched": matched(F.concat_ws("\n", "path", "text", "symbol"), of.core),
    }
    scored = found.withColumns(parts).withColumn("coverage", F.size("matched") / F.lit(float(max(1, len(of.core)))))
    # A symbol that only its signature speaks for earns what it has over a chunk by its share of the terms.
    weak = F.col("symbol").isNotNull() & (F.col("symbol_score") == 0) & ~module
    scored = scored.withColumn("boost", F.when(weak, F.greatest(F.lit(0.0), F.col("boost") - 3 * (1 - F.col("coverage")))).otherwise(F.col("boost")))
    total = sum((F.col(c) for c in ("fts", "path_score", "name_score", "text_score", "symbol_score", "role_score")), F.col("boost")) - F.col("noise") - F.col("penalty")
    scored = saved(scored.withColumn("score", F.round(total, 6)).drop("text", "size", "rank"), "search")
    taken = budgets(scored, len(of.tiers), limit).withColumn("in_text", F.col("source") == "chunk_fts")
    return with_file_coverage(taken, of, limit).drop("tier", "nth")


def with_file_coverage(scored: DataFrame, of: Plan, limit: int) -> DataFrame:
    """The candidates, those by their text raised for terms that other candidates of their file have, unless the file is among the best anyway."""
    if not of.core:
        return scored.withColumn("file_score", F.lit(0.0)).drop("matched", "in_text")
    of_file = scored.groupBy("path").agg(F.size(F.array_distinct(F.flatten(F.collect_list("matched")))).alias("all"))
    seen = best_of(scored, limit).select("path", F.lit(True).alias("seen"))  # at most MOST rows
    more = F.when(F.col("in_text") & F.col("seen").isNull(), 3 * (F.col("all") - F.size("matched")) / F.lit(float(len(of.core)))).otherwise(0.0)
    rows = scored.join(of_file, "path").join(F.broadcast(seen), "path", "left").withColumn("file_score", more)
    return rows.withColumn("score", F.round(F.col("score") + F.col("file_score"), 6)).drop("matched", "in_text", "all", "seen")


def best_of(scored: DataFrame, limit: int) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("score"), "ordinal"))
    one = scored.where("score > 0").withColumn("nth", first).where("nth = 1").drop("nth")
    return one.orderBy(F.desc("score"), "path", "start_line").limit(clamped(limit))


def search(tables: Tables | DataFrame, query: str, limit: int = 10, prefix: str = "") -> DataFrame:
    """path, ordinal, source, score and its components, snippet, best first; one candidate a path, at most MOST."""
    return best_of(scored_candidates(tables, query, limit, prefix), limit)


def package(index: StoredIndex, query: str, limit: int = 10, prefix: str = "", head: str | None = None) -> dict:
    """A search of a stored index with the index's state: what a caller needs to trust the results."""
    found = search(Tables.of_index(index), query, limit, prefix)
    state = index.status(prefix, head)
    results = found.collect()  # at most MOST rows
    sure = confidence(found.sparkSession.createDataFrame([(r["path"], r["score"]) for r in results], "path string, score double")).first()
    return {"query": query, "path_prefix": normalize_prefix(prefix), "last_indexed_at": state["last_indexed_at"], "stale": state["stale"], "warnings": state["warnings"], "results": results, "confidence": (sure["level"], sure["margin"])}


def confidence(results: DataFrame, least: float = 0.1) -> DataFrame:
    """One row (level, margin): how far the best of a search's results (path, score) is ahead of the next."""
    two = results.select("path", "score").orderBy(F.desc("score"), "path").limit(2)
    scores = two.agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("high"), F.min("score").alias("low"))
    ahead = F.when(F.col("high") > 0, (F.col("high") - F.col("low")) / F.col("high")).otherwise(0.0)
    margin = F.when(F.col("n") == 0, 0.0).when(F.col("n") == 1, 1.0).otherwise(ahead)
    level = F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "single").when(margin >= least, "high").otherwise("low")
    return scores.select(level.alias("level"), margin.alias("margin"))


def debug(tables: Tables | DataFrame, query: str, limit: int = 10, prefix: str = "") -> DataFrame:
    """Every candidate with its components, a decision and, where it was selected, its rank."""
    scored = scored_candidates(tables, query, limit, prefix)
    order = Window.orderBy(F.desc("score"), "path", "start_line")  # over at most MOST rows
    top = best_of(scored, limit).select("path", F.row_number().over(order).cast("long").alias("rank"))
    first = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("score"), "ordinal", "source"))
    out = scored.withColumn("first", first).join(F.broadcast(top), "path", "left").withColumn("rank", F.when(F.col("first") == 1, F.col("rank")))
    why = F.when(F.col("rank").isNotNull(), "selected").when(F.col("score") <= 0, "non_positive_score").when(F.col("first") > 1, "deduped_lower_score").otherwise("outside_limit")
    return out.withColumn("decision", why).drop("first")


def documents_index(spark: SparkSession, sf_dir: str) -> StoredIndex:
    """The stored index of the documents table, made where it isn't there or the table's files have changed since."""
    docs = table(spark, sf_dir, "documents")
    hadoop, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    seen = []
    for name in sorted(docs.inputFiles()):
        at = jvm.org.apache.hadoop.fs.Path(name)
        state = at.getFileSystem(hadoop).getFileStatus(at)
        seen.append(f"{name} {state.getLen()} {state.getModificationTime()}")
    head = hashlib.sha256("\n".join(seen).encode()).hexdigest()
    index = StoredIndex(spark, f"{shared_dir(spark)}/documents-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}")
    if index.status(head=head)["stale"] or not index.versions():
        try:
            index.update(_state(documents_as_files(docs)), head=head)
        except Conflict:  # another session has just made it
            pass
    return index


def q_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' index in figures: made once, then only looked at."""
    state = documents_index(spark, sf_dir).status()
    return spark.createDataFrame([(state["files"], state["chunks"], state["symbols"])], "files long, chunks long, symbols long")


def q_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best files for the first passage, from the documents' stored index; a plan keeps a query's first terms, as for any query."""
    first = table(spark, sf_dir, "benchmark").orderBy("item_id").first()["text"]
    return search(Tables.of_index(documents_index(spark, sf_dir)), first)


QUERIES = {"hlt01_index": q_index, "search": q_search}
SQL = {"hlt01_index": "select count(*) as files, sum(len(range(0, greatest(len(regexp_split_to_array(text, '\\r?\\n')) - 11, 0) + 1, 70)))::bigint as chunks, 0::bigint as symbols from documents"}
