"""What to read with a file: for all targets at once, one ranked merge of twenty capped lists of related files.

Lists that go by names and folders need each target's nearest few among the files of its key. Of files of one
key below one folder and at one depth, only the first by path can be among a target's nearest, whatever the target: so
those are kept for each folder above a file, and a target meets the ones of the folders above it. No target meets
all files, and no folder or name that many files share makes pairs of them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navspark.functions.paths import normalize_prefix, roles, snippet, under
from navspark.operators.search import ROUTE, Tables, search
from navspark.operators.structure import counterparts, locality, route_pairs
from navspark.sources.scratch import saved

#: Items of a list, chunks of a target, limits of the result; roles that are never read first.
MOST, CHUNKS, LEAST_LIMIT, MOST_LIMIT = 8, 6, 1, 25
NOISE = ["lockfile", "generated", "build_output", "minified", "large_json"]
#: Letters of a name by which it is looked for in others.
GRAM = 6


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def above(path: Column) -> Column:
    """The folders above a path, the root's name being empty."""
    parts = F.filter(F.split(folder_of(path), "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def bare(path: Column) -> Column:
    """The base name without its last extension, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"\.[^.]+$", ""))


def is_test(path: Column) -> Column:
    low = F.lower(path)
    return low.rlike(r"(^|/)(__tests__|tests?|spec)(/|$)") | F.regexp_extract(low, "([^/]*)$", 1).rlike(r"(^|[._-])(test|spec)([._-]|$)")


def is_config(path: Column, size: Column) -> Column:
    """By role, extension or name."""
    base = F.regexp_extract(F.lower(path), "([^/]*)$", 1)
    named = base.rlike(r"\.(json|ya?ml|toml|ini|env)$") & ~F.array_contains(roles(path, size), "lockfile")
    return named | base.isin("requirements.txt", "go.mod") | base.rlike(r"(^|[._-])config([._-]|$)")


def is_noise(path: Column, size: Column) -> Column:
    return F.arrays_overlap(roles(path, size), F.array(*map(F.lit, NOISE)))


def judged(files: DataFrame) -> DataFrame:
    """path, folder, stem and what a file is: test, config, prose, noise."""
    path, size = F.col("path"), F.coalesce(F.col("size"), F.lit(0))
    prose = F.lower(path).rlike(r"\.mdx?$")
    return files.select("path", folder_of(path).alias("folder"), bare(path).alias("stem"), is_test(path).alias("test"), is_config(path, size).alias("config"), prose.alias("prose"), is_noise(path, size).alias("noise"))


def nearest(targets: DataFrame, items: DataFrame, most: int = MOST) -> DataFrame:
    """target, path, pos (from 0): of the items (key, path) with the key of a target (target, key), the nearest by locality, then path."""
    path, target = F.col("path"), F.col("target")
    spread = items.select("key", "path", (F.size(above(path)) - 1).alias("depth"), F.explode(above(path)).alias("above"))
    first = F.row_number().over(Window.partitionBy("key", "above", "depth").orderBy("path"))
    kept = spread.withColumn("nth", first).where(F.col("nth") <= most + 1).select("key", "above", "path")  # one may be the target itself
    met = targets.select("target", "key", F.explode(above(target)).alias("above")).join(kept, ["key", "above"]).where(path != target).select("target", "path").distinct()
    order = F.row_number().over(Window.partitionBy("target").orderBy(F.desc(locality(target, path)), "path"))
    return met.withColumn("pos", order - 1).where(F.col("pos") < most)


def holding(stems: DataFrame, items: DataFrame, text: Column) -> DataFrame:
    """key (a stem), path: the items whose text (a column) holds a stem (stem); met by the stem's first letters, then compared whole."""
    low = F.lower(text)
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(low), F.lit(1)))
    grams = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(0), F.lit(GRAM)), lambda n: F.substr(low, i, n)))))
    spread = items.select("path", low.alias("low"), F.explode(grams).alias("gram"))
    asked = stems.select("stem").distinct().withColumn("gram", F.substring("stem", 1, GRAM))
    return asked.join(spread, "gram").where(F.contains("low", F.col("stem"))).select(F.col("stem").alias("key"), "path").distinct()


def related_tests(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """target, path, pos: the nearest tests whose path holds the name of a target (target)."""
    named = targets.select("target", bare(F.col("target")).alias("key"))
    tests = facts.where("test and not noise").where(F.lower("path").rlike("test|spec"))
    return nearest(named, holding(named.select(F.col("key").alias("stem")), tests, F.col("path")))


def related_docs(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """The nearest texts about a target by name, or else the nearest readme files."""
    prose = facts.where("prose and not noise")
    named = targets.select("target", bare(F.col("target")).alias("key"))
    # Whether there is a text by name is asked of all of them, noise and the target too.
    by_name = holding(named.select(F.col("key").alias("stem")), facts.where("prose"), F.col("path"))
    none = named.join(by_name.select("key").distinct(), "key", "left_anti")
    readme = prose.where(F.lower("path").rlike(r"(^|/)readme\.md$"))
    return nearest(named, by_name.join(prose.select("path"), "path", "left_semi")).unionByName(nearest(none.select("target", F.lit("").alias("key")), readme.select(F.lit("").alias("key"), "path")))


def near_configs(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """The nearest configuration files of a target's folder or name, and of containers."""
    configs = facts.where("config and not noise")
    base = F.regexp_extract(F.lower("path"), "([^/]*)$", 1)
    named = targets.select("target", bare(F.col("target")).alias("key"))
    parts = [
        nearest(targets.select("target", folder_of(F.col("target")).alias("key")), configs.select(F.col("folder").alias("key"), "path")),
        nearest(named, holding(named.select(F.col("key").alias("stem")), configs, base)),
        nearest(targets.select("target", F.lit("").alias("key")), configs.where(base.rlike(r"^docker-compose([.-].*)?\.ya?ml$")).select(F.lit("").alias("key"), "path")),
    ]
    met = parts[0].unionByName(parts[1]).unionByName(parts[2]).select("target", "path").distinct()
    return ranked(met)


def ranked(pairs: DataFrame, most: int = MOST) -> DataFrame:
    """target, path, pos of pairs (target, path): the nearest first."""
    order = F.row_number().over(Window.partitionBy("target").orderBy(F.desc(locality(F.col("target"), F.col("path"))), "path"))
    return pairs.withColumn("pos", order - 1).where(F.col("pos") < most)


def akin(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """The nearest sources of a target's folder one of whose names begins with the other's, up to a sign."""
    begins = lambda stem: F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(stem), F.lit(1))), lambda i: F.when(F.substr(stem, i, F.lit(1)).isin(".", "-", "_"), F.substr(stem, F.lit(1), i - 1))), lambda s: s.isNotNull())
    sources = facts.where("not (noise or config or test or prose)")
    mine = targets.select("target", folder_of(F.col("target")).alias("folder"), bare(F.col("target")).alias("stem"))
    longer = mine.join(sources.select("folder", "path", F.explode(begins(F.col("stem"))).alias("stem")), ["folder", "stem"])
    shorter = mine.select("target", "folder", F.explode(begins(F.col("stem"))).alias("stem")).join(sources.select("folder", "path", "stem"), ["folder", "stem"])
    return ranked(longer.select("target", "path").unionByName(shorter.select("target", "path")).where("path <> target").distinct())


def tested_by(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """The sources that a test's name names, in its folder."""
    plain = F.regexp_replace(bare(F.col("target")), r"([._-](test|spec)|(test|spec)[._-])$", "")
    tests = targets.where(is_test(F.col("target"))).select("target", folder_of(F.col("target")).alias("folder"), plain.alias("stem"))
    sources = facts.where("not (noise or config or test or prose)").select("folder", "stem", "path")
    return ranked(tests.join(sources, ["folder", "stem"]).where("path <> target").select("target", "path").distinct())


def dependencies(facts: DataFrame, edges: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """target, path, pos, reasons: what targets import, by line, and what imports them, the nearest first."""
    quiet = facts.where("not noise").select("path")
    word = lambda back: F.when(F.col("kind").isin("include", "includes"), f"{back}include").otherwise(f"{back}import")
    out = edges.join(targets, edges["src"] == targets["target"]).select("target", F.col("dst").alias("path"), "line", "specifier", word("").alias("reason"))
    out = out.join(quiet, "path", "left_semi").where("path <> target")
    of_test = F.when(is_test(F.col("target")) & ~is_test(F.col("path")), F.array(F.lit("test_of"))).otherwise(F.array().cast("array<string>"))
    out = out.groupBy("target", "path").agg(F.min(F.struct(F.col("line").isNull(), "line", "path", "specifier")).alias("at"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    nth = F.row_number().over(Window.partitionBy("target").orderBy("at"))
    imports = out.withColumn("pos", nth - 1).where(F.col("pos") < MOST).select("target", "path", "pos", F.concat("reasons", of_test).alias("reasons"))
    back = edges.join(targets, edges["dst"] == targets["target"]).select("target", F.col("src").alias("path"), word("reverse_").alias("reason"))
    back = back.join(quiet, "path", "left_semi").where("path <> target").groupBy("target", "path").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    by_test = F.when(is_test(F.col("path")) & ~is_test(F.col("target")), F.array(F.lit("reverse_test"))).otherwise(F.array().cast("array<string>"))
    importers = ranked(back).select("target", "path", "pos", F.concat("reasons", by_test).alias("reasons"))
    return imports, importers


def neighbour_tests(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """target, path, pos 0: the first test of the first two of a target's related files (target, path, pos) that has one."""
    two = pairs.where("pos < 2").select("target", F.col("path").alias("beside"), "pos")
    tests = related_tests(facts, two.select(F.col("beside").alias("target")).distinct()).where("pos = 0").select(F.col("target").alias("beside"), "path")
    first = two.join(tests, "beside").groupBy("target").agg(F.min(F.struct("pos", "path")).alias("one"))
    return first.select("target", F.col("one.path").alias("path"), F.lit(0).alias("pos"))


def related(files: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """target, path, rank (from 0), weak, reasons: the files to read with each target (target), each once, by the first list that names it.

    files: path, size, ...; edges: src, dst, kind, specifier, line. The target itself isn't among them; weak ones
    only have a name like the target's.
    """
    # What several lists go back to is written once.
    facts = saved(judged(files), "context")
    targets = targets.select("target").distinct()
    imports, importers = (saved(x, "context") for x in dependencies(facts, edges, targets))
    pairs = counterparts(files).unionByName(route_pairs(files)).select(F.col("src").alias("target"), F.col("dst").alias("path")).distinct()
    pairs = saved(ranked(pairs.join(targets, "target", "left_semi").join(facts.where("not noise").select("path"), "path", "left_semi")), "context")
    plain = lambda rows: rows.where(~is_test(F.col("path"))).withColumn("pos", F.row_number().over(Window.partitionBy("target").orderBy("pos")) - 1)
    stem, other = bare(F.col("target")), bare(F.col("path"))
    like = F.lit(False)
    for sign in ".-_":
        like = like | F.startswith(other, F.concat(stem, F.lit(sign))) | F.startswith(stem, F.concat(other, F.lit(sign)))
    kind = F.when(F.lower("path").rlike(ROUTE + r"[cm]?[jt]sx?$"), "route").when(like & (stem != other), "akin").otherwise("other")
    sorted_importers = importers.withColumn("class", kind).withColumn("pos", F.row_number().over(Window.partitionBy("target", "class").orderBy("pos")) - 1)
    of = lambda name: sorted_importers.where(F.col("class") == name).drop("class")
    tests, docs, configs, sources = related_tests(facts, targets), related_docs(facts, targets), near_configs(facts, targets), tested_by(facts, targets)
    # Each list with the reason it gives, and its places in the order: of its first rows (as many as the last number says) and of the rest.
    lists = [
        (of("route"), None, 0, 13, 1),
        (imports, None, 1, 12, 2),
        (pairs, "implementation_pair", 2, 2, MOST),
        (neighbour_tests(facts, plain(pairs)), "sibling_test", 3, 3, 1),
        (tests, "sibling_test", 4, 18, 1),
        (of("akin"), None, 5, 14, 1),
        (neighbour_tests(facts, imports), "sibling_test", 6, 6, 1),
        (neighbour_tests(facts, plain(importers)), "sibling_test", 7, 7, 1),
        (of("other"), None, 8, 15, 1),
        (sources, "test_of", 9, 16, 1),
        (configs, "near_config", 10, 17, 1),
        (docs, "related_doc", 11, 19, 1),
        (akin(facts, targets), "same_dir", 20, 20, MOST),
    ]
    rows = None
    for part, reason, first, rest, most in lists:
        given = F.col("reasons") if reason is None else F.array(F.lit(reason))
        part = part.select("target", "path", F.struct(F.when(F.col("pos") < most, first).otherwise(rest).alias("list"), F.col("pos").alias("pos")).alias("at"), given.alias("reasons"))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.where("path <> target").groupBy("target", "path").agg(F.min("at").alias("at"), F.sort_array(F.collect_list(F.struct("at", "reasons"))).alias("all"))
    # What also has a stronger list doesn't name the weak one.
    strong = F.filter("all", lambda x: (x["at"]["list"] < 20) | (F.col("at.list") == 20))
    reasons = F.array_distinct(F.flatten(F.transform(strong, lambda x: x["reasons"])))
    nth = F.row_number().over(Window.partitionBy("target").orderBy("at"))
    return rows.select("target", "path", (nth - 1).alias("rank"), (F.col("at.list") == 20).alias("weak"), reasons.alias("reasons"))


def read_first(files: DataFrame, chunks: DataFrame, edges: DataFrame, targets: DataFrame, limit: int = MOST) -> DataFrame:
    """target, rank (from 1), path, start_line, end_line, kind, snippet, reasons: the first chunk of each target, the first chunks
    of its related files, and the target's next chunks, ``limit`` in all. A target that isn't among the files has no rows."""
    limit = min(max(limit, LEAST_LIMIT), MOST_LIMIT)
    targets = targets.select("target").distinct().join(files.select(F.col("path").alias("target")), "target", "left_semi")
    heads = chunks.where("ordinal = 0").select("path", "ordinal", "start_line", "end_line", "kind", "text")
    beside = related(files, edges, targets).where(F.col("rank") < limit + MOST).join(heads, "path")
    beside = beside.select("target", "path", F.lit(1).alias("part"), "rank", "start_line", "end_line", "kind", "text", "reasons")
    own = chunks.join(targets, chunks["path"] == targets["target"]).where(F.col("ordinal") < min(limit, CHUNKS))
    own = own.select("target", "path", F.when(F.col("ordinal") == 0, 0).otherwise(2).alias("part"), F.col("ordinal").cast("int").alias("rank"), "start_line", "end_line", "kind", "text", F.array(F.lit("target")).alias("reasons"))
    nth = F.row_number().over(Window.partitionBy("target").orderBy("part", "rank"))
    rows = own.unionByName(beside).withColumn("rank", nth.cast("long")).where(F.col("rank") <= limit)
    return rows.select("target", "rank", "path", "start_line", "end_line", "kind", snippet(F.col("text")).alias("snippet"), "reasons")


def neighbourhood(files: DataFrame, edges: DataFrame, targets: DataFrame, limit: int = MOST) -> DataFrame:
    """target, group, rank (from 1), path, specifiers: five groups of each target's neighbours, at most ``limit`` in each, without noise.

    What a target imports or includes comes by line; what imports or includes it by path; its counterparts by locality.
    """
    limit = min(max(limit, LEAST_LIMIT), MOST_LIMIT)
    quiet = judged(files).where("not noise").select("path")
    targets = targets.select("target").distinct()
    plural = F.when(F.col("kind").isin("include", "includes"), "includes").otherwise("imports")
    line = F.coalesce(F.col("line").cast("long"), F.lit(2147483647)).alias("line")
    specifier = F.coalesce("specifier", F.lit("")).alias("specifier")
    out = edges.join(targets, edges["src"] == targets["target"]).select("target", plural.alias("group"), F.col("dst").alias("path"), F.struct(line, F.col("dst").alias("path"), specifier).alias("at"), "specifier")
    back = edges.join(targets, edges["dst"] == targets["target"]).select("target", F.concat(F.lit("reverse_"), plural).alias("group"), F.col("src").alias("path"), F.struct(F.lit(0).cast("long").alias("line"), F.col("src").alias("path"), F.lit("").alias("specifier")).alias("at"), F.col("specifier"))
    rows = out.unionByName(back).where("path <> target").groupBy("target", "group", "path").agg(F.min("at").alias("at"), F.array_sort(F.collect_set("specifier")).alias("specifiers"))
    pairs = counterparts(files).unionByName(route_pairs(files)).select(F.col("src").alias("target"), F.col("dst").alias("path")).distinct().join(targets, "target", "left_semi")
    near = F.struct((-locality(F.col("target"), F.col("path"))).alias("line"), "path", F.lit("").alias("specifier"))
    rows = rows.unionByName(pairs.select("target", F.lit("implementation_pair").alias("group"), "path", near.alias("at"), F.array().cast("array<string>").alias("specifiers")))
    nth = F.row_number().over(Window.partitionBy("target", "group").orderBy("at"))
    rows = rows.join(quiet, "path", "left_semi").withColumn("rank", nth.cast("long")).where(F.col("rank") <= limit)
    return rows.select("target", "group", "rank", "path", "specifiers")


def resolved_target(files: DataFrame, target: str, prefix: str = "") -> tuple[str | None, list[str]]:
    """The file that a target means, exactly or else the shortest path that holds it, and warnings about it."""
    wanted = target.strip()
    rows = files.where(under(F.col("path"), prefix)).where((F.col("path") == wanted) | F.contains(F.lower("path"), F.lit(wanted.lower())))
    found = [r["path"] for r in rows.orderBy(F.desc(F.col("path") == wanted), F.length("path"), "path").select("path").limit(6).collect()]
    if not found:
        return None, ["Target was not an indexed file path; falling back to search results."]
    if len(found) == 1:
        return found[0], []
    count = "6 or more" if len(found) >= 6 else str(len(found))
    more = ", …" if len(found) > 4 else ""
    return found[0], [f'Ambiguous target "{wanted}" matched {count} indexed files; using {found[0]}. Other matches: {", ".join(found[1:4])}{more}']


def context(tables: Tables, target: str, limit: int = MOST, prefix: str = "") -> tuple[DataFrame, list[str]]:
    """What to read first for one target, as ``read_first`` has it, and warnings; results of a search where no path is meant."""
    limit, clean = min(max(limit, LEAST_LIMIT), MOST_LIMIT), normalize_prefix(prefix)
    files = tables.read("files", None).where(under(F.col("path"), clean))
    path, warnings = resolved_target(files, target, clean)
    if path is None:
        order = F.row_number().over(Window.orderBy(F.desc("score"), "path", "start_line"))  # over at most ``limit`` rows
        rows = search(tables, target, limit, prefix)
        return rows.select(F.lit(target.strip()).alias("target"), order.cast("long").alias("rank"), "path", "start_line", "end_line", "kind", "snippet", F.array(F.lit("search_result")).alias("reasons")), warnings
    inside = lambda rows, *cs: rows.where(under(F.col(cs[0]), clean) & under(F.col(cs[-1]), clean))
    one = files.sparkSession.createDataFrame([(path,)], "target string")
    return read_first(files, inside(tables.read("chunks", None), "path"), inside(tables.read("edges", None), "src", "dst"), one, limit), warnings
