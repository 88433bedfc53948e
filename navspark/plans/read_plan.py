"""What to read for a task: ranked search hits and ranked context merged into one list, for many tasks at once.

Each path goes to the first bucket that takes it; a list is ordered by bucket and then by rank. Search hits
(case, path, rank) and context (case, path, rank, reasons array<struct<kind, target>>) meet in one join, and
what depends on a task's other paths comes from windows over its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets in order, for tasks whose first hit isn't a route adapter, and for those where it is.
BUCKETS = ["first_search", "visible_search_pair", "uncovered_visible_test", "prioritized_config", "prioritized_test", "context_backed_search", "direct_import", "active_search", "remaining_context", "archived_search"]
ROUTE_BUCKETS = ["first_search", "visible_search_pair", "uncovered_visible_test", "route_direct_import", "route_direct_import_test", "prioritized_test", "context_backed_search", "active_search", "prioritized_config", "remaining_context", "archived_search"]
#: Reasons that back a search hit, and path words that say nothing.
BACKING = ["reverse_import", "reverse_test", "sibling_test", "test_of", "related_doc", "near_config"]
NOISE = ["app", "api", "src", "lib", "route", "test", "tests", "web"]


def is_test(path: Column) -> Column:
    return path.rlike(r"(?i)(^|/)(__tests__|tests?|specs?)(/|$)|\.(test|spec)\.")


def stem(path: Column) -> Column:
    """Base name in lower case without its last extension and a test mark before it."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(path, r"([^/]*)$", 1)), r"\.(test|spec)(?=\.)", ""), r"\.[^.]+$", "")


def path_terms(path: Column) -> Column:
    words = F.array_distinct(F.split(F.lower(path), "[^a-z0-9]+"))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(NOISE))


def explain(search: DataFrame, context: DataFrame, limit: int) -> DataFrame:
    """case, path, bucket, rank, selected, search_rank, context_rank, reasons of every path; the first ``limit`` of a case are selected."""
    hits = search.where("path <> ''").groupBy("case", "path").agg(F.min("rank").alias("search_rank"))
    near = context.where("path <> ''").groupBy("case", "path").agg(F.min("rank").alias("context_rank"), F.max_by("reasons", "rank").alias("reasons"))
    task = Window.partitionBy("case")
    kinds, targets = F.transform("reasons", lambda r: r["kind"]), F.filter("reasons", lambda r: r["kind"] == "sibling_test")
    has = lambda *k: F.coalesce(F.arrays_overlap("kinds", F.array(*map(F.lit, k))), F.lit(False))
    rows = hits.join(near, ["case", "path"], "full_outer").withColumn("kinds", kinds)
    rows = rows.withColumns({
        "siblings": F.transform(targets, lambda r: r["target"]),
        "backed": has(*BACKING),
        "test": is_test(F.col("path")),
        "stem": stem(F.col("path")),
        "first": F.coalesce(F.col("search_rank") == F.min("search_rank").over(task), F.lit(False)),
        "searched": F.collect_set(F.when(F.col("search_rank").isNotNull(), F.col("path"))).over(task),
    })
    rows = rows.withColumn("later", F.col("search_rank").isNotNull() & ~F.col("first"))
    rows = rows.withColumn("opening", F.max(F.when(F.col("first"), F.col("path"))).over(task))
    family = Window.partitionBy("case", "stem")
    seen = lambda c: F.count_if(F.col("later") & c).over(family)
    alone = F.col("later") & ~F.col("backed")
    other = F.when(F.col("test"), seen(~F.col("backed") & ~F.col("test"))).otherwise(seen(~F.col("backed") & F.col("test")))
    fresh = F.col("context_rank").isNotNull() & F.col("search_rank").isNull()
    related = has("reverse_test", "test_of") | F.coalesce(F.arrays_overlap("siblings", "searched"), F.lit(False))
    rows = rows.withColumns({
        "route": F.coalesce(F.col("opening").rlike(r"(?i)(^|/)app/api/.+/route\.[cm]?[jt]sx?$"), F.lit(False)),
        "pair": alone & (other > 0),
        "lone_test": alone & F.col("test") & (seen(~F.col("test")) == 0),
        "config": fresh & has("near_config") & F.col("path").rlike(r"(^|/)docker-compose([.-][^/]*)?\.ya?ml$"),
        "related": fresh & related,
        "archived": F.col("path").rlike(r"(?i)(^|/)docs/archive/"),
        "affinity": F.size(F.array_intersect(path_terms(F.col("path")), path_terms(F.coalesce("opening", F.lit(""))))),
    })
    crowded = F.col("config") | F.col("related") | has("related_doc", "near_config") | (F.col("later") & F.col("path").rlike(r"(?i)\.(md|mdx|rst|txt)$"))
    imports = F.col("context_rank").isNotNull() & has("import") & (F.col("route") | F.col("search_rank").isNull())
    rows = rows.withColumns({"imports": imports, "crowded": F.max(crowded).over(task)})
    # The one import that is promoted: of a route the most akin, else the first, unless something competes.
    order = F.struct(F.when(F.col("route"), -F.col("affinity")).otherwise(F.col("context_rank")).alias("a"), F.col("path").alias("p"))
    chosen = F.min(F.when(F.col("imports") & (F.col("route") | ~F.col("crowded")), order)).over(task)["p"]
    rows = rows.withColumn("chosen", chosen)
    promoted = F.coalesce(F.col("path") == F.col("chosen"), F.lit(False))
    import_test = fresh & ~promoted & F.col("route") & F.col("chosen").isNotNull() & (F.col("related") | F.coalesce(F.array_contains("siblings", F.col("chosen")), F.lit(False)))
    rows = rows.withColumns({"promoted": promoted, "import_test": import_test})
    rows = rows.withColumn("first_test", F.coalesce(F.col("import_test") & (F.col("context_rank") == F.min(F.when(F.col("import_test"), F.col("context_rank"))).over(task)), F.lit(False)))
    takes = {
        "first_search": F.col("first"),
        "visible_search_pair": F.col("pair"),
        "uncovered_visible_test": F.col("lone_test"),
        "route_direct_import": F.col("promoted"),
        "route_direct_import_test": F.col("first_test"),
        "prioritized_config": F.col("config"),
        "prioritized_test": F.col("related"),
        "context_backed_search": F.col("later") & F.col("backed"),
        "direct_import": F.col("promoted"),
        "active_search": alone & ~F.col("archived"),
        "remaining_context": F.col("context_rank").isNotNull() & ~F.col("config") & ~F.col("related") & ~F.col("promoted") & ~F.col("first_test"),
        "archived_search": alone & F.col("archived"),
    }
    place = lambda names: F.coalesce(*[F.when(takes[b], F.struct(F.lit(i).alias("at"), F.lit(b).alias("bucket"))) for i, b in enumerate(names)])
    rows = rows.withColumn("place", F.when(F.col("route"), place(ROUTE_BUCKETS)).otherwise(place(BUCKETS)))
    by_context = F.col("place.bucket").isin("route_direct_import", "route_direct_import_test", "prioritized_config", "prioritized_test", "direct_import", "remaining_context")
    within = F.when(by_context, F.col("context_rank")).otherwise(F.col("search_rank"))
    rank = F.row_number().over(task.orderBy("place.at", within, "path")).cast("long")
    rows = rows.where("place is not null").withColumn("rank", rank)
    return rows.select("case", "path", "place.bucket", "rank", (F.col("rank") <= max(limit, 0)).alias("selected"), "search_rank", "context_rank", F.col("kinds").alias("reasons"))


def merged(search: DataFrame, context: DataFrame, limit: int) -> DataFrame:
    """case, path, rank of what is selected."""
    return explain(search, context, limit).where("selected").select("case", "path", "rank")


def budget(plan: DataFrame) -> DataFrame:
    """available, selected and dropped paths by case."""
    chosen = F.count_if("selected")
    return plan.groupBy("case").agg(F.count(F.lit(1)).alias("available"), chosen.alias("selected"), (F.count(F.lit(1)) - chosen).alias("dropped"))
