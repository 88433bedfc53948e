"""Evaluation of retrieval and navigation: assessments, summaries, gates, paired records, miss classes, index drift, budgets.

Case tables have one row per (case, mode). The registered queries play them on the driver's tables: in
``events`` a user is a task, an event type a mode and the value a latency; ``labels`` is an index of
``documents`` whose low-quality rows count as changed; a conversation is an episode of tool calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from navspark.operators.text_index import _BM25, relevant
from navspark.operators.text_index import _ranked as ranked_passages
from navspark.sources.corpus import documents_as_files, table
from navspark.sources.scratch import saved

#: Recalls that differ by no more than this are a tie.
TIE = 1e-6
#: Classes of misses, in report order.
MISS_CLASSES = ["alias", "convention", "missing_symbol", "noise", "staleness", "query_formulation", "unknown"]
#: The stated query of the registered lexical baseline.
LEXICAL_QUERY = "data order the_time"


def terms_of(query: str) -> list[str]:
    """Distinct lower-cased runs of letters, digits and underscores, two characters or more."""
    import re

    return list(dict.fromkeys(t for t in re.findall(r"[a-z0-9_]+", query.lower()) if len(t) > 1))


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences."""
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("long")


def lexical_scores(files: DataFrame, query: str) -> DataFrame:
    """path, score of every file with a term of the query; an occurrence in the path counts four times."""
    path, text = F.lower("path"), F.lower(F.coalesce("text", F.lit("")))
    score = F.lit(0).cast("long")
    for t in terms_of(query):
        score = score + 4 * occurrences(path, t) + occurrences(text, t)
    return files.select("path", score.alias("score")).where("score > 0")


def assess(cases: DataFrame) -> DataFrame:
    """Recalls and success of each row of (case, mode, entry, required, forbidden, selected); arrays of paths."""
    wanted = F.array_distinct(F.concat(F.array("entry"), "required"))
    share = lambda a: F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, F.col("selected"))) / F.size(a))
    rows = cases.withColumns({
        "expected_recall": share(wanted),
        "context_recall": share(F.array_distinct("required")),
        "entry_found": F.array_contains("selected", F.col("entry")),
        "forbidden_read": F.array_intersect("selected", "forbidden"),
        "missing": F.array_except(wanted, F.col("selected")),
    })
    return rows.withColumn("success", F.col("entry_found") & (F.col("context_recall") == 1) & (F.size("forbidden_read") == 0))


def mode_summary(assessed: DataFrame) -> DataFrame:
    """Rates and means of assessed cases with latency and bytes_read, by mode."""
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 3)
    return assessed.groupBy("mode").agg(
        F.count(F.lit(1)).alias("cases"),
        mean("success").alias("success_rate"),
        mean("entry_found").alias("entry_rate"),
        F.round(F.avg((F.size("forbidden_read") > 0).cast("double")), 3).alias("forbidden_rate"),
        mean("expected_recall").alias("expected_recall"),
        mean("context_recall").alias("context_recall"),
        F.round(F.avg(F.size("selected")), 3).alias("files"),
        F.round(F.avg("bytes_read") / 4).cast("long").alias("tokens"),
        mean("latency").alias("latency_avg"),
        F.expr("cast(percentile_disc(0.95) within group (order by latency) as double)").alias("latency_p95"),
    )


def mode_delta(summary: DataFrame, left: str, right: str, measures: list[str]) -> DataFrame:
    """measure, delta: what ``left`` has over ``right``; the modes meet in one aggregation."""
    pick = lambda m, c: F.max(F.when(F.col("mode") == m, F.col(c)))
    deltas = [F.struct(F.lit(c).alias("measure"), F.round(pick(left, c) - pick(right, c), 3).alias("delta")) for c in measures]
    return summary.where(F.col("mode").isin(left, right)).agg(F.array(*deltas).alias("d")).select(F.inline("d"))


def paired(rows: DataFrame, left: str, right: str) -> DataFrame:
    """One row: wins, losses, ties and the largest loss of mode ``left`` against ``right`` over the tasks (task, mode, value) that have both."""
    pick = lambda m: F.max(F.when(F.col("mode") == m, F.col("value")))
    each = rows.where(F.col("mode").isin(left, right)).groupBy("task").agg((pick(left) - pick(right)).alias("d")).where("d is not null")
    lost = F.max(F.when(F.col("d") < -TIE, -F.col("d")))
    return each.agg(F.count_if(F.col("d") > TIE).alias("wins"), F.count_if(F.col("d") < -TIE).alias("losses"), F.count_if(F.abs("d") <= TIE).alias("ties"), F.round(F.coalesce(lost, F.lit(0.0)), 4).alias("max_loss"))


def gate(metrics: DataFrame, least: dict[str, float]) -> DataFrame:
    """metric, value, threshold of each metric of each row (with its mode) that is missing or below its least value."""
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value"), F.lit(float(v)).alias("threshold")) for k, v in least.items()])
    return metrics.select("mode", F.inline(pairs)).where("value is null or value < threshold")


def above(metrics: DataFrame, most: dict[str, float]) -> DataFrame:
    """metric, value, threshold of each metric of each row that is above its greatest value."""
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value"), F.lit(float(v)).alias("threshold")) for k, v in most.items()])
    return metrics.select(F.inline(pairs)).where("value > threshold")


def search_quality(expected: DataFrame, excluded: DataFrame, results: DataFrame, most: int = 5) -> DataFrame:
    """One row of measures over the cases that expect something: expected (case, path), excluded (case, path), results (case, path, rank from 1).

    Accuracy at rank 1; cases with an expected path among the first ``most``; the mean share of expected paths there and the
    mean reciprocal rank of the first; cases without any and with only some; cases with an excluded path there, and their share of all.
    """
    top = results.where(F.col("rank") <= most).select("case", "path", "rank").distinct()
    wanted = expected.select("case", "path").distinct().join(top, ["case", "path"], "left").groupBy("case").agg(F.count(F.lit(1)).alias("all"), F.count("rank").alias("found"), F.min("rank").alias("first"))
    wrong = excluded.select("case", "path").distinct().join(top, ["case", "path"], "left_semi").select("case").distinct().withColumn("wrong", F.lit(1))
    n = lambda c: F.count(F.when(c, 1))
    share = lambda c, name: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(name)
    rows = wanted.join(wrong, "case", "left")
    return rows.agg(
        F.count(F.lit(1)).alias("cases"),
        share((F.coalesce("first", F.lit(0)) == 1).cast("double"), "top1_accuracy"),
        share((F.col("found") > 0).cast("double"), "recall"),
        share(F.col("found") / F.col("all"), "expected_coverage"),
        share(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), "mrr"),
        n(F.col("found") == 0).alias("misses"),
        n((F.col("found") > 0) & (F.col("found") < F.col("all"))).alias("partial_misses"),
        F.count("wrong").alias("excluded_hits"),
        share(F.coalesce("wrong", F.lit(0)).cast("double"), "false_positive_rate"),
    )


def misses(assessed: DataFrame) -> DataFrame:
    """case, mode, file, kind, class: why files were missed or read in vain.

    ``assessed`` has query, stale and hints (map of path to classes) besides. A forbidden file is noise. A
    missing one is staleness under a stale index, else what its hint says, else a convention's neighbour,
    a missed symbol, a query that shares no word with the path, or unknown, in this order.
    """
    split = lambda c: F.filter(F.split(F.lower(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9_]+"), lambda t: F.length(t) > 1)
    stem = lambda c: F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(c, r"([^/]*)$", 1), r"(?i)\.(test|spec)\.[^.]+$", ""), r"\.[^.]+$", ""))
    file, low = F.col("file"), F.lower("file")
    usual = low.rlike(r"(^|/)(__tests__|tests?|specs?|docs?)/|\.(test|spec)\.|\.md$|(^|/)(docker-)?compose[^/]*\.ya?ml$|\.(config|conf)\.(js|ts|mjs|cjs|json|ya?ml)$")
    near = (file != F.col("entry")) & (usual | (F.array_contains("required", file) & (stem(file) == stem(F.col("entry")))))
    symbol = F.col("query").rlike("[a-z][A-Z]") | F.col("query").rlike(r"(?i)\b(class|def|function|implementation|handler|provider|component|hook)\b")
    hinted = F.element_at("hints", file)
    verdict = (
        F.when(F.col("stale"), F.array(F.lit("staleness")))
        .when(F.size(hinted) > 0, hinted)
        .when(near, F.array(F.lit("convention")))
        .when((file == F.col("entry")) & symbol, F.array(F.lit("missing_symbol")))
        .when(~F.arrays_overlap(split(F.col("query")), split(file)), F.array(F.lit("query_formulation")))
        .otherwise(F.array(F.lit("unknown")))
    )
    lost = assessed.withColumn("file", F.explode("missing")).select("case", "mode", "file", F.lit("missing_expected").alias("kind"), F.explode(verdict).alias("class"))
    vain = assessed.select("case", "mode", F.explode("forbidden_read").alias("file"), F.lit("forbidden_read").alias("kind"), F.lit("noise").alias("class"))
    return lost.unionByName(vain)


def miss_counts(found: DataFrame) -> DataFrame:
    """class, n for every class, those without a miss too."""
    counts = [F.struct(F.lit(c).alias("class"), F.count_if(F.col("class") == c).alias("n")) for c in MISS_CLASSES]
    return found.agg(F.array(*counts).alias("c")).select(F.inline("c"))


def drift(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """state, n over (path, hash) of an index and a tree: same, changed, missing (only in the tree), deleted (only in the index)."""
    both = indexed.select("path", F.col("hash").alias("old"), F.lit(1).alias("i")).join(current.select("path", F.col("hash").alias("new"), F.lit(1).alias("c")), "path", "full_outer")
    state = F.when(F.col("i").isNull(), "missing").when(F.col("c").isNull(), "deleted").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    return both.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def budget(fields: DataFrame) -> DataFrame:
    """tool, fields, tokens (a fourth of the characters, rounded up per field), with a row of null tool for the total."""
    cost = F.ceil(F.char_length(F.coalesce("text", F.lit(""))) / 4)
    return fields.rollup("tool").agg(F.count(F.lit(1)).alias("fields"), F.sum(cost).alias("tokens"))


def episodes(calls: DataFrame) -> DataFrame:
    """episode, calls, first tool, where the tool ``wanted`` comes first, how many ``raw`` calls precede it: (episode, seq, tool, wanted, raw).

    Positions are compared after one aggregation; no episode is sorted.
    """
    first = F.min(F.when(F.col("wanted"), F.col("seq")))
    raws = F.array_agg(F.when(F.col("raw"), F.col("seq")))
    rows = calls.groupBy("episode").agg(F.count(F.lit(1)).alias("calls"), F.min_by("tool", "seq").alias("first_tool"), first.alias("first_wanted"), raws.alias("raws"))
    before = F.size(F.filter("raws", lambda s: F.col("first_wanted").isNull() | (s < F.col("first_wanted"))))
    return rows.select("episode", "calls", "first_tool", "first_wanted", before.cast("long").alias("raw_before"))


def symbol_truth(hits: DataFrame) -> DataFrame:
    """name, paths (sorted, distinct) and how many hits were repeated at the same place: (name, path, line)."""
    places = hits.groupBy("name", "path", "line").agg(F.count(F.lit(1)).alias("n"))
    return places.groupBy("name").agg(F.array_sort(F.collect_set("path")).alias("paths"), F.count_if(F.col("n") > 1).alias("repeated"))


def q_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_scores(documents_as_files(table(spark, sf_dir, "documents")), LEXICAL_QUERY)


def _modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("task"), F.col("event_type").alias("mode")).agg(F.max("value").alias("value"))


def q_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired(_modes(spark, sf_dir), "click", "view")


def q_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _modes(spark, sf_dir).groupBy("mode").agg(F.min("value").alias("least"), F.max("value").alias("most"))
    return gate(rows, {"least": 1.0, "most": 1_000_000.0})


def q_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.lit(1).alias("hash"))
    index = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"), F.col("quality").alias("hash"))
    return drift(index, docs)


def q_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget(table(spark, sf_dir, "conversations").withColumnRenamed("role", "tool"))


def q_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return episodes(rows.select(F.col("conv_id").alias("episode"), F.col("turn").alias("seq"), F.col("role").alias("tool"), (F.col("role") == "assistant").alias("wanted"), (F.col("role") == "user").alias("raw")))


def q_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by event type, by day and over all, in one pass of grouping sets."""
    rows = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").cast("string").alias("day"))
    kinds = rows.groupingSets([["event_type"], ["day"], []], "event_type", "day")
    return kinds.agg(F.count(F.lit(1)).alias("n"))


def q_search_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The BM25 search of every passage that some document holds, judged: those documents are expected, toxic ones excluded."""
    results = ranked_passages(spark, sf_dir).select(F.col("item_id").alias("case"), F.col("doc_id").alias("path"), "rank")
    expected = relevant(spark, sf_dir).select(F.col("item_id").alias("case"), F.col("doc_id").alias("path"))
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("path")).distinct()
    saved_results = saved(results, "quality")
    # Only what was found can be wrong, so what is excluded is asked of the results.
    return search_quality(expected, saved_results.join(toxic, "path", "left_semi").select("case", "path"), saved_results)


QUERIES = {"evl03_search_quality": q_search_quality, "lexical_baseline": q_lexical, "paired_record": q_paired, "threshold_gate": q_gate, "index_drift": q_drift, "token_budget": q_budget, "routing_episodes": q_episodes, "usage_histograms": q_histograms}

_COUNT = " + ".join(
    f"4 * ((length(p) - length(replace(p, '{t}', ''))) // {len(t)}) + (length(t) - length(replace(t, '{t}', ''))) // {len(t)}" for t in terms_of(LEXICAL_QUERY)
)
_MODES = "with m as (select user_id as task, event_type as mode, max(value) as value from events group by all)"
SQL = {
    "evl03_search_quality": f"""with {_BM25},
 w as (select distinct item_id, doc_id from benchmark b join documents d on contains(d.text, b.text)),
 x as (select item_id, count(*) as n, count(rank) as found, min(rank) as first from w left join (select * from r where rank <= 5) using (item_id, doc_id) group by item_id),
 g as (select x.*, exists (select 1 from r join labels l using (doc_id) where r.item_id = x.item_id and rank <= 5 and toxic = 1) as wrong from x)
 select count(*) as cases, round(coalesce(avg((coalesce(first, 0) = 1)::int), 0), 6) as top1_accuracy, round(coalesce(avg((found > 0)::int), 0), 6) as recall, round(coalesce(avg(found / n), 0), 6) as expected_coverage,
 round(coalesce(avg(coalesce(1.0::double / first, 0)), 0), 6) as mrr, count(*) filter (found = 0) as misses, count(*) filter (found > 0 and found < n) as partial_misses, count(*) filter (wrong) as excluded_hits,
 round(coalesce(avg(wrong::int), 0), 6) as false_positive_rate from g""",
    "lexical_baseline": f"""with f as (select 'docs/' || source || '/' || lang || '/' || doc_id || '.txt' as path, lower(path) as p, lower(coalesce(text, '')) as t from documents)
 select path, cast({_COUNT} as bigint) as score from f where score > 0""",
    "paired_record": f"""{_MODES}, d as (select max(value) filter (mode = 'click') - max(value) filter (mode = 'view') as d from m group by task having d is not null)
 select count(*) filter (d > {TIE}) as wins, count(*) filter (d < -{TIE}) as losses, count(*) filter (abs(d) <= {TIE}) as ties, round(coalesce(max(-d) filter (d < -{TIE}), 0), 4) as max_loss from d""",
    "threshold_gate": f"""{_MODES}, s as (select mode, min(value) as least, max(value) as most from m group by mode),
 u as (select mode, 'least' as metric, least as value from s union all select mode, 'most', most from s)
 select mode, metric, value, cast(case metric when 'least' then 1 else 1000000 end as double) as threshold from u where value is null or value < threshold""",
    "index_drift": """select case when l.doc_id is null then 'missing' when d.doc_id is null then 'deleted' when quality is not distinct from 1 then 'same' else 'changed' end as state, count(*) as n
 from labels l full join documents d on l.doc_id = d.doc_id group by 1""",
    "token_budget": "select role as tool, count(*) as fields, cast(sum(ceil(length(coalesce(text, '')) / 4.0)) as bigint) as tokens from conversations group by rollup (role)",
    "routing_episodes": """with f as (select conv_id, min(turn) filter (role = 'assistant') as first_wanted from conversations group by 1)
 select c.conv_id as episode, count(*) as calls, arg_min(role, turn) as first_tool, any_value(first_wanted) as first_wanted,
 count(*) filter (role = 'user' and (first_wanted is null or turn < first_wanted)) as raw_before from conversations c join f on f.conv_id is not distinct from c.conv_id group by 1""",
    "usage_histograms": "select event_type, cast(cast(ts as date) as varchar) as day, count(*) as n from events group by grouping sets ((event_type), (day), ())",
}
