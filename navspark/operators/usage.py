"""Usage analytics over an event log: overview, latencies, funnels, refresh and click-through joins.

The ``events`` table plays the log: user_id is the repository; view is a search, click a context
request, purchase an approving index run, signup a status call, error a refused request; value is the
latency, and a search whose property k is divisible by three counts as stale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from navspark.sources.corpus import table

DAY_MS = 86_400_000


def log(events: DataFrame) -> DataFrame:
    command = F.when(F.col("event_type") == "view", "search").when(F.col("event_type") == "click", "context").when(F.col("event_type") == "purchase", "index").when(F.col("event_type") == "signup", "status").otherwise("refused")
    k = F.get_json_object("props", "$.k").cast("long")
    ms = F.expr("unix_millis(cast(ts as timestamp))")
    return events.select("event_id", "ts", ms.alias("ms"), F.col("user_id").alias("repo"), command.alias("command"), F.col("value").alias("latency"), (k % 3 == 0).alias("stale"))


def overview(rows: DataFrame) -> DataFrame:
    return rows.groupBy("command").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("repo").alias("repos"))


def per_repo(rows: DataFrame) -> DataFrame:
    return rows.groupBy("repo", F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("command") == "search").alias("searches"), F.max("ts").alias("last_ts"))


def latencies(rows: DataFrame) -> DataFrame:
    """Nearest-rank percentiles and the share of stale rows, by command."""
    rank = lambda p: F.expr(f"cast(percentile_disc({p}) within group (order by latency) as double)")
    return rows.groupBy("command").agg(rank(0.5).alias("p50"), rank(0.95).alias("p95"), F.round(F.avg(F.coalesce(F.col("stale"), F.lit(False)).cast("double")), 4).alias("stale_rate"))


def funnel(rows: DataFrame) -> DataFrame:
    """Per repository that was refused: the first refusal, the first approving index from then on, whether a search followed it.

    Three scans by time within a repository, in one shuffle.
    """
    w = Window.partitionBy("repo")
    gate = rows.withColumn("gate", F.min(F.when(F.col("command") == "refused", F.col("ms"))).over(w)).where("gate is not null")
    approved = gate.withColumn("approved", F.min(F.when((F.col("command") == "index") & (F.col("ms") >= F.col("gate")), F.col("ms"))).over(w))
    return approved.groupBy("repo").agg(F.min("gate").alias("gate"), F.min("approved").alias("approved"), F.coalesce(F.bool_or((F.col("command") == "search") & (F.col("ms") >= F.col("approved"))), F.lit(False)).alias("searched"))


def refreshes(rows: DataFrame, window_ms: int = DAY_MS) -> DataFrame:
    """Stale searches, the first index within the window from each, and whether a search within the window follows that."""
    ahead = Window.partitionBy("repo").orderBy("ms").rangeBetween(Window.currentRow, window_ms)
    after = Window.partitionBy("repo").orderBy("ms").rangeBetween(1, window_ms)
    seen = rows.withColumn("refresh", F.min(F.when(F.col("command") == "index", F.col("ms"))).over(ahead)).withColumn("again", F.min(F.when(F.col("command") == "search", F.col("ms"))).over(after))
    # What follows a refresh is read off the index row itself.
    index = seen.where("command = 'index'").groupBy("repo", F.col("ms").alias("refresh")).agg(F.max(F.col("again").isNotNull()).alias("searched"))
    stale = seen.where("command = 'search' and stale").select("event_id", "repo", "ms", "refresh")
    return stale.join(index, ["repo", "refresh"], "left").select("event_id", "repo", "ms", "refresh", F.coalesce("searched", F.lit(False)).alias("searched"))


def click_through(rows: DataFrame, window_ms: int = DAY_MS) -> DataFrame:
    """Each context request with the latest search of its repository in the window before it (the later event wins ties)."""
    before = Window.partitionBy("repo").orderBy("ms").rangeBetween(-window_ms, Window.currentRow)
    search = F.when(F.col("command") == "search", F.struct("ms", "event_id"))
    joined = rows.withColumn("hit", F.max(search).over(before)).where("command = 'context'")
    return joined.select("event_id", "repo", F.col("hit.event_id").alias("search_id"), (F.col("ms") - F.col("hit.ms")).alias("lag_ms"))


def click_ranks(rows: DataFrame, window_ms: int = DAY_MS) -> DataFrame:
    """event_id, repo, outcome, search_id, rank of each context request in rows (event_id, ms, repo, agent, command, target_form, resolved_path, results).

    A request is held against the latest search of its agent in the window before it, or else the latest of its repository;
    the later event wins ties. Outcomes: query (no path was asked for), unjoinable (no search), joined (the path has a rank among the
    search's results), recovered_miss (it has none). Requests for anything but a path or query are left out.
    """
    # One shuffle by repository serves both orders.
    by_repo = Window.partitionBy("repo").orderBy("ms").rangeBetween(-window_ms, Window.currentRow)
    by_agent = Window.partitionBy("repo", "agent").orderBy("ms").rangeBetween(-window_ms, Window.currentRow)
    search = F.when(F.col("command") == "search", F.struct("ms", "event_id", "results"))
    same = F.when(F.col("agent").isNotNull(), F.max(search).over(by_agent))
    asked = rows.withColumn("any", F.max(search).over(by_repo)).withColumn("same", same).where("command = 'context'")
    asked = asked.where((F.col("target_form") == "query") | (F.col("target_form") == "path") & F.col("resolved_path").isNotNull())
    hit = F.when(F.col("target_form") == "path", F.coalesce("same", "any"))
    rank = F.array_position(F.col("hit.results"), F.col("resolved_path"))
    outcome = F.when(F.col("target_form") == "query", "query").when(F.col("hit").isNull(), "unjoinable").when(rank > 0, "joined").otherwise("recovered_miss")
    return asked.withColumn("hit", hit).select("event_id", "repo", outcome.alias("outcome"), F.col("hit.event_id").alias("search_id"), F.when(rank > 0, rank).alias("rank"))


def click_summary(ranks: DataFrame) -> DataFrame:
    """One row: path and query contexts, joined, recovered misses, unjoinable, hits at rank 1, mean rank and the number of each rank."""
    n = lambda c: F.count(F.when(c, 1))
    of = lambda name: n(F.col("outcome") == name).alias(name)
    sums = ranks.agg(n(F.col("outcome") != "query").alias("path_contexts"), of("query"), of("joined"), of("recovered_miss"), of("unjoinable"), n(F.col("rank") == 1).alias("top_rank_hits"), F.round(F.avg("rank"), 2).alias("mean_rank"))
    each = ranks.where("rank is not null").groupBy("rank").agg(F.count(F.lit(1)).alias("n")).agg(F.sort_array(F.collect_list(F.struct("rank", "n"))).alias("ranks"))  # as many as a search has results
    return sums.join(F.broadcast(each)).withColumn("ranks", F.array_join(F.transform("ranks", lambda r: F.concat_ws(":", r["rank"].cast("string"), r["n"].cast("string"))), ","))


def _clicks(events: DataFrame) -> DataFrame:
    """The log with agents, results and paths made of the property k: agent k % 4 (none for 0), results k, k + 1 and k + 2, path k, all mod 10."""
    k = F.get_json_object("props", "$.k").cast("long")
    path = lambda x: F.concat(F.lit("p"), (x % 10).cast("string"))
    extra = events.select(F.col("event_id").alias("id"), F.when(k % 4 != 0, k % 4).alias("agent"), F.array(path(k), path(k + 1), path(k + 2)).alias("results"), path(k).alias("resolved_path"), F.when(F.col("event_id") % 7 == 0, "query").otherwise("path").alias("target_form"))
    rows = log(events)
    return rows.join(extra, rows["event_id"] == extra["id"]).drop("id")


def q_click_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return click_ranks(_clicks(table(spark, sf_dir, "events")))


def q_click_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return click_summary(click_ranks(_clicks(table(spark, sf_dir, "events"))))


def _over(f):
    return lambda spark, sf_dir: f(log(table(spark, sf_dir, "events")))


QUERIES = {"usage_overview": _over(overview), "usage_per_repo": _over(per_repo), "usage_latencies": _over(latencies), "usage_funnel": _over(funnel), "usage_refreshes": _over(refreshes), "usage_click_through": _over(click_through), "usg06_click_ranks": q_click_ranks, "usg06_click_summary": q_click_summary}

_LOG = """with e as (select event_id, ts, epoch_us(ts) // 1000 as ms, user_id as repo, case event_type when 'view' then 'search' when 'click' then 'context'
 when 'purchase' then 'index' when 'signup' then 'status' else 'refused' end as command, value as latency, cast(json_extract_string(props, '$.k') as bigint) % 3 = 0 as stale from events)"""
_CLICKS = f"""{_LOG}, x as (select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events),
 v as (select e.*, case when k % 4 <> 0 then k % 4 end as agent, ['p' || k % 10, 'p' || (k + 1) % 10, 'p' || (k + 2) % 10] as results, 'p' || k % 10 as path,
  case when event_id % 7 = 0 then 'query' else 'path' end as form from e join x using (event_id)),
 j as (select c.event_id, c.repo, c.form, c.path, s.event_id as search_id, s.results,
  row_number() over (partition by c.event_id order by coalesce(s.agent = c.agent, false) desc, s.ms desc, s.event_id desc) as rn
  from v c left join v s on c.form = 'path' and s.repo = c.repo and s.command = 'search' and s.ms between c.ms - {DAY_MS} and c.ms where c.command = 'context'),
 r as (select event_id, repo, case when form = 'query' then 'query' when search_id is null then 'unjoinable' when list_position(results, path) > 0 then 'joined' else 'recovered_miss' end as outcome,
  search_id, case when list_position(results, path) > 0 then list_position(results, path) end::bigint as rank from j where rn = 1)"""
SQL = {
    "usg06_click_ranks": f"{_CLICKS} select * from r",
    "usg06_click_summary": f"""{_CLICKS} select count(*) filter (outcome <> 'query') as path_contexts, count(*) filter (outcome = 'query') as query, count(*) filter (outcome = 'joined') as joined,
 count(*) filter (outcome = 'recovered_miss') as recovered_miss, count(*) filter (outcome = 'unjoinable') as unjoinable, count(*) filter (rank = 1) as top_rank_hits, round(avg(rank), 2) as mean_rank,
 (select string_agg(rank || ':' || n, ',' order by rank) from (select rank, count(*) as n from r where rank is not null group by rank)) as ranks from r""",
    "usage_overview": f"{_LOG} select command, count(*) as n, min(ts) as first_ts, max(ts) as last_ts, count(distinct repo) as repos from e group by command",
    "usage_per_repo": f"{_LOG} select repo, cast(cast(ts as date) as varchar) as day, count(*) as n, count(*) filter (command = 'search') as searches, max(ts) as last_ts from e group by all",
    "usage_latencies": f"{_LOG} select command, cast(quantile_disc(latency, 0.5) as double) as p50, cast(quantile_disc(latency, 0.95) as double) as p95, round(avg(cast(coalesce(stale, false) as double)), 4) as stale_rate from e group by command",
    "usage_funnel": f"""{_LOG}, g as (select repo, min(ms) as gate from e where command = 'refused' group by repo),
 a as (select g.repo, gate, min(ms) as approved from g left join e on e.repo = g.repo and command = 'index' and ms >= gate group by all)
 select repo, gate, approved, exists (select 1 from e where e.repo = a.repo and command = 'search' and ms >= approved) as searched from a""",
    "usage_refreshes": f"""{_LOG}, r as (select s.event_id, s.repo, s.ms, (select min(ms) from e where e.repo = s.repo and command = 'index' and e.ms between s.ms and s.ms + {DAY_MS}) as refresh
 from e s where command = 'search' and stale)
 select *, exists (select 1 from e where e.repo = r.repo and command = 'search' and e.ms > refresh and e.ms <= refresh + {DAY_MS}) as searched from r""",
    "usage_click_through": f"""{_LOG}, j as (select c.event_id, c.repo, c.ms, s.event_id as search_id, s.ms as s_ms, row_number() over (partition by c.event_id order by s.ms desc, s.event_id desc) as rn
 from e c left join e s on s.repo = c.repo and s.command = 'search' and s.ms between c.ms - {DAY_MS} and c.ms where c.command = 'context')
 select event_id, repo, search_id, ms - s_ms as lag_ms from j where rn = 1""",
}
