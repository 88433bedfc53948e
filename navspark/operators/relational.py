"""The relational categories on the star schema: every join kind, set operations, frames, grouping sets, percentiles, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from navspark.sources.corpus import table
from navspark.sources.scratch import saved


def _t(name: str):
    return lambda spark, sf_dir: table(spark, sf_dir, name)


def q_join_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of customers and orders under inner, outer, semi and anti joins."""
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    on = c["c_custkey"] == o["o_custkey"]
    kinds = ["inner", "left", "right", "full", "left_semi", "left_anti"]
    parts = [c.join(o, on, k).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(k).alias("kind"), "rows") for k in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def q_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("k"))
    named = {"union": a.union(b).distinct(), "union_all": a.union(b), "intersect": a.intersect(b), "except": a.subtract(b), "intersect_all": a.intersectAll(b), "except_all": a.exceptAll(b)}
    out = None
    for name, rows in named.items():
        part = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("total")).select(F.lit(name).alias("operation"), "rows", "total")
        out = part if out is None else out.unionByName(part)
    return out


def q_window_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey",
        F.row_number().over(w).cast("long").alias("nth"),
        F.lag("o_orderkey").over(w).alias("previous"),
        F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"),
        F.round(F.max("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("recent_max"),
        F.dense_rank().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderpriority"))).cast("long").alias("priority_rank"),
    )


def q_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    cube = line.cube("l_returnflag", "l_linestatus")
    return cube.agg(F.grouping_id().cast("long").alias("gid"), F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def percentiles_by(rows: DataFrame, group: str, value: str, percents: tuple[int, ...]) -> DataFrame:
    """group and p<percent> of each: the least value that so many percent of the group's values don't exceed; nulls don't count.

    Distinct values are counted and dealt out by ranges, each range's rows are numbered behind those of the ranges
    before it, and so no task holds a group's values, however few groups there are.
    """
    counts = rows.groupBy(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count(value).alias("n"))
    dealt = saved(counts.repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()), "ranges")
    parts = dealt.groupBy("g", "part").agg(F.sum("n").alias("of_part"))  # a row for each range and group in it
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("of_part").over(before), F.lit(0))).withColumn("total", F.sum("of_part").over(Window.partitionBy("g")))
    parts = parts.select(F.col("g").alias("part_g"), F.col("part").alias("part_of"), "before", "total")
    met = dealt.join(F.broadcast(parts), F.col("g").eqNullSafe(F.col("part_g")) & (F.col("part") == F.col("part_of")))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("g", "part").orderBy("v"))
    ranked = met.select("g", "v", "n", "total", upto.alias("upto"))
    rank = lambda p: F.greatest(F.lit(1), F.expr(f"(total * {p} + 99) div 100"))
    here = lambda p: (F.col("upto") >= rank(p)) & (F.col("upto") - F.col("n") < rank(p))
    return ranked.groupBy(F.col("g").alias(group)).agg(*(F.max(F.when(here(p), F.col("v"))).alias(f"p{p}") for p in percents))


def q_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles_by(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", (50, 90, 95, 99))


def q_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'2000-09-01'")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return line.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


def q_region_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, o, c = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer"))
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    j = line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", F.year("o_orderdate").cast("long").alias("year")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def q_top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    best = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("spent"), "c_custkey"))
    rows = total.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.withColumn("rank", best.cast("long")).where("rank <= 3").select("c_nationkey", "c_custkey", "spent", "rank")


def q_like_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose type or name matches one of a few patterns: a join by LIKE, the patterns broadcast."""
    patterns = spark.createDataFrame([("starts", "S%"), ("ends", "%L"), ("holds", "%an%")], "rule string, pattern string")
    part = table(spark, sf_dir, "part")
    return part.join(F.broadcast(patterns), F.expr("p_type like pattern or p_name like pattern")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"))


def q_set_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose orders have every priority that occurs, and those who lack exactly one."""
    o = table(spark, sf_dir, "orders")
    kinds = o.agg(F.count_distinct("o_orderpriority").alias("kinds"))  # one row
    held = o.groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("held"))
    return held.join(F.broadcast(kinds), F.col("held") >= F.col("kinds") - 1).select("o_custkey", (F.col("held") == F.col("kinds")).alias("every"))


def q_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return groups.where("n >= 20 and quantity > 500")


def q_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types by user bucket over the dense list of types; what doesn't occur counts 0."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    events = table(spark, sf_dir, "events").withColumn("bucket", F.pmod("user_id", F.lit(10)))
    return events.groupBy("bucket").pivot("event_type", kinds).agg(F.count(F.lit(1))).na.fill(0).select("bucket", *kinds)


def q_scalar_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path functions over the pages' addresses."""
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/]*(/[^?#]*)", 1), "/+$", "")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.regexp_extract(path, "([^/]*)$", 1).alias("base"), F.regexp_replace(path, "/[^/]*$", "").alias("folder"), F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("long").alias("depth"), F.lower(F.regexp_extract("url", "://([^/]*)", 1)).alias("host"))


def q_scalar_json_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON, date and conditional functions over the events."""
    k = F.get_json_object("props", "$.k").cast("long")
    size = F.when(F.col("value").isNull(), "none").when(F.col("value") < 10, "small").when(F.col("value") < 50, "middle").otherwise("large")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.hour("ts").cast("long").alias("hour"), F.dayofweek("ts").cast("long").alias("weekday"), size.alias("size"), F.coalesce(F.nullif(k % 3, F.lit(0)), F.lit(-1)).alias("third"))


def q_scalar_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array and map functions: each order's ship flags, sorted and counted."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_returnflag")).alias("flags"))
    counts = F.map_from_entries(F.transform(F.array_distinct("flags"), lambda f: F.struct(f, F.size(F.filter("flags", lambda x: x == f)))))
    return lines.select("l_orderkey", F.array_join("flags", "").alias("letters"), F.array_join(F.array_distinct("flags"), ",").alias("kinds"), F.coalesce(F.element_at(counts, "R"), F.lit(0)).cast("long").alias("returned"), F.array_max("flags").alias("last"))


def q_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of six hours, a new one every two hours."""
    rows = table(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "6 hours", "2 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("begin"), "n")


def q_session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's sessions: events less than 24 hours after the one before."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "24 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("begin"), "n")


QUERIES = {"join_kinds": q_join_kinds, "set_operations": q_set_operations, "window_frames": q_window_frames, "grouping_sets": q_grouping_sets, "percentiles": q_percentiles, "pricing_summary": q_pricing_summary, "region_revenue": q_region_revenue, "top_customers": q_top_customers, "like_join": q_like_join, "set_containment": q_set_containment, "having": q_having, "pivot": q_pivot, "scalar_paths": q_scalar_paths, "scalar_json_dates": q_scalar_json_dates, "scalar_collections": q_scalar_collections, "sliding_windows": q_sliding_windows, "session_windows": q_session_windows}

_SETS = {"union": "select k from a union select k from b", "union_all": "select k from a union all select k from b", "intersect": "select k from a intersect select k from b", "except": "select k from a except select k from b", "intersect_all": "select k from a intersect all select k from b", "except_all": "select k from a except all select k from b"}
SQL = {
    "join_kinds": " union all ".join(f"select '{k}' as kind, (select count(*) from customer {j} join orders on c_custkey = o_custkey) as rows" for k, j in (("inner", "inner"), ("left", "left"), ("right", "right"), ("full", "full"), ("left_semi", "semi"), ("left_anti", "anti"))),
    "set_operations": "with a as (select c_nationkey as k from customer), b as (select s_nationkey as k from supplier where s_acctbal > 0) " + " union all ".join(f"select '{n}' as operation, count(*) as rows, cast(coalesce(sum(k), 0) as bigint) as total from ({q})" for n, q in _SETS.items()),
    "window_frames": """select o_orderkey, row_number() over w as nth, lag(o_orderkey) over w as previous,
 round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding), 2) as running,
 round(max(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows 2 preceding), 2) as recent_max,
 dense_rank() over (partition by o_custkey order by o_orderpriority desc) as priority_rank
 from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""",
    "grouping_sets": "select l_returnflag, l_linestatus, cast(grouping(l_returnflag, l_linestatus) as bigint) as gid, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem group by cube (l_returnflag, l_linestatus)",
    "percentiles": "select l_returnflag, " + ", ".join(f"cast(quantile_disc(l_extendedprice, {p / 100}) as double) as p{p}" for p in (50, 90, 95, 99)) + " from lineitem group by l_returnflag",
    "pricing_summary": "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '2000-09-01' group by all",
    "region_revenue": "select r_name, year(o_orderdate) as year, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all",
    "top_customers": "with t as (select o_custkey, round(sum(o_totalprice), 2) as spent from orders group by o_custkey) select c_nationkey, c_custkey, spent, row_number() over (partition by c_nationkey order by spent desc, c_custkey) as rank from t join customer on o_custkey = c_custkey qualify rank <= 3",
    "like_join": "select rule, count(*) as n, min(p_partkey) as first from part join (values ('starts', 'S%'), ('ends', '%L'), ('holds', '%an%')) p(rule, pattern) on p_type like pattern or p_name like pattern group by rule",
    "set_containment": "with h as (select o_custkey, count(distinct o_orderpriority) as held from orders group by 1), k as (select count(distinct o_orderpriority) as kinds from orders) select o_custkey, held = kinds as every from h, k where held >= kinds - 1",
    "having": "select l_suppkey, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem group by 1 having count(*) >= 20 and round(sum(l_quantity), 2) > 500",
    "pivot": "select user_id % 10 as bucket, " + ", ".join(f"count(*) filter (event_type = '{k}') as {k}" for k in ("click", "error", "purchase", "signup", "view")) + " from events group by 1",
    "scalar_paths": """with p as (select page_id, url, regexp_replace(regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1), '/+$', '') as path from pages)
 select page_id, path, regexp_extract(path, '([^/]*)$', 1) as base, regexp_replace(path, '/[^/]*$', '') as folder, len(list_filter(string_split(path, '/'), lambda x: x <> '')) as depth, lower(regexp_extract(url, '://([^/]*)', 1)) as host from p""",
    "scalar_json_dates": """with e as (select *, cast(props ->> '$.k' as bigint) as k from events)
 select event_id, k, strftime(ts, '%Y-%m-%d') as day, hour(ts) as hour, dayofweek(ts) + 1 as weekday, case when value is null then 'none' when value < 10 then 'small' when value < 50 then 'middle' else 'large' end as size, coalesce(nullif(k % 3, 0), -1) as third from e""",
    "scalar_collections": """with f as (select l_orderkey, list_sort(list(l_returnflag)) as flags from lineitem group by 1)
 select l_orderkey, array_to_string(flags, '') as letters, array_to_string(list_sort(list_distinct(flags)), ',') as kinds, len(list_filter(flags, lambda x: x = 'R')) as returned, list_max(flags) as last from f""",
    "sliding_windows": "with w as (select unnest([time_bucket(interval '2 hours', ts), time_bucket(interval '2 hours', ts) - interval '2 hours', time_bucket(interval '2 hours', ts) - interval '4 hours']) as b from events) select strftime(b, '%Y-%m-%d %H:%M:%S') as \"begin\", count(*) as n from w group by 1",
    "session_windows": """with g as (select user_id, ts, case when ts - lag(ts) over w < interval '24 hours' then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
 s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as nth from g)
 select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as "begin", count(*) as n from s group by user_id, nth""",
}
