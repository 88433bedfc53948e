"""Reports over a directed graph (src, dst): degrees, strongly connected components, clusters, shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from navspark.sources.corpus import table
from navspark.sources.scratch import saved as _saved


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, inbound, outbound, total, kind (bridge: both ways; isolated: none) of distinct edges between different nodes."""
    real = edges.where("src <> dst").select("src", "dst").distinct()
    ends = real.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(real.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    sums = ends.groupBy("node").agg(F.sum("i").alias("inbound"), F.sum("o").alias("outbound"))
    out = nodes.join(sums, "node", "left").select("node", F.coalesce("inbound", F.lit(0)).cast("long").alias("inbound"), F.coalesce("outbound", F.lit(0)).cast("long").alias("outbound"))
    kind = F.when((F.col("inbound") > 0) & (F.col("outbound") > 0), "bridge").when(F.col("inbound") + F.col("outbound") == 0, "isolated").otherwise("leaf")
    return out.select("*", (F.col("inbound") + F.col("outbound")).alias("total"), kind.alias("kind"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the greatest node of its strongly connected component.

    Colours spread forward until stable (greatest wins); what reaches a colour's root backward within the
    colour is a component and leaves the graph. Rounds repeat on the rest.
    """
    rest, done = _saved(nodes.select("node").distinct()), None
    links = _saved(edges.where("src <> dst").select("src", "dst").distinct())
    while not rest.isEmpty():
        colour = rest.withColumn("colour", F.col("node"))
        while True:
            near = links.join(colour, links["src"] == colour["node"]).groupBy("dst").agg(F.max("colour").alias("near"))
            new = _saved(colour.join(near, colour["node"] == near["dst"], "left").select("node", F.col("colour").alias("old"), F.greatest("colour", F.coalesce("near", "colour")).alias("colour")))
            colour = new.select("node", "colour")
            if new.where("colour > old").isEmpty():
                break
        inside = links.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("d")), "dst").where("c = d").select("src", "dst")
        inside = _saved(inside)
        found = _saved(colour.where("node = colour"))
        frontier = found
        while not frontier.isEmpty():
            step = inside.join(frontier, inside["dst"] == frontier["node"]).select(F.col("src").alias("node"), "colour").distinct()
            frontier = _saved(step.join(found, "node", "left_anti"))
            found = _saved(found.unionByName(frontier))
        part = found.select("node", F.col("colour").alias("component"))
        done = part if done is None else done.unionByName(part)
        rest = _saved(rest.join(found, "node", "left_anti"))
        links = _saved(links.join(rest.select(F.col("node").alias("src")), "src", "left_semi").join(rest.select(F.col("node").alias("dst")), "dst", "left_semi"))
    return nodes.select("node", F.col("node").alias("component")).limit(0) if done is None else done


def clusters(members: DataFrame, edges: DataFrame) -> DataFrame:
    """cluster, nodes, edges: an edge within a cluster counts once, one between clusters once in each. members: (node, cluster)."""
    real = edges.where("src <> dst").select("src", "dst").distinct()
    named = real.join(members.select(F.col("node").alias("src"), F.col("cluster").alias("a")), "src").join(members.select(F.col("node").alias("dst"), F.col("cluster").alias("b")), "dst")
    counts = named.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("cluster")).groupBy("cluster").agg(F.count(F.lit(1)).alias("edges"))
    return members.groupBy("cluster").agg(F.count(F.lit(1)).alias("nodes")).join(counts, "cluster", "left").select("cluster", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"))


def distances(start: DataFrame, edges: DataFrame, hops: int = 4) -> DataFrame:
    """(node, hops): steps over edges in either direction from the start nodes, up to a bound."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct()
    seen = frontier = _saved(start.select("node", F.lit(0).cast("long").alias("hops")))
    for k in range(1, hops + 1):
        step = both.join(frontier, both["src"] == frontier["node"]).select(F.col("dst").alias("node")).distinct()
        frontier = _saved(step.join(seen, "node", "left_anti").withColumn("hops", F.lit(k).cast("long")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def paths(pairs: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """src, dst, hops, steps (from, to, kind, specifier, line) for the pairs (src, dst) that a path of 1 to 4 hops connects, in either direction of edges
    (src, dst, kind, specifier, line); a node's path to itself has no steps.

    All pairs are searched at once, breadth first. Of a node's shortest paths the first counts, by its steps in turn: by the edge's
    source, target, kind, line and specifier. A frontier row carries its path, four steps at most, so the least path to
    a node is a minimum over its incoming steps.
    """
    hops = min(max(int(hops), 1), 4)
    known = edges.where("src <> dst").select("src", "dst", "kind", "specifier", F.col("line").cast("long").alias("line")).distinct()
    order = F.struct("src", "dst", "kind", F.coalesce("line", F.lit(2147483647)).alias("line"), F.coalesce("specifier", F.lit("")).alias("specifier"))
    step = lambda a, b, kind: known.select(F.col(a).alias("at"), F.struct(order.alias("order"), F.col(a).alias("from"), F.col(b).alias("to"), kind.alias("kind"), "specifier", "line").alias("step"))
    steps = _saved(step("src", "dst", F.col("kind")).unionByName(step("dst", "src", F.concat(F.lit("reverse_"), "kind"))))
    none = F.array().cast(f"array<{steps.schema['step'].dataType.simpleString()}>")
    frontier = _saved(pairs.select(F.col("src").alias("start"), F.col("src").alias("node")).distinct().select("start", "node", none.alias("path")))
    seen = frontier
    for _ in range(hops):
        reached = frontier.join(steps, frontier["node"] == steps["at"]).select("start", F.col("step.to").alias("node"), F.concat("path", F.array("step")).alias("path"))
        frontier = _saved(reached.groupBy("start", "node").agg(F.min("path").alias("path")).join(seen, ["start", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    found = pairs.select("src", "dst").distinct().join(seen.select(F.col("start").alias("src"), F.col("node").alias("dst"), "path"), ["src", "dst"])
    return found.select("src", "dst", F.size("path").cast("long").alias("hops"), F.transform("path", lambda s: F.struct(s["from"].alias("from"), s["to"].alias("to"), s["kind"].alias("kind"), s["specifier"].alias("specifier"), s["line"].alias("line"))).alias("steps"))


def _trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations, and an edge from a supplier's nation to each of the two nations that buy most of it.

    Nearly every pair of nations trades, so with all pairs as edges every node and every path would look alike.
    """
    supply = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src")), "l_suppkey")
    buyers = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), F.col("c_nationkey").alias("dst"))
    weight = supply.join(buyers, "l_orderkey").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))
    edges = weight.withColumn("rn", place).where("rn <= 2").select("src", "dst")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("cluster")), edges


def q_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degrees(*_trade(spark, sf_dir)).select("node", "inbound", "outbound", "total", "kind")


def q_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(*_trade(spark, sf_dir))


def q_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(*_trade(spark, sf_dir))


def q_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _trade(spark, sf_dir)
    return distances(nodes.where("node = 0"), edges)


def q_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first shortest path of at most four hops between any two nations; edges out of odd nations are includes."""
    nodes, edges = _trade(spark, sf_dir)
    edges = edges.select("src", "dst", F.when(F.col("src") % 2 == 1, "includes").otherwise("imports").alias("kind"), F.lit(None).cast("string").alias("specifier"), F.lit(None).cast("long").alias("line"))
    pairs = nodes.select(F.col("node").alias("src")).join(nodes.select(F.col("node").alias("dst")), F.lit(True))  # 625 pairs: the question itself
    trail = F.array_join(F.transform("steps", lambda s: F.concat(s["kind"], F.lit(":"), s["to"].cast("string"))), ">")
    return paths(pairs, _saved(edges), 4).select("src", "dst", "hops", trail.alias("trail"))


_EDGES = """w as (select s_nationkey as src, c_nationkey as dst, count(*) as w from lineitem join supplier on l_suppkey = s_suppkey
 join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by all),
 x as (select src, dst from w qualify row_number() over (partition by src order by w desc, dst) <= 2), e as (select src, dst from x where src <> dst)"""
SQL = {
    "graph_degrees": f"""with {_EDGES}, d as (select n_nationkey as node, (select count(*) from e where dst = n_nationkey) as inbound, (select count(*) from e where src = n_nationkey) as outbound from nation)
 select *, inbound + outbound as total, case when inbound > 0 and outbound > 0 then 'bridge' when inbound + outbound = 0 then 'isolated' else 'leaf' end as kind from d""",
    "graph_components": f"""with recursive {_EDGES}, r(a, b) as (select n_nationkey, n_nationkey from nation union select a, dst from r join e on b = src)
 select x.a as node, max(x.b) as component from r x join r y on x.a = y.b and x.b = y.a group by x.a""",
    "graph_clusters": f"""with {_EDGES}, k as (select p.n_regionkey as a, q.n_regionkey as b from e join nation p on src = p.n_nationkey join nation q on dst = q.n_nationkey)
 select n_regionkey as cluster, count(*) as nodes, (select count(*) from k where a = n_regionkey or b = n_regionkey) as edges from nation group by n_regionkey""",
    "graph_distances": f"""with recursive {_EDGES}, u as (select src, dst from e union select dst, src from e), r(node, hops) as (select 0, 0 union select dst, hops + 1 from r join u on node = src where hops < 4)
 select node, cast(min(hops) as bigint) as hops from r group by node""",
    "grf05_paths": f"""with recursive {_EDGES}, k as (select src, dst, case when src % 2 = 1 then 'includes' else 'imports' end as kind from e),
 s as (select src as f, dst as t, kind, printf('%03d %03d', src, dst) as o from k union all select dst, src, 'reverse_' || kind, printf('%03d %03d', src, dst) from k),
 r(src, dst, hops, keys, trail) as (select n_nationkey, n_nationkey, 0::bigint, '', '' from nation
  union all select r.src, t, hops + 1, keys || '|' || o, case when trail = '' then '' else trail || '>' end || kind || ':' || t from r join s on dst = f where hops < 4),
 m as (select src, dst, min(hops) as hops from r group by src, dst)
 select r.src, r.dst, r.hops, arg_min(trail, keys) as trail from r join m using (src, dst, hops) group by r.src, r.dst, r.hops""",
}
QUERIES = {"graph_degrees": q_degrees, "graph_components": q_components, "graph_clusters": q_clusters, "graph_distances": q_distances, "grf05_paths": q_paths}
