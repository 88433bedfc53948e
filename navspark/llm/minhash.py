"""Near-duplicate documents by one-permutation MinHash, banded buckets and star-shaped candidate edges.

A document's set holds its distinct shingles of five words (lower-cased A-Z); a text of one to four
words has its whole sequence as the only one; a null, empty or wordless text has none and is linked with
nothing. Documents with equal sets form one class, so copies of any number are one node. A class's
signature takes the least hash in each of BINS ranges of the hash space (one permutation); an empty
range borrows from a range that the range's own hash sequence names (optimal densification). Bands of
the signature are bucket keys; in a bucket the most connected class and the one with the least doc_id
each get an edge to every member, so a bucket of n classes makes fewer than 2n edges. Edges are
confirmed on the full sets. Further rounds join members that a bucket's first stars left apart. Members
of a bucket that are in separate components after the last round, and none of which was a centre there,
are decided by an exact join: shingles are ordered from rare to common, and a pair of sizes x and y that
is similar has its first common shingle among those of each set that the needed overlap leaves over.

A component's id is its smallest doc_id; null doc_ids count as larger than any (a component of nulls
only has a null id). Repeated rows share a class. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from navspark.llm.common import checked, claim, documents_view, same, table, text_slices, written
from navspark.llm.exact_dedup import raw_hash
from navspark.llm.textcore import LOWER, U, Words, buffers, mix, prefix_hash, span_hash, windows

SHINGLE, BANDS, BAND_ROWS = 5, 24, 6
BINS = BANDS * BAND_ROWS
#: Linked when 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Bytes of text whose sets are made together.
SET_BYTES = 256 << 10
#: Members of a star or bucket that one group of the confirming step, or one salt of a bucket, holds, about.
STAR_ROWS = 256
#: Rounds of stars; each after the first joins only what is still apart within a bucket. The exact join decides the rest.
ROUNDS = 2
#: Shingles that a batch of the exact join's rows holds, about.
POSTINGS = 1 << 17
LARGEST = (1 << 63) - 1


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = buffers(column)
    data = LOWER[data]
    words = Words(data, offsets)
    hashes = span_hash(prefix_hash(data), words.start, words.end)
    shingles, at = windows(words, hashes, SHINGLE)
    bounds = np.searchsorted(at, words.first)
    out = []
    for i, n in enumerate(words.count.tolist()):
        if n >= SHINGLE:
            out.append(np.unique(shingles[bounds[i] : bounds[i + 1]]))
        elif n:
            value = np.array([n], U)
            for h in hashes[words.first[i] : words.first[i + 1]]:
                value = mix(value * U(0xD6E8FEB86659FD93) + h)
            out.append(value)
        else:
            out.append(np.zeros(0, U))
    return out


def set_id(shingles: np.ndarray) -> bytes | None:
    """128 bits that equal sets share."""
    if not len(shingles):
        return None
    return np.array([np.bitwise_xor.reduce(mix(shingles)), np.add.reduce(mix(shingles + U(7)))], U).tobytes()


def _borrow(attempts: int) -> np.ndarray:
    """Fixed table [attempt, bin] of the bins to borrow from."""
    k = np.arange(attempts * BINS, dtype=U) + U(0x5EED)
    return ((mix(k) >> U(32)) * U(BINS) >> U(32)).astype(np.int64).reshape(attempts, BINS)


BORROW = _borrow(64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least hash of each bin; shingles are sorted, so a bin's least is the first of its run."""
    bins = ((shingles >> U(32)) * U(BINS) >> U(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out, full = np.zeros(BINS, U), np.zeros(BINS, bool)
    out[bins[first]] = shingles[first]
    full[bins[first]] = True
    if not full.all():
        empty = np.flatnonzero(~full)
        source = BORROW[:, empty]
        pick = full[source].argmax(0)
        chosen = source[pick, np.arange(len(empty))]
        lost = ~full[chosen]  # no attempt met a full bin
        chosen[lost] = bins[first[0]]
        out[empty] = out[chosen]
    return out


def band_keys(shingles: np.ndarray) -> np.ndarray:
    sig = signature(shingles).reshape(BANDS, BAND_ROWS)
    key = np.arange(BANDS, dtype=U) + U(1)
    for k in range(BAND_ROWS):
        key = mix(key * U(0x9E3779B97F4A7C15) + sig[:, k])
    return key.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, th, n_shingles, sid (null without shingles), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near dedup", lambda: None)
        for batch in text_slices(batches, "text", SET_BYTES):
            sets = shingle_sets(batch.column(1))
            bands = [band_keys(s) if len(s) else np.zeros(0, np.int64) for s in sets]
            ends = np.cumsum([0, *map(len, bands)]).astype(np.int32)
            flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n, pa.array([set_id(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(ends, flat)], ["doc_id", "th", "n_shingles", "sid", "bands"])

    return documents_view(docs, raw_hash("text").alias("th")).mapInArrow(run, "doc_id long, th long, n_shingles long, sid binary, bands array<long>")


def class_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sid, shingles binary) for the classes in nodes (sid, rep)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near dedup", lambda: None)
        for batch in text_slices(batches, "text", SET_BYTES):
            sets = shingle_sets(batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["sid", "shingles"])

    view = documents_view(docs)
    ids = written(nodes.select(F.col("rep").alias("id")).distinct(), "near-ids")
    wanted = view.join(checked(ids), same(view, ids, {"doc_id": "id"}), "left_semi").select("doc_id", "text")
    found = wanted.mapInArrow(run, "sid binary, shingles binary")
    return found.join(checked(nodes.select("sid")), "sid", "left_semi").dropDuplicates(["sid"])


def _confirm(percent: int):
    def run(rows: pa.Table) -> pa.Table:
        members, sets = rows.column("member").to_pylist(), rows.column("shingles").to_pylist()
        centre = next((np.frombuffer(s, U) for m, s in zip(members, sets, strict=True) if m is None), None)
        good = []
        for m, s in zip(members, sets, strict=True):
            if m is not None and centre is not None:
                other = np.frombuffer(s, U)
                common = len(centre) + len(other) - len(np.union1d(centre, other))
                if 100 * common >= percent * (len(centre) + len(other) - common):
                    good.append(m)
        name = rows.column("centre")[0].as_py()
        return pa.table({"a": pa.array([name] * len(good), pa.binary()), "b": pa.array(good, pa.binary())})

    return run


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose full sets are similar. A star's members are dealt out over groups of STAR_ROWS."""
    stars = edges.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR_ROWS).cast("int").alias("salts"))
    # Only large stars need their number of groups; edges aren't shuffled by centre for it.
    large = written(stars.where("salts > 1").withColumnRenamed("a", "l_a"), "near-large")
    salted = edges.join(checked(large), edges["a"] == large["l_a"], "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    members = salted.join(sets, salted["b"] == sets["sid"]).select(F.col("a").alias("centre"), "salt", F.col("b").alias("member"), "shingles")
    centres = stars.join(sets, stars["a"] == sets["sid"]).select(F.col("a").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("binary").alias("member"), "shingles")
    return members.unionByName(centres).groupBy("centre", "salt").applyInArrow(_confirm(percent), "a binary, b binary")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(sid, label): the least ``rep`` reachable, for nodes (sid, rep) over undirected edges (a, b).

    Every round each node hooks on to the least of its neighbours and itself, hooks are followed to their ends, and edges are
    drawn anew between those. Edges that became loops or equal go, so later rounds read few of them.
    """
    at = nodes.select("sid", F.struct("rep", "sid").alias("node"))  # classes without a doc_id share a rep
    ends = edges.join(at.withColumnRenamed("node", "x"), edges["a"] == at["sid"]).drop("sid").join(at.withColumnRenamed("node", "y"), edges["b"] == at["sid"])
    drawn = lambda x, y: (F.least(x, y).alias("x"), F.greatest(x, y).alias("y"))
    left = written(ends.select(*drawn("x", "y")).where("x < y").distinct(), "near-links")
    roots = written(left.select(F.col("x").alias("node")).union(left.select("y")).distinct().select("node", F.col("node").alias("root")), "near-roots")
    while not left.isEmpty():
        hooks = left.select(F.col("y").alias("at"), F.col("x").alias("hook")).union(left.select(F.col("x").alias("at"), F.col("x").alias("hook")))
        hooks = written(hooks.groupBy("at").agg(F.min("hook").alias("hook")), "near-hooks")
        while True:  # what a node hooked on to may have hooked on to another
            end = hooks.select(F.col("at").alias("end_at"), F.col("hook").alias("end"))
            hooks = written(hooks.join(end, F.col("hook") == F.col("end_at")).select("at", F.col("end").alias("hook"), (F.col("end") < F.col("hook")).alias("moved")), "near-hooks")
            if hooks.where("moved").isEmpty():
                break
        x, y = (hooks.select(F.col("at").alias(f"{c}_at"), F.col("hook").alias(f"{c}_hook")) for c in "xy")
        left = left.join(x, left["x"] == x["x_at"]).join(y, left["y"] == y["y_at"]).select(*drawn("x_hook", "y_hook"))
        left = written(left.where("x < y").distinct(), "near-links")
        roots = written(roots.join(hooks, roots["root"] == hooks["at"], "left").select("node", F.coalesce("hook", "root").alias("root")), "near-roots")
    return roots.select(F.col("node.sid").alias("sid"), F.col("root.rep").alias("label"))


def beside(members: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
    """members (key, salt, ...) joined with facts (key, salts, ...) of their bucket; a crowded bucket is dealt out over its salts."""
    dealt = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return members.join(dealt, ["key", "salt"], how)


def stars(crowd: DataFrame, labels: DataFrame | None, tested: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Candidate edges (a, b) between centres and members of the buckets in crowd (key, salt, salts, sid, rep, company), and the centres (key, sid)."""
    members = crowd
    if labels is not None:
        members = crowd.join(labels, "sid", "left").withColumn("label", F.coalesce("label", "rep"))
        apart = members.groupBy("key").agg(F.max("salts").alias("salts"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
        members = beside(members, apart)
        # The centres are the most connected class of the component of least label and of the one of greatest label.
        best = F.struct("company", "sid", "label")
        centres = members.groupBy("key").agg(F.max("salts").alias("salts"), F.max(F.when(F.col("label") == F.col("low"), best)).alias("c"), F.max(F.when(F.col("label") == F.col("high"), best)).alias("d"))
        centres = centres.select("key", "salts", F.array("c", "d").alias("centres"))
    else:
        best, first = F.max(F.struct("company", "sid")), F.min(F.struct("rep", "sid"))
        centres = members.groupBy("key").agg(F.max("salts").alias("salts"), best.alias("c"), first.alias("d")).select("key", "salts", F.array_distinct(F.array("c.sid", "d.sid")).alias("centres"))
        centres = centres.withColumn("centres", F.transform("centres", lambda c: F.struct(c.alias("sid"))))
    pairs = beside(members, centres).withColumn("centre", F.explode("centres")).where("centre.sid <> sid")
    if labels is not None:  # one component needs no further edge; classes without a doc_id share a label without being linked
        pairs = pairs.where((F.col("centre.label") != F.col("label")) | (F.col("label") == LARGEST))
    edges = pairs.select(F.col("centre.sid").alias("a"), F.col("sid").alias("b")).distinct()
    edges = edges if tested is None else edges.join(tested, ["a", "b"], "left_anti")
    return edges, centres.select("key", F.explode("centres.sid").alias("sid"))


def undecided(crowd: DataFrame, labels: DataFrame, centres: DataFrame) -> DataFrame:
    """(sid, label) of the classes that share a bucket with one of another component, neither being a centre (key, sid) there."""
    members = crowd.join(labels, "sid", "left").select("key", "salt", "salts", "sid", F.coalesce("label", "rep").alias("label"))
    rest = members.join(centres, ["key", "sid"], "left_anti")
    apart = rest.groupBy("key").agg(F.max("salts").alias("salts"), F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"))
    # Classes without a doc_id share a label without being linked.
    apart = apart.where((F.col("low") < F.col("high")) | ((F.col("low") == LARGEST) & (F.col("n") > 1)))
    return beside(rest, apart, "left_semi").select("sid", "label").distinct()


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(s, np.int64) for s in batch.column(2).to_pylist()]
        sizes = np.array([len(s) for s in sets], np.int64)
        end = np.cumsum(sizes)
        start = 0
        while start < len(sets):
            stop = max(start + 1, int(np.searchsorted(end, end[start] - sizes[start] + POSTINGS, side="right")))
            at = pa.array(np.repeat(np.arange(start, stop), sizes[start:stop]))
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.repeat(sizes[start:stop], sizes[start:stop])), pa.array(np.concatenate(sets[start:stop]))]
            yield pa.RecordBatch.from_arrays(columns, ["sid", "label", "n", "shingle"])
            start = stop


def similar_pairs(classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate edges (a, b): every similar pair of different label among classes (sid, label), and few others.

    A similar pair of sizes x <= y has 100 x >= percent * y and at least percent * (x + y) / (100 + percent)
    common shingles. In any order of all shingles, the first common one stands so early in both sets that as
    many follow: within the first x - 2 percent * x / (100 + percent) of the smaller set (``index``), and within
    the first y - percent * y / 100 of the larger. From rare to common, those are seldom shared otherwise.
    """
    each = written(classes.join(sets, "sid").select("sid", "label", "shingles").mapInArrow(_postings, "sid binary, label long, n long, shingle long"), "near-postings")
    often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    common = each.join(often, "shingle")
    # Shingles of one set only come first in the order and pair nothing; their number is all that counts.
    order = Window.partitionBy("sid").orderBy("often", "shingle")
    ranked = common.withColumn("nth", F.row_number().over(order)).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy("sid")))
    ranked = ranked.withColumn("left", F.col("all") - F.col("nth") + 1)  # of this shingle and those after it
    ranked = ranked.where(F.col("left") * 100 >= F.col("n") * percent)
    ranked = ranked.withColumn("index", F.col("left") * (100 + percent) >= F.col("n") * 2 * percent)
    ranked = written(ranked.select("sid", "label", "n", "shingle", "left", "index"), "near-prefixes")
    # Pairs within one label need no test: of the label that most sets of a shingle have, only pairs with other labels are made.
    alone = F.when(F.col("label") == LARGEST, F.col("sid"))
    held = ranked.groupBy("shingle", "label", alone.alias("alone")).agg(F.count(F.lit(1)).alias("sets"), F.max("index").alias("index"))
    held = held.groupBy("shingle").agg(F.max(F.struct("sets", "label", "alone")).alias("main"), F.count(F.lit(1)).alias("labels"), F.max("index").alias("any")).where("labels > 1 and any")
    posted = ranked.join(held.select("shingle", "main"), "shingle")
    posted = posted.withColumn("minor", ~(F.col("label").eqNullSafe(F.col("main.label")) & alone.eqNullSafe(F.col("main.alone")))).drop("main")
    posted = written(posted, "near-posted")
    x, y = posted.where("index").alias("x"), posted.alias("y")
    needed = F.expr(f"least(x.left, y.left) * {100 + percent} >= (x.n + y.n) * {percent}")
    smaller = F.expr(f"(x.n < y.n or x.n = y.n and x.sid < y.sid) and x.n * 100 >= y.n * {percent}")
    apart = F.expr(f"x.label <> y.label or x.label = {LARGEST}")

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b, (F.col("x.shingle") == F.col("y.shingle")) & smaller & needed & apart).select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"))

    return met(x.where("x.minor"), y).union(met(x.where("not x.minor"), y.where("y.minor"))).distinct()


def clusters(docs: DataFrame, percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, th, n_shingles, component_id of every row."""
    rows = written(signatures(docs), "near-signatures")
    rows = rows.withColumn("rank_id", F.coalesce("doc_id", F.lit(LARGEST)))
    classes = written(rows.where("sid is not null").groupBy("sid").agg(F.min("rank_id").alias("rep"), F.max("bands").alias("bands")), "near-classes")
    keys = classes.select("sid", "rep", F.explode("bands").alias("key"))
    full = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    crowd = written(keys.join(full, "key"), "near-crowd")
    company = crowd.groupBy("sid").agg(F.sum("members").alias("company"))
    salts = F.ceil(F.col("members") / STAR_ROWS).cast("int")
    crowd = crowd.join(company, "sid").select("key", F.pmod(F.xxhash64("sid"), salts).cast("int").alias("salt"), salts.alias("salts"), "sid", "rep", "company")
    crowd = written(crowd, "near-company")
    nodes = written(crowd.groupBy("sid").agg(F.first("rep").alias("rep")), "near-nodes")
    as_id = F.when(F.col("rep") != LARGEST, F.col("rep"))
    sets = written(class_sets(docs, nodes.select("sid", as_id.alias("rep"))), "near-sets")
    labels = links = tested = centres = None
    for _ in range(rounds):
        edges, middle = stars(crowd, labels, tested)
        edges, middle = written(edges, "near-edges"), written(middle, "near-centres")
        centres = middle if centres is None else centres.unionByName(middle)
        if edges.isEmpty():
            break
        good = written(confirmed(edges, sets, percent), "near-good")
        if links is not None and good.isEmpty():
            break
        links = good if links is None else links.unionByName(good)
        tested = edges if tested is None else tested.unionByName(edges)
        labels = components(nodes, links)
    if labels is not None:
        rest = written(undecided(crowd, labels, centres), "near-rest")
        if not rest.isEmpty():
            edges = similar_pairs(rest, sets, percent)
            edges = edges.join(tested, ["a", "b"], "left_anti").join(tested.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")
            good = written(confirmed(written(edges, "near-edges"), sets, percent), "near-good")
            if not good.isEmpty():
                labels = components(nodes, links.unionByName(good))
    named = classes.select("sid", "rep")
    if labels is not None:
        named = named.join(labels, "sid", "left").select("sid", F.coalesce("label", "rep").alias("rep"))
    label = F.coalesce(F.col("rep"), F.col("rank_id"))
    return rows.join(named, "sid", "left").select("doc_id", "th", "n_shingles", F.when(label != LARGEST, label).alias("component_id"))


def drop_near_copies(docs: DataFrame, percent: int = 80, rounds: int = ROUNDS) -> DataFrame:
    """The rows of docs that stay, one of each component, with all their columns."""
    found = clusters(docs, percent, rounds)
    alone = F.col("doc_id").eqNullSafe(F.col("component_id"))
    # A component whose doc_ids are all null keeps the row of least text hash; of rows that repeat doc_id and text, one stays.
    groups = found.groupBy("doc_id", "th").agg(F.max("n_shingles").alias("n"), F.max("component_id").alias("component_id"), F.count(F.lit(1)).alias("copies"))
    gone = written(groups.where((~alone & (F.col("n") > 0)) | (F.col("copies") > 1)).select("doc_id", "th", alone.alias("kept")), "near-gone")
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), raw_hash("text").alias("th"))
    pair = same(packed, gone, {"doc_id": "doc_id", "th": "th"})
    single = packed.join(checked(gone), pair, "left_anti").select("row.*")
    nth = F.row_number().over(Window.partitionBy("doc_id", "th").orderBy(F.xxhash64("row")))
    again = packed.join(checked(gone.where("kept")), pair, "left_semi").withColumn("nth", nth).where("nth = 1").select("row.*")
    return single.unionByName(again)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
