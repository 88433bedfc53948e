"""Ranked lexical search of all documents for each of a set of queries, exactly, by an index of two levels.

Documents lie in blocks. A block's first level has, for each term, the block's documents that hold it and one byte
each: their impact rounded up to a multiple of STEP. Its second level has the exact counts. A query's sum of
bytes, weighted, is an upper bound of a document's score, and less than STEP times the query's weights above it. So
the TOP-th greatest upper bound over all blocks less that is a lower bound of the TOP-th best score, and
every document whose upper bound reaches it is scored again from the second level in exact 64-bit integers.
Of a block's documents only the TOP best can be among the TOP best of all, so a block gives no more,
however many copies tie.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. A document's impact of a term is
(1000000000 * tf) div (1000 * tf + 12 * m) with m = 75 + (25 * n * N) div L; a term weighs floor(1000 * ln((2 * N + 2) / (2 * df + 1))).
A score is the sum of weight times impact over the query's terms, repeats included. Ranks are by falling score, then doc_id, nulls last.

Null and empty texts have no terms: such a document is never found and such a query finds nothing. Repeated document rows are
documents of their own; query rows that repeat id and text are one query. Queries are taken in blocks of about
QUERIES rows and QUERY_BYTES, each against all documents; the index holds the terms of its queries. No document with a score above 0 gives
no row. Other columns are ignored, empty tables give an empty result, whole texts are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from navspark.llm.common import claim, documents_view, table, text_slices, written

TOP = 20
#: An impact is less than a million, and 255 steps are no less.
STEP = 3922
#: Documents of a block; queries, and bytes of queries, that are searched together, about.
BLOCK, QUERIES, QUERY_BYTES = 4_096, 2_000, 8 << 20
#: Bytes of text that are taken apart together; partial results of so many tasks meet first.
PART, MEET = 1 << 20, 64
LARGEST = (1 << 63) - 1


def _fold() -> bytes:
    """Each byte's lower-case form if it belongs to a term, else a space."""
    own = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]
    return bytes(ord(chr(b).lower()) if b < 0x80 and b in own else b if b in own else 0x20 for b in range(256))


FOLD = _fold()


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def counted(docs: DataFrame, place: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms of the document), terms (numbers of those in place, ascending), tfs; of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("search", lambda: None)
        number = shared.value.get
        for batch in text_slices(batches, "text", PART):
            n, terms, tfs, ends = [], [], [], [0]
            for text in batch.column(1).to_pylist():
                found = terms_of(text)
                n.append(len(found))
                tf = Counter(map(number, found))
                tf.pop(None, None)
                own = sorted(tf)
                terms += own
                tfs += map(tf.__getitem__, own)
                ends.append(len(terms))
            listed = lambda x, ends=ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), listed(terms), listed(tfs)], ["doc_id", "n", "terms", "tfs"])

    return documents_view(docs).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def impacts(tf: np.ndarray, n: np.ndarray, all_docs: int, all_terms: int) -> np.ndarray:
    """Exact impacts of terms that occur tf times in documents of n terms."""
    m = 75 + (25 * n * all_docs) // all_terms
    return (1_000_000_000 * tf) // (1_000 * tf + 12 * m)


INDEX = "doc_ids array<long>, lengths array<long>, terms array<int>, ends array<int>, members binary, bytes binary, tfs array<int>"


def indexed(counts: DataFrame, all_docs: int, all_terms: int) -> DataFrame:
    """INDEX, a row for each block: its documents, their lengths, its terms, where each one's postings end, and the postings:
    number of the document in the block (16 bits), impact rounded up (8 bits), count (second level)."""

    def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(rows).combine_chunks()
        doc_ids, n, terms, tfs = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in rows.columns)
        ends = np.diff(terms.offsets.to_numpy())
        doc = np.repeat(np.arange(len(n)), ends)
        term, tf, n = terms.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.int64), n.to_numpy()
        order = np.argsort(term, kind="stable")
        term, tf, doc = term[order], tf[order], doc[order]
        up = -(-impacts(tf, n[doc], all_docs, all_terms) // STEP)
        cut = np.flatnonzero(np.diff(term, append=-1)) + 1
        one = lambda x, kind: pa.array([x], kind)
        ids = pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids)
        return pa.RecordBatch.from_arrays([ids, one(n, pa.list_(pa.int64())), one(term[cut - 1], pa.list_(pa.int32())), one(cut, pa.list_(pa.int32())), one(doc.astype(np.uint16).tobytes(), pa.binary()), one(up.astype(np.uint8).tobytes(), pa.binary()), one(tf, pa.list_(pa.int32()))], ["doc_ids", "lengths", "terms", "ends", "members", "bytes", "tfs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("search", lambda: None)
        held, n = [], 0
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                part = batch.slice(start, BLOCK - n)
                held.append(part)
                n, start = n + part.num_rows, start + part.num_rows
                if n == BLOCK:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)

    return counts.mapInArrow(run, INDEX)


class Block:
    def __init__(self, columns: dict):
        self.terms, self.ends = (np.asarray(columns[c].values) for c in ("terms", "ends"))
        self.members, self.bytes = np.frombuffer(columns["members"].as_py(), np.uint16), np.frombuffer(columns["bytes"].as_py(), np.uint8).astype(np.int64)
        self.size = len(columns["lengths"].values)
        self.columns = columns

    def postings(self, query: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(weight, begin, end) of the query's terms that the block has; query: (term, weight times repeats)."""
        terms = np.array([t for t, _ in query])
        at = np.minimum(self.terms.searchsorted(terms), len(self.terms) - 1) if len(self.terms) else np.zeros(0, int)
        return [(w, int(self.ends[k - 1]) if k else 0, int(self.ends[k])) for (t, w), k in zip(query, at.tolist(), strict=False) if self.terms[k] == t]

    def bounds(self, postings: list[tuple[int, int, int]]) -> np.ndarray:
        """Each document's upper bound, in steps."""
        out = np.zeros(self.size, np.int64)
        for w, a, b in postings:
            out[self.members[a:b]] += w * self.bytes[a:b]
        return out

    def exact(self, postings: list[tuple[int, int, int]], chosen: np.ndarray, all_docs: int, all_terms: int) -> np.ndarray:
        """Scores of the chosen documents, from the second level."""
        tfs, n = np.asarray(self.columns["tfs"].values), np.asarray(self.columns["lengths"].values)
        place = np.full(self.size, -1)
        place[chosen] = np.arange(len(chosen))
        out = np.zeros(len(chosen), np.int64)
        for w, a, b in postings:
            mine = np.flatnonzero(place[self.members[a:b]] >= 0) + a
            doc = self.members[mine]
            out[place[doc]] += w * impacts(tfs[mine].astype(np.int64), n[doc], all_docs, all_terms)
        return out

    def ids(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """doc_ids of the chosen documents and whether each is null."""
        ids = self.columns["doc_ids"].values.take(pa.array(chosen))
        return ids.fill_null(LARGEST).to_numpy(), np.asarray(ids.is_null())


def _blocks(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[Block]:
    claim("search", lambda: None)
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block({c: batch.column(k)[i] for k, c in enumerate(names)})


def greatest(rows: DataFrame, order: list[Column], by: str = "query") -> DataFrame:
    """The TOP first rows of each query; what a few tasks gave meets first, so no group holds what all tasks gave."""
    salt = F.pmod(F.spark_partition_id(), F.lit(MEET))
    some = rows.withColumn("salt", salt).withColumn("nth", F.row_number().over(Window.partitionBy(by, "salt").orderBy(*order))).where(F.col("nth") <= TOP).drop("salt", "nth")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= TOP)


def best_of(docs: DataFrame, queries: list[str | None]) -> DataFrame | None:
    """query (place in the list), rank, doc_id, score; None where nothing is found."""
    spark = docs.sparkSession
    asked = [Counter(terms_of(q)) for q in queries]
    place = {t: k for k, t in enumerate(sorted({t for q in asked for t in q}))}
    counts = written(counted(docs, place), "search-counts")
    whole = counts.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
    if not place or not whole["docs"]:
        return None
    all_docs, all_terms = whole["docs"], whole["terms"]
    found = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()  # at most the queries' terms
    df = np.zeros(len(place), np.int64)
    df[found.column("term").to_numpy()] = found.column("df").to_numpy()
    weight = np.floor(1000 * np.log((2 * all_docs + 2) / (2 * df + 1))).astype(np.int64)
    plans = [sorted((place[t], int(weight[place[t]]) * n) for t, n in q.items() if df[place[t]]) for q in asked]
    index = written(indexed(counts, all_docs, all_terms), "search-index")
    shared = spark.sparkContext.broadcast(plans)
    first = ["lengths", "terms", "ends", "members", "bytes"]

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros(0, np.int64) for _ in shared.value]
        for block in _blocks(batches, first):
            for k, plan in enumerate(shared.value):
                up = block.bounds(block.postings(plan))
                if len(up) > TOP:
                    up = np.partition(up, -TOP)[-TOP:]
                best[k] = np.sort(np.concatenate([best[k], up]))[-TOP:]
        for k, up in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(up), k, np.int32)), pa.array(up)], ["query", "bound"])

    bounds = greatest(index.select(*first).mapInArrow(bound, "query int, bound long"), [F.desc("bound")])
    least = np.zeros(len(plans), np.int64)
    for r in bounds.where(F.col("rank") == TOP).collect():  # at most one row a query
        # The TOP greatest bounds' documents score more than this, at least; a score is above 0.
        least[r["query"]] = max(0, r["bound"] - sum(w for _, w in plans[r["query"]]))
    limits = spark.sparkContext.broadcast(least)

    def rescore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, [*first, "doc_ids", "tfs"]):
            for k, plan in enumerate(shared.value):
                postings = block.postings(plan)
                chosen = np.flatnonzero(block.bounds(postings) >= max(1, limits.value[k]))
                if len(chosen):
                    score = block.exact(postings, chosen, all_docs, all_terms)
                    ids, null = block.ids(chosen)
                    order = np.lexsort((ids, null, -score))[:TOP]
                    order = order[score[order] > 0]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(order), k, np.int32)), pa.array(ids[order], mask=null[order]), pa.array(score[order])], ["query", "doc_id", "score"])

    exact = index.select(*first, "doc_ids", "tfs").mapInArrow(rescore, "query int, doc_id long, score long")
    return greatest(exact, [F.desc("score"), F.asc_nulls_last("doc_id")]).select("query", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, most: int = QUERIES) -> DataFrame:
    """item_id, rank, doc_id, score for items (item_id, text)."""
    spark = docs.sparkSession
    asked = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // most), -(-size["bytes"] // QUERY_BYTES))
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for number in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).orderBy("item_id", "text").collect()
        if rows and (found := best_of(docs, [r["text"] for r in rows])) is not None:
            names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(rows)], f"query int, item_id {kind}")
            out = out.unionByName(found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return out


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
with d as (select row_number() over () as r, doc_id, {_TERMS.format("text")} as terms from documents),
a as (select count(*) as nn, sum(len(terms))::bigint as ll from d where len(terms) > 0),
p as (select r, doc_id, len(terms)::bigint as n, unnest(terms) as term from d),
t as (select r, doc_id, n, term, count(*)::bigint as tf from p group by all),
f as (select term, floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)::double))::bigint as w from t, a group by term, nn),
q as (select item_id, unnest({_TERMS.format("text")}) as term from benchmark),
s as (select item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))))::bigint as score
      from q join f using (term) join t using (term), a group by item_id, r, doc_id),
o as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::integer as rank, doc_id, score from s where score > 0)
select item_id, rank, doc_id, score from o where rank <= {TOP}"""
