"""Chunks, tokens, postings and BM25."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from navspark.functions.paths import snippet
from navspark.sources.corpus import documents_as_files, table
from navspark.sources.scratch import saved

LINES, STRIDE = 80, 70
K1, B = 1.2, 0.75
#: Query terms or passages that may be broadcast, or held by a worker, at once.
AT_ONCE = 500_000
#: Rows whose texts a worker takes apart at once, and pairs of a query and a row, about, that it scores at once.
ROWS, PAIRS = 512, 1 << 20
#: Stands for a null key, behind all others.
NO_KEY = (1 << 63) - 1
TOKEN, ASCII_TOKEN = regex.compile(r"[\p{L}\p{N}]+"), re.compile("[0-9a-z]+")


def _plain_letters() -> tuple[str, str]:
    """The letters of the Latin blocks that Unicode decomposes into a letter and marks, and those letters."""
    base = {c: unicodedata.normalize("NFD", c) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)])}
    found = [(c, d[0]) for c, d in base.items() if len(d) > 1 and all(unicodedata.combining(m) for m in d[1:])]
    return "".join(c for c, _ in found), "".join(d for _, d in found)


MARKED, PLAIN = _plain_letters()


def chunks(files: DataFrame, key: str = "path") -> DataFrame:
    """Windows of 80 lines that overlap by 10: key, ordinal, start_line, end_line, text. The last ends with the file."""
    lines = files.select(key, F.split("text", r"\r?\n").alias("lines")).withColumn("n", F.size("lines"))
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - 11, F.lit(0)), F.lit(STRIDE))
    each = lines.select(key, "lines", "n", F.posexplode(starts).alias("ordinal", "start"))
    return each.select(key, F.col("ordinal").cast("long"), (F.col("start") + 1).cast("long").alias("start_line"), F.least(F.col("start") + LINES, F.col("n")).cast("long").alias("end_line"), F.array_join(F.slice("lines", F.col("start") + 1, LINES), "\n").alias("text"))


def folded(text) -> F.Column:
    """Lower-cased text without marks; only texts beyond ASCII are searched for marks."""
    low = F.lower(text)
    plain = F.regexp_replace(F.translate(low, MARKED, PLAIN), "[\u0300-\u036f]", "")
    return F.when(F.char_length(low) == F.octet_length(low), low).otherwise(plain)


def tokens(text) -> F.Column:
    """Runs of letters and digits, lower-cased, without marks."""
    return F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def postings(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, term, tf, length (tokens of the row)."""
    listed = rows.select(key, tokens(F.col(text)).alias("terms")).withColumn("length", F.size("terms").cast("long"))
    return listed.select(key, "length", F.explode("terms").alias("term")).groupBy(key, "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(index: DataFrame, queries: DataFrame, key: str, query: str, stats: DataFrame) -> DataFrame:
    """query, key, score (higher is better) of rows that share a term; queries: (query, term), distinct; stats: one row (n, average)."""
    frequency = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    hits = index.join(queries.join(frequency, "term"), "term").crossJoin(F.broadcast(stats))
    part = F.when(weight > 0, weight).otherwise(1e-6) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average")))
    return hits.groupBy(query, key).agg(F.round(F.sum(part), 6).alias("score"))


def term_counts(docs: DataFrame, key: str, only: list[str] | None = None) -> DataFrame:
    """key, length (tokens), terms, tfs of every row of docs (key, text), of the terms in ``only`` if it is given; null counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(None if only is None else frozenset(only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                lengths, ends, terms, tfs = [], [0], [], []
                for text in part.column(1).to_pylist():
                    words = ASCII_TOKEN.findall(text) if text.isascii() else TOKEN.findall(text)
                    found = Counter(words)
                    mine = [w for w in found if wanted is None or w in wanted]
                    terms += mine
                    tfs += [found[w] for w in mine]
                    lengths.append(len(words))
                    ends.append(len(terms))
                listed = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values) for values in (pa.array(terms, pa.string()), pa.array(tfs, pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths, pa.int64()), *listed], [key, "length", "terms", "tfs"])

    view = docs.select(key, folded(F.coalesce("text", F.lit(""))).alias("text"))
    return view.mapInArrow(run, f"`{key}` {view.schema[key].dataType.simpleString()}, length long, terms array<string>, tfs array<long>")


class Best:
    """The ``most`` best (query, key, score) among the rows seen, ties by key, nulls last."""

    def __init__(self, queries: int, most: int):
        self.most, self.least = most, np.full(queries, -1.0)
        self.query, self.key, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, query: np.ndarray, key: np.ndarray, score: np.ndarray) -> None:
        near = score >= self.least[query]
        query, key, score = (np.concatenate([a, b[near]]) for a, b in ((self.query, query), (self.key, key), (self.score, score)))
        order = np.lexsort((key, -score, query))
        query, key, score = query[order], key[order], score[order]
        first = np.searchsorted(query, query)
        nth = np.arange(len(query)) - first
        last = nth == self.most - 1
        self.least[query[last]] = score[last]
        kept = nth < self.most
        self.query, self.key, self.score = query[kept], key[kept], score[kept]


def best_matches(docs: DataFrame, queries: DataFrame, key: str, query: str, most: int) -> DataFrame:
    """query, key (a long), score, rank (from 1) of the ``most`` rows of docs (key, text) that BM25 ranks best for each of queries (query, term); ties by key.

    Texts are taken apart once: the counts of the queries' terms are dealt out by key and kept. Each task scores its rows in
    slices and passes on its own best of each query, so no pair of a query and a row is shuffled.
    """
    queries = saved(queries.distinct(), "query-terms")
    terms = queries.select("term").distinct()
    only = [r[0] for r in terms.collect()] if terms.count() <= AT_ONCE else None
    # Rows that share a key are scored as one; of one length, their terms are counted together.
    counted = saved(term_counts(docs, key, only).groupBy(key).agg(F.collect_list(F.struct("length", "terms", "tfs")).alias("parts")), "term-counts")
    stats = counted.select(F.inline("parts")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("all")).first()
    rows, average = stats["n"], (stats["all"] or 0) / max(1, stats["n"])
    several = "array_distinct(flatten(transform(parts, p -> transform(p.terms, t -> named_struct('length', p.length, 'term', t))))).term"
    frequency = counted.select(F.expr(f"explode(if(size(parts) = 1, parts[0].terms, {several}))").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    uses = saved(queries.join(frequency, "term"), "query-uses")
    blocks = max(1, -(-uses.count() // AT_ONCE))
    kind = queries.schema[query].dataType.simpleString()

    def block(number: int) -> DataFrame:
        mine = uses.where(F.pmod(F.xxhash64(query), F.lit(blocks)) == number).select(query, "term", "df").collect()  # at most about AT_ONCE rows
        names = list(dict.fromkeys(r[0] for r in mine))
        place, by_term = {q: i for i, q in enumerate(names)}, {}
        for q, term, df in mine:
            by_term.setdefault(term, (df, []))[1].append(place[q])
        number_of = {t: i for i, t in enumerate(by_term)}
        weights = np.array([max(0.0, math.log((rows - df + 0.5) / (df + 0.5))) or 1e-6 for df, _ in by_term.values()])
        starts = np.cumsum([0, *(len(q) for _, q in by_term.values())])
        used = np.array([q for _, of in by_term.values() for q in of], np.int64)
        shared = docs.sparkSession.sparkContext.broadcast((number_of, weights, starts, used, len(names)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number_of, weights, starts, used, n = shared.value
            best = Best(n, most)
            many = np.diff(starts)

            def score(keys: list[int], flat: list[tuple[int, int, int, int]]) -> None:
                row, ids, tfs, lengths = np.array(flat, np.int64).reshape(-1, 4).T
                part = weights[ids] * (tfs * (K1 + 1) / (tfs + K1 * (1 - B + B * lengths / average)))
                each = many[ids]
                use = np.repeat(starts[ids] - np.cumsum(each) + each, each) + np.arange(each.sum())
                pair = np.repeat(row, each) * n + used[use]
                total = np.bincount(pair, np.repeat(part, each), len(keys) * n)
                pair = np.flatnonzero(np.bincount(pair, minlength=len(keys) * n))
                best.add(pair % n, np.array(keys, np.int64)[pair // n], np.floor(total[pair] * 1e6 + 0.5) / 1e6)

            keys, flat, held = [], [], 0
            for batch in batches:
                for name, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found: dict[tuple[int, int], int] = {}
                    for p in parts:
                        for term, tf in zip(p["terms"], p["tfs"], strict=True):
                            if (i := number_of.get(term)) is not None:
                                found[i, p["length"]] = found.get((i, p["length"]), 0) + tf
                    flat += [(len(keys), i, tf, length) for (i, length), tf in found.items()]
                    keys.append(NO_KEY if name is None else name)
                    held += n + sum(int(many[i]) for i, _ in found)
                    if held >= PAIRS:
                        score(keys, flat)
                        keys, flat, held = [], [], 0
            if keys and n:
                score(keys, flat)
            found = pa.array(best.key, pa.int64(), mask=best.key == NO_KEY)
            yield pa.RecordBatch.from_arrays([pa.array(best.query), found, pa.array(best.score)], ["nth", key, "score"])

        named = docs.sparkSession.createDataFrame(list(enumerate(names)), f"nth long, `{query}` {kind}")
        return counted.mapInArrow(run, f"nth long, `{key}` long, score double").join(F.broadcast(named), "nth").drop("nth")

    hits = block(0)
    for number in range(1, blocks):
        hits = hits.unionByName(block(number))
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), F.asc_nulls_last(key)))
    return hits.withColumn("rank", place.cast("long")).where(F.col("rank") <= most)


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return best_matches(docs, queries, "doc_id", "item_id", 5)


def q_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_as_files(table(spark, sf_dir, "documents")).select("doc_id", "path", "language", "size", "hash")


def q_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(table(spark, sf_dir, "documents"), "doc_id")


def q_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", snippet(F.col("text")).alias("snippet"))


def q_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(table(spark, sf_dir, "documents"), "doc_id").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


def q_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("item_id", "doc_id", "rank", "score")


def relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, doc_id) where the document holds the passage: each text is searched once for a block of passages by an Aho-Corasick automaton."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage")).where("passage <> ''")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    blocks = max(1, -(-items.count() // AT_ONCE))

    def block(number: int) -> DataFrame:
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number).collect()  # at most about AT_ONCE rows
        shared = spark.sparkContext.broadcast([(r["item_id"], r["passage"]) for r in rows])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            by_text: dict[str, list[int]] = {}
            for item, passage in shared.value:
                by_text.setdefault(passage, []).append(item)
            automaton = ahocorasick.Automaton()
            for passage, ids in by_text.items():
                automaton.add_word(passage, ids)
            if by_text:
                automaton.make_automaton()
            for batch in batches:
                pairs = [(item, doc) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if by_text for item in {i for _, ids in automaton.iter(text) for i in ids}]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["item_id", "doc_id"])

        return docs.mapInArrow(run, "item_id long, doc_id long")

    found = block(0)
    for number in range(1, blocks):
        found = found.unionByName(block(number))
    return found.distinct()


def q_retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per passage that some document holds: expected, found among the best five, reciprocal rank of the first."""
    truth = relevant(spark, sf_dir)
    best = _ranked(spark, sf_dir).select("item_id", "doc_id", "rank")
    each = truth.join(best, ["item_id", "doc_id"], "left").groupBy("item_id").agg(F.count(F.lit(1)).alias("expected"), F.count("rank").alias("found"), F.min("rank").alias("first"))
    return each.select("item_id", "expected", "found", F.round(F.col("found") / F.col("expected"), 6).alias("recall"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("rr"), (F.coalesce("first", F.lit(0)) == 1).alias("top1"))


_TOKENS = "regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+')"
_BM25 = f"""
d as (select doc_id, {_TOKENS} as terms from documents),
i as (select doc_id, len(terms) as length, unnest(terms) as term from d),
p as (select doc_id, length, term, count(*) as tf from i group by all),
s as (select count(*) as n, sum(len(terms)) / count(*) as average from d),
f as (select term, count(*) as df from p group by term),
q as (select distinct item_id, unnest({_TOKENS}) as term from benchmark),
h as (select item_id, doc_id, round(sum(case when ln((n - df + 0.5) / (df + 0.5)) > 0 then ln((n - df + 0.5) / (df + 0.5)) else 1e-6 end
      * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * length / average))), 6) as score
      from q join f using (term) join p using (term), s group by item_id, doc_id),
r as (select item_id, doc_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, score from h)"""

SQL = {
    "files": "select doc_id, 'docs/' || source || '/' || lang || '/' || doc_id || '.txt' as path, 'txt' as language, strlen(text) as size, sha256(text) as hash from documents",
    "chunks": """
with l as (select doc_id, regexp_split_to_array(text, '\\r?\\n') as lines from documents),
     s as (select doc_id, lines, len(lines) as n, unnest(range(0, greatest(len(lines) - 11, 0) + 1, 70)) as start from l)
select doc_id, start // 70 as ordinal, start + 1 as start_line, least(start + 80, n) as end_line, array_to_string(lines[start + 1:start + 80], chr(10)) as text from s""",
    "snippets": """
with t as (select conv_id, turn, trim(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(13) || chr(9)) as b from conversations)
select conv_id, turn, case when length(b) > 700 then rtrim(substr(b, 1, 699), ' ' || chr(10) || chr(13) || chr(9)) || '…' else b end as snippet from t""",
    "terms": f"with t as (select doc_id, unnest({_TOKENS}) as term from documents) select term, count(distinct doc_id) as df, count(*) as tf from t group by term",
    "bm25": f"with {_BM25} select item_id, doc_id, rank, score from r where rank <= 5",
    "retrieval_quality": f"""with {_BM25},
t as (select item_id, doc_id from benchmark b join documents d on contains(d.text, b.text)),
e as (select item_id, count(*) as expected, count(rank) as found, min(rank) as first from t left join (select * from r where rank <= 5) using (item_id, doc_id) group by item_id)
select item_id, expected, found, round(found / expected, 6) as recall, round(coalesce(1.0::double / first, 0), 6) as rr, coalesce(first, 0) = 1 as top1 from e""",
}
QUERIES = {"files": q_files, "chunks": q_chunks, "snippets": q_snippets, "terms": q_terms, "bm25": q_bm25, "retrieval_quality": q_retrieval_quality}
