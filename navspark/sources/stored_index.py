"""A stored, versioned index of a file corpus: files, chunks, symbols, positional postings and reference edges.

Rows are dealt into buckets by a hash of their path. An update finds the files that were inserted, changed or
deleted, writes the buckets that hold any of them anew into a folder of its own, and commits by renaming one
manifest into place; the manifest says which folder holds each bucket of each table. Readers keep the manifest
they began with. An update that dies before its rename leaves the version before it readable and nothing else but a folder that
``vacuum`` removes. Of two updates that began from the same version the second to commit fails with ``Conflict``.
An update that changes nothing writes nothing.

All tables of a path lie in the same bucket, so replacing or deleting a file replaces or deletes its chunks,
symbols, postings and references with it. Edges are resolved over all files, since a new file may be
what another file's reference meant.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from navspark.functions.paths import normalize_prefix, under
from navspark.operators.code import is_project, references, resolved, symbols
from navspark.operators.match import positional
from navspark.operators.structure import structured_chunks
from navspark.operators.text_index import chunks as fixed_windows
from navspark.sources.corpus import documents_as_files, table
from navspark.sources.scratch import shared_dir

#: Raised whenever stored rows would be made in another way: an index of another format is made anew.
FORMAT = 1
#: Bytes of text that a bucket holds, about, when an index is first made.
BUCKET_BYTES = 256 << 20
#: Bytes of text that an update deals to a task, about, and of stored files that a task reads: what a task sorts stays in its memory.
PIECE_BYTES, READ_BYTES = 32 << 20, 16 << 20
#: Paths that an update broadcasts at once, and rows of a number and a flag.
PATHS_AT_ONCE, FLAGS_AT_ONCE = 500_000, 2_000_000
FILE_COLUMNS = ["path", "language", "size", "hash", "modified_ms", "text"]
WITH_SYMBOLS = ["typescript", "javascript", "py", "python", "c", "cpp", "java", "go", "rs", "kt", "rb", "php", "markdown"]
CHUNK_COLUMNS, SYMBOL_COLUMNS = ["path", "language", "kind", "text"], ["path", "name", "kind", "signature"]
_TERMS = "path string, ordinal long, length long, column string, term string, positions array<int>"
TABLES = {
    "files": "path string, language string, size long, hash string, modified_ms double, indexed_at timestamp",
    "chunks": "path string, ordinal long, start_line long, end_line long, kind string, language string, text string",
    "symbols": "path string, ordinal long, name string, kind string, start_line long, end_line long, signature string",
    "chunk_terms": _TERMS,
    "symbol_terms": _TERMS,
    "references": "src string, kind string, specifier string, line long, choice int, dst string",
    "edges": "src string, dst string, kind string, specifier string, line long",
}


@contextmanager
def small_reads(spark: SparkSession) -> Iterator[None]:
    """Tasks that begin within read READ_BYTES of files at most."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(READ_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Tables of rows that were dealt out otherwise while they were made.
SHUFFLED = ("symbols", "symbol_terms", "edges")


class Conflict(RuntimeError):
    """Another update committed first."""


def chunk_rows(files: DataFrame) -> DataFrame:
    kind = F.when(F.col("kind") == "section", "markdown").otherwise(F.col("kind"))
    return structured_chunks(files, languages=True).select("path", "ordinal", "start_line", "end_line", kind.alias("kind"), "language", "text")


def symbol_rows(files: DataFrame) -> DataFrame:
    """The ordinal is a symbol's line, the first of its kind and name there."""
    found = symbols(files.where(F.col("language").isin(WITH_SYMBOLS)))
    return found.select("path", F.col("line").alias("ordinal"), "name", "kind", F.col("line").alias("start_line"), F.col("line").alias("end_line"), "signature").dropDuplicates(["path", "ordinal"])


def derived(files: DataFrame) -> dict[str, DataFrame]:
    """What an index stores for files (path, language, size, hash, modified_ms, text), but for the edges."""
    chunks, names = chunk_rows(files), symbol_rows(files)
    return {
        "files": files.select("path", "language", "size", "hash", "modified_ms", F.current_timestamp().alias("indexed_at")),
        "chunks": chunks,
        "symbols": names,
        "chunk_terms": positional(chunks, ["path", "ordinal"], CHUNK_COLUMNS),
        "symbol_terms": positional(names, ["path", "ordinal"], SYMBOL_COLUMNS),
        "references": references(files),
    }


@dataclass
class Version:
    number: int = 0
    buckets: int = 0
    #: table: bucket: the folder of the update that wrote it.
    places: dict[str, dict[str, str]] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)
    meta: dict[str, str | None] = field(default_factory=dict)
    format: int = FORMAT


class StoredIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- versions

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("manifest") if n.endswith(".json") and n[:-5].isdigit()]

    def current(self, number: int | None = None) -> Version:
        """The last committed version, or the one named; an empty one where nothing was committed."""
        known = self.versions()
        if not known:
            return Version()
        stream = self._fs.open(self._path(f"{self.root}/manifest/{number or known[-1]:012d}.json"))
        try:
            return Version(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def table(self, name: str, version: Version | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table of a version; of the named buckets only, where they are known."""
        places = (version or self.current()).places.get(name, {})
        paths = [f"{self.root}/data/{at}/{name}/bucket={b}" for b, at in sorted(places.items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name])

    def bucket_of(self, paths: list[str], version: Version) -> list[int]:
        """The buckets of a few paths."""
        if not paths:
            return []
        rows = self.spark.createDataFrame([(p,) for p in paths], "path string")
        return sorted(r[0] for r in rows.select(self._bucket(version.buckets)).distinct().collect())

    @staticmethod
    def _bucket(n: int, path: str = "path"):
        return F.pmod(F.xxhash64(path), F.lit(n)).cast("int").alias("bucket")

    # ---- updates

    def changes(self, files: DataFrame, version: Version, prefix: str = "", complete: bool = True, force: bool = False) -> DataFrame:
        """path, action (insert, update, delete) that take a version to files (path, hash, modified_ms, ...).

        A file is unchanged if its hash and its rounded time are; nothing is deleted after an incomplete scan, nor outside the prefix.
        """
        return self._changes(files, version, prefix, complete, force).select("path", "action")

    def _changes(self, files: DataFrame, version: Version, prefix: str, complete: bool, force: bool) -> DataFrame:
        """``changes`` and the new size."""
        clean = normalize_prefix(prefix)
        old = self.table("files", version).where(under(F.col("path"), clean)).select("path", F.col("hash").alias("old_hash"), F.round("modified_ms").alias("old_time"))
        new = files.select("path", "hash", F.round("modified_ms").alias("time"), "size")
        same = F.col("old_hash").eqNullSafe(F.col("hash")) & F.col("old_time").eqNullSafe(F.col("time")) & F.lit(not force)
        met = old.withColumn("stored", F.lit(True)).join(new.withColumn("seen", F.lit(True)), "path", "full_outer")
        action = F.when(F.col("stored").isNull(), "insert").when(F.col("seen").isNull(), "delete" if complete else "keep").when(same, "keep").otherwise("update")
        return met.select("path", action.alias("action"), "size").where("action <> 'keep'")

    def update(self, files: DataFrame, prefix: str = "", complete: bool = True, head: str | None = None, buckets: int | None = None) -> dict:
        """Takes the index to files (path, language, size, hash, modified_ms, text) below the prefix; says what was done."""
        began = self.current()
        forced = began.number > 0 and began.format != FORMAT
        base = Version(number=began.number) if forced and not prefix else began
        clean = normalize_prefix(prefix)
        files = files.where(under(F.col("path"), clean))
        if not base.buckets:
            size = files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
            base.buckets = buckets or max(8, -(-size // BUCKET_BYTES))
        place = uuid.uuid4().hex
        staged = f"{self.root}/data/{place}"
        changes = self._changes(files, base, clean, complete, forced).withColumn("bucket", self._bucket(base.buckets))
        changes.write.parquet(f"{staged}/changes")
        changes = self.spark.read.schema("path string, action string, size long, bucket int").parquet(f"{staged}/changes")
        rows = changes.groupBy("bucket", "action").agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).collect()  # at most three rows a bucket
        done = {a: sum(r["count"] for r in rows if r["action"] == a) for a in ("insert", "update", "delete")}
        scope = f":{clean}" if clean else ""
        meta = {**began.meta, f"indexed_head{scope}": head, f"index_format{scope}": str(FORMAT)}
        report = {"indexed": done["insert"] + done["update"], "removed": done["delete"], "version": began.number}
        if not rows and began.number and {k: v for k, v in began.meta.items() if k in meta} == meta:
            self._fs.delete(self._path(staged), True)
            return report
        places = {name: dict(of) for name, of in base.places.items()}
        counts = dict(base.counts)
        if rows or not began.number:
            touched = sorted({r["bucket"] for r in rows})
            texts, groups = f"{staged}/texts", self._groups(rows)
            with small_reads(self.spark):
                self._texts(files, changes, rows, base, texts)
                fresh = self.spark.read.schema(files.select(*FILE_COLUMNS).schema).parquet(texts)
                made = derived(fresh)
                for name in [t for t in TABLES if t != "edges"]:
                    key = "src" if name == "references" else "path"
                    kept = self._kept(name, base, changes, groups, key)
                    self._stage(name, made[name].select(*self._columns(name)), staged, base.buckets, key, kept)
                    old = {b: at for b, at in places.get(name, {}).items() if int(b) not in touched}
                    places[name] = old | {n.removeprefix("bucket="): place for n in self._names(f"data/{place}/{name}") if n.startswith("bucket=")}
            self._fs.delete(self._path(texts), True)
            later = Version(buckets=base.buckets, places=places)
            projects = rebuilt_texts(self.table("chunks", later).where(is_project(F.col("path"))))
            self._stage("edges", resolved(self.table("references", later), self.table("files", later), projects), staged, base.buckets, "src", [])
            places["edges"] = {n.removeprefix("bucket="): place for n in self._names(f"data/{place}/edges") if n.startswith("bucket=")}
            counts = self._counts(later)
        meta[f"last_indexed_at{scope}"] = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
        self._commit(Version(began.number + 1, base.buckets, places, counts, meta), place)
        return report | {"version": began.number + 1}

    @staticmethod
    def _columns(name: str) -> list:
        return [F.col(c.split()[0]).cast(c.split()[1]) for c in TABLES[name].split(", ")]

    @staticmethod
    def _groups(rows: list) -> list[tuple[list[int], int]]:
        """The touched buckets in groups whose stored paths that go may be broadcast together (one bucket may have more), and how many go."""
        out: list[tuple[list[int], int]] = []
        for bucket in sorted({r["bucket"] for r in rows}):
            n = sum(r["count"] for r in rows if r["bucket"] == bucket and r["action"] != "insert")
            if out and out[-1][1] + n <= PATHS_AT_ONCE:
                out[-1] = ([*out[-1][0], bucket], out[-1][1] + n)
            else:
                out.append(([bucket], n))
        return out

    def _kept(self, name: str, base: Version, changes: DataFrame, groups: list[tuple[list[int], int]], key: str) -> list[DataFrame]:
        """A table's rows in touched buckets whose paths stay, group by group; they are read and written, not shuffled."""
        out = []
        for buckets, n in groups:
            gone = changes.where(F.col("bucket").isin(buckets) & (F.col("action") != "insert")).select(F.col("path").alias(key))
            if any(str(b) in base.places.get(name, {}) for b in buckets):
                out.append(self.table(name, base, buckets).join(F.broadcast(gone) if n <= PATHS_AT_ONCE else gone, key, "left_anti").select(*self._columns(name)))
        return out

    def _texts(self, files: DataFrame, changes: DataFrame, rows: list, base: Version, path: str) -> None:
        """The new and changed files, dealt out once by bucket and in pieces of it; all tables are made of what is written here."""
        fresh = files.select(*FILE_COLUMNS)
        come = changes.where("action <> 'delete'").select("path")
        if not base.places.get("files"):
            fresh = fresh.where("path is not null")  # all are new
        elif sum(r["count"] for r in rows if r["action"] != "delete") <= PATHS_AT_ONCE:
            fresh = fresh.join(F.broadcast(come), "path", "left_semi")
        else:
            fresh = fresh.join(come, "path", "left_semi")
        pieces = max(1, -(-sum(r["size"] for r in rows) // (base.buckets * PIECE_BYTES)))
        dealt = fresh.withColumn("bucket", self._bucket(base.buckets)).repartition(base.buckets * pieces, "bucket", F.pmod(F.hash("path"), F.lit(pieces)))
        dealt.write.partitionBy("bucket").parquet(path)

    def _stage(self, name: str, rows: DataFrame, staged: str, buckets: int, key: str, kept: list[DataFrame]) -> None:
        """Writes rows by bucket, and ``kept`` ones behind them; what comes of shuffled rows is dealt out by bucket first."""
        # Within a bucket, row groups by term or path: a query reads the few that hold its own.
        order = ["bucket", "term"] if "term" in rows.columns else ["bucket", key]
        named = lambda part: part.withColumn("bucket", self._bucket(buckets, key))
        dealt = named(rows).repartition("bucket") if name in SHUFFLED else named(rows)
        for part in (dealt, *map(named, kept)):
            part.sortWithinPartitions(*order).write.mode("append").partitionBy("bucket").parquet(f"{staged}/{name}")

    def _counts(self, version: Version) -> dict[str, int]:
        out = {t: self.table(t, version).count() for t in ("files", "chunks", "symbols", "edges")}
        for name in ("chunk_terms", "symbol_terms"):  # the tokens behind an index are its positions
            out[name] = self.table(name, version).agg(F.coalesce(F.sum(F.size("positions")), F.lit(0))).first()[0]
        return out

    def _commit(self, version: Version, place: str) -> None:
        folder = f"{self.root}/manifest"
        self._fs.mkdirs(self._path(folder))
        draft, final = self._path(f"{folder}/.{place}"), self._path(f"{folder}/{version.number:012d}.json")
        stream = self._fs.create(draft, True)
        stream.write(json.dumps(version.__dict__).encode())
        stream.close()
        try:
            if self._fs.exists(final) or not self._fs.rename(draft, final):
                raise Conflict(f"version {version.number} of {self.root} is there already")
        except Py4JJavaError as e:
            raise Conflict(f"version {version.number} of {self.root} is there already") from e
        finally:
            if self._fs.exists(draft):
                self._fs.delete(draft, False)

    def vacuum(self, keep: int = 2) -> int:
        """Removes manifests but the last few, and folders that none of those names; how many folders went."""
        known = self.versions()
        used = {at for v in known[-keep:] for of in self.current(v).places.values() for at in of.values()}
        gone = [n for n in self._names("data") if n not in used]
        for n in gone:
            self._fs.delete(self._path(f"{self.root}/data/{n}"), True)
        for v in known[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifest/{v:012d}.json"), False)
        return len(gone)

    # ---- state

    def status(self, prefix: str = "", head: str | None = None) -> dict:
        """Readiness, counts below the prefix, when and at which head it was indexed, and whether the head tells that it is stale."""
        version, clean = self.current(), normalize_prefix(prefix)
        of = lambda key: (version.meta.get(f"{key}:{clean}") if clean else None) or version.meta.get(key) or None
        count = lambda t: version.counts.get(t, 0) if not clean else self.table(t, version).where(under(F.col("path"), clean)).count()
        files = count("files")
        known = of("indexed_head")
        moved = bool(known and head and known != head)
        warnings = ["Git HEAD unreadable — index may be stale."] if head is None and known else ["Git HEAD changed since last index."] if moved else ["No indexed HEAD baseline — index may be stale."] if head and not known else []
        return {"readiness": "ready" if files else "not_indexed", "files": files, "chunks": count("chunks"), "symbols": count("symbols"), "last_indexed_at": of("last_indexed_at"), "indexed_head": known, "current_head": head, "head_changed": moved, "stale": bool(warnings), "warnings": warnings}

    def drift(self, listing: DataFrame, prefix: str = "", dirty: DataFrame | None = None, head: str | None = None) -> DataFrame:
        """One row (changed, missing, deleted, dirty, head_changed, stale): listing (path, hash) against the index.

        dirty (path) are files with uncommitted changes; those that the index or the listing has make it stale, if there is a head to compare with.
        """
        version, clean = self.current(), normalize_prefix(prefix)
        old = self.table("files", version).where(under(F.col("path"), clean)).select("path", F.col("hash").alias("old"))
        both = old.withColumn("a", F.lit(1)).join(listing.where(under(F.col("path"), clean)).select("path", "hash").withColumn("b", F.lit(1)), "path", "full_outer")
        known = self.status(prefix, head)["indexed_head"]
        compared = bool(known and head)
        if dirty is not None and compared:
            both = both.join(dirty.select("path").distinct().withColumn("d", F.lit(1)), "path", "left")
        else:
            both = both.withColumn("d", F.lit(None).cast("int"))
        n = lambda c: F.count(F.when(c, 1))
        a, b = F.col("a").isNotNull(), F.col("b").isNotNull()
        out = both.agg(n(a & b & ~F.col("old").eqNullSafe(F.col("hash"))).alias("changed"), n(b & ~a).alias("missing"), n(a & ~b).alias("deleted"), n(F.col("d").isNotNull()).alias("dirty"))
        return out.withColumn("head_changed", F.lit(compared and known != head)).withColumn("stale", (F.col("changed") + F.col("missing") + F.col("deleted") + F.col("dirty") > 0) | F.col("head_changed"))


def rebuilt_texts(chunks: DataFrame, key: str = "path") -> DataFrame:
    """key, text: files' texts from their chunks (key, ordinal, start_line, end_line, text). Of lines that several chunks have the
    first chunk's copy counts, and lines that none has are empty.
    """
    lines = F.split("text", r"\r?\n")
    part = F.struct("start_line", "ordinal", F.slice(lines, F.lit(1), (F.col("end_line") - F.col("start_line") + 1).cast("int")).alias("lines"))
    parts = chunks.groupBy(key).agg(F.sort_array(F.collect_list(part)).alias("parts"), F.max("end_line").cast("int").alias("last"))

    def add(acc: Column, part: Column) -> Column:
        """Each chunk gives its lines behind the last one written, after empty lines for a gap."""
        start, have = part["start_line"].cast("int"), F.size(acc)
        skip = F.greatest(have - start + 1, F.lit(0))
        rest = F.slice(part["lines"], skip + 1, F.greatest(F.size(part["lines"]) - skip, F.lit(0)))
        return F.concat(acc, F.array_repeat(F.lit(""), F.greatest(start - 1 - have, F.lit(0))), rest)

    written = parts.select(key, "last", F.aggregate("parts", F.array().cast("array<string>"), add).alias("lines"))
    full = F.concat("lines", F.array_repeat(F.lit(""), F.greatest(F.col("last") - F.size("lines"), F.lit(0))))
    return written.select(key, F.array_join(full, "\n").alias("text"))


def _state(files: DataFrame) -> DataFrame:
    return files.select("path", "language", "size", "hash", F.lit(0.0).alias("modified_ms"), "text")


def q_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents indexed, then taken to a later state: those of the first source by name are gone, those with a label ended
    by a line more, and those that are both toxic and labelled new under another path. What is stored then, by path."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").dropDuplicates(["doc_id"])
    labels = F.broadcast(labels) if labels.count() <= FLAGS_AT_ONCE else labels  # else every text is shuffled to its label
    first = docs.agg(F.min("source")).first()[0]
    later = docs.where(F.col("source") != first).join(labels, "doc_id", "left")
    later = later.withColumn("text", F.when(F.col("toxic").isNotNull(), F.concat("text", F.lit("\nlabelled"))).otherwise(F.col("text")))
    later = later.withColumn("lang", F.when(F.col("toxic") == 1, F.concat("lang", F.lit("-x"))).otherwise(F.col("lang")))
    index = StoredIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    index.update(_state(documents_as_files(docs)))
    index.update(_state(documents_as_files(later)))
    chunks = index.table("chunks").groupBy("path").agg(F.count(F.lit(1)).alias("chunks"), F.max("end_line").alias("lines"))
    terms = index.table("chunk_terms").where("column = 'text' and ordinal = 0").groupBy("path").agg(F.sum(F.size("positions")).cast("long").alias("tokens"))
    files = index.table("files").select("path", "language", "size", "hash")
    return files.join(chunks, "path", "left").join(terms, "path", "left").select("path", "language", "size", "hash", "chunks", "lines", F.coalesce("tokens", F.lit(0)).alias("tokens"))


def q_indexed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text, from its chunks."""
    chunks = fixed_windows(table(spark, sf_dir, "documents"), "doc_id")
    return rebuilt_texts(chunks, "doc_id").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("hash"))


_LINES = r"regexp_split_to_array(text, '\r?\n')"
SQL = {
    "idx01_update": f"""
with l as (select doc_id, max(toxic) as toxic from labels group by doc_id),
d as (select source, doc_id, case when toxic = 1 then lang || '-x' else lang end as lang, case when toxic is not null then text || chr(10) || 'labelled' else text end as text
 from documents left join l using (doc_id) where source <> (select min(source) from documents)),
f as (select 'docs/' || source || '/' || lang || '/' || doc_id || '.txt' as path, text, {_LINES} as lines from d)
select path, 'txt' as language, strlen(text) as size, sha256(text) as hash, len(range(0, greatest(len(lines) - 11, 0) + 1, 70)) as chunks, len(lines) as lines,
 len(regexp_extract_all(strip_accents(lower(array_to_string(lines[1:80], chr(10)))), '[\\p{{L}}\\p{{N}}]+')) as tokens from f""",
    "src10_indexed_text": f"""
with d as (select doc_id, {_LINES} as l from documents), c as (select doc_id, l, unnest(range(0, greatest(len(l) - 11, 0) + 1, 70)) as s from d),
r as (select doc_id, s // 70 as ordinal, unnest(l[s + 1:s + 80]) as line, s + generate_subscripts(l[s + 1:s + 80], 1) as n from c),
o as (select doc_id, n, arg_min(line, ordinal) as line from r group by doc_id, n), t as (select doc_id, string_agg(line, chr(10) order by n) as text from o group by doc_id)
select doc_id, strlen(text) as bytes, sha256(text) as hash from t""",
}
QUERIES = {"idx01_update": q_update, "src10_indexed_text": q_indexed_text}
