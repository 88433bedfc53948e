"""Token ids in binary files: the tokenizers library's ids, coded by the range coder, in doc_id order.

Rows are range-partitioned by doc_id and sorted (null doc_ids first, then by a hash of the text, so
repeated rows lie together); each partition becomes one file with its documents' lengths and its ids in
independently reset, checksummed blocks. Null texts are empty: they have the end id only. An empty table
gives no files. Other columns are not stored. A file's name holds the task attempt and only names in the
committed manifest are read, so a lost executor leaves nothing behind.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from navspark.llm.common import claim, documents_view, scratch, table, text_bundles, written
from navspark.llm.exact_dedup import raw_hash
from navspark.llm.idcoder import pack, unpack
from navspark.llm.units import filled, parted, words
from navspark.llm.warc import place

VOCABULARY, END = "word_bpe_49k.json", 2
#: UTF-8 bytes of text that a file holds, about.
FILE_BYTES = 24 << 20
#: Bytes of text that are encoded together.
ENCODE_BYTES = 8 << 20
#: Units that the library gets as one text; characters that it gets in one call, whose results are far larger than the ids, or one longer text.
TOGETHER, CALL_CHARS = 128, 1 << 18
#: Fixed value: ASCII marks, none of them a letter, digit or white space to the library, which takes a run of them behind letters as one word.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Tokens:
    """Whole texts to ids, remembering the ids of the units of letters in the slice before.

    The library's own splitting drops white space and never joins what a space parts, nor letters and the
    marks behind them, so a text's ids are those of its units one after another. Tokens that the vocabulary
    adds hold no space, so the library finds them in their unit. Lower-cased Latin letters are left alone by
    the library's normalizers and are one word, so they skip these and the pattern: their texts are cut at spaces.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends_word = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.clear()

    def clear(self) -> None:
        self.units, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def each(self, units: list[str]) -> pa.Array:
        """Each unit's ids as little-endian unsigned 32-bit integers."""
        return pa.array([ids.tobytes() for ids in called(self.tokenizer, units)], pa.large_binary())

    def together(self, units: pa.Array) -> pa.Array:
        """The same for units of lower-cased letters only: each is one word, so many are encoded as one text and cut where words end."""
        starts = np.append(np.arange(0, len(units), TOGETHER), len(units))
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), units), " ").to_pylist()
        found = called(self.plain, texts)
        ids = np.concatenate([np.zeros(0, "<u4"), *found])
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        counts = np.diff(np.searchsorted(ends, np.cumsum([0, *map(len, found)]), side="right"))
        if not np.array_equal(counts, np.diff(starts)):  # another vocabulary may not mark the ends of words
            return self.each(units.to_pylist())
        return binary(ids, np.insert(ends, 0, 0))

    def letters(self, units: pa.Array) -> pa.Array:
        """The same through what is remembered, and remembers these."""
        known = pc.index_in(units, value_set=self.units)
        values = pa.concat_arrays([self.ids, self.together(units.filter(known.is_null()))])
        at, new = np.asarray(known.fill_null(0)).astype(np.int64), np.asarray(known.is_null())
        at[new] = len(self.ids) + np.arange(new.sum())
        self.units, self.ids = units, values.take(pa.array(at))
        return self.ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's end, from 0."""
        number, units, first = words(pc.replace_substring(filled(texts), "\n", " "))  # both are dropped
        letters, others, marks, front, back = parted(units, fold=True, marks=MARKS)  # the library lower-cases
        heads = pa.concat_arrays([self.letters(letters), self.each(others)])
        of = pc.binary_join_element_wise(heads.take(pa.array(front)), self.each(marks).take(pa.array(back)), pa.scalar(b"", pa.large_binary()))
        found = of.take(number)
        ends = np.frombuffer(found.buffers()[1], np.int64)[first] >> 2
        return np.frombuffer(found.buffers()[2] or b"", "<u4")[: ends[-1]], ends


def called(tokenizer, texts: list[str]) -> list[np.ndarray]:
    """The library's ids of each text."""
    call = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))) // CALL_CHARS
    starts = np.flatnonzero(np.diff(call, prepend=-1)).tolist()
    return [np.array(e.ids, "<u4") for a, b in zip(starts, [*starts[1:], len(texts)], strict=False) for e in tokenizer.encode_batch_fast(texts[a:b], add_special_tokens=False)]


def binary(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Stretches of ids that end there (the first at 0), each as bytes."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((4 * ends).astype(np.int64)), pa.py_buffer(ids)])


@cache
def tokens(path: str) -> Tokens:
    return Tokens(path)


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """Writes the files under path; the manifest in order: part, file, documents, ids."""
    view = documents_view(docs, raw_hash("text").alias("th"))
    total = view.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("b")).first()["b"]
    parts = max(1, -(-total // FILE_BYTES))
    line = view.repartitionByRange(parts, "doc_id", "th").sortWithinPartitions("doc_id", "th").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        of, context = tokens(public_tokenizers.path(vocabulary)), TaskContext.get()
        claim("token files", of.clear)
        doc_ids, missing, counts, ids = [], [], [], []
        for batch in text_bundles(batches, "text", ENCODE_BYTES):
            found, ends = of.encode(batch.column(1))
            ids.append(np.insert(found, ends[1:], np.uint32(end)))
            counts.append(np.diff(ends) + 1)
            doc_ids.append(np.asarray(pc.fill_null(batch.column(0), 0)))
            missing.append(np.asarray(batch.column(0).is_null()))
        if not doc_ids:
            return
        counts = np.concatenate(counts)
        data = pack(np.concatenate(doc_ids), np.concatenate(missing), counts, np.concatenate(ids))
        fs, root = place(path)
        fs.create_dir(root, recursive=True)
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}.ids"
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            out.write(data)
        yield pa.RecordBatch.from_pydict({"part": pa.array([context.partitionId()], pa.int64()), "file": [name], "documents": pa.array([len(counts)], pa.int64()), "ids": pa.array([int(counts.sum())], pa.int64())})

    return written(line.mapInArrow(run, "part long, file string, documents long, ids long"), "ids-manifest")


def read(manifest: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit) of every document in the files."""
    # One row a file: the window runs over the manifest only.
    ordered = manifest.withColumn("before", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ordered = written(ordered.select("file", "before"), "ids-order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = place(path)
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as f:
                    doc_ids, missing, counts, ids = unpack(f.read())
                ends = np.concatenate([[0], np.cumsum(counts)])
                for k in range(0, len(doc_ids), 512):
                    stop = min(len(doc_ids), k + 512)
                    each = [ids[ends[i] : ends[i + 1]].astype("<u4").tobytes() for i in range(k, stop)]
                    columns = [pa.array(doc_ids[k:stop], mask=missing[k:stop]), pa.array(before + ends[k:stop]), pa.array(counts[k:stop]), pa.array(each, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])

    parts = max(1, min(ordered.count(), 4096))
    return ordered.repartition(parts).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "ids")
    rows = read(write(table(spark, sf_dir, "documents"), path), path)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
