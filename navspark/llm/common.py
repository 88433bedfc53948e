"""What the training-data operators share: table access, shared scratch folders, size-checked joins.

Nothing here writes to a machine-local folder: intermediate tables go to the folder that the
session names in ``spark.checkpoint.dir`` (a folder of our own only where it is unset, as in tests).
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a key list that may be broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 500_000
#: Bytes of text that a vectorised kernel works on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Bytes that an Arrow batch to or from a Python worker holds, about; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


_OWNERS: dict[str, Callable[[], None]] = {}


def claim(owner: str, clear: Callable[[], None]) -> None:
    """Says in a Python worker that ``owner`` keeps memory from here on: what other owners keep there is dropped."""
    for name in [name for name in _OWNERS if name != owner]:
        _OWNERS.pop(name)()
    _OWNERS[owner] = clear
    trim()


def trim() -> None:
    """Gives memory that a Python worker freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, whose buffers lie outside the heap, once in each task and once in its worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir("/tmp/navspark-checkpoints")
    return str(jsc.getCheckpointDir().get()).rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/navspark-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows, from a table in the shared folder: lineage ends there and lost executors cost nothing."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def same(left: DataFrame, right: DataFrame, pairs: dict[str, str]) -> Column:
    """Null-safe equality of the columns named left: right."""
    out = F.lit(True)
    for a, b in pairs.items():
        out = out & left[a].eqNullSafe(right[b])
    return out


def checked(small: DataFrame, rows: int | None = None) -> DataFrame:
    """``small`` with a broadcast hint if it has at most BROADCAST_ROWS rows; a shuffled join handles the rest."""
    n = small.count() if rows is None else rows
    return F.broadcast(small) if n <= BROADCAST_ROWS else small


def string_offsets(column: pa.Array) -> np.ndarray:
    """The offsets of a string or binary column's values in its data buffer."""
    if not len(column):
        return np.zeros(1, np.int32)
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]


def text_slices(batches: Iterable[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches whose texts together have at most ``most`` bytes, or one row if that alone has more."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        offsets, start = string_offsets(column), 0
        while start < batch.num_rows:
            stop = max(start + 1, int(offsets.searchsorted(offsets[start] + most, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def text_bundles(batches: Iterable[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches as large as ``text_slices`` allows: neighbours are put together while their texts have at most ``most`` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for piece in text_slices(batches, text, most):
        offsets = string_offsets(piece.column(piece.schema.get_field_index(text)))
        more = int(offsets[-1] - offsets[0])
        if held and size + more > most:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(piece)
        size += more
    if held:
        yield pa.concat_batches(held)


def documents_view(docs: DataFrame, *extra: Column) -> DataFrame:
    """(doc_id long, text string, ...) of a table that may have any other columns besides."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)
