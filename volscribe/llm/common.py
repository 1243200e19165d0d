"""Helpers the operators here share: table access, Arrow slices, byte views of texts."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from volscribe.session import configure

# A Python worker gets its rows in batches of about this size, however long its texts are.
BATCH_BYTES = 16 << 20
# Work on arrays goes through about this many text bytes at a time, one document at least.
SLICE_BYTES = 1 << 20


def prepared(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> SparkSession:
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{folder}/{name}.parquet")


def shuffle_parts(df: DataFrame) -> int:
    """The session's number of shuffle partitions, which users scale with their input."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns in use, so that other columns can have any names; null text is empty."""
    return docs.select("doc_id", *more, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def slices(batches: Iterable[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in runs of about ``limit`` bytes of the column ``text``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0))
        block = (np.cumsum(sizes, dtype=np.int64) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), batch.num_rows]
        for low, high in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(low, high - low)
    give_back()


def give_back() -> None:
    """Return the memory of a task's arrays to the system; workers live on and the next task may need less."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes in one array, and where each text starts, with the end last."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    store = column.buffers()[2]
    data = np.frombuffer(store, np.uint8) if store is not None else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit keys (the public splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
