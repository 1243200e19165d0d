"""Writers.

Files are laid out by a rebalance on the key: rows of a key land together, and
adaptive execution splits a key that outgrows the advisory partition size, so no
single task writes a hot key and small keys share a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, functions as F

from volscribe.functions.numeric import hash_bucket

# File sizing and bucket count of the delivered layouts.
MAX_RECORDS_PER_FILE = 300_000
BUCKETS = 40


def write_layout(
    df: DataFrame,
    path: str,
    key: str | None = None,
    sort: Sequence[str] = (),
    compression: str = "snappy",
    max_records: int | None = None,
    mode: str = "overwrite",
    dynamic: bool = False,
) -> None:
    """Write Parquet, in one folder per value of ``key`` when it is given.

    An overwrite replaces all that was there. With ``dynamic`` and a key, only the
    folders this frame has rows for are replaced, and others stay as they are.
    """
    if key:
        df = df.hint("rebalance", F.col(key)).sortWithinPartitions(key, *sort)
    elif sort:
        df = df.sortWithinPartitions(*sort)
    writer = df.write.mode(mode).option("compression", compression)
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    if key:
        writer = writer.partitionBy(key).option("partitionOverwriteMode", "dynamic" if dynamic else "static")
    writer.parquet(path)


def write_overwrite(df: DataFrame, path: str) -> None:
    write_layout(df, path)


def write_by_key(df: DataFrame, path: str, key: str, sort: Sequence[str] = ()) -> None:
    write_layout(df, path, key=key, sort=sort)


def write_sized(df: DataFrame, path: str, key: str, append: bool = False, dynamic: bool = False) -> None:
    """Partitioned files of at most 300,000 records.

    Replaces the table; ``dynamic=True`` only the folders it writes to, so a rerun
    over some keys leaves the others. ``append=True`` adds files instead, which
    doubles the rows when a job is run twice.
    """
    mode = "append" if append else "overwrite"
    write_layout(df, path, key=key, max_records=MAX_RECORDS_PER_FILE, mode=mode, dynamic=dynamic)


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int = BUCKETS, method: str = "crc32") -> None:
    """One folder per hash bucket of ``key``, all written in one pass."""
    write_layout(df.withColumn("bucket", hash_bucket(key, buckets, method)), path, key="bucket")


def write_zstd(df: DataFrame, path: str, key: str = "ticker") -> None:
    """zstd files in which rows of a key sit together; the key stays a column."""
    df = df.hint("rebalance", F.col(key)).sortWithinPartitions(key)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_colocated(df: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """A table at ``path``, bucketed and sorted by ``keys``, one file for each bucket.

    Two such tables with equal keys and buckets join without an exchange, as often as
    they are used. A bucket is one task's, so this is for keys that are spread evenly.
    """
    dealt = df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    dealt.option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def write_models(fits: DataFrame, path: str) -> None:
    """The fits of all windows as a table with a folder for each window; a rerun replaces those it has."""
    write_layout(fits, path, key="train_start", dynamic=True)


def save_model(model: MLWritable, path: str) -> None:
    model.write().overwrite().save(path)
