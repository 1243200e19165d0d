"""CSV and Parquet readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from volscribe.functions.dates import compact_date_epoch
from volscribe.session import broadcast_if_small, written

# Column names of the two delivered CSV files.
SECURITY_COLUMNS = ("Ticker", "SecInfoStartDt", "SecInfoEndDt")
RETURN_COLUMNS = ("PERMNO", "date", "RET", "RETX", "DLRET")


def _read_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """All columns as text, then the named ones; the reader prunes the rest.

    Only the header is looked at to learn the column order, no data is scanned.
    """
    return spark.read.option("header", True).csv(path).select(*columns)


def read_securities(spark: SparkSession, path: str) -> DataFrame:
    return prepare_securities(_read_csv(spark, path, SECURITY_COLUMNS))


def prepare_securities(raw: DataFrame) -> DataFrame:
    """Ticker life spans as epoch seconds; rows without a ticker are dropped."""
    return raw.select(
        F.upper("Ticker").alias("ticker"),
        compact_date_epoch("SecInfoStartDt").alias("start_ts"),
        compact_date_epoch("SecInfoEndDt").alias("end_ts"),
    ).na.drop(subset=["ticker"])


def read_returns(spark: SparkSession, path: str) -> DataFrame:
    """Raw returns: everything stays text until ``operators.panel`` parses it."""
    return _read_csv(spark, path, RETURN_COLUMNS)


def read_projected(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def read_partitions(spark: SparkSession, path: str, key: str, wanted: Sequence | DataFrame) -> DataFrame:
    """Only the folders of the wanted keys of a table partitioned by ``key``.

    A short literal list becomes a partition filter. A table of keys is stored once
    and semi-joined; while it is small enough to broadcast, dynamic partition pruning
    skips the other folders. Pruning asks for a filter on the keys, so they get the
    range they lie in anyway.
    """
    table = spark.read.parquet(path)
    if not isinstance(wanted, DataFrame):
        return table.filter(F.col(key).isin(*wanted))
    keys = written(wanted.select(key).distinct(), "keys")
    low, high = keys.agg(F.min(key), F.max(key)).first()
    return table.join(broadcast_if_small(keys.filter(F.col(key).between(low, high))), key, "left_semi")
