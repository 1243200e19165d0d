"""Samples that do not depend on how rows are spread over partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from volscribe.functions.numeric import MD5_HEAD_RANGE, md5_head

# Sizes and seeds in use.
FIGURE_ROWS = 200_000
FIGURE_SEED = "42"
SCATTER_ROWS = 5_000
BERNOULLI_SEED = "2025"
# Bits of the hash that a histogram tells apart.
PREFIX_BITS = 16


def hash_cut(hashes: DataFrame, column: str, n: int) -> int:
    """The least bound, in steps of the histogram's bins, below which ``n`` or more of the hashes lie; the whole range if there are fewer.

    One pass counts the hashes' first PREFIX_BITS bits, so what is sorted is one row for
    each prefix, whatever the number of hashes.
    """
    width = MD5_HEAD_RANGE >> PREFIX_BITS
    counts = hashes.groupBy(F.floor(F.col(column) / width).alias("prefix")).agg(F.count("*").alias("n"))
    upto = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    reached = counts.withColumn("upto", F.sum("n").over(upto)).where(F.col("upto") >= n).agg(F.min("prefix")).first()[0]
    return MD5_HEAD_RANGE if reached is None else (reached + 1) * width


def sample_topn_random(df: DataFrame, keys: Sequence[str], n: int = FIGURE_ROWS, seed: str = FIGURE_SEED) -> DataFrame:
    """The ``n`` rows that come first in the order of md5(keys, seed); 0 means all.

    A plain sort-and-limit has every task hand ``n`` rows to one. So one pass over the
    keys first finds the part of the hash range that holds ``n`` rows; only those rows,
    and those of the last prefix beyond them, take part in the sort.
    """
    if n == 0:
        return df
    place = md5_head(*keys, salt=seed)
    limit = hash_cut(df.select(place.alias("_place")), "_place", n)
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(seed))
    return df.filter(place < F.lit(limit)).withColumn("_order", F.md5(text)).orderBy("_order", *keys).limit(n).drop("_order")


def sample_bernoulli(df: DataFrame, keys: Sequence[str], fraction: float, seed: str = BERNOULLI_SEED) -> DataFrame:
    """Keep a row when its hash falls below ``fraction`` of the hash range."""
    if fraction >= 1:
        return df
    return df.filter(md5_head(*keys, salt=seed) < F.lit(int(fraction * MD5_HEAD_RANGE)))


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)
