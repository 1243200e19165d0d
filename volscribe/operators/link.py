"""Joins between texts, embeddings, securities and the volatility panel.

Order matters for volume: narrow keys are joined first and the wide vector last,
so it crosses the network once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from volscribe.functions.dates import epoch_to_date, epoch_to_timestamp
from volscribe.session import broadcast_if_small, written


def with_created_date(posts: DataFrame) -> DataFrame:
    return posts.withColumns(
        {
            "created_ts": epoch_to_timestamp(F.col("created_utc")),
            "created_date": epoch_to_date("created_utc"),
        }
    )


def attach_embeddings(
    posts: DataFrame, embeddings: DataFrame, on: Sequence[str] = ("id", "ticker"), unique: bool = True
) -> DataFrame:
    """Left join of the vectors; texts without one stay, with a null ``embed``.

    Of several vectors stored under one key the one with the smallest hash counts,
    so every text row comes out once, and the same on any layout. They are put in
    order after the exchange that the join needs anyway. ``unique=False`` joins
    them all: with ``on=("id",)`` each mention of a text then meets each of the
    text's vectors.
    """
    vectors = embeddings.select(*on, "embed")
    if unique:
        order = Window.partitionBy(*on).orderBy(F.xxhash64("embed"))
        vectors = vectors.withColumn("_copy", F.row_number().over(order)).filter("_copy = 1").drop("_copy")
    return posts.join(vectors, list(on), "left")


def attach_security(posts: DataFrame, ticker_map: DataFrame, keep_unmapped: bool = False) -> DataFrame:
    """PERMNO valid for (created_date, ticker).

    The map grows with days times tickers. It is stored once, then measured, and
    broadcast only when it is small.
    """
    days = ticker_map.select(F.to_date("DATE").alias("created_date"), F.col("TICKER").alias("ticker"), "PERMNO")
    days = broadcast_if_small(written(days, "ticker_map"))
    joined = posts.join(days, ["created_date", "ticker"], "left" if keep_unmapped else "inner")
    return joined.select(*posts.columns, "PERMNO")


def keep_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose id is in a table of ids; the ids never reach the driver."""
    return df.join(ids.select(key), key, "left_semi")


def join_colocated(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join of two tables that are bucketed alike by ``on``: by merging, bucket by bucket, without an exchange."""
    return left.join(right.hint("merge"), list(on), how)


def prefix_columns(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({name: f"{prefix}_{name}" for name in df.columns})


def link_panel(posts: DataFrame, panel: DataFrame, how: str = "inner") -> DataFrame:
    """Texts with the panel row of their security and day: ``inner``, ``left`` or ``outer``.

    Columns become ``r_*`` and ``c_*``, plus the shared key PERMNO. One join for
    all securities: a security-day that draws a large share of all texts is split
    by adaptive execution, because the text side of an inner or left join may be
    split. A full outer join may not be, so it is put together from a left join
    and the panel rows no text refers to, with both inputs stored first.
    """
    if how not in ("inner", "left", "outer"):
        raise ValueError(f"unsupported join kind {how!r}")
    if how == "outer":
        posts, panel = written(posts, "texts"), written(panel, "days")
    by = ["PERMNO", "_day"]
    texts = prefix_columns(posts, "r").withColumns({"PERMNO": F.col("r_PERMNO"), "_day": F.col("r_created_date")})
    days = prefix_columns(panel, "c").withColumns({"PERMNO": F.col("c_PERMNO"), "_day": F.col("c_date")})
    linked = texts.join(days, by, "inner" if how == "inner" else "left")
    if how == "outer":
        silent = days.join(texts.select(*by).distinct(), by, "left_anti")
        linked = linked.unionByName(silent, allowMissingColumns=True)
    return linked.select(*[c for c in linked.columns if c not in by], "PERMNO")
