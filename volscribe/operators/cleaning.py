"""Filters and text cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from volscribe.functions import text as tx


def filter_placeholder_text(df: DataFrame, column: str = "selftext") -> DataFrame:
    return df.filter(tx.has_real_text(column))


def clean_text(df: DataFrame, column: str = "selftext", drop_empty: bool = False) -> DataFrame:
    """Replace the raw text by ``clean_text``; rows without real text go.

    Text that was nothing but a link is left as '' unless ``drop_empty``.
    """
    kept = [c for c in df.columns if c not in (column, "title", "is_comment")]
    out = filter_placeholder_text(df, column).select(*kept, tx.clean(column).alias("clean_text"))
    return out.filter(F.col("clean_text") != "") if drop_empty else out
