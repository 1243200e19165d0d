"""Fixed-length token ids and attention masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from volscribe.functions.numeric import md5_head

# Sequence lengths in use and the id of the padding token.
SHORT_LENGTH = 32
LONG_LENGTH = 64
PAD_ID = 0
HASH_VOCABULARY = 30_000


def tokenize_hashed(
    texts: DataFrame,
    max_length: int = SHORT_LENGTH,
    vocabulary: int = HASH_VOCABULARY,
    column: str = "clean_text",
    keep: Sequence[str] = ("id", "ticker"),
) -> DataFrame:
    """The same output without a vocabulary: words hash to ids 1..vocabulary.

    Runs as built-in expressions only.
    """
    words = F.filter(F.split(column, " "), lambda w: w != "")
    ids = F.transform(
        F.slice(words, 1, max_length), lambda w: (md5_head(w) % F.lit(vocabulary) + 1).cast("int")
    )
    cut = texts.select(*keep, F.coalesce(ids, F.array().cast("array<int>")).alias("ids"))
    missing = F.lit(max_length) - F.size("ids")
    return cut.select(
        *keep,
        F.concat("ids", F.array_repeat(F.lit(PAD_ID), missing)).alias("input_ids"),
        F.concat(
            F.transform("ids", lambda _: F.lit(1).cast("tinyint")),
            F.array_repeat(F.lit(0).cast("tinyint"), missing),
        ).alias("attention_mask"),
    )
