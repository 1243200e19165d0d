"""The stages put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from volscribe.functions.text import clean, has_real_text
from volscribe.operators.accounting import Accounts
from volscribe.operators.cleaning import filter_placeholder_text
from volscribe.operators.embed import DIMENSIONS, batch_embed
from volscribe.operators.link import attach_security, keep_ids, link_panel, with_created_date
from volscribe.operators.mentions import mine_mentions
from volscribe.operators.ridge import LABEL, LAGS, design_rows, ridge_walk_forward
from volscribe.operators.sampling import sample_bernoulli
from volscribe.operators.tokens import tokenize_hashed
from volscribe.session import written


def clean_mentions(texts: DataFrame, securities: DataFrame, distinct: bool = True) -> DataFrame:
    """Mentions with the cleaned text of their post; tickers are mined from the raw text.

    Cleaning comes after the join with the securities: most texts name no valid
    ticker and need none.
    """
    keep = ("id", "created_utc", "subreddit", "selftext")
    found = mine_mentions(filter_placeholder_text(texts), securities, keep, distinct=distinct)
    return found.select("id", "created_utc", "subreddit", "ticker", clean("selftext").alias("clean_text"))


def mentions_on_panel(texts: DataFrame, securities: DataFrame, ticker_map: DataFrame, panel: DataFrame) -> DataFrame:
    """Distinct mentions joined to volatility and next-day targets of their security."""
    narrow = mine_mentions(texts, securities, distinct=True)
    return link_panel(attach_security(with_created_date(narrow), ticker_map), panel)


def linked_with_vectors(
    texts: DataFrame, securities: DataFrame, ticker_map: DataFrame, panel: DataFrame, embeddings: DataFrame
) -> DataFrame:
    """The full linked panel: mentions, panel rows and, joined last, the given vectors.

    Only vectors of texts that reach the panel go into the join.
    """
    linked = written(mentions_on_panel(texts, securities, ticker_map, panel), "linked")
    vectors = keep_ids(embeddings, linked.select(F.col("r_id").alias("id")).distinct())
    vectors = vectors.select(F.col("id").alias("r_id"), F.col("embed").alias("r_embed"))
    return linked.join(vectors, "r_id", "left")


def accounted_design(
    texts: DataFrame, securities: DataFrame, ticker_map: DataFrame, panel: DataFrame, embeddings: DataFrame, accounts: Accounts
) -> DataFrame:
    """``linked_with_vectors`` down to complete rows, with the rows every stage loses on the way in ``accounts``.

    Counted are lines that were no records, mentions without a security on their day,
    those without a panel row, and linked rows without a vector or with a null target or
    lag. Each stage is counted by the pass that writes it.
    """
    texts = accounts.observed(texts, "texts", {"malformed": F.col("id").isNull()})
    found = written(mine_mentions(texts, securities, distinct=True), "mentions")
    mapped = attach_security(with_created_date(found), ticker_map, keep_unmapped=True)
    mapped = accounts.stored(mapped, "mentions", {"unmapped_security": F.col("PERMNO").isNull()})
    linked = accounts.stored(link_panel(mapped, panel, "left"), "linked", {"no_panel_row": F.col("c_date").isNull()})
    vectors = keep_ids(embeddings, linked.select(F.col("r_id").alias("id")).distinct())
    vectors = vectors.select(F.col("id").alias("r_id"), F.col("embed").alias("r_embed"))
    incomplete = F.col(LABEL).isNull()
    for lag in LAGS:
        incomplete = incomplete | F.col(lag).isNull()
    return accounts.stored(linked.join(vectors, "r_id", "left"), "design", {"null_vector": F.col("r_embed").isNull(), "incomplete": incomplete})


def counted_stages(texts: DataFrame, securities: DataFrame, ticker_map: DataFrame, panel: DataFrame, accounts: Accounts) -> None:
    """Count texts, mentions, mention keys (those of placeholder texts apart) and linked rows, each once."""
    keep = ("id", "created_utc", "subreddit", "is_comment", "real")
    marked = accounts.observed(texts.withColumn("real", F.coalesce(has_real_text("selftext"), F.lit(False))), "texts")
    found = accounts.stored(mine_mentions(marked, securities, keep), "mentions")
    keys = accounts.stored(found.distinct(), "keys", {"placeholder": ~F.col("real")}, drop=False)
    accounts.run(link_panel(attach_security(with_created_date(keys), ticker_map), panel), "linked")


def text_to_forecast(
    texts: DataFrame,
    securities: DataFrame,
    ticker_map: DataFrame,
    panel: DataFrame,
    dimensions: int = DIMENSIONS,
    fraction: float = 1.0,
) -> DataFrame:
    """Raw texts and returns to ridge forecasts, vectors made by the hashed encoder.

    Texts are read once. Short token arrays, not texts or vectors, go through the
    joins, and only mentions that reach the panel are embedded. The fit stores what it
    is given, for vectors are the costly part to lose with an executor.
    ``fraction`` is the share of linked rows to fit and test on.
    """
    mentions = clean_mentions(texts, securities)
    tokens = tokenize_hashed(mentions, keep=("id", "ticker", "created_utc"))
    linked = link_panel(attach_security(with_created_date(tokens), ticker_map), panel)
    linked = sample_bernoulli(linked, ("r_id", "r_ticker"), fraction).withColumnsRenamed(
        {"r_input_ids": "input_ids", "r_attention_mask": "attention_mask"}
    )
    keep = ("r_id", "r_ticker", "PERMNO", "c_date", *LAGS, LABEL)
    vectors = batch_embed(linked, dimensions=dimensions, keep=keep).withColumnRenamed("embed", "r_embed")
    return ridge_walk_forward(design_rows(vectors))
