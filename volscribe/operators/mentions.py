"""Ticker mentions and their check against dated securities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from volscribe.functions import text as tx
from volscribe.functions.dates import SECONDS_PER_DAY
from volscribe.session import broadcast_if_small

KEPT = ("id", "created_utc", "subreddit", "is_comment")


def extract_candidates(df: DataFrame, title: str = "title", body: str = "selftext") -> DataFrame:
    return df.withColumn("candidates", tx.ticker_tokens(tx.raw_text(title, body)))


def explode_mentions(
    df: DataFrame, keep: Sequence[str] = KEPT, candidates: str | Column = "candidates", distinct: bool = False
) -> DataFrame:
    """One row per candidate token; rows without candidates vanish."""
    tokens = F.col(candidates) if isinstance(candidates, str) else candidates
    return df.select(*keep, F.explode(F.array_distinct(tokens) if distinct else tokens).alias("token"))


def with_ticker(df: DataFrame) -> DataFrame:
    return df.withColumn("ticker", tx.normalize_ticker("token"))


def within_life_span(end_inclusive_day: bool = False) -> Column:
    """Created between start and end.

    The end stamp is the midnight that begins the last day, so posts of that day
    fall outside unless ``end_inclusive_day``.
    """
    created, end = F.col("created_utc"), F.col("end_ts")
    before_end = created < end + F.lit(SECONDS_PER_DAY) if end_inclusive_day else created <= end
    return (created >= F.col("start_ts")) & before_end


def join_securities(mentions: DataFrame, securities: DataFrame) -> DataFrame:
    """Inner equi-join on ticker; a ticker with several life spans fans out."""
    return mentions.join(broadcast_if_small(securities), "ticker")


def join_validity_interval(
    mentions: DataFrame, securities: DataFrame, end_inclusive_day: bool = False, once: bool = False
) -> DataFrame:
    """Mentions whose ticker was alive at that moment.

    Equality on ticker drives a hash join, the interval is checked on each match.
    Overlapping life spans of a ticker repeat its mentions unless ``once``, which
    makes it a semi-join.
    """
    narrow = securities.select(F.col("ticker").alias("_ticker"), "start_ts", "end_ts")
    spans = broadcast_if_small(narrow)
    match = (F.col("ticker") == F.col("_ticker")) & within_life_span(end_inclusive_day)
    joined = mentions.join(spans, match, "left_semi" if once else "inner")
    return joined.select(*mentions.columns)


def mine_mentions(
    posts: DataFrame,
    securities: DataFrame,
    keep: Sequence[str] = KEPT,
    source: str = "both",
    distinct: bool = False,
    end_inclusive_day: bool = False,
) -> DataFrame:
    """One row per valid ticker mention.

    ``source`` is 'posts', 'comments' or 'both'. With ``distinct`` a text names a
    ticker once, however often and however spelled. Tokens that can never count
    are dropped inside the array, before rows are multiplied; nothing is shuffled
    while the securities are small enough to broadcast.
    """
    if source != "both":
        posts = posts.filter(F.col("is_comment") == F.lit(source == "comments"))
    tokens = F.filter(tx.ticker_tokens(tx.raw_text("title", "selftext")), tx.plausible_token)
    tickers = F.transform(tokens, tx.normalize_ticker)
    if distinct:
        tickers = F.array_distinct(tickers)
    named = posts.select(*keep, F.explode(tickers).alias("ticker"))
    return join_validity_interval(named, securities, end_inclusive_day, once=distinct)
