"""Text expressions: ticker tokens and cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Patterns and words that decide which text counts.
TICKER_TOKEN = r"\$?[A-Z]{1,5}(?![A-Za-z0-9_])"
URL = r"https?://\S+|www\.\S+"
MARKDOWN = r"[*_`>~\[\]\(\)]"
# Runs of whitespace and lone non-spaces; a lone space needs no replacing.
WHITESPACE = r"\s{2,}|[\t\n\x0B\f\r]"
# The two above at once: runs of marks and whitespace, but not a lone space.
MARKDOWN_OR_WHITESPACE = r"[*_`>~\[\]()\t\n\x0B\f\r][*_`>~\[\]()\s]*| [*_`>~\[\]()\s]+"
URL_HINTS = ("://", "www.")
PLACEHOLDERS = ("[removed]", "[deleted]")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def raw_text(*parts: Column | str) -> Column:
    """Parts joined by one space; null parts leave no gap."""
    return F.concat_ws(" ", *map(_col, parts))


def ticker_tokens(text: Column | str) -> Column:
    """Every ticker-shaped token of the text, in order, repeats kept.

    The lookahead stands for an ASCII word boundary, so that accented letters
    end a token no matter which Java release runs the job.
    """
    return F.regexp_extract_all(_col(text), F.lit(TICKER_TOKEN), F.lit(0))


def normalize_ticker(token: Column | str) -> Column:
    return F.upper(F.regexp_replace(_col(token), r"^\$", ""))


def has_dollar(token: Column | str) -> Column:
    return _col(token).startswith("$")


def plausible_token(token: Column | str) -> Column:
    """A one-letter ticker only counts when it was written with a dollar sign."""
    return (F.length(normalize_ticker(token)) >= 2) | has_dollar(token)


def has_real_text(text: Column | str) -> Column:
    """True for text that is present, not blank and not a moderation stub."""
    trimmed = F.trim(_col(text))
    return F.coalesce((trimmed != "") & ~F.lower(trimmed).isin(*PLACEHOLDERS), F.lit(False))


def strip_urls(text: Column | str) -> Column:
    """Links replaced by a space. Most texts hold none and skip the pattern."""
    c = _col(text)
    maybe = reduce(lambda a, b: a | b, (c.contains(hint) for hint in URL_HINTS))
    return F.when(maybe, F.regexp_replace(c, URL, " ")).otherwise(c)


def strip_markdown(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), MARKDOWN, " ")


def squeeze_space(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(text), WHITESPACE, " "))


def clean(text: Column | str) -> Column:
    """URLs out, lower case, markdown out, single spaces, no outer spaces.

    Marks become spaces and runs of spaces one space, so both are replaced in a
    single scan of the text.
    """
    return F.trim(F.regexp_replace(F.lower(strip_urls(text)), MARKDOWN_OR_WHITESPACE, " "))
