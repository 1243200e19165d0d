"""Dates and epochs, written so that the session time zone has no say."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Date format and day length.
COMPACT_DATE = "yyyyMMdd"
SECONDS_PER_DAY = 86400


def parse_compact_date(text: Column | str) -> Column:
    """'yyyyMMdd' to date, null when it does not parse."""
    return F.try_to_date(text, COMPACT_DATE)


def compact_date_epoch(text: Column | str) -> Column:
    """'yyyyMMdd' to epoch seconds of that day's UTC midnight."""
    return F.unix_date(parse_compact_date(text)).cast("long") * F.lit(SECONDS_PER_DAY)


def epoch_to_date(seconds: Column | str) -> Column:
    """Epoch seconds to the UTC calendar day."""
    col = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.date_from_unix_date(F.floor(col / F.lit(SECONDS_PER_DAY)).cast("int"))


def epoch_to_timestamp(seconds: Column | str) -> Column:
    return F.timestamp_seconds(seconds)


def year_range(date: Column | str, first: int, last: int) -> Column:
    """Years first..last as a half-open date range, which a scan can push down."""
    col = F.col(date) if isinstance(date, str) else date
    return (col >= F.lit(f"{first:04d}-01-01").cast("date")) & (
        col < F.lit(f"{last + 1:04d}-01-01").cast("date")
    )
