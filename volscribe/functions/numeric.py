"""Number parsing and hash expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# How much of an md5 makes a number.
MD5_HEAD = 8
MD5_HEAD_RANGE = 16**MD5_HEAD


def numeric_with_flags(text: Column | str) -> Column:
    """Text to double; one-letter flags, blanks and anything unparsable become null."""
    return (F.col(text) if isinstance(text, str) else text).try_cast("double")


def first_return(*texts: Column | str) -> Column:
    """The first of several return columns that holds a number."""
    return F.coalesce(*map(numeric_with_flags, texts))


def md5_head(*keys: Column | str, salt: str = "") -> Column:
    """A number in [0, 2^32) from the md5 of the keys; the same on any layout."""
    joined = F.concat_ws("|", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys], F.lit(salt))
    return F.conv(F.substring(F.md5(joined), 1, MD5_HEAD), 16, 10).cast("long")


def hash_bucket(key: Column | str, buckets: int, method: str = "crc32") -> Column:
    """Bucket number of a key; null keys have no bucket."""
    text = (F.col(key) if isinstance(key, str) else key).cast("string")
    if method == "crc32":
        return (F.crc32(text) % F.lit(buckets)).cast("int")
    if method == "md5":
        number = F.conv(F.substring(F.md5(text), 1, MD5_HEAD), 16, 10).cast("long")
        return (number % F.lit(buckets)).cast("int")
    raise ValueError(f"unknown hash method {method!r}")
