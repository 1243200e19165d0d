"""Compressed NDJSON posts and comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# The fields kept of each record, all read as text.
COMMON_FIELDS = ("id", "created_utc", "subreddit")
POST_FIELDS = ("title", "selftext")
COMMENT_FIELDS = ("body",)


def json_schema(kind: str) -> str:
    """DDL schema of one record; any kind but 'post' is a comment."""
    extra = POST_FIELDS if kind.lower() == "post" else COMMENT_FIELDS
    return ", ".join(f"{name} string" for name in COMMON_FIELDS + extra)


def open_filesystem(path: str):
    """Arrow file system and inner path for a path as Spark spells it."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    if path.startswith("s3a://"):
        path = "s3://" + path.removeprefix("s3a://")
    return fs.FileSystem.from_uri(path)


def parse_records(lines: DataFrame, kind: str) -> DataFrame:
    """Lines to record columns; a malformed line becomes a row of nulls."""
    return lines.select(F.from_json("value", json_schema(kind)).alias("record")).select("record.*")


def standardize(records: DataFrame, kind: str) -> DataFrame:
    """Posts and comments under one column set, epoch seconds as a number."""
    is_post = kind.lower() == "post"
    return records.select(
        "id",
        F.col("created_utc").try_cast("long").alias("created_utc"),
        "subreddit",
        (F.col("title") if is_post else F.lit(None).cast("string")).alias("title"),
        F.col("selftext" if is_post else "body").alias("selftext"),
    )


def read_archive(spark: SparkSession, path: str, kind: str, spread: int | None = None) -> DataFrame:
    """Read an archive into the common column set.

    Spark's text reader decompresses it. An archive cannot be split while that
    happens, so one task reads one file. ``spread`` deals the raw lines out to that
    many tasks *before* the JSON is parsed, which is the costly part.
    """
    lines = spark.read.text(path)
    if spread:
        lines = lines.repartition(spread)
    return standardize(parse_records(lines, kind), kind)


def drop_malformed(posts: DataFrame) -> DataFrame:
    """Rows without an id come from lines that were not valid records."""
    return posts.na.drop(subset=["id"])


def tag_source(posts: DataFrame, is_comment: bool) -> DataFrame:
    return posts.withColumn("is_comment", F.lit(is_comment))


def union_posts_comments(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """All rows of both, tagged with where they came from."""
    return tag_source(posts, False).unionByName(tag_source(comments, True))
