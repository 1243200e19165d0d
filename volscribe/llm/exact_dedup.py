"""Exact dedup by content-defined chunk recipes.

A text is cut where its own bytes say so, which puts equal texts into equal chunks.
A chunk's identifier is its digest, once a look at all chunks has verified that no two
different ones share it. A text's recipe is the ordered list of its identifiers; texts
are equal when their recipes are. Only distinct chunks and short recipes move between
tasks, never long documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from volscribe.llm.common import SLICE_BYTES, id_and_text, mixed, slices
from volscribe.session import broadcast_if_small, written

# Chunk lengths in bytes: least, most, and the mean distance of the places where a text may be cut.
LEAST, MOST, MEAN = 256, 4096, 1024


def normalised(text: bytes) -> bytes:
    """Every run of space, tab, line feed, vertical tab, form feed and carriage return as one space."""
    words = text.split()
    if not words:
        return b" " if text else b""
    out = b" ".join(words)
    return b" " * (text[:1].isspace()) + out + b" " * (text[-1:].isspace())


def chunks(text: bytes) -> list[bytes]:
    """``text`` cut after each 8 bytes whose hash is a multiple of MEAN, within LEAST and MOST."""
    if len(text) <= LEAST:
        return [text] if text else []
    data = np.frombuffer(text, np.uint8)
    window = np.zeros(len(data) - 7, np.uint64)
    for k in range(8):
        window |= data[k : len(data) - 7 + k].astype(np.uint64) << np.uint64(8 * k)
    with np.errstate(over="ignore"):
        places = np.flatnonzero(mixed(window) % np.uint64(MEAN) == 0) + 8
    out, start = [], 0
    for place in [*places.tolist(), len(text)]:
        while place - start > MOST:
            out.append(text[start : start + MOST])
            start += MOST
        if place - start >= LEAST or place == len(text) and place > start:
            out.append(text[start:place])
            start = place
    return out


def _digest(chunk: bytes, size: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=size).digest()


def chunk_rows(docs: DataFrame, digest_bytes: int) -> DataFrame:
    """digest, chunk: a row for each chunk, once for each slice of the input."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4 * SLICE_BYTES):
            own = {c for text in part.column("text").cast(pa.binary()).to_pylist() for c in chunks(normalised(text))}
            yield pa.RecordBatch.from_arrays(
                [pa.array([_digest(c, digest_bytes) for c in own], pa.binary()), pa.array(list(own), pa.binary())],
                ["digest", "chunk"],
            )

    return docs.mapInArrow(rows, "digest binary, chunk binary")


def shared_by_different(docs: DataFrame, digest_bytes: int) -> DataFrame:
    """Digests that different chunks have. Equal chunks are merged before they are shuffled."""
    found = chunk_rows(docs, digest_bytes).groupBy("digest").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    return found.where("low <> high").select("digest")


def recipes(docs: DataFrame, digest_bytes: int) -> DataFrame:
    """doc_id, text_sha256 of the normalised text, recipe: the chunks' digests in order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [normalised(t) for t in part.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                    pa.array([b"".join(_digest(c, digest_bytes) for c in chunks(t)) for t in texts], pa.binary()),
                ],
                ["doc_id", "text_sha256", "recipe"],
            )

    return docs.mapInArrow(rows, "doc_id bigint, text_sha256 string, recipe binary")


def exact_groups(docs: DataFrame, digest_bytes: int = 16) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and times of every document (doc_id, text).

    Null texts are empty, and all empty texts are equal. Of equal texts the smallest
    doc_id stays; a null doc_id stays only when the whole group has none. Rows that
    repeat both doc_id and text come out as one row with their number in ``times``, and
    ``group_size`` counts each.
    An empty table gives no rows; other columns are not read.

    Should two different chunks share a digest, all digests are made twice as long
    and verified again. A group of copies of any size meets only as counts made
    before the shuffle, and as the join with its one row, which Spark splits.
    """
    docs = id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    while digest_bytes < 64 and not shared_by_different(docs, digest_bytes).isEmpty():
        digest_bytes *= 2
    own = written(
        recipes(docs, digest_bytes).groupBy("doc_id", "text_sha256", "recipe").agg(F.count("*").alias("times")), "recipes"
    )
    groups = own.groupBy("recipe").agg(
        F.min("doc_id").alias("keep_id"), F.sum("times").alias("group_size"), F.count("*").alias("members")
    )
    copies = written(groups.where("members > 1").drop("members"), "copies")
    alone = F.col("group_size").isNull()
    return own.join(copies, "recipe", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", "times").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))).alias("kept"),
        "text_sha256",
        "times",
    )


def first_copies(docs: DataFrame) -> DataFrame:
    """Those rows of ``docs`` (doc_id, text, ...) that stay, with all their columns; of repeated rows, one.

    What stays is named by doc_id, and by text as well only where rows share a doc_id.
    The ids are broadcast if they measure small; else Spark shuffles and splits.
    """
    groups = written(exact_groups(docs), "groups")
    ids = groups.groupBy("doc_id").agg(F.sum("times").alias("id rows"), F.bool_or("kept").alias("any kept"))
    ids = written(ids.select(F.col("doc_id").alias("named id"), "id rows", "any kept"), "ids")
    same = F.col("doc_id").eqNullSafe(F.col("named id"))
    once = ids.where("`id rows` = 1 AND `any kept`").select("named id")
    plain = docs.join(broadcast_if_small(once), same, "left_semi")
    shared = docs.join(broadcast_if_small(ids.where("`id rows` > 1 AND `any kept`").select("named id")), same, "left_semi")
    text = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    shared = shared.withColumn("text hash", F.sha2(text, 256))
    kept = groups.where("kept").select(F.col("doc_id").alias("named id"), F.col("text_sha256").alias("named hash"))
    shared = shared.join(kept, same & (F.col("text hash") == F.col("named hash")), "left_semi").dropDuplicates(["doc_id", "text hash"])
    return plain.unionByName(shared.drop("text hash"))
