"""Substring dedup by hashing lines and the sentences inside them.

A unit is a line, or a sentence of a line that has several. Units are normalised to
lower case with single spaces. Of all units with one digest the earliest stays, by
doc_id and then by place; the others' characters are removed. Sentences catch a passage
that was put into the middle of other lines.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from volscribe.llm.common import id_and_text, slices
from volscribe.session import written

# Every line and sentence counts. Text without spaces is one word, whatever its length.
LINE_WORDS, SENTENCE_WORDS = 1, 1
# The marks of scripts without spaces end a sentence by themselves.
_SENTENCE = re.compile(r"\S.*?(?:[.!?]+(?=\s)|[。！？｡]+|$)", re.DOTALL)


def units(text: str, line_words: int = LINE_WORDS, sentence_words: int = SENTENCE_WORDS) -> Iterator[tuple[bytes, int, int]]:
    """Digest, start and end, in code points, of each unit with enough words."""
    start = 0
    for line in text.split("\n"):
        end = start + len(line)
        words = line.lower().split()
        if len(words) >= line_words:
            yield _digest(words), start, end
        found = list(_SENTENCE.finditer(line))
        if len(found) > 1:
            for one in found:
                own = one.group().lower().split()
                if len(own) >= sentence_words:
                    yield _digest(own), start + one.start(), start + one.end()
        start = end + 1


def _digest(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest()


def unit_rows(docs: DataFrame, line_words: int = LINE_WORDS, sentence_words: int = SENTENCE_WORDS) -> DataFrame:
    """digest, doc_id, version, begin, stop of every unit; ``version`` tells texts of one doc_id apart."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1 << 19):
            found = [
                (digest, doc_id, version, start, end)
                for doc_id, version, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "version", "text")), strict=True)
                for digest, start, end in units(text, line_words, sentence_words)
            ]
            if found:
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["digest", "doc_id", "version", "begin", "stop"])

    return docs.mapInArrow(rows, "digest binary, doc_id bigint, version bigint, begin bigint, stop bigint")


def removed_spans(docs: DataFrame, line_words: int = LINE_WORDS, sentence_words: int = SENTENCE_WORDS) -> DataFrame:
    """doc_id, version and spans, the places (begin, stop) to remove, of the documents that have any.

    A digest's first place is found before the shuffle as far as a task can, and only
    digests seen twice go on. The units then join those; a unit that a third of all
    documents share is split by Spark.
    """
    places = unit_rows(docs, line_words, sentence_words)
    first = F.min(F.struct("doc_id", "version", "begin")).alias("first")
    groups = places.groupBy("digest").agg(first, F.max(F.struct("doc_id", "version", "begin")).alias("last"))
    repeated = written(groups.where("first <> last").select("digest", "first"), "repeated")
    later = places.join(repeated, "digest").where(F.struct("doc_id", "version", "begin") > F.col("first"))
    return later.groupBy("doc_id", "version").agg(F.array_sort(F.collect_set(F.struct("begin", "stop"))).alias("spans"))


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_chars, n_removed, spans (merged, in the original text) and kept_text of every document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = []
            for doc_id, text, found in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                merged: list[list[int]] = []
                for span in found or ():
                    if merged and span["begin"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], span["stop"])
                    else:
                        merged.append([span["begin"], span["stop"]])
                edges = [0, *(x for span in merged for x in span), len(text)]
                kept = "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((doc_id, len(text), len(text) - len(kept), [dict(zip(("begin", "stop"), s, strict=True)) for s in merged], kept))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)],
                ["doc_id", "n_chars", "n_removed", "spans", "kept_text"],
            )

    span = pa.struct([("begin", pa.int64()), ("stop", pa.int64())])
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(span), pa.string())
    both = docs.join(
        spans.select(F.col("doc_id").alias("of"), F.col("version").alias("of_version"), "spans"),
        F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("version") == F.col("of_version")), "left",
    )
    schema = "doc_id bigint, n_chars bigint, n_removed bigint, spans array<struct<begin: bigint, stop: bigint>>, kept_text string"
    return both.select("doc_id", "text", "spans").mapInArrow(rows, schema)


def dedup_units(docs: DataFrame, line_words: int = LINE_WORDS, sentence_words: int = SENTENCE_WORDS) -> DataFrame:
    """doc_id, n_chars, n_removed, spans and kept_text of every row of ``docs`` (doc_id, text).

    Null texts are empty and lose nothing. A null doc_id ranks before all others. Rows
    that repeat a document have the same result each: they are at one place, so none is
    later. Texts that share a doc_id rank by a hash. Other columns are not read.
    """
    docs = id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("bigint")).withColumn("version", F.xxhash64("text"))
    return remove_spans(docs, removed_spans(docs, line_words, sentence_words))
