"""Document fingerprints: the k smallest hashes of a text's five-word shingles.

Fingerprints of parts merge into that of the whole. Two of them give estimates of
resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from volscribe.llm.common import id_and_text, shuffle_parts, slices, text_buffer
from volscribe.llm.words import shingles, word_hashes

KEPT_HASHES = 128
# Ranges of doc_id a shuffle partition gets on average; a range is what one group holds in memory.
RANGES_PER_PARTITION = 4
_LOWEST = -(2**63)


def sketches(texts: Sequence[str], kept: int = KEPT_HASHES) -> list[np.ndarray]:
    """The ``kept`` smallest distinct shingle hashes of each text, ascending; all if there are fewer."""
    data, at = text_buffer(pa.array(texts, pa.large_string()))
    hashes, first = shingles(*word_hashes(data, at))
    return [smallest(hashes[a:b], kept) for a, b in zip(first, first[1:], strict=False)]


def smallest(hashes: np.ndarray, kept: int = KEPT_HASHES) -> np.ndarray:
    if len(hashes) > 4 * kept:
        few = np.unique(np.partition(hashes, 2 * kept)[: 2 * kept])
        if len(few) >= kept:
            return few[:kept]
    return np.unique(hashes)[:kept]


def merged(a: np.ndarray, b: np.ndarray, kept: int = KEPT_HASHES) -> np.ndarray:
    return np.union1d(a, b)[:kept]


def distinct_shingles(a: np.ndarray, kept: int = KEPT_HASHES) -> float:
    """Exact below ``kept``, else an estimate from the largest hash kept."""
    return float(len(a)) if len(a) < kept else (kept - 1) * 2.0**64 / (float(a[-1]) + 1)


def resemblance(a: np.ndarray, b: np.ndarray, kept: int = KEPT_HASHES) -> float:
    """Share of the two texts' distinct shingles that both have; 1 if neither has any."""
    union = merged(a, b, kept)
    if not len(union):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum()) / len(union)


def containment(a: np.ndarray, b: np.ndarray, kept: int = KEPT_HASHES) -> float:
    """Share of the first text's distinct shingles that the second one has; 1 if the first has none."""
    if not len(a):
        return 1.0
    common = resemblance(a, b, kept) * distinct_shingles(merged(a, b, kept), kept)
    return min(1.0, common / distinct_shingles(a, kept))


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u8")


def fingerprints(docs: DataFrame, kept: int = KEPT_HASHES) -> DataFrame:
    """doc_id and fingerprint of every row of ``docs`` (doc_id, text).

    A null or empty text has an empty fingerprint; a text of one to four words has one
    shingle. Repeated rows each have theirs. Nothing is shuffled.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [to_text(s) for s in sketches(part.column("text").to_pylist(), kept)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    docs = id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return docs.mapInArrow(rows, "doc_id bigint, fingerprint string")


def merge_by(parts: DataFrame, key: str, kept: int = KEPT_HASHES) -> DataFrame:
    """One fingerprint for each value of ``key``, from the column ``fingerprint`` of its parts.

    Tasks merge what they have before the shuffle, so a key's rows there number one for
    each slice of the input at most, whatever its size.
    """
    kind = parts.select(key).schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, fingerprint string"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict = {}
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own[k] = merged(own.get(k, np.empty(0, "<u8")), from_text(text or ""), kept)
            if len(own) > 10_000:
                yield out(batch.schema, own)
                own = {}
        if own:
            yield out(batch.schema, own)

    def out(schema: pa.Schema, own: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(own), schema.field(0).type), pa.array(map(to_text, own.values()))], schema=schema)

    def whole(group: pa.Table) -> pa.Table:
        total = np.empty(0, "<u8")
        for text in group.column(1).to_pylist():
            total = merged(total, from_text(text), kept)
        return pa.table([group.column(0).slice(0, 1), pa.array([to_text(total)])], schema=group.schema)

    return parts.select(key, "fingerprint").mapInArrow(local, schema).groupBy(key).applyInArrow(whole, schema)


class _Ranges:
    """Ranges of (doc_id, hash of text) with about as many rows each.

    ``edges`` are doc_ids. An id that is an edge several times has that many ranges of its
    own, by hash, after the range of the ids below it.
    """

    def __init__(self, cuts: list[int], most: int):
        ids, times = np.unique(np.array(cuts, np.int64), return_counts=True)
        self.edges, self.parts, self.most = ids, np.where(times > 1, times, 0), most

    def crowded(self) -> list[int]:
        return self.edges[self.parts > 0].tolist()

    def of(self, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.edges, ids)
        edge = np.minimum(at, max(len(self.edges) - 1, 0))
        parts = np.where(self.edges[edge] == ids, self.parts[edge], 0) if len(self.edges) else np.zeros(len(ids), np.int64)
        # The hash's upper half as a share of its range, in order.
        share = (hashes.astype(np.int64) >> 32) + 2**31
        return at * (self.most + 1) + np.where(parts > 0, 1 + ((share * parts) >> 32), 0)


def _ranges(docs: DataFrame) -> tuple[_Ranges, dict[int, tuple[int, int | None]]]:
    """The ranges, and the largest doc_id of each, with the largest hash where one doc_id has several ranges.

    Texts are read for the hashes of such ids only. Ranges are a fixed multiple of the
    number of shuffle partitions.
    """
    number = RANGES_PER_PARTITION * shuffle_parts(docs)
    identity = F.coalesce("doc_id", F.lit(_LOWEST)).alias("id")
    shares = F.array(*[F.lit(k / number) for k in range(1, number)])
    ranges = _Ranges(docs.select(identity).agg(F.percentile_approx("id", shares, 20 * number)).first()[0] or [], number)

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = ranges.of(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(home, pa.int64()), *batch.columns], ["range", "id", "hash"])

    def tops(rows: DataFrame, top) -> dict:
        found = rows.mapInArrow(ranged, "range bigint, id bigint, hash bigint").groupBy("range").agg(F.max("id").alias("id"), top.alias("hash"))
        return {r["range"]: (r["id"], r["hash"]) for r in found.toLocalIterator()}

    crowded = ranges.crowded()
    is_crowded = F.coalesce("doc_id", F.lit(_LOWEST)).isin(crowded) if crowded else F.lit(False)
    out = tops(docs.where(~is_crowded).select(identity, F.lit(0).cast("bigint")), F.lit(None).cast("bigint"))
    if crowded:
        out |= tops(docs.where(is_crowded).select(identity, F.xxhash64("text")), F.max("hash"))
    return ranges, out


def edited_neighbours(docs: DataFrame, kept: int = KEPT_HASHES) -> DataFrame:
    """Each text's fingerprint, its edited text's, and their likeness to it and to the next document.

    ``docs`` has doc_id and text (null: empty). The next document is the one with the
    next smaller doc_id, after the last one the first; rows without doc_id come last, and
    rows of one doc_id follow each other by descending hash of their texts. The edited text has its last
    half replaced by as many code points from the start of the next text, or all it has.
    A single document is its own next one. An empty table gives no rows.

    One shuffle deals the compressed texts out by ranges of doc_id, and of the texts'
    hashes where many rows share a doc_id or have none. The largest document of each range
    also goes to the range above, as the next one of its smallest.
    """
    docs = id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    ranges, tops = _ranges(docs)
    docs, order = docs.withColumn("hash", F.xxhash64("text")), sorted(tops)
    # Range to the range that its largest document visits; the overall largest follows the smallest.
    above = {low: high for low, high in zip(order, [*order[1:], *order[:1]], strict=True)}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for part in slices(batches, 4 << 20):
            ids, hashes = part.column("doc_id").to_pylist(), part.column("hash").to_numpy()
            packed = [press.compress(t) for t in part.column("text").cast(pa.binary()).to_pylist()]
            known = [_LOWEST if i is None else i for i in ids]
            home = ranges.of(np.array(known, np.int64), hashes).tolist()
            rows = [(r, False, i, h, t) for r, i, h, t in zip(home, ids, hashes.tolist(), packed, strict=True)]
            rows += [(above[r], True, i, h, t) for (r, _, i, h, t), k in zip(rows, known, strict=True) if k == tops[r][0] and tops[r][1] in (None, h)]
            columns = zip([pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()], zip(*rows, strict=True), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for kind, c in columns], ["range", "guest", "doc_id", "hash", "packed"])

    def compared(group: pa.Table) -> pa.Table:
        unpress = zstandard.ZstdDecompressor()
        rows = [
            (g, i, unpress.decompress(t).decode(), h)
            for g, i, h, t in zip(*(group.column(c).to_pylist() for c in ("guest", "doc_id", "hash", "packed")), strict=True)
        ]
        by_id = lambda r: (_LOWEST if r[1] is None else r[1], r[3], r[2])
        guests = sorted((r for r in rows if r[0]), key=by_id)
        own = sorted((r for r in rows if not r[0]), key=by_id, reverse=True)
        own += guests[-1:] if own else []
        out = [[] for _ in OUT_TYPES]
        low = 0
        while low < len(own) - 1:
            high, size = low, 0
            while high < len(own) - 1 and (high == low or size < 1 << 20):
                size += len(own[high][2])
                high += 1
            texts = [r[2] for r in own[low : high + 1]]
            edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for t, after in zip(texts, texts[1:], strict=False)]
            plain, changed = sketches(texts, kept), sketches(edited, kept)
            for k, text in enumerate(edited):
                values = (
                    own[low + k][1], len(texts[k]), hashlib.sha256(text.encode()).hexdigest(), to_text(plain[k]), to_text(changed[k]),
                    resemblance(plain[k], changed[k], kept), resemblance(plain[k], plain[k + 1], kept),
                )
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            low = high
        return pa.table([pa.array(c, kind) for c, kind in zip(out, OUT_TYPES.values(), strict=True)], names=list(OUT_TYPES))

    schema = "range bigint, guest boolean, doc_id bigint, hash bigint, packed binary"
    return docs.mapInArrow(dealt, schema).groupBy("range").applyInArrow(compared, OUT)


OUT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
OUT_TYPES = {
    "doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(),
    "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(),
}
