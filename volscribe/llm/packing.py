"""Best-fit packing by minimum bin slack.

Pieces of documents go into sequences of a fixed number of tokens. For each sequence a
subset-sum over the lengths still to be had, with one bit for each sum, finds the
fullest combination, which is then removed. All that matters about a piece here is its
length, so the search works on the number of pieces of each length: a table that has an
entry for each length up to the capacity, however many documents there are.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from volscribe.llm.common import give_back, id_and_text, shuffle_parts, slices, text_buffer
from volscribe.llm.words import span_hashes, word_spans
from volscribe.session import written

CAPACITY = 4096
END_ID = 1
# Distinct words that a task remembers the ids of: up to 170 MB.
CACHED_WORDS = 700_000
# A control character that is a token of its own.
_BETWEEN = "\x01"


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
# Second bytes of the letters from U+00C0 to U+00FF.
_ACCENTED = np.zeros(256, bool)
_ACCENTED[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True


def without_marks(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """The spans of words with a full stop or comma at the end, after a letter, as spans of their own."""
    size, last, before, second = end - start, data[end - 1], data[np.maximum(end - 2, 0)], data[np.maximum(end - 3, 0)]
    letter = _LETTER[before] | (_ACCENTED[before] & (second == 0xC3) & (size >= 3))
    cut = (size >= 2) & ((last == 46) | (last == 44)) & letter
    at = np.r_[0, np.cumsum(1 + cut)]
    starts, ends = np.repeat(start, 1 + cut), np.repeat(end, 1 + cut)
    ends[at[:-1][cut]] -= 1
    starts[at[:-1][cut] + 1] = end[cut] - 1
    return starts, ends, at[first]


class Encoder:
    """Token ids of texts, encoded word by word and remembered by the words' hashes.

    For tokenizers that drop white space and never join words across it, as
    ``tests/llm`` checks for the one in use.
    """

    def __init__(self, tokenizer: str):
        # The task's own thread is all it may use.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        (self.between,) = self.tokenizer.encode(_BETWEEN, add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        # Sorted hashes, and the row of each in the arrays below.
        self.hashes, self.row = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.ids, self.start, self.count = np.empty(1 << 20, "<u4"), np.empty(1 << 18, np.int64), np.empty(1 << 18, np.int64)
        self.used = 0

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def fresh(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word; many words are encoded at once, with a mark between them."""
        texts = [w.decode() for w in words]
        out: list[np.ndarray] = []
        for low in range(0, len(texts), 500):
            some = texts[low : low + 500]
            (ids,) = self._ids([f" {_BETWEEN} ".join(some)])
            marks = np.flatnonzero(ids == self.between)
            if len(marks) == len(some) - 1:
                out += [ids[i:j] for i, j in zip([0, *(marks + 1).tolist()], [*marks.tolist(), len(ids)], strict=True)]
            else:
                out += self._ids(some)
        return out

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Remember words, given in the order of their hashes."""
        found = self.fresh(words)
        counts = np.array([len(x) for x in found], np.int64)
        rows, high = len(self.row), self.used + int(counts.sum())
        while high > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while rows + len(words) > len(self.start):
            self.start, self.count = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.count))
        self.ids[self.used : high] = np.concatenate(found)
        self.start[rows : rows + len(words)] = self.used + np.cumsum(counts) - counts
        self.count[rows : rows + len(words)] = counts
        self.used = high
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.row = np.insert(self.row, at, np.arange(rows, rows + len(words)))

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's start, with the end last."""
        if len(self.hashes) > CACHED_WORDS:
            self.forget()
        start, end, first = word_spans(data, at)
        if not len(start):
            return np.empty(0, "<u4"), np.zeros(len(at), np.int64)
        start, end, first = without_marks(data, start, end, first)
        distinct, example, codes = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        at_hash = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at_hash < len(self.hashes)
        known[inside] = self.hashes[at_hash[inside]] == distinct[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            stored, spans = data.tobytes(), zip(start[example[new]].tolist(), end[example[new]].tolist(), strict=True)
            self._learn(distinct[new], [stored[i:j] for i, j in spans])
        rows = self.row[np.searchsorted(self.hashes, distinct)][codes]
        counts = self.count[rows]
        before = np.r_[0, np.cumsum(counts)]
        return self.ids[np.repeat(self.start[rows] - before[:-1], counts) + np.arange(before[-1])], before[first]


@lru_cache(maxsize=1)
def _encoder(tokenizer: str) -> Encoder:
    """The encoder of this task, which keeps the words it knows, up to a bound."""
    return Encoder(tokenizer)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of the pieces of every row of ``docs`` (doc_id, text).

    ``tokenizer`` is the content of a tokenizer's file, of a fixed size. A null or empty
    text has the end id only. Repeated rows each have their pieces.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for part in slices(batches):
            rows = []
            ids, at = encoder.encode(*text_buffer(part.column("text")))
            for doc_id, i, j in zip(part.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = ids[i:j].tobytes() + end
                for k, low in enumerate(range(0, len(own), 4 * capacity)):
                    piece = own[low : low + 4 * capacity]
                    rows.append((doc_id, k, low // 4, len(piece) // 4, zlib.crc32(piece)))
            columns = zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in columns], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )
        # The worker lives on, and what it does next needs neither the tokenizer nor the words.
        del encoder
        _encoder.cache_clear()
        give_back()

    docs = id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return docs.mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def fullest(available: dict[int, int], room: int) -> dict[int, int]:
    """How many pieces of each length fill ``room`` as far as any choice of the available ones does.

    Bit n of a number says that some choice of the lengths so far adds up to n. Longer
    lengths come first, and the search ends when the room is full.
    """
    whole, full = (1 << (room + 1)) - 1, 1 << room
    steps, sums = [], 1
    for length in sorted((n for n, left in available.items() if left and n <= room), reverse=True):
        many, size = min(available[length], room // length), 1
        while many:
            size = min(size, many)
            steps.append((length, size, sums))
            sums |= (sums << (length * size)) & whole
            many -= size
            size *= 2
        if sums & full:
            break
    rest, out = sums.bit_length() - 1, {}
    for length, size, before in reversed(steps):
        if not (before >> rest) & 1:
            rest -= length * size
            out[length] = out.get(length, 0) + size
    return out


def patterns(available: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths and how many sequences have each, until no piece is left.

    A sequence begins with the longest piece left, which has to go somewhere, and gets
    the fullest combination beside it. The same combination is then still the fullest
    one for as long as its pieces last, so it is taken as often as they allow.
    """
    left, out = {n: k for n, k in available.items() if k}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = fullest(left, capacity - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[n] // k for n, k in chosen.items())
        out.append((chosen, times))
        for n, k in chosen.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


def slots(found: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, ...]:
    """Where the pieces of each length go, by rank: key, first rank, first sequence, how many a sequence has, first offset."""
    rows, given, sequence = [], {}, 0
    for chosen, times in found:
        offset = 0
        for length, k in sorted(chosen.items(), reverse=True):
            first = given.get(length, 0)
            rows.append(((length << 48) + first, first, sequence, k, offset))
            given[length] = first + k * times
            offset += length * k
        sequence += times
    return tuple(np.array(c, np.int64) for c in zip(*sorted(rows), strict=True)) if rows else (np.empty(0, np.int64),) * 5


def ranked(cut: DataFrame, salts: int) -> DataFrame:
    """``cut`` with each piece's ``rank`` among those of its length, from 0.

    Pieces of one length, which may be a third of all, are numbered in ``salts`` groups,
    which then start where the groups before end.
    """
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    earlier = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    starts = salted.groupBy("length", "salt").agg(F.count("*").alias("own"))
    starts = starts.select("length", "salt", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("earlier"))
    order = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("rank", F.row_number().over(order))
    return numbered.join(starts, ["length", "salt"]).select(*cut.columns, (F.col("rank") - 1 + F.col("earlier")).alias("rank"))


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of ``docs`` (doc_id, text).

    Texts longer than ``capacity`` tokens, with the end id, are cut; others stay whole.
    Rows that repeat a document are packed as often as they occur, in any order among
    themselves. A null doc_id is kept as it is. An empty table gives no rows. Other
    columns are not read.
    """
    cut = written(pieces(docs, Path(tokenizer_file).read_text(), capacity), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).toLocalIterator()}
    keys, first, sequence, many, offset = slots(patterns(counts, capacity))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            own = rank - first[at]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(sequence[at] + own // many[at]), pa.array(offset[at] + own % many[at] * length)]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    names = [c.split()[0] for c in schema.split(", ")]
    return ranked(cut, shuffle_parts(docs)).mapInArrow(placed, schema)
