"""Ranked lexical search over geometric blocks of posting lists, with exact bounds.

Documents are kept as vectors of impacts, one for each term that some query asks for,
and lie in shards in the order of their similarity (signs of random projections). In a
shard each posting list is cut into blocks of similar documents. A block has a summary:
for each term the largest impact of its documents, rounded up. The summary times the
query bounds the score of every document in the block, so a block is skipped only when
that bound is below the score that a place among the best takes.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from volscribe.llm.common import id_and_text, shuffle_parts, slices, text_buffer
from volscribe.llm.line_dedup import with_earlier
from volscribe.llm.terms import term_hashes, term_spans, terms_of
from volscribe.session import written

BEST = 20
# Terms of the queries that are answered in one pass over the documents.
QUERY_TERMS = 50_000
# A shard is full at so many documents, or impacts.
SHARD_DOCS, SHARD_IMPACTS = 4096, 1 << 19
BLOCK_DOCS = 32
# Summaries are whole multiples of this, and at most 255 of them; no impact is over 1,000,000.
STEP = 4096
# Documents looked at first for each query, through its rarest terms, to learn what a place among the best takes.
SEED_POSTINGS = 200
PROJECTIONS = 32
_FLAG_BITS = 20
_ARRAYS = {
    "row": np.int64, "at": np.int64, "term": np.int32, "impact": np.int32, "block_term": np.int32, "member_at": np.int64,
    "member": np.int32, "summary_at": np.int64, "summary_term": np.int32, "summary": np.uint8,
}


def query_blocks(items: DataFrame, limit: int = QUERY_TERMS) -> DataFrame:
    """One row, queries, for each block of about ``limit`` terms of ``items`` (item_id, text); an item is never cut."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = [terms_of(t) for t in part.column("text").to_pylist()]
            columns = [part.column("item_id"), part.column("text"), pa.array([len(w) for w in words], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "text", "n"])

    items = items.select(F.col("item_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sized = written(items.mapInArrow(counted, "item_id bigint, text string, n bigint").where("n > 0"), "queries")
    if (sized.agg(F.sum("n")).first()[0] or 0) > limit:
        blocks = with_earlier(sized, ["item_id", "text"]).withColumn("block", F.floor(F.col("earlier") / limit))
    else:
        blocks = sized.withColumn("block", F.lit(0).cast("bigint"))

    def built(part: pa.Table) -> pa.Table:
        texts = [terms_of(t) for t in part["text"].to_pylist()]
        vocabulary = sorted({w for words in texts for w in words})
        number = {w: k for k, w in enumerate(vocabulary)}
        own = [np.unique([number[w] for w in words], return_counts=True) for words in texts]
        stored = pickle.dumps((part["item_id"].to_pylist(), vocabulary, own), protocol=5)
        return pa.table({"queries": pa.array([stored], pa.binary())})

    return blocks.select("block", "item_id", "text").groupBy("block").applyInArrow(built, "queries binary")


class Vocabulary:
    """Numbers of terms by their hashes. Two terms are told apart by 64 bits."""

    def __init__(self, terms: list[bytes]):
        sizes = np.array([len(t) for t in terms], np.int64)
        ends = np.cumsum(sizes)
        hashes = term_hashes(np.frombuffer(b"".join(terms), np.uint8), ends - sizes, ends)
        self.number = np.argsort(hashes)
        self.hashes = hashes[self.number]
        self.flags = np.zeros(1 << _FLAG_BITS, bool)
        self.flags[self._slot(hashes)] = True

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - _FLAG_BITS)

    def counted(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """How many terms each text has; and where each text's own numbers start, with the end last, the numbers, and how often they occur."""
        data, start, end, first = term_spans(data, at)
        hashes = term_hashes(data, start, end)
        place = np.flatnonzero(self.flags[self._slot(hashes)])
        found = np.minimum(np.searchsorted(self.hashes, hashes[place]), len(self.hashes) - 1)
        same = self.hashes[found] == hashes[place]
        doc = np.searchsorted(first, place[same], side="right") - 1
        keys, times = np.unique(doc * len(self.hashes) + self.number[found[same]], return_counts=True)
        doc, numbers = np.divmod(keys, len(self.hashes))
        return np.diff(first), np.searchsorted(doc, np.arange(len(at))), numbers, times


def forward_rows(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """row, doc_id, n, term and tf of every row of ``docs`` (doc_id, text): how often it has each of ``terms``."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    lists = pa.list_(pa.int32())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        for part in slices(batches):
            n, at, numbers, times = vocabulary.counted(*text_buffer(part.column("text")))
            nested = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())).cast(lists) for x in (numbers, times)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), *nested], ["doc_id", "n", "term", "tf"])

    found = docs.mapInArrow(rows, "doc_id bigint, n bigint, term array<int>, tf array<int>")
    return found.withColumn("row", F.monotonically_increasing_id())


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists and where each list starts, with the end last."""
    at = np.asarray(column.offsets, np.int64)
    return np.asarray(column.values)[at[0] : at[-1]], at - at[0]


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """The score of ``tf`` occurrences in a document of ``n`` terms, per unit of weight; whole numbers throughout."""
    m = 75 + (25 * n.astype(np.int64) * documents) // max(length, 1)
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 12 * m)


class Queries:
    """The weights of one block of queries, given statistics of all documents: their number, their terms, and for each term df and the largest tf."""

    def __init__(self, stored: bytes, documents: int, length: int, df: np.ndarray, most: np.ndarray, best: int):
        self.ids, self.terms, own = pickle.loads(stored)  # noqa: S301
        self.documents, self.length, self.df, self.best = documents, length, df, best
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        # Without documents, or with weight 0, a term adds nothing. Rarest first.
        self.own = []
        for numbers, times in own:
            used = (df[numbers] > 0) & (weight[numbers] > 0)
            numbers, times = numbers[used], times[used]
            order = np.lexsort((numbers, df[numbers]))
            self.own.append((numbers[order], (times * weight[numbers])[order]))
        self.weight = weight
        self.most = impacts(most, np.zeros(len(most), np.int64), documents, length)
        self.least = np.ones(len(self.ids), np.int64)

    def needed(self, k: int, top: np.ndarray) -> int:
        """Of the terms of query ``k``, rarest first, how many lists hold all that can reach its least score, given the largest impact of each term."""
        numbers, weights = self.own[k]
        rest = np.cumsum((weights * top[numbers])[::-1])[::-1]
        return int((rest >= self.least[k]).sum())

    def plan(self) -> None:
        """The lists that some query needs, and of each the terms of those queries."""
        self.beside: dict[int, np.ndarray] = {}
        found: dict[int, set] = {}
        for k, (numbers, _) in enumerate(self.own):
            for term in numbers[: self.needed(k, self.most)].tolist():
                found.setdefault(term, set()).update(numbers.tolist())
        self.beside = {term: np.array(sorted(x), np.int64) for term, x in found.items()}

    def seeds(self) -> dict[int, np.ndarray]:
        """For each query the rarest terms whose lists hold ``SEED_POSTINGS`` documents together."""
        return {k: n[: int(np.searchsorted(np.cumsum(self.df[n]), SEED_POSTINGS)) + 1] for k, (n, _) in enumerate(self.own)}

    def vector(self, k: int) -> np.ndarray:
        out = np.zeros(len(self.terms), np.int64)
        out[self.own[k][0]] = self.own[k][1]
        return out


def _gathered(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values of some rows of lists, and where each row's start, with the end last."""
    sizes = at[rows + 1] - at[rows]
    own = np.r_[0, np.cumsum(sizes)]
    return np.arange(own[-1]) + np.repeat(at[rows] - own[:-1], sizes), own


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of each run of values."""
    total = np.r_[0, np.cumsum(values)]
    return total[at[1:]] - total[at[:-1]]


class Best:
    """The best documents of each query so far, as (score, doc_id, row), and the score that a place among them takes."""

    def __init__(self, queries: Queries):
        self.queries = queries
        self.held: list[list[tuple]] = [[] for _ in queries.ids]
        self.least = queries.least.copy()

    def add(self, k: int, scores: np.ndarray, doc_ids: np.ndarray, missing: np.ndarray, rows: np.ndarray) -> None:
        good = np.flatnonzero(scores >= self.least[k])
        if not len(good):
            return
        # Best score first, then the smallest doc_id, with rows that have none last.
        columns = zip((-scores[good]).tolist(), missing[good].tolist(), doc_ids[good].tolist(), rows[good].tolist(), strict=True)
        self.held[k] = sorted([*self.held[k], *columns])[: self.queries.best]
        if len(self.held[k]) == self.queries.best:
            self.least[k] = max(self.least[k], -self.held[k][-1][0])

    def batch(self) -> pa.RecordBatch:
        rows = [(k, None if gone else d, row, -score) for k, own in enumerate(self.held) for score, gone, d, row in own]
        columns = zip(*rows, strict=True) if rows else [()] * 4
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["query", "doc_id", "row", "score"])


FOUND = "query int, doc_id bigint, row bigint, score bigint"


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    missing = np.asarray(column.is_null())
    return np.asarray(column.fill_null(0)), missing


def _seeded(forward: DataFrame, queries: Queries) -> DataFrame:
    """The best of the documents that have one of a query's rarest terms."""
    shared = forward.sparkSession.sparkContext.broadcast(queries)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        best, seeds = Best(own), own.seeds()
        for batch in batches:
            term, at = _flat(batch.column("term"))
            tf, _ = _flat(batch.column("tf"))
            n = np.asarray(batch.column("n"))
            doc = np.repeat(np.arange(len(n)), np.diff(at))
            doc_ids, missing = _ids(batch.column("doc_id"))
            row, impact = np.asarray(batch.column("row")), impacts(tf, n[doc], own.documents, own.length)
            order = np.argsort(term, kind="stable")
            lists = np.searchsorted(term[order], np.arange(len(own.terms) + 1))
            for k, numbers in seeds.items():
                held = [order[lists[t] : lists[t + 1]] for t in numbers.tolist()]
                docs = np.unique(doc[np.concatenate(held)]) if held else np.empty(0, np.int64)
                if len(docs):
                    place, ends = _gathered(at, docs)
                    best.add(k, _sums(own.vector(k)[term[place]] * impact[place], ends), doc_ids[docs], missing[docs], row[docs])
        yield best.batch()

    return forward.select("row", "doc_id", "n", "term", "tf").mapInArrow(rows, FOUND)


def _in_order(forward: DataFrame, queries: Queries) -> DataFrame:
    """The documents that have some term of a query, in ranges and in the order of their similarity."""
    shared = forward.sparkSession.sparkContext.broadcast(queries)
    names = ["row", "doc_id", "n", "term", "tf"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        signs = np.random.default_rng(11).choice(np.array([-1, 1], np.float32), (len(own.terms), PROJECTIONS))
        for batch in batches:
            batch = batch.filter(pa.compute.greater(pa.compute.list_value_length(batch.column("term")), 0))
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                (term, at), (tf, _), n = _flat(part.column("term")), _flat(part.column("tf")), np.asarray(part.column("n"))
                size = (impacts(tf, np.repeat(n, np.diff(at)), own.documents, own.length) * own.weight[term]).astype(np.float32)
                side = np.add.reduceat(signs[term] * size[:, None], at[:-1]) > 0
                code = (side.astype(np.int64) << np.arange(PROJECTIONS)).sum(axis=1)
                # Neighbours in this order differ in few signs (the inverse of the Gray code).
                for shift in (1, 2, 4, 8, 16):
                    code ^= code >> shift
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(code)], [*names, "similar"])

    coded = forward.select(*names).mapInArrow(rows, "row bigint, doc_id bigint, n bigint, term array<int>, tf array<int>, similar bigint")
    return coded.repartitionByRange(shuffle_parts(forward), "similar", "row").sortWithinPartitions("similar", "row").drop("similar")


def _shard(doc_ids: list, row: np.ndarray, at: np.ndarray, term: np.ndarray, impact: np.ndarray, queries: Queries) -> dict:
    """The posting blocks of some documents and their summaries, beside the documents' vectors."""
    doc = np.repeat(np.arange(len(row)), np.diff(at))
    order = np.argsort(term, kind="stable")
    lists = np.searchsorted(term[order], np.arange(len(queries.terms) + 1))
    column = np.full(len(queries.terms), -1, np.int64)
    blocks, members, member_sizes, sizes, terms, tops = [], [], [], [], [], []
    for t in np.flatnonzero(np.diff(lists)).tolist():
        beside = queries.beside.get(t)
        if beside is None:
            continue
        held = doc[order[lists[t] : lists[t + 1]]]
        number = -(-len(held) // BLOCK_DOCS)
        column[beside] = np.arange(len(beside))
        table = np.zeros((number, len(beside)), np.int32)
        for low in range(0, number, 64):
            some = held[low * BLOCK_DOCS : (low + 64) * BLOCK_DOCS]
            place, ends = _gathered(at, some)
            use = column[term[place]]
            block = low + np.repeat(np.arange(len(some)) // BLOCK_DOCS, np.diff(ends))
            good = use >= 0
            np.maximum.at(table, (block[good], use[good]), impact[place[good]])
        column[beside] = -1
        rounded = -(-table // STEP)
        at_block, at_term = np.nonzero(rounded)
        blocks.append(np.full(number, t))
        members.append(held)
        member_sizes.append(np.minimum(BLOCK_DOCS, len(held) - BLOCK_DOCS * np.arange(number)))
        sizes.append(np.bincount(at_block, minlength=number))
        terms.append(beside[at_term])
        tops.append(rounded[at_block, at_term])
    joined = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (blocks, members, member_sizes, sizes, terms, tops)]
    values = (row, at, term, impact, joined[0], np.r_[0, np.cumsum(joined[2])], joined[1], np.r_[0, np.cumsum(joined[3])], joined[4], joined[5])
    return {"doc_ids": doc_ids} | {name: x.astype(kind).tobytes() for (name, kind), x in zip(_ARRAYS.items(), values, strict=True)}


def build_index(forward: DataFrame, queries: Queries) -> DataFrame:
    """One row for each shard: the vectors of its documents, its posting blocks and their summaries."""
    ordered = _in_order(forward, queries)
    shared = forward.sparkSession.sparkContext.broadcast(queries)
    schema = pa.schema([("doc_ids", pa.list_(pa.int64())), *((name, pa.binary()) for name in _ARRAYS)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for doc_ids, row, n, at, term, tf in _filled(batches):
            impact = impacts(tf, np.repeat(n, np.diff(at)), own.documents, own.length)
            yield pa.RecordBatch.from_pylist([_shard(doc_ids, row, at, term, impact, own)], schema)

    return ordered.mapInArrow(rows, "doc_ids array<bigint>, " + ", ".join(f"{name} binary" for name in _ARRAYS))


def _filled(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The documents of a partition, a shard at a time."""
    waiting: list[tuple] = []
    docs = size = 0

    def joined() -> tuple:
        ids, row, n, sizes, term, tf = zip(*waiting, strict=True)
        return [x for i in ids for x in i], *(np.concatenate(x) for x in (row, n)), np.r_[0, np.cumsum(np.concatenate(sizes))], *(np.concatenate(x) for x in (term, tf))

    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            (term, at), (tf, _) = _flat(part.column("term")), _flat(part.column("tf"))
            waiting.append((part.column("doc_id").to_pylist(), *(np.asarray(part.column(c)) for c in ("row", "n")), np.diff(at), term, tf))
            docs, size = docs + part.num_rows, size + len(term)
            if docs >= SHARD_DOCS or size >= SHARD_IMPACTS:
                yield joined()
                waiting, docs, size = [], 0, 0
    if waiting:
        yield joined()


def _read(row: dict) -> SimpleNamespace:
    return SimpleNamespace(doc_ids=row["doc_ids"], **{name: np.frombuffer(row[name], kind) for name, kind in _ARRAYS.items()})


def visit(shard: SimpleNamespace, queries: Queries, best: Best) -> int:
    """Add a shard's documents to the best ones, list by list, rarest first; how many blocks were not skipped."""
    top = np.zeros(len(queries.terms), np.int64)
    np.maximum.at(top, shard.term, shard.impact)
    blocks = np.searchsorted(shard.block_term, np.arange(len(queries.terms) + 1))
    doc_ids, missing = _ids(pa.array(shard.doc_ids, pa.int64()))
    opened = 0
    for k, (numbers, weights) in enumerate(queries.own):
        # What the terms from each on can add together.
        rest = np.cumsum((weights * top[numbers])[::-1])[::-1]
        if not len(rest) or rest[0] < best.least[k]:
            continue
        vector, seen = queries.vector(k), np.zeros(len(doc_ids), bool)
        for t, most in zip(numbers.tolist(), rest.tolist(), strict=True):
            if most < best.least[k]:
                break
            low, high = blocks[t], blocks[t + 1]
            if low == high:
                continue
            at = shard.summary_at[low : high + 1]
            bound = _sums(vector[shard.summary_term[at[0] : at[-1]]] * (shard.summary[at[0] : at[-1]].astype(np.int64) * STEP), at - at[0])
            good = low + np.flatnonzero(bound >= best.least[k])
            opened += len(good)
            docs = shard.member[_gathered(shard.member_at, good)[0]]
            docs = docs[~seen[docs]]
            if len(docs):
                seen[docs] = True
                place, ends = _gathered(shard.at, docs)
                scores = _sums(vector[shard.term[place]] * shard.impact[place].astype(np.int64), ends)
                best.add(k, scores, doc_ids[docs], missing[docs], shard.row[docs])
    return opened


def search_index(index: DataFrame, queries: Queries) -> DataFrame:
    """The best documents of each task's shards for each query."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(shared.value)
        for batch in batches:
            for k in range(batch.num_rows):
                visit(_read(batch.slice(k, 1).to_pylist()[0]), shared.value, best)
        yield best.batch()

    return index.mapInArrow(rows, FOUND)


def _ranked(found: DataFrame, best: int) -> DataFrame:
    order = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def _statistics(forward: DataFrame, number: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Documents with terms, all their terms, and for each of the queries' terms df and the largest tf."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, most = np.zeros(number, np.int64), np.zeros(number, np.int64)
        for batch in batches:
            (term, _), (tf, _) = _flat(batch.column("term")), _flat(batch.column("tf"))
            df += np.bincount(term, minlength=number)
            np.maximum.at(most, term, tf)
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(df[used]), pa.array(most[used])], ["t", "df", "most"])

    total = forward.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df, most = np.zeros(number, np.int64), np.zeros(number, np.int64)
    parts = forward.select("term", "tf").mapInArrow(rows, "t int, df bigint, most bigint")
    # One row for each term of this block of queries, at most.
    for r in parts.groupBy("t").agg(F.sum("df").alias("df"), F.max("most").alias("most")).toLocalIterator():
        df[r.t], most[r.t] = r.df, r.most
    return total[0], total[1], df, most


def search(docs: DataFrame, items: DataFrame, best: int = BEST, query_terms: int = QUERY_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score: the ``best`` rows of ``docs`` (doc_id, text) for every row of ``items`` (item_id, text).

    Only documents with a score above 0 rank; equal scores go by doc_id, with those that
    have none last. Rows that repeat a doc_id, or an item_id, are documents, or queries,
    of their own. Null and empty texts have no terms: such a document never ranks, such
    an item has no rows. Texts are read whole, however long. Without documents or items
    there are no rows. Other columns are not read.

    Queries are answered in blocks of ``query_terms`` terms, each in one pass over the
    texts; only the terms that its queries ask for are kept from them.
    """
    docs = id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    out = None
    for stored in written(query_blocks(items, query_terms), "blocks").toLocalIterator():
        answered = _answered(docs, bytes(stored.queries), best)
        out = answered if out is None else out.unionByName(answered)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return out


def _answered(docs: DataFrame, stored: bytes, best: int) -> DataFrame:
    ids, terms, _ = pickle.loads(stored)  # noqa: S301
    forward = written(forward_rows(docs, terms), "forward")
    queries = Queries(stored, *_statistics(forward, len(terms)), best)
    # The last of the best seeds is a score that many documents reach, so a bound below it never wins.
    for r in _ranked(_seeded(forward, queries), best).where(F.col("rank") == best).toLocalIterator():
        queries.least[r.query] = r.score
    queries.plan()
    index = written(build_index(forward, queries), "index")
    # One row for each query of this block.
    names = docs.sparkSession.createDataFrame(list(enumerate(ids)), "query int, item_id bigint")
    found = _ranked(search_index(index, queries), best)
    return found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
