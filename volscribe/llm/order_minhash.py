"""Near-dedup by order MinHash, with candidates verified by banded alignment.

A text's k-mers are its runs of five words, labelled with their occurrence. A sketch
takes the few labelled k-mers with the smallest hashes and keeps them in text order, so
equal sketches speak for a small edit distance. Texts that share a sketch are candidates,
and so are short ones that share one of a few single k-mers, without chance.
Two texts are near copies if their longest common subsequence of k-mers is 0.8 or more of
all k-mers of the two, those common counted once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from volscribe.llm.common import id_and_text, mixed, slices, text_buffer
from volscribe.llm.components import components
from volscribe.llm.words import shingles, word_hashes
from volscribe.session import broadcast_if_small, written

# Sketches of a text, and k-mers of a sketch. At a similarity of 0.8 two long texts have 13
# of the sketches in common on average, and none in one of ten million cases.
SKETCHES, KMERS = 40, 5
SIMILARITY = 0.8
# Among few k-mers shared sketches are rarer, and below KMERS they need equal texts. Texts of
# up to these many also meet by single k-mers, which leaves out none of their near copies.
EXACT_KMERS = 25
# Texts of a group that its others meet in one turn, and turns at most before all pairs do.
STARS, TURNS = 3, 2
# Cells that count how common k-mers are; this only orders them.
CELLS = 1 << 20
_SINGLE = np.uint64(0xA0761D6478BD642F)
_ODD = np.random.default_rng(4).integers(0, 2**31, SKETCHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def labelled(kmers: np.ndarray) -> np.ndarray:
    """Hashes of one text's k-mers, each with how often it has occurred before."""
    ordered = np.sort(kmers)
    repeated = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    out = mixed(kmers)
    if len(repeated):
        at = np.flatnonzero(np.isin(kmers, repeated))
        order = at[np.argsort(kmers[at], kind="stable")]
        first = np.flatnonzero(np.r_[True, kmers[order][1:] != kmers[order][:-1]])
        occurrence = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
        out[order] = mixed(kmers[order] + occurrence.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def chosen(kmers: np.ndarray) -> np.ndarray:
    """For each sketch the KMERS smallest labelled k-mers in text order; with fewer, all and zeros."""
    labels = (labelled(kmers) >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((SKETCHES, KMERS), np.uint64)
    if len(kmers) <= KMERS:
        out[:, : len(kmers)] = kmers
        return out
    step = max(1, (1 << 20) // len(kmers))
    with np.errstate(over="ignore"):
        for low in range(0, SKETCHES, step):
            hashes = labels * _ODD[low : low + step, None]
            places = np.argpartition(hashes, KMERS - 1, axis=1)[:, :KMERS]
            places.sort(axis=1)
            out[low : low + step] = kmers[places]
    return out


def order_sketches(found: list[np.ndarray]) -> np.ndarray:
    """SKETCHES hashes of each text's chosen k-mers, one row for each text."""
    every = np.array([chosen(k) for k in found], np.uint64).reshape(len(found), SKETCHES, KMERS)
    value = np.broadcast_to(np.arange(SKETCHES, dtype=np.uint64), every.shape[:2])
    with np.errstate(over="ignore"):
        for k in range(KMERS):
            value = mixed(value * np.uint64(0xD6E8FEB86659FD93) + every[:, :, k])
    return value


def meeting_places(found: list[np.ndarray]) -> list[np.ndarray]:
    """Each text's sketches and, with up to EXACT_KMERS k-mers, the first of these in one order of all k-mers.

    Of the latter there are so many that any two near copies share one, see ``rarest``.
    """
    out = []
    for kmers, own in zip(found, order_sketches(found), strict=True):
        if len(kmers) <= EXACT_KMERS:
            own = np.r_[own, mixed(rarest(labelled(kmers), np.zeros(1, np.int64)) ^ _SINGLE)]
        out.append(own)
    return out


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence with partners at most ``band`` places apart.

    Bit n of a number stands for place n of ``a``; each element of ``b`` takes a few
    operations on whole numbers. What only one of them has is left out first.
    """
    at_a, at_b = np.flatnonzero(np.isin(a, b)), np.flatnonzero(np.isin(b, a))
    x, y = a[at_a], b[at_b]
    if np.array_equal(x, y) and (not len(x) or int(np.abs(at_a - at_b).max()) <= band):
        return len(x)
    where: dict[int, int] = {}
    for k, value in enumerate(x.tolist()):
        where[value] = where.get(value, 0) | (1 << k)
    low = np.searchsorted(at_a, at_b - band).tolist()
    high = np.searchsorted(at_a, at_b + band, side="right").tolist()
    full = (1 << len(x)) - 1
    free = full
    for value, i, j in zip(y.tolist(), low, high, strict=True):
        hits = free & where[value] & ((1 << j) - (1 << i))
        free = ((free + hits) | (free - hits)) & full
    return len(x) - free.bit_count()


def near(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two sequences of k-mers are near copies.

    If they are, at most ``(1 - similarity) / (1 + similarity)`` of all k-mers have no
    partner, so no partners stand further apart than that; this is the band.
    """
    total = len(a) + len(b)
    if not total:
        return True
    need = similarity * total / (1 + similarity) - 1e-9
    if min(len(a), len(b)) < need or min(int(np.isin(a, b).sum()), int(np.isin(b, a).sum())) < need:
        return False
    return aligned(a, b, int(total * (1 - similarity) / (1 + similarity)) + 1) >= need


def _sequence(text: bytes) -> bytes:
    return hashlib.blake2b(b" ".join(text.split()), digest_size=16).digest()


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, node (a digest of the text's words in order), kmers (their number) and sketches of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            kmers, first = shingles(*word_hashes(*text_buffer(part.column("text"))))
            some = np.flatnonzero(np.diff(first))
            rows = meeting_places([kmers[first[k] : first[k + 1]] for k in some])
            number = np.zeros(part.num_rows, np.int64)
            number[some] = [len(r) for r in rows]
            at = np.r_[0, np.cumsum(number)]
            rows = np.concatenate([np.empty(0, np.uint64), *rows]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([_sequence(t) for t in part.column("text").cast(pa.binary()).to_pylist()], pa.binary()),
                    pa.array(np.diff(first), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(rows)),
                ],
                ["doc_id", "node", "kmers", "sketches"],
            )

    return docs.mapInArrow(rows, "doc_id bigint, node binary, kmers bigint, sketches array<bigint>")


def bodies(docs: DataFrame) -> DataFrame:
    """node and body, the hashes of its words, of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words, first = word_hashes(*text_buffer(part.column("text")))
            nodes = [_sequence(t) for t in part.column("text").cast(pa.binary()).to_pylist()]
            found = [(words[a:b] >> np.uint64(32)).astype("<u4").tobytes() for a, b in zip(first, first[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(found, pa.binary())], ["node", "body"])

    return docs.mapInArrow(rows, "node binary, body binary")


def verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """root_a, root_b of those of ``pairs`` (a, b, root_a, root_b) that are near copies, once each.

    ``words`` has the bodies of all texts that are candidates; those of these pairs go on to the join.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for own in zip(batch.column("body_a").to_pylist(), batch.column("body_b").to_pylist(), strict=True):
                parts = [np.frombuffer(x, "<u4").astype(np.uint64) for x in own]
                keep.append(near(*(shingles(w, np.array([0, len(w)]))[0] for w in parts)))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("root_a"), kept.column("root_b")], ["root_a", "root_b"])

    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    own = words.join(broadcast_if_small(ends), "node", "left_semi")
    both = pairs.join(own.select(F.col("node").alias("b"), F.col("body").alias("body_b")), "b")
    both = both.join(own.select(F.col("node").alias("a"), F.col("body").alias("body_a")), "a")
    found = both.select("root_a", "root_b", "body_a", "body_b").mapInArrow(rows, "root_a binary, root_b binary")
    return written(found.distinct(), "links")


def _open_groups(classed: DataFrame) -> DataFrame:
    """The rows of those groups that still have texts of different classes."""
    several = classed.groupBy("sketch").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return written(classed.join(several.select("sketch"), "sketch", "left_semi"), "open")


def _star_pairs(left: DataFrame, turn: int) -> DataFrame:
    """Each text of a group with a few texts of the group, drawn anew each turn, as far as they are of other classes."""
    text = F.struct("node", "root")
    drawn = [F.min_by(text, F.xxhash64("node", F.lit(turn), F.lit(k))) for k in range(STARS)]
    stars = written(left.groupBy("sketch").agg(F.array(*drawn).alias("stars")), "stars")
    met = left.join(stars, "sketch").select("node", "root", F.explode("stars").alias("star")).where("root <> star.root")
    return _ordered(met, "node", "star.node", "root", "star.root").distinct()


def _ordered(pairs: DataFrame, node_1: str, node_2: str, root_1: str, root_2: str) -> DataFrame:
    first = F.col(node_1) < F.col(node_2)
    ends = [("a", node_1, node_2), ("b", node_2, node_1), ("root_a", root_1, root_2), ("root_b", root_2, root_1)]
    return pairs.select(*[F.when(first, F.col(x)).otherwise(F.col(y)).alias(name) for name, x, y in ends])


def _commonness(words: DataFrame) -> np.ndarray:
    """How many k-mers of ``words`` hash to each of CELLS cells.

    Tasks add up their own and send what they have in pieces, which are added up by
    piece. Its size is fixed, whatever the number of texts, so every task may have it.
    """
    piece = CELLS // 64

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            for body in batch.column("body").to_pylist():
                np.add.at(cells, (_labels(body) % np.uint64(CELLS)).astype(np.int64), 1)
        parts = [(k, cells[k * piece : (k + 1) * piece].tobytes()) for k in range(64)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts]), pa.array([c for _, c in parts], pa.binary())], ["piece", "cells"])

    def added(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.int64) for c in group.column("cells").to_pylist())
        return pa.table([group.column("piece").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["piece", "cells"])

    schema = "piece bigint, cells binary"
    rows = words.select("body").mapInArrow(counted, schema).groupBy("piece").applyInArrow(added, schema).toLocalIterator()
    parts = {r["piece"]: np.frombuffer(bytes(r["cells"]), np.int64) for r in rows}
    return np.concatenate([parts[k] for k in range(64)]) if parts else np.zeros(CELLS, np.int64)


def _labels(body: bytes) -> np.ndarray:
    words = np.frombuffer(body, "<u4").astype(np.uint64)
    return labelled(shingles(words, np.array([0, len(words)]))[0])


def rarest(labels: np.ndarray, commonness: np.ndarray) -> np.ndarray:
    """The least common of a text's labelled k-mers, so many that any near copy has one of its own among them.

    Near copies have 0.8 of the longer one's k-mers in common, so not all of them are
    outside the first fifth and one more, in one order of all k-mers.
    """
    number = len(labels) - int(np.ceil(SIMILARITY * len(labels) - 1e-9)) + 1
    order = np.lexsort((labels, commonness[(labels % np.uint64(len(commonness))).astype(np.int64)]))
    return labels[order[:number]]


def _all_pairs(left: DataFrame, words: DataFrame) -> DataFrame:
    """All pairs of texts of different classes that can be near copies.

    Two such texts share one of the rarest k-mers of each, and from the first one they
    share on, in the order of all k-mers, each has as many left as near copies have in
    common. This leaves out no near copies, but most pairs that only share a passage.
    """
    nodes = written(left.select("node", "kmers", "root").distinct(), "nodes")
    own = written(words.join(broadcast_if_small(nodes.select("node")), "node", "left_semi"), "bodies")
    commonness = words.sparkSession.sparkContext.broadcast(_commonness(own))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [rarest(_labels(body), commonness.value).astype(np.int64) for body in batch.column("body").to_pylist()]
            which = np.repeat(np.arange(batch.num_rows), [len(f) for f in found])
            if len(which):
                places = pa.array(np.concatenate([np.arange(len(f)) for f in found]))
                columns = [pa.array(np.concatenate(found)), places, batch.column("node").take(pa.array(which))]
                yield pa.RecordBatch.from_arrays(columns, ["kmer", "place", "node"])

    rare = written(own.mapInArrow(rows, "kmer bigint, place bigint, node binary"), "rare")
    several = rare.groupBy("kmer").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    rare = written(rare.join(written(several.select("kmer"), "several"), "kmer").join(nodes, "node"), "rare")
    # Lengths in steps of 1 / 0.8: near copies are in the same step or in neighbouring ones.
    step = F.floor(F.log("kmers") / float(np.log(1 / SIMILARITY)) + 1e-9)
    names = ("node", "kmers", "root", "place")
    one = rare.select("kmer", F.explode(F.array(step, step + 1)).alias("step"), step.alias("own"), *[F.col(c).alias(c + "_1") for c in names])
    two = rare.select("kmer", step.alias("step"), *[F.col(c).alias(c + "_2") for c in names])
    common = SIMILARITY / (1 + SIMILARITY)
    close = f"least(kmers_1 - place_1, kmers_2 - place_2) >= {common} * (kmers_1 + kmers_2) - 1e-9"
    once = "(own < step OR node_1 < node_2)"
    crossing = one.join(two, ["kmer", "step"]).where(f"root_1 <> root_2 AND {close} AND {once}")
    return _ordered(crossing, "node_1", "node_2", "root_1", "root_2").distinct()


def _joined(classed: DataFrame, links: DataFrame) -> DataFrame:
    """``classed`` with the classes that ``links`` connect made one."""
    found = components(links.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    found = written(found.select(F.col("node").alias("root"), F.col("root").alias("to")), "roots")
    return written(classed.join(found, "root", "left").withColumn("root", F.coalesce("to", "root")).drop("to"), "classed")


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, node and root, which names the class, of every row of ``docs``, as ``near_classes`` describes it."""
    docs = id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    own = written(sketched(docs), "sketches")
    texts = own.groupBy("node").agg(
        F.min("doc_id").alias("lead"), F.first("kmers").alias("kmers"), F.first("sketches").alias("sketches")
    )
    texts = written(texts, "texts")
    places = texts.select("node", "kmers", F.explode("sketches").alias("sketch"))
    shared = places.groupBy("sketch").agg(F.count("*").alias("members")).where("members > 1")
    classed = written(places.join(written(shared, "shared"), "sketch").select("sketch", "node", "kmers", F.col("node").alias("root")), "classed")
    wanted = texts.join(classed.select("node").distinct(), "node", "left_semi").select("node", F.col("lead").alias("of"))
    wanted = written(wanted, "candidates")
    found = bodies(docs.join(broadcast_if_small(wanted.select("of")), F.col("doc_id").eqNullSafe(F.col("of")), "left_semi"))
    words = written(found.join(broadcast_if_small(wanted.select("node")), "node", "left_semi"), "bodies")

    left, turn = classed, 0
    while turn < TURNS:
        links = verified(written(_star_pairs(left, turn), "pairs"), words)
        if links.isEmpty():
            break
        classed, turn = _joined(classed, links), turn + 1
        left = _open_groups(classed)
    if not left.isEmpty():
        links = verified(written(_all_pairs(left, words), "pairs"), words)
        if not links.isEmpty():
            classed = _joined(classed, links)

    roots = classed.select("node", "root").distinct()
    every = own.select("doc_id", "node").join(roots, "node", "left")
    return written(every.select("doc_id", "node", F.coalesce("root", "node").alias("root")), "classes")


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id, the smallest doc_id of its class, of every row of ``docs`` (doc_id, text).

    Texts with the same words in the same order are in one class, whatever stands
    between the words; so are all texts without words. Classes are what verified links
    connect. A null text is empty. A class without any doc_id has none as its id. Rows
    repeat as they are given; other columns are not read.

    The texts of one sketch form a group. To keep large groups of near copies from
    meeting in all pairs, they first meet a few of their group, and turn by turn those
    not yet in one class meet a few others. After TURNS turns, or one without links, all
    texts of open groups that are still in different classes and share a rare k-mer meet,
    so none that could join two classes are left out.
    """
    every = _classes(docs)
    ids = written(every.groupBy("root").agg(F.min("doc_id").alias("class_id")), "ids")
    return every.join(ids, "root").select("doc_id", "class_id")


def _with_nodes(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text node``, the digest of the text's words in order."""
    columns = docs.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("node text").cast(pa.binary()).to_pylist()
            nodes = pa.array([_sequence(t) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), nodes], [*columns, "text node"])

    schema = T.StructType([*docs.schema.fields, T.StructField("text node", T.BinaryType())])
    return docs.withColumn("node text", F.coalesce(F.col("text").cast("string"), F.lit(""))).mapInArrow(rows, schema)


def first_of_classes(docs: DataFrame) -> DataFrame:
    """Of each class the row of ``docs`` (doc_id, text, ...) with the smallest doc_id, with all its columns.

    One without a doc_id stays only where its whole class has none; among those, and among
    texts that share a doc_id, the order is that of a hash. What stays is named by doc_id, and by its
    words as well only where rows share a doc_id or have none.
    """
    every = _classes(docs)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    kept = every.groupBy("root").agg(F.min(place).alias("first")).select("first.doc_id", "first.node")
    kept = written(kept, "kept")
    shared = written(every.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "shared_ids")
    id_of = F.col("doc_id").alias("kept id")
    same = F.col("doc_id").eqNullSafe(F.col("kept id"))
    alone = kept.join(shared.select(id_of), same, "left_anti")
    plain = docs.join(broadcast_if_small(alone.select(id_of)), same, "left_semi")
    if shared.isEmpty():
        return plain
    several = docs.join(broadcast_if_small(shared.select(id_of)), same, "left_semi")
    named = kept.select(id_of, F.col("node").alias("kept node"))
    several = _with_nodes(several).join(named, same & (F.col("text node") == F.col("kept node")), "left_semi")
    return plain.unionByName(several.dropDuplicates(["doc_id", "text node"]).drop("text node"))
