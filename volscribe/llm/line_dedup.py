"""Line dedup with a suffix array over sequences of line ids, built by prefix doubling.

A document is the sequence of its lines' ids. Ranks order its suffixes by their first
lines: by one at first, then by 2, 4, 8 and 16 times as many each turn, from the ranks of a
suffix and of those so many lines further on. A suffix that shares its rank with no other leaves.

Suffixes with a common prefix are an interval of the suffix array, and intervals form a
tree. It is unfolded from the ranks of all turns, the longest first: members of an
interval that agree on so many more lines are an interval inside it, which its first
place represents in the outer one. Every member but the first then has its longest run
of lines that also starts earlier, and where. Those that are not the end of a longer one
are the maximal repeated runs; later copies are deleted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from volscribe.llm.common import id_and_text, shuffle_parts, slices
from volscribe.session import written

# For callers who want single lines left alone, as these may repeat by chance or by custom. The registered query takes 1.
MIN_LINES = 2
# Doublings that one turn makes of the ranks it is given.
DOUBLINGS = 4
KEY = ("doc_id", "version")
PLACE = ("doc_id", "version", "place")


def lines_of(text: str) -> list[tuple[int, int, str]]:
    """Start, end and normalised content of the lines that are not blank."""
    out, start = [], 0
    for line in text.split("\n"):
        words = line.split()
        if words:
            out.append((start, start + len(line), " ".join(words)))
        start += len(line) + 1
    return out


def line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, version, place, left (how many lines are left from there) and line (a digest) of every line that is not blank."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [
                (doc_id, version, k, len(lines) - k, hashlib.blake2b(content.encode(), digest_size=16).digest())
                for doc_id, version, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "version", "text")), strict=True)
                for lines in [lines_of(text)]
                for k, (_, _, content) in enumerate(lines)
            ]
            if found:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                columns = [pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, [*PLACE, "left", "line"])

    return docs.mapInArrow(rows, "doc_id bigint, version bigint, place bigint, left bigint, line binary")


def with_earlier(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``earlier``, one plus the sum of ``n`` over all rows before in ``order``.

    Ranges of rows are added up side by side; one sum for each range meets in one task.
    """
    ranged = rows.repartitionByRange(shuffle_parts(rows), *order).withColumn("range", F.spark_partition_id())
    ranged = written(ranged, "ranged")
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy("range").agg(F.sum("n").alias("own"))
    sums = sums.select("range", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("ranges"))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("inside", inside).join(F.broadcast(sums), "range")
    return placed.withColumn("earlier", 1 + F.col("ranges") + F.col("inside")).drop("range", "ranges", "inside")


def _shared(suffixes: DataFrame, keys: list[str]) -> DataFrame:
    """The ``suffixes`` whose ``keys`` occur several times, with the rank these give them, and the first place that has them.

    Ranks are numbers in the order of the keys, with gaps. Equal keys are counted before
    the shuffle; a rank with many suffixes then joins as a single row, which Spark splits.
    """
    counted = suffixes.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("first")).where("n > 1").drop("n")
    order = counted.repartitionByRange(shuffle_parts(suffixes), *keys).sortWithinPartitions(*keys)
    order = written(order.withColumn("rank", F.monotonically_increasing_id()), "ranks")
    return suffixes.join(order, keys)


def _prefixes(names: DataFrame, length: int, k: int) -> DataFrame:
    """doc_id, version, place, left, k and names: of each suffix its first 2 * ``length``, 4 * ``length``, ... lines.

    ``names`` has the ranks of all suffixes by their first ``length`` lines, as far as
    these are shared; up to 2**DOUBLINGS of them, that many lines apart, stand for a
    longer prefix. Where the document ends before, there are fewer. A suffix that lacks one
    is unique from there on.
    """
    ahead = W.partitionBy(*KEY, F.col("place") % length).orderBy("place").rangeBetween(0, length * ((1 << DOUBLINGS) - 1))
    blocks = names.select(*PLACE, "left", F.collect_list(F.struct("place", "rank")).over(ahead).alias("blocks"))
    until_end = F.floor((F.col("left") + length - 1) / length)
    turns = [F.struct(F.lit(k + j).alias("k"), F.least(F.lit(1 << j), until_end).cast("int").alias("n")) for j in range(1, DOUBLINGS + 1)]
    # Once a suffix has ended, more lines tell nothing new; the longest prefixes have all, as the next turn's names.
    going = [F.when(F.col("left") > length << (j - 1), turn) for j, turn in enumerate(turns[:-1], 1)]
    each = blocks.select(*PLACE, "left", "blocks", F.explode(F.array_compact(F.array(*going, turns[-1]))).alias("turn"))
    last = F.expr("blocks[turn.n - 1].place")
    each = each.where((F.size("blocks") >= F.col("turn.n")) & (last == F.col("place") + length * (F.col("turn.n") - 1)))
    return each.select(*PLACE, "left", "turn.k", F.expr("slice(blocks.rank, 1, turn.n)").alias("names"))


def repeated_suffixes(docs: DataFrame) -> list[DataFrame]:
    """For k = 0, 1, ...: the suffixes whose first 2**k lines (or all, if fewer are left) also start elsewhere.

    Each as doc_id, version, place, left, rank and first (the first place of that rank),
    and for k > 0 only those with more than 2**(k - 1) lines left. A turn makes DOUBLINGS
    of these tables at once; the turns grow with the logarithm of the longest repeated
    run. Rows that repeat a document come once.
    """
    # Both the count of each line and the join with it read this.
    names = _shared(written(line_rows(docs), "lines"), ["line"]).drop("line")
    names = written(names.dropDuplicates(list(PLACE)), "suffixes")
    levels, length, k = [names], 1, 0
    goes_on = names.agg(F.max("left")).first()[0]
    while goes_on is not None and goes_on > length:
        found = _shared(written(_prefixes(names, length, k), "prefixes"), ["k", "names"])
        found = written(found.select(*PLACE, "left", "k", "rank", "first"), "suffixes")
        going = F.col("left") > F.expr("shiftleft(1L, k - 1)")
        highest, goes_on = found.agg(F.max(F.when(going, F.col("k"))), F.max(F.when(F.col("k") == k + DOUBLINGS, F.col("left")))).first()
        levels += [found.where(going & (F.col("k") == n)).drop("k") for n in range(k + 1, (highest or k) + 1)]
        names, length, k = found.where(F.col("k") == k + DOUBLINGS), length << DOUBLINGS, k + DOUBLINGS
    return levels


def _longest(levels: list[DataFrame]) -> DataFrame:
    """The rows of all ``levels``, with their number ``k``, but those of a suffix that has an earlier one of its rank in a longer level."""
    every = reduce(DataFrame.unionByName, [level.withColumn("k", F.lit(k)) for k, level in enumerate(levels)])
    later = F.max(F.when(~F.struct(*PLACE).eqNullSafe(F.col("first")), F.col("k"))).over(W.partitionBy(*PLACE))
    every = every.withColumn("later", later).where("later IS NULL OR k >= later")
    return written(every.select(*PLACE, "left", "rank", "k"), "longest")


def _at(rows: DataFrame, other: DataFrame, place: str, how: str) -> DataFrame:
    """``rows`` joined with the rows of ``other`` that name the same document and ``place``."""
    other = other.select(*[F.col(c).alias(f"of_{c}") for c in PLACE], *[c for c in other.columns if c not in PLACE])
    same = F.col("doc_id").eqNullSafe(F.col("of_doc_id")) & (F.col("version") == F.col("of_version")) & (F.col(place) == F.col("of_place"))
    return rows.join(other, same, how).drop("of_doc_id", "of_version", "of_place")


def copies(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """doc_id, version, place, lines, first: the longest run of lines from a place that also starts earlier, and where first.

    Only runs of ``min_lines`` or more lines. A place with such a run may come twice.
    An interval is named by its first place (``head``) and its number of lines (``m``);
    the whole array has no lines. One turn for each table of repeated suffixes, and never
    more rows in it than twice the repeated suffixes.
    """
    levels, found, items = repeated_suffixes(docs), [], None
    whole = F.struct(F.lit(None).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("version"), F.lit(-1).cast("bigint").alias("place"))
    # Of suffixes that agree on twice as many lines, only the first is left in the whole array.
    longest = _longest(levels)
    for k in reversed(range(len(levels))):
        step = 1 << k
        looked = longest.where(F.col("k") == k)
        looked = looked.select(*PLACE, "left", whole.alias("head"), F.lit(0).cast("bigint").alias("m"), "rank")
        if items is not None:
            ranks = levels[k].select(*PLACE, "rank")
            inner = _at(items.withColumn("ahead", F.col("place") + F.col("m")), ranks, "ahead", "left").drop("ahead")
            looked = written(looked.unionByName(inner), "looked")
        inside = looked.where("rank is not null")
        groups = inside.groupBy("head", "m", "rank").agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("top")).where("n > 1").drop("n")
        # A row for each group, stored, so that Spark may split the other side where one group is hot.
        grouped = inside.join(written(groups, "groups"), ["head", "m", "rank"], "left").drop("rank")
        alone = looked.where("rank is null").drop("rank").withColumn("top", F.lit(None).cast(grouped.schema["top"].dataType))
        grouped = written(grouped.unionByName(alone), "intervals")
        is_top, end = F.struct(*PLACE).eqNullSafe(F.col("top")), F.col("m") + step
        # Equal to the end of their documents, so no longer run can follow.
        ended = grouped.where(F.col("top").isNotNull() & ~is_top & (F.col("left") < end))
        found.append(ended.select(*PLACE, F.col("left").alias("lines"), F.col("top").alias("first")))
        stays = F.when((F.col("m") > 0) & (F.col("top").isNull() | is_top), F.struct("head", "m"))
        enters = F.when(F.col("top").isNotNull() & (F.col("left") >= end), F.struct(F.col("top").alias("head"), end.alias("m")))
        items = grouped.select(*PLACE, "left", F.explode(F.array_compact(F.array(stays, enters))).alias("item")).select(*PLACE, "left", "item.*")
    last = items.where(~F.struct(*PLACE).eqNullSafe(F.col("head"))).select(*PLACE, F.col("m").alias("lines"), F.col("head").alias("first"))
    # Where documents end alike, others may hold the same lines earlier and go on; then the first of the former starts there.
    known = written(last, "last").select(F.col("first").alias("earliest"), F.col("lines").alias("of_lines"), *[F.col(c).alias(f"of_{c}") for c in PLACE])
    same = F.col("first.doc_id").eqNullSafe(F.col("of_doc_id")) & (F.col("lines") == F.col("of_lines"))
    for c in ("version", "place"):
        same &= F.col(f"first.{c}") == F.col(f"of_{c}")
    ended = reduce(DataFrame.unionByName, found).join(known, same, "left").select(*PLACE, "lines", F.coalesce("earliest", "first").alias("first"))
    return ended.unionByName(known.select(*[F.col(f"of_{c}").alias(c) for c in (*PLACE, "lines")], F.col("earliest").alias("first"))).where(F.col("lines") >= min_lines)


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """doc_id, n_lines, n_removed, runs and kept_text of every row of ``docs`` (doc_id, text).

    ``runs`` holds each maximal run of ``min_lines`` or more lines that also starts
    earlier: first_line, lines, and from_doc_id and from_line, where it starts first.
    Runs may touch or overlap; every line in one is removed. Earlier is by doc_id and
    place, also where a run overlaps itself. Lines are compared with
    their white space as single spaces; blank lines are no lines here, and stay. Null
    texts are empty. A null doc_id comes first. Texts that share a doc_id come in the
    order of a hash, and rows that repeat a document are one place: each keeps what the
    other does. Whole texts are read, however long. An empty table gives no rows. Other
    columns are not read.
    """
    docs = id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("bigint")).withColumn("version", F.xxhash64("text"))
    marks = copies(docs, min_lines).groupBy(*KEY).agg(F.collect_set(F.struct("place", "lines", "first.doc_id", F.col("first.place").alias("from"))).alias("marks"))
    run = pa.struct([(c, pa.int64()) for c in ("first_line", "lines", "from_doc_id", "from_line")])
    kinds = {"doc_id": pa.int64(), "n_lines": pa.int64(), "n_removed": pa.int64(), "runs": pa.list_(run), "kept_text": pa.string()}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = []
            for doc_id, text, marked in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "marks")), strict=True):
                runs, cuts, end = [], [], 0
                for m in sorted(marked or (), key=lambda m: m["place"]):
                    low, high = m["place"], m["place"] + m["lines"]
                    # The end of the run before it is no run of its own.
                    if high <= end:
                        continue
                    runs.append({"first_line": low, "lines": m["lines"], "from_doc_id": m["doc_id"], "from_line": m["from"]})
                    if cuts and low <= end:
                        cuts[-1][1] = high
                    else:
                        cuts.append([low, high])
                    end = high
                places = lines_of(text) if cuts else None
                kept, at = [], 0
                for low, high in cuts:
                    kept.append(text[at : places[low][0]])
                    # With the line feed, if the text goes on.
                    at = min(len(text), places[high - 1][1] + 1)
                kept.append(text[at:])
                n = len(places) if cuts else sum(not x.isspace() for x in text.split("\n") if x)
                out.append((doc_id, n, sum(b - a for a, b in cuts), runs, "".join(kept)))
            columns = zip(zip(*out, strict=True), kinds.values(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in columns], names=list(kinds))

    named = marks.select(*[F.col(k).alias(f"of_{k}") for k in KEY], "marks")
    both = docs.join(named, F.col("doc_id").eqNullSafe(F.col("of_doc_id")) & (F.col("version") == F.col("of_version")), "left")
    schema = "doc_id bigint, n_lines bigint, n_removed bigint, runs array<struct<first_line: bigint, lines: bigint, from_doc_id: bigint, from_line: bigint>>, kept_text string"
    return both.select("doc_id", "text", "marks").mapInArrow(rows, schema)
