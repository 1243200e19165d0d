"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Each document has a number of copies that its source's target asks for, with a fraction.
Two documents with fractions meet, and words move from one to the other, in a random
direction, until the copies of one are whole; the other one meets the next. The moves
keep each document's mean and the words of the two together. Blocks of documents are
worked off side by side, and what each has left over meets in a tree of blocks, whose
last document alone is drawn by itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from volscribe.llm.common import prepared, shuffle_parts
from volscribe.session import broadcast_if_small, written

WEIGHTS = (5, 2, 1)
SHARE, MOST_COPIES = 1.5, 2
# Documents of a block on average, and blocks that one block of the next level takes up.
BLOCK = 32
# Documents of a tier have lengths from one power of this to the next.
TIER = 16
_NULLS = {"ignoreNullFields": "false"}
_WORD = r"[^\x20\x09-\x0D]+"


def word_count() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("bigint")


def sized(docs: DataFrame) -> DataFrame:
    """source, doc_id, size, copy: a row for each row of ``docs``; ``copy`` numbers those that are the same."""
    words = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        word_count().alias("size"),
    )
    same = words.groupBy("source", "doc_id", "size").agg(F.count("*").alias("times"))
    return same.select("source", "doc_id", "size", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``, from 0, in the order of code points with null last.

    Ranges of sources are numbered side by side; only one count for each range meets in one task.
    """
    order = F.col("source").asc_nulls_last()
    ranged = sources.repartitionByRange(shuffle_parts(sources), order).withColumn("range", F.spark_partition_id())
    ranged = written(ranged, "sources")
    earlier = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = ranged.groupBy("range").agg(F.count("*").alias("own"))
    starts = starts.select("range", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("earlier"))
    inside = ranged.withColumn("row", F.row_number().over(W.partitionBy("range").orderBy(order)))
    return inside.join(starts, "range").withColumn("place", F.col("row") - 1 + F.col("earlier")).drop("range", "row", "earlier")


def targets(documents: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target and n, the number of documents that have words, of each source.

    Sources share ``share`` times all words by their weights. One whose share is above
    ``most`` times its words gets those, and the others share the rest, until none is
    above. Each turn settles one source at least and sends three sums to the driver.
    """
    totals = documents.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n")
    )
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = numbered(totals).withColumn("weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int")))
    weighed = written(weighed, "weights")
    limit, rate, held = most * F.col("source_size"), 0.0, -1
    whole = share * float(weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    while True:
        above = F.col("weight") * rate > limit
        row = weighed.agg(
            F.count(F.when(above, 1)), F.coalesce(F.sum(F.when(above, limit)), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)),
        ).first()
        if row[0] == held or not row[2]:
            break
        held, rate = row[0], (whole - row[1]) / row[2]
    return weighed.select("source", "source_size", "n", F.least(F.col("weight") * rate, limit.cast("double")).alias("target"))


# One step: acc has the documents that are settled and the one, if any, still with a fraction.
_EPS = "1e-9D"
_SETTLED = "named_struct('doc_id', {0}.doc_id, 'copy', {0}.copy, 'size', {0}.size, 'take', {1})"
_LEFT = "named_struct('h', {0}.h, 'doc_id', {0}.doc_id, 'copy', {0}.copy, 'size', {0}.size, 'p', {1})"
_ITEM = "struct<h: bigint, doc_id: bigint, copy: bigint, size: bigint, p: double>"
_DONE = "array<struct<doc_id: bigint, copy: bigint, size: bigint, take: int>>"


def _outcome(settled: str, take: int, other: str, fraction: str) -> str:
    """``settled`` gets ``take`` copies; ``other`` goes on with ``fraction``, unless that is whole too."""
    done = f"concat(acc.done, array({_SETTLED.format(settled, take)}))"
    both = f"concat({done}, array({_SETTLED.format(other, f'cast(round({fraction}) AS int)')}))"
    whole = f"({fraction} < {_EPS} OR {fraction} > 1 - {_EPS})"
    return (
        f"named_struct('left', if({whole}, cast(null AS {_ITEM}), {_LEFT.format(other, fraction)}), "
        f"'done', if({whole}, {both}, {done}))"
    )


def _fold(seed: int) -> str:
    """SQL that works off the array ``items`` of a block."""
    draw = f"(pmod(xxhash64(acc.left.h, x.h, {seed}), 1048576) + 0.5D) / 1048576"
    step = f"""
      transform(array(named_struct('a', acc.left, 'b', x,
          'a_up', (1 - acc.left.p) * acc.left.size, 'a_down', acc.left.p * acc.left.size,
          'b_up', (1 - x.p) * x.size, 'b_down', x.p * x.size, 'draw', {draw})),
        t -> CASE
          WHEN t.draw * (least(t.a_up, t.b_down) + least(t.a_down, t.b_up)) < least(t.a_down, t.b_up) THEN
            if(t.a_up <= t.b_down,
               {_outcome('t.a', 1, 't.b', '(t.b.p - t.a_up / t.b.size)')},
               {_outcome('t.b', 0, 't.a', '(t.a.p + t.b_down / t.a.size)')})
          ELSE
            if(t.a_down <= t.b_up,
               {_outcome('t.a', 0, 't.b', '(t.b.p + t.a_down / t.b.size)')},
               {_outcome('t.b', 1, 't.a', '(t.a.p - t.b_up / t.a.size)')})
        END)[0]"""
    start = f"named_struct('left', cast(null AS {_ITEM}), 'done', cast(array() AS {_DONE}))"
    return f"aggregate(items, {start}, (acc, x) -> if(acc.left IS NULL, named_struct('left', x, 'done', acc.done), {step}))"


def rounded_copies(fractions: DataFrame, largest: int, seed: int = 8) -> DataFrame:
    """source, doc_id, copy, size and take, 0 or 1, from rows with a chance ``p`` from 0 to 1.

    ``n`` is the number of such rows the source has at most, and ``largest`` that of all
    sources. The tree follows from it:
    rows are dealt over ``n / BLOCK`` blocks by hash, and BLOCK blocks make one of the
    next level, until a source is one block. What is left of that is drawn by itself.
    """
    fractional = F.col("p").between(1e-9, 1 - 1e-9)
    settled = [fractions.where(~fractional).select("source", "doc_id", "copy", "size", F.round("p").cast("int").alias("take"))]
    fractions = fractions.where(fractional)
    blocks = F.ceil(F.col("n") / BLOCK)
    key = F.xxhash64("source", "doc_id", "size", "copy", F.lit(seed))
    items = fractions.select(
        "source", F.pmod(key, F.greatest(blocks, F.lit(1))).alias("block"),
        F.struct(key.alias("h"), F.col("doc_id"), F.col("copy"), F.col("size"), F.col("p")).alias("item"),
    )
    levels = 1 + max(0, math.ceil(math.log(max(1, math.ceil(largest / BLOCK)), BLOCK) - 1e-9))
    for level in range(levels):
        grouped = items.groupBy("source", "block").agg(F.array_sort(F.collect_list("item")).alias("items"))
        folded = grouped.select("source", "block", F.expr(_fold(seed + level)).alias("out")).select("source", "block", "out.*")
        folded = written(folded, "rounded")
        settled.append(folded.select("source", F.inline("done")))
        items = folded.where("left IS NOT NULL").select(
            "source", F.floor(F.col("block") / BLOCK).alias("block"), F.col("left").alias("item")
        )
    draw = (F.pmod(F.xxhash64("item.h", F.lit(seed + levels)), F.lit(1048576)) + 0.5) / 1048576
    last = items.select("source", "item.doc_id", "item.copy", "item.size", (draw < F.col("item.p")).cast("int").alias("take"))
    for part in settled:
        last = last.unionByName(part)
    return last


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: int = 8) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken of every row of ``docs`` (doc_id, text, source).

    ``size`` is the number of words, 0 for null; null is a source of its own, the last in
    order. ``copies`` is the whole part of target / source_size or one more. A document
    without words gets the whole part. Long documents are rounded first, by tiers of
    length; what a tier's last document takes too much or too little is made up for by
    the chances of the shorter ones, so the words taken miss the target by a few. Rows that are alike in doc_id, source and size are
    documents of their own, numbered by ``copy``. All draws are hashes of these, so
    reruns agree. An empty table gives no rows.
    """
    prepared(docs.sparkSession)
    documents = written(sized(docs).withColumn("tier", F.floor(F.log(float(TIER), F.greatest("size", F.lit(1))) + 1e-9)), "sizes")
    goal = written(targets(documents, weights, share, most), "targets")
    ask = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.withColumn("base", F.floor(ask + 1e-9).cast("bigint"))
    open_words = F.greatest(F.col("target") - F.col("base") * F.col("source_size"), F.lit(0.0))
    # What the source is still to take beyond the base, and the words it can take that from.
    state = goal.select(F.col("source").alias("of"), "n", open_words.alias("due"), F.col("source_size").alias("room"))
    same = F.col("source").eqNullSafe(F.col("of"))
    takes = []
    largest = goal.agg(F.max("n")).first()[0] or 0
    for tier in range(int(documents.agg(F.max("tier")).first()[0] or 0), -1, -1):
        chance = F.least(F.coalesce(F.try_divide("due", "room"), F.lit(0.0)), F.lit(1.0))
        own = documents.where((F.col("tier") == tier) & (F.col("size") > 0)).join(state, same)
        own = own.select("source", "doc_id", "copy", "size", "n", F.greatest(chance, F.lit(0.0)).alias("p"))
        taken = rounded_copies(written(own, "chances"), largest, seed + 100 * tier)
        takes.append(taken)
        sums = taken.groupBy("source").agg(
            F.sum("size").alias("words"), F.sum(F.col("size") * F.col("take")).alias("took")
        )
        state = written(
            state.join(sums, same, "left").select(
                "of", "n", (F.col("due") - F.coalesce("took", F.lit(0))).alias("due"),
                (F.col("room") - F.coalesce("words", F.lit(0))).alias("room"),
            ), "state",
        )
    every = documents.where("size = 0").select("source", "doc_id", "copy", "size", F.lit(0).alias("take"))
    for part in takes:
        every = every.unionByName(part)
    copies = F.col("base") + F.col("take")
    return every.join(goal.withColumnRenamed("source", "of"), same).select(
        "doc_id", "source", "copy", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mixed_rows(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source, ...), each as often as the mix takes it, with all their columns.

    Rows that are alike in doc_id, source and number of words have the copies of such
    rows in ``mix``, in the order of a hash of their texts and of the texts. As a third of
    all rows may be without a doc_id, such rows are numbered in groups by that hash.
    """
    plan = written(mix(docs, weights, share, most), "plan")
    # Column names with a space, which no other column of the input should have.
    name = F.to_json(F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source")), _NULLS)
    plan = plan.select(name.alias("mix key"), "size", "copy", "copies")
    keys = written(plan.groupBy("mix key").agg(F.count("*").alias("rows"), F.sum("copies").alias("mix times")), "keys")
    named = docs.withColumn("mix key", name)
    once = keys.where("rows = 1 AND `mix times` > 0").select("mix key", "mix times")
    single = named.join(broadcast_if_small(once), "mix key")
    several = keys.where("rows > 1").select("mix key")
    salt = F.pmod(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(shuffle_parts(docs)))
    group = ["mix key", "mix size", "mix salt"]
    alike = named.join(broadcast_if_small(several), "mix key", "left_semi")
    alike = alike.withColumn("mix size", word_count()).withColumn("mix salt", salt)
    earlier = W.partitionBy("mix key", "mix size").orderBy("mix salt").rowsBetween(W.unboundedPreceding, -1)
    starts = alike.groupBy(*group).agg(F.count("*").alias("mix own"))
    starts = starts.select(*group, F.coalesce(F.sum("mix own").over(earlier), F.lit(0)).alias("mix start"))
    number = F.row_number().over(W.partitionBy(*group).orderBy("text"))
    alike = alike.withColumn("mix copy", number).join(starts, group)
    alike = alike.withColumn("mix copy", (F.col("mix copy") + F.col("mix start")).cast("int")).drop("mix salt", "mix start")
    takes = plan.where("copies > 0").join(several, "mix key", "left_semi").select(
        "mix key", F.col("size").alias("mix size"), F.col("copy").alias("mix copy"), F.col("copies").alias("mix times")
    )
    alike = alike.join(takes, ["mix key", "mix size", "mix copy"]).drop("mix size", "mix copy")
    times = F.explode(F.sequence(F.lit(1), F.col("mix times").cast("int")))
    return single.unionByName(alike).withColumn("mix times", times).select(*[F.col(f"`{c}`") for c in docs.columns])
