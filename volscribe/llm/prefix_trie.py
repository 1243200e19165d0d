"""A z-fast trie of conversations, kept as tables.

The trie is compacted: its nodes are the prefixes where conversations part or end, and an
edge spans all turns between two nodes. A prefix is known by a digest of its turns. Each
node is filed under its handle, the prefix whose length is the 2-fattest number on its
edge, so that the way of a conversation down the trie is found by fat binary search, in
about as many joins as its length has bits. Conversations are inserted in batches: what
lies beyond the place where one leaves the trie becomes new edges, and the edge it leaves
is split. Edges are expanded into single prefixes in the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from volscribe.llm.carry import carried
from volscribe.session import written

# Batches take in these parts of all conversations, so that each finds a trie of about its own size.
BATCHES = ((0,), (1,), (2, 3))
MOST_BORROWED = 8
NODE = ("depth", "p1", "p2")


def fattest(low: int, high: int) -> int:
    """The number in (low, high] that has the most zero bits at its end."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


def fattest_column(low: str, high: str) -> F.Column:
    return F.expr(f"{high} & shiftleft(-1L, length(bin({low} ^ {high})) - 1)")


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv, place (from 1), d1, d2 (120 bits of a digest of role and text) and bytes of every turn, in order.

    Turns go by their number, null first; those that share one go by their digest.
    Rows without a conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    part = [F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint").alias(name) for at, name in ((1, "d1"), (16, "d2"))]
    turn = F.col("turn").cast("bigint")
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv"), turn.isNotNull().cast("int").alias("numbered"), F.coalesce(turn, F.lit(0)).alias("number"),
        *part, F.octet_length(text).cast("bigint").alias("bytes"), F.lit(1).cast("bigint").alias("one"),
    )
    placed = carried(written(rows, "turns"), "conv", ["numbered", "number", "d1", "d2"], sums=["one"])
    return placed.select("conv", F.col("sum_one").alias("place"), "d1", "d2", "bytes")


def borrowed(turns: DataFrame) -> DataFrame:
    """``turns`` rebuilt: the first h turns of conversation c - c % 5, then the conversation's own after its first h; h is crc32(c) % 9."""
    turns = written(turns, "placed")
    convs = turns.groupBy("conv").agg(F.max("place").alias("n"))
    convs = convs.withColumn("h", F.crc32(F.col("conv").cast("string")) % (MOST_BORROWED + 1)).withColumn("source", F.col("conv") - F.col("conv") % 5)
    convs = written(convs, "convs")
    sources = convs.select(F.col("conv").alias("source"), F.col("n").alias("has"))
    taken = written(convs.join(sources, "source", "left").withColumn("taken", F.least("h", F.coalesce("has", F.lit(0)))), "taken")
    own = turns.join(taken.select("conv", "h", "taken"), "conv").where(F.col("place") > F.col("h"))
    own = own.withColumn("place", F.col("place") - F.col("h") + F.col("taken"))
    first = turns.where(F.col("place") <= MOST_BORROWED).withColumnRenamed("conv", "source")
    lent = first.join(taken.select("conv", "source", "taken"), "source").where(F.col("place") <= F.col("taken"))
    columns = ["conv", "place", "d1", "d2", "bytes"]
    nothing = taken.select("conv", *(F.lit(0).cast("bigint").alias(c) for c in columns[1:]))
    return own.select(*columns).unionByName(lent.select(*columns)).unionByName(nothing)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv, depth, p1, p2 (of the prefix of so many turns), b1, b2 (of the one before), bytes and upto (their sum).

    ``turns`` has a row with place 0 for each conversation, its empty prefix. Digests are
    sums of random numbers that place and turn give: two of 64 bits.
    """
    mixed = [F.when(F.col("place") > 0, F.xxhash64(*order)).otherwise(0).alias(name) for name, order in (("g1", ("place", "d1", "d2")), ("g2", ("d2", "place", "d1")))]
    rows = written(turns.select("conv", F.col("place").alias("depth"), *mixed, "bytes"), "mixed")
    summed = carried(rows, "conv", ["depth"], sums=["g1", "g2", "bytes"])
    before = carried_before(summed)
    return written(before, "prefixes")


def carried_before(summed: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, g = (np.stack([np.asarray(batch.column(c)) for c in names]) for names in (("sum_g1", "sum_g2"), ("g1", "g2")))
            # Wraps around, as the sums do.
            b = p - g
            columns = [batch.column("conv"), batch.column("depth"), *map(pa.array, (*p, *b)), batch.column("bytes"), batch.column("sum_bytes")]
            yield pa.RecordBatch.from_arrays(columns, ["conv", "depth", "p1", "p2", "b1", "b2", "bytes", "upto"])

    return summed.mapInArrow(rows, "conv bigint, depth bigint, p1 bigint, p2 bigint, b1 bigint, b2 bigint, bytes bigint, upto bigint")


def _of(paths: DataFrame, conv: str, depth: str, **names: str) -> DataFrame:
    """Columns of ``paths`` renamed, to look up a conversation's prefix of some length."""
    return paths.select(F.col("conv").alias(conv), F.col("depth").alias(depth), *(F.col(old).alias(new) for new, old in names.items()))


class ZFastTrie:
    """``nodes``: rep (a conversation that runs through), base (what of it other nodes hold), above and depth (the edge), p1, p2.

    The root is not listed. ``paths`` are the prefixes of all conversations, inserted or not.
    """

    def __init__(self, paths: DataFrame):
        self.paths, self.nodes, self.filed = paths, None, None

    def file(self) -> None:
        """File each node under its handle and under the first turn of its edge."""
        keys = F.array_distinct(F.array(fattest_column("above", "end"), F.col("above") + 1))
        wanted = self.nodes.withColumnsRenamed({"depth": "end", "p1": "e1", "p2": "e2"}).withColumn("key", F.explode(keys))
        wanted = wanted.withColumn("handle", F.col("key") == fattest_column("above", "end")).withColumn("name", F.col("key") == F.col("above") + 1)
        self.filed = written(wanted.join(_of(self.paths, "rep", "key", k1="p1", k2="p2"), ["rep", "key"]), "handles")

    def located(self, convs: DataFrame) -> DataFrame:
        """conv, n, deepest (node that is a prefix) and match (turns in common with the trie), of ``convs`` (conv, n), with rep and base of the edge left."""
        if self.nodes is None:
            nothing = (F.lit(None).cast("bigint").alias(c) for c in ("rep", "base"))
            return convs.select("conv", "n", F.lit(0).cast("bigint").alias("deepest"), F.lit(0).cast("bigint").alias("match"), *nothing)
        handles = self.filed.where("handle").select("key", "k1", "k2", F.col("end"), "e1", "e2")
        state = written(convs.select("conv", "n", F.lit(0).cast("bigint").alias("low"), F.col("n").alias("high")), "search")
        done = state.where("low >= high")
        going = state.where("low < high")
        while not going.isEmpty():
            probe = going.withColumn("key", fattest_column("low", "high")).join(_of(self.paths, "conv", "key", k1="p1", k2="p2"), ["conv", "key"])
            hit = probe.join(handles, ["key", "k1", "k2"], "left")
            # A handle in common does not say that the whole edge is.
            there = hit.join(_of(self.paths, "conv", "end", f1="p1", f2="p2"), ["conv", "end"], "left")
            same = F.coalesce((F.col("e1") == F.col("f1")) & (F.col("e2") == F.col("f2")), F.lit(False))
            moved = there.select(
                "conv", "n", F.when(same, F.col("end")).otherwise(F.col("low")).alias("low"), F.when(same, F.col("high")).otherwise(F.col("key") - 1).alias("high")
            )
            state = written(moved, "search")
            done, going = done.unionByName(state.where("low >= high")), state.where("low < high")
        found = done.select("conv", "n", F.col("low").alias("deepest"))
        # The edge that goes on with the next turn, and how far.
        names = self.filed.where("name").select("key", "k1", "k2", "rep", "base", "end")
        left = found.withColumn("key", F.col("deepest") + 1).join(_of(self.paths, "conv", "key", k1="p1", k2="p2"), ["conv", "key"], "left")
        left = written(left.join(names, ["key", "k1", "k2"], "left").select("conv", "n", "deepest", "rep", "base", "end"), "edges")
        edge = left.where("rep IS NOT NULL").select("conv", "deepest", "rep", "end").join(self.paths, "conv")
        edge = edge.where("depth > deepest AND depth <= end").select("conv", "rep", "depth", "p1", "p2")
        same = edge.join(_of(self.paths, "rep", "depth", p1="p1", p2="p2"), ["rep", *NODE]).groupBy("conv").agg(F.count("*").alias("along"))
        return left.join(same, "conv", "left").select("conv", "n", "deepest", (F.col("deepest") + F.coalesce("along", F.lit(0))).alias("match"), "rep", "base")

    def insert(self, convs: DataFrame) -> None:
        """Insert ``convs`` (conv, n) into the trie."""
        found = written(self.located(convs), "located")
        split = found.where("match > deepest").withColumn("depth", F.col("match")).join(_of(self.paths, "conv", "depth", p1="p1", p2="p2"), ["conv", "depth"])
        split = split.groupBy(*NODE).agg(F.min("rep").alias("rep"), F.min("base").alias("base")).select("rep", "base", *NODE)
        beyond = self.paths.join(found.select("conv", "n", "match"), "conv").where("depth > match")
        new = beyond.groupBy(*NODE).agg(F.min("conv").alias("rep"), F.min("b1").alias("b1"), F.min("b2").alias("b2"), F.max((F.col("depth") == F.col("n")).cast("int")).alias("ends"))
        new = written(new, "beyond")
        ways = new.groupBy((F.col("depth") - 1).alias("depth"), F.col("b1").alias("p1"), F.col("b2").alias("p2")).agg(F.count("*").alias("ways"))
        base = new.groupBy("rep").agg((F.min("depth") - 1).alias("base"))
        kept = new.join(ways, list(NODE), "left").where("ends = 1 OR ways > 1").join(base, "rep").select("rep", "base", *NODE)
        nodes = kept.unionByName(split)
        if self.nodes is not None:
            nodes = nodes.unionByName(self.nodes.drop("above"))
        nodes = written(nodes, "nodes").withColumn("end", F.col("depth"))
        linked = carried(nodes, "rep", ["depth"], latest=["end"]).withColumn("above", F.coalesce("last_end", "base"))
        self.nodes = written(linked.select("rep", "base", "above", *NODE), "nodes")
        self.file()


def build_trie(paths: DataFrame, convs: DataFrame) -> ZFastTrie:
    """The trie of all of ``convs`` (conv, n)."""
    trie = ZFastTrie(paths)
    part = F.pmod(F.xxhash64("conv"), F.lit(sum(map(len, BATCHES))))
    for parts in BATCHES:
        trie.insert(convs.where(part.isin(*parts) & (F.col("n") > 0)))
    return trie


def _ends(rows: DataFrame) -> DataFrame:
    """own, depth and ends_sha256 of ``rows`` (own, depth, conv), their conv in order and joined by commas, read as a stream."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, running, out = None, None, []
        for batch in batches:
            for own, depth, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (own, depth) != current:
                    if current is not None:
                        out.append((*current, running.hexdigest()))
                    current, running = (own, depth), hashlib.sha256(str(conv).encode())
                else:
                    running.update(f",{conv}".encode())
            if out:
                yield made(out)
                out = []
        if current is not None:
            yield made([(*current, running.hexdigest())])

    def made(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["own", "depth", "ends_sha256"])

    ordered = rows.select("own", "depth", "conv").repartition("own", "depth").sortWithinPartitions("own", "depth", "conv")
    return ordered.mapInArrow(hashed, "own bigint, depth bigint, ends_sha256 string")


def expanded(trie: ZFastTrie, convs: DataFrame) -> DataFrame:
    """Every prefix of ``convs`` (conv, n, total): a row of the trie's nodes and of all places on its edges.

    Members of a node come from the conversations' paths at node depths alone. A prefix
    belongs to its smallest member, so a conversation owns the last part of its path,
    below the deepest node that a smaller one runs through. Sums over a subtree are
    then sums over a node's members: of their bytes, of the bytes they own, and of their
    ends that are leaves.
    """
    root = trie.paths.sparkSession.range(1).select(*(F.lit(0).cast("bigint").alias(c) for c in NODE))
    nodes = trie.nodes.select(*NODE).unionByName(root)
    member = trie.paths.select("conv", *NODE, "upto").join(nodes, list(NODE)).join(convs, "conv")
    member = written(member, "members")
    node = member.groupBy(*NODE).agg(F.min("conv").alias("own"), F.count("*").alias("n_convs"), F.sum("total").alias("totals"))
    member = written(member.join(node.select(*NODE, "own"), list(NODE)), "members")
    other = F.col("own") < F.col("conv")
    # The deepest node of someone else's on the path, and whether the conversation's end is its own.
    shared = member.groupBy("conv", "n", "total").agg(
        F.max(F.when(other, F.col("depth"))).alias("fork"), F.max_by("own", F.when(other, F.col("depth"))).alias("fork_own"),
        F.max(F.when(other, F.col("upto"))).alias("fork_upto"),
    )
    shared = written(shared.withColumn("owned", F.col("total") - F.coalesce("fork_upto", F.lit(0))), "owners")
    rows = trie.paths.join(shared.select("conv", "fork", "fork_own"), "conv").where(F.col("depth") > F.coalesce("fork", F.lit(-1)))
    rows = rows.join(node.select(F.col("own").alias("conv"), "depth", F.col("depth").alias("end")), ["conv", "depth"], "left")
    rows = written(rows.withColumn("back", -F.col("depth")), "owned")
    rows = carried(rows, "conv", ["back"], latest=["end"])
    rows = written(rows.withColumn("node", F.coalesce("end", "last_end")).drop("back", "last_end"), "placed")
    parent = F.when(F.col("depth") == 0, None).when(F.col("depth") == F.col("fork") + 1, F.col("fork_own")).otherwise(F.col("conv"))
    rows = rows.withColumn("parent_conv_id", parent)
    # A node's children are the prefixes one turn longer; the parent is known by its smallest member.
    children = rows.where("depth > 0").groupBy(F.col("parent_conv_id").alias("own"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    children = written(children, "children")
    leaf = shared.where(F.coalesce("fork", F.lit(-1)) < F.col("n")).join(children, (F.col("conv") == F.col("own")) & (F.col("n") == F.col("depth")), "left_anti")
    member = member.join(shared.select("conv", "owned"), "conv").join(leaf.select("conv", F.lit(1).alias("leaf")), "conv", "left")
    sums = member.groupBy("own", "depth").agg(F.sum("owned").alias("all_owned"), F.count("leaf").alias("n_leaves"))
    ends = _ends(member.where("depth = n"))
    stats = written(
        node.select("own", "depth", "n_convs", "totals").join(sums, ["own", "depth"]).join(ends, ["own", "depth"], "left")
        .select(F.col("own").alias("conv"), F.col("depth").alias("node"), "n_convs", "totals", "all_owned", "n_leaves", "ends_sha256"), "stats"
    )
    out = rows.join(stats, ["conv", "node"]).join(shared.select("conv", "total", "owned"), "conv")
    out = out.join(children.select(F.col("own").alias("conv"), "depth", "n_children"), ["conv", "depth"], "left")
    above = F.col("upto") - F.col("bytes")
    saved = F.col("totals") - F.col("n_convs") * above - (F.col("all_owned") - F.col("owned") + F.col("total") - above)
    ends_here = F.when(F.col("depth") == F.col("node"), F.col("ends_sha256"))
    return out.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
        saved.alias("saved_tokens"), F.coalesce(ends_here, F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def prefix_nodes(conversations: DataFrame, rebuild: bool = True) -> DataFrame:
    """Every distinct prefix of the conversations in ``conversations`` (conv_id, turn, role, text), with figures of its subtree.

    ``rebuild`` gives each conversation the first turns of another one (see
    ``borrowed``), as branches of one dialogue have them. The prefix of no turns is the
    root; it has all conversations, also those without a turn. Null roles and texts are
    empty, a null turn comes first, turns with equal numbers and repeated rows follow
    each other in the order of a digest. Rows without a conv_id are in no conversation.
    Texts are read whole, but only their digests and sizes move. An empty table has no
    nodes, not even a root. Other columns are not read.

    No conversation or prefix is one task's, however many rows it has, except that the
    ids that end at one node are hashed in order, as a stream.
    """
    turns = turn_rows(conversations)
    if rebuild:
        turns = borrowed(turns)
    else:
        turns = written(turns, "placed")
        turns = turns.unionByName(turns.select("conv").distinct().select("conv", *(F.lit(0).cast("bigint").alias(c) for c in ("place", "d1", "d2", "bytes"))))
    paths = prefixes(turns)
    convs = written(paths.groupBy("conv").agg(F.max("depth").alias("n"), F.max("upto").alias("total")), "convs")
    return expanded(build_trie(paths, convs.select("conv", "n")), convs)
