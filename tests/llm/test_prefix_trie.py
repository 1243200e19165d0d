import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF
from volscribe.llm import prefix_trie as pt, queries
from volscribe.llm.carry import carried

COLUMNS = "conv_id long, turn long, role string, text string"


def ordered(rows):
    """The turns of each conversation, as (role, text)."""
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(conv, []).append((turn is not None, turn or 0, digest, role, text))
    return {c: [t[3:] for t in sorted(own)] for c, own in convs.items()}


def brute_nodes(rows, rebuild=True):
    convs = ordered(rows)
    if rebuild:
        heads = {c: zlib.crc32(str(c).encode()) % 9 for c in convs}
        source = {c: c - int(np.fmod(c, 5)) for c in convs}
        convs = {c: convs.get(source[c], [])[: heads[c]] + own[heads[c] :] for c, own in convs.items()}
    members = {}
    for c, own in convs.items():
        for d in range(len(own) + 1):
            members.setdefault(tuple(own[:d]), set()).add(c)
    out = []
    for node, own in members.items():
        d = len(node)
        below = [x for x in members if x[:d] == node]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        children = sum(len(x) == d + 1 for x in below)
        leaves = sum(not any(len(y) > len(x) and y[: len(x)] == x for y in below) for x in below)
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == d)
        up = min(members[node[:-1]]) if d else None
        out.append((min(own), d, up, len(own), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 5000), st.integers(1, 5000))
def test_fattest(low, size):
    want = max(range(low + 1, low + size + 1), key=lambda x: x & -x)
    assert pt.fattest(low, low + size) == want


def test_fattest_column(spark):
    pairs = spark.range(0, 40).join(spark.range(1, 60).withColumnRenamed("id", "high"), F.col("id") < F.col("high"))
    got = pairs.select("id", "high", pt.fattest_column("id", "high").alias("f")).collect()
    assert all(r.f == pt.fattest(r.id, r.high) for r in got)


def test_op12_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.QUERIES["op12_prefix_trie"](spark, SF)) == brute_nodes(rows)


def made_up(seed, number=60, turns=12):
    """Conversations over two turns, so that many share prefixes, stop inside others or are equal."""
    rng = random.Random(seed)
    return [(c, t, rng.choice(["u", "a"]) if t % 3 == 0 else "u", rng.choice(["x", "x", "yy"])) for c in range(-3, number) for t in range(rng.randrange(turns))]


@pytest.mark.parametrize("rebuild", [True, False])
def test_shared_prefixes_equal_brute_force(spark, rebuild):
    rows = made_up(rebuild) + [(500, t, "u", "x") for t in range(200)] + [(505, t, "u", "x") for t in range(90)] + [(510, 0, "u", "x")] * 3
    assert rows_of(pt.prefix_nodes(spark.createDataFrame(rows, COLUMNS).repartition(5), rebuild)) == brute_nodes(rows, rebuild)


def test_located_is_the_longest_prefix_in_the_trie(spark):
    rows = made_up(7, 50, 20)
    turns = pt.turn_rows(spark.createDataFrame(rows, COLUMNS))
    convs = {c: tuple(own) for c, own in ordered(rows).items()}
    empty = spark.createDataFrame([(c, 0, 0, 0, 0) for c in convs], "conv long, place long, d1 long, d2 long, bytes long")
    paths = pt.prefixes(turns.unionByName(empty))
    sizes = spark.createDataFrame([(c, len(own)) for c, own in convs.items()], "conv long, n long")
    trie = pt.ZFastTrie(paths)
    held, asked = [c for c in convs if c % 3], [c for c in convs if not c % 3]
    trie.insert(sizes.where(F.col("conv").isin(held)))
    inside = {convs[c][:d] for c in held for d in range(len(convs[c]) + 1)}
    explicit = {convs[r["rep"]][: r.depth] for r in trie.nodes.collect()}
    ends = {convs[c] for c in held}
    assert explicit >= ends - {()} and all(x in ends or len({y[len(x)] for y in inside if len(y) > len(x) and y[: len(x)] == x}) > 1 for x in explicit)
    for r in trie.located(sizes.where(F.col("conv").isin(asked))).collect():
        own = convs[r.conv]
        assert r["match"] == max(d for d in range(len(own) + 1) if own[:d] in inside)
        assert r.deepest == max((d for d in range(1, len(own) + 1) if own[:d] in explicit), default=0)


def test_running_sums_across_ranges(spark):
    """One key holds most rows, so its ranges meet; sums wrap around."""
    rng = random.Random(2)
    rows = [(k % 4 if k > 500 else 9, k, rng.randrange(-(2**63), 2**63), rng.choice([None, k])) for k in range(700)]
    frame = spark.createDataFrame(rows, "key long, at long, value long, mark long").repartition(3)
    got = {(r["key"], r["at"]): (r["sum_value"], r["last_mark"]) for r in carried(frame, "key", ["at"], ["value"], ["mark"]).collect()}
    sums, last = {}, {}
    for key, at, value, mark in sorted(rows):
        sums[key] = (sums.get(key, 0) + value + 2**63) % 2**64 - 2**63
        assert got[key, at] == (sums[key], last.get(key))
        if mark is not None:
            last[key] = mark
    assert carried(frame.where("false"), "key", ["at"], ["value"], ["mark"]).count() == 0


def test_op12_odd(spark):
    long = "word " * 60_000
    rows = [(0, None, None, None), (0, None, None, None), (0, 3, "user", long), (5, 1, "user", ""), (5, 1, "user", "tie"), (6, 0, None, "é"), (7, 0, "user", long)]
    rows += [(7, 0, "user", long), (None, 1, "user", "lost"), (-4, 2, "user", "before"), (11, 0, "user", "only own"), (1, 0, "", "")]
    frame = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit("x") for c in ("depth", "conv", "p1", "rep", "base", "end", "place", "own")})
    assert rows_of(pt.prefix_nodes(frame)) == brute_nodes(rows)
    assert pt.prefix_nodes(frame.where("false")).count() == 0
    # Conversations without a turn of their own have the root only.
    heads = {c: zlib.crc32(str(c).encode()) % 9 for c in range(1, 400)}
    bare = [c for c, h in heads.items() if h > 1 and c % 5][:3]
    rows = [(c, 0, "user", "gone") for c in bare]
    assert rows_of(pt.prefix_nodes(spark.createDataFrame(rows, COLUMNS))) == brute_nodes(rows)
