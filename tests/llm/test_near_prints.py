import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tests.conftest import SF
from volscribe.llm import fingerprint, order_minhash, queries
from volscribe.llm.components import components

kmers = st.lists(st.integers(0, 6), max_size=25).map(lambda x: np.array(x, np.uint64))


def brute_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(kmers, kmers)
def test_alignment_equals_dynamic_programming(a, b):
    common = brute_common(a.tolist(), b.tolist())
    assert order_minhash.aligned(a, b, 1000) == common
    total = len(a) + len(b)
    assert order_minhash.near(a, b) == (total == 0 or common / (total - common) >= 0.8 - 1e-9)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=20))
def test_occurrences_are_labelled_in_order(values):
    labels = order_minhash.labelled(np.array(values, np.uint64))
    seen, named = Counter(), {}
    for value, label in zip(values, labels.tolist(), strict=True):
        assert named.setdefault((value, seen[value]), label) == label
        seen[value] += 1
    assert len(set(labels.tolist())) == len(values)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=30), st.lists(st.integers(0, 30), max_size=6), st.integers(0, 5), st.integers(1, 8))
def test_near_copies_share_a_rarest_kmer(base, added, dropped, cells):
    commonness = np.random.default_rng(cells).integers(0, 5, cells)
    a = np.array(base, np.uint64)
    b = np.array(base[dropped:] + added, np.uint64)
    if len(b) and order_minhash.near(a, b):
        rare = [order_minhash.rarest(order_minhash.labelled(x), commonness) for x in (a, b)]
        assert np.intersect1d(*rare).size


def shingled(text):
    words = text.split()
    return [tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))] if words else []


def brute_classes(texts):
    """Connected components of all pairs at 0.8 by the ordered overlap of five-word shingles."""
    found = {d: shingled(t) for d, t in texts}
    root = {d: d for d in found}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    shared = defaultdict(set)
    for d, own in found.items():
        for s in own or [()]:
            shared[s].add(d)
    pairs = Counter((a, b) for ds in shared.values() for a in ds for b in ds if a < b)
    for (a, b), n in pairs.items():
        x, y = found[a], found[b]
        if n / (len(x) + len(y) or 1) >= 0.3 or not x + y:
            ids = {s: k for k, s in enumerate(dict.fromkeys(x + y))}
            if order_minhash.near(np.array([ids[s] for s in x], np.uint64), np.array([ids[s] for s in y], np.uint64)):
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {d: top(d) for d in found}


def test_op4_equals_brute_force(spark, texts):
    got = {r.doc_id: r.class_id for r in queries.QUERIES["op4_near_dedup"](spark, SF).collect()}
    assert got == brute_classes(texts)


def test_large_group_of_near_copies_of_near_copies(spark):
    """Neighbours are near copies, the ends are not; nobody is left out."""
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in rng.integers(0, 10**6, 300)]
    rows = []
    for k in range(60):
        words = list(words)
        words[(7 * k) % 300] = f"new{k}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, " ".join(f"v{x}" for x in rng.integers(0, 10**6, 200))) for k in range(20)]
    got = {r.doc_id: r.class_id for r in order_minhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)
    assert all(got[k] == 0 for k in range(60)) and got[105] == 105


def test_short_near_copies_are_never_lost(spark):
    """8 words against the same with one more at either end (4 and 5 k-mers), and so on."""
    rows, base = [], 0
    for kmers in (4, 5, 6, 8, 12, 20):
        for _ in range(30):
            words = [f"w{base}x{k}" for k in range(kmers + 4)]
            rows += [(3 * base, " ".join(words)), (3 * base + 1, " ".join([*words, "after"])), (3 * base + 2, " ".join(["before", *words]))]
            base += 1
    got = {r.doc_id: r.class_id for r in order_minhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows) == {d: d - d % 3 for d, _ in rows}


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 180)] + [(7, 7), (300, 299)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 180)}, 299: 299, 300: 299}


def test_op4_odd(odd, nothing):
    got = [(r.doc_id, r.class_id) for r in order_minhash.near_classes(odd).collect()]
    assert len(got) == 15
    by_id = dict(got)
    assert by_id[1] == by_id[2] == by_id[3] == 1 and by_id[5] == by_id[4] == by_id[None] == 4 and by_id[9] == by_id[8] == 8
    assert order_minhash.near_classes(nothing).count() == 0


def exact_resemblance(a, b):
    a, b = set(shingled(a)), set(shingled(b))
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(text, after):
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def test_op5_equals_brute_force(spark, texts):
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in queries.QUERIES["op5_fingerprints"](spark, SF).collect()}
    assert len(got) == len(texts)
    errors = []
    for (d, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        row, new = got[d], edited(text, after)
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert row.fingerprint == fingerprint.to_text(fingerprint.sketches([text])[0])
        assert row.edited_fingerprint == fingerprint.to_text(fingerprint.sketches([new])[0])
        errors += [row.near_edited - exact_resemblance(text, new), row.near_next - exact_resemblance(text, after)]
    assert np.abs(errors).max() < 0.2 and abs(np.mean(errors)) < 0.01


def test_op5_ids_that_many_rows_share(spark):
    """A third of the rows has no doc_id and a third has one in common; their ranges are cut by hash."""
    rng = np.random.default_rng(9)
    noise = lambda: " ".join(rng.choice(["ab", "cde", "f", "ghij"], rng.integers(0, 40)))
    rows = [((None, 7, k)[k % 3], noise()) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    ranges, tops = fingerprint._ranges(docs)
    assert ranges.crowded() == [fingerprint._LOWEST, 7]
    order = docs.selectExpr(f"coalesce(doc_id, {fingerprint._LOWEST}) AS id", "xxhash64(text) AS hash", "text").collect()
    home = Counter(ranges.of(np.array([r.id for r in order]), np.array([r.hash for r in order])).tolist())
    assert home.keys() == tops.keys() and max(home.values()) < 10 * sorted(home.values())[len(home) // 2]
    order = [tuple(r) for r in sorted(order, reverse=True)]
    want = []
    for (d, _, text), (_, _, after) in zip(order, order[1:] + order[:1], strict=True):
        want.append((None if d == fingerprint._LOWEST else d, len(text), hashlib.sha256(edited(text, after).encode()).hexdigest()))
    got = [(r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprint.edited_neighbours(docs).collect()]
    assert Counter(got) == Counter(want)


def test_fingerprints_merge_and_estimate(spark, odd):
    words = [f"w{k}" for k in range(6000)]
    a, b, ab, part = fingerprint.sketches([" ".join(words[:3000]), " ".join(words[3000:]), " ".join(words), " ".join(words[:1500])])
    # Shingles across the seam are only in the whole.
    assert fingerprint.resemblance(fingerprint.merged(a, b), ab) > 0.97
    assert fingerprint.distinct_shingles(ab) == pytest.approx(5996, rel=0.3)
    assert fingerprint.containment(part, ab) > 0.8 > 0.4 > fingerprint.containment(ab, part)
    assert (fingerprint.from_text(fingerprint.to_text(a)) == a).all()
    parts = fingerprint.fingerprints(odd).withColumnRenamed("doc_id", "key")
    merged = {r.key: r.fingerprint for r in fingerprint.merge_by(parts.unionByName(parts), "key").collect()}
    assert merged == {r.key: r.fingerprint for r in parts.collect()}


def test_op5_odd(spark, odd, nothing):
    got = fingerprint.edited_neighbours(odd).collect()
    assert len(got) == 15
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].n_chars == 0 and by_id[1].fingerprint == by_id[2].fingerprint == "" and by_id[2].near_next == 1.0
    assert by_id[-5].edited_sha256 == hashlib.sha256(b"aloon").hexdigest()  # the one without doc_id is the last
    assert by_id[9].near_next == 1.0
    assert fingerprint.edited_neighbours(nothing).count() == 0
    one = spark.createDataFrame([(3, "abcd")], "doc_id long, text string")
    assert fingerprint.edited_neighbours(one).first().edited_sha256 == hashlib.sha256(b"abab").hexdigest()
