import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import zstandard
from hypothesis import given, settings, strategies as st

from tests.conftest import SF
from volscribe import session
from volscribe.llm import line_dedup, queries, substring_dedup, suffix_dedup
from volscribe.llm.suffix_array import Segments, common_prefixes, suffix_array


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abé\0", max_size=40).map(str.encode), max_size=6), st.integers(1, 12))
def test_suffix_array_equals_sorting(segments, depth):
    text = Segments(segments)
    order = suffix_array(text, 1000)
    suffixes = [segments[text.segment[i]][i - text.first[text.segment[i]] :] for i in order]
    assert suffixes == sorted(suffixes) and sorted(order) == list(range(len(text.symbols)))
    prefixes = common_prefixes(text, order, depth)
    for k in range(1, len(order)):
        a, b = suffixes[k - 1][:depth], suffixes[k][:depth]
        assert prefixes[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def brute_removed(texts):
    """Bytes of ``texts`` (doc_id, bytes, in order) that a 50-byte string of a smaller document covers."""
    seen, out = {}, {}
    for doc_id, text in texts:
        covered = np.zeros(len(text), bool)
        for k in range(len(text) - 49):
            if seen.setdefault(text[k : k + 50], doc_id) < doc_id:
                covered[k : k + 50] = True
        spans = int(np.count_nonzero(np.diff(np.r_[0, covered.astype(int)]) == 1))
        kept = np.frombuffer(text, np.uint8)[~covered].tobytes()
        out[doc_id] = (len(text), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_op3_equals_brute_force(spark, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.QUERIES["op3_suffix_dedup"](spark, SF).collect()}
    assert got == brute_removed([(d, t.encode()) for d, t in texts])


def made_up(spark):
    """Passages inside random texts, periods, a crowd of different contexts."""
    rng = np.random.default_rng(5)
    noise = lambda n: "".join(rng.choice(list("abcdefgh éß"), n))
    passage, period = noise(120), "xyz" * 200
    rows = [(k, noise(40) + passage[: 60 + k % 60] + noise(40)) for k in range(60)]
    rows += [(100, period), (101, "y" + period + "q"), (102, noise(49)), (103, "z" * 500), (104, "z" * 51), (105, None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def settled_marks(texts):
    """What one bucket settles or sends on, for texts that arrive in separate slices."""
    dealt = []
    for doc_id, text in texts:
        columns = [pa.array([doc_id], pa.int64()), pa.array([text]), pa.array([0], pa.int64())]
        dealt += suffix_dedup._dealt(1)(iter([pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "version"])]))
    return suffix_dedup._settled(1000)(pa.Table.from_batches(dealt)).to_pylist()


@pytest.mark.parametrize("narrow", ["content", "check"])
def test_op3_hashes_that_collide_settle_nothing(monkeypatch, narrow):
    """Different segments under one anchor are compared by their bytes even if one of their two hashes is the same."""
    rng = np.random.default_rng(8)
    noise = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passage = noise(200)
    texts = [(k, noise(45) + passage + noise(45)) for k in range(4)]
    want = settled_marks(texts)
    whole, place = suffix_dedup.segments, ("content", "check").index(narrow) + 4

    def narrowed(*texts):
        out = list(whole(*texts))
        out[place] = out[place] & np.uint64(0)
        return tuple(out)

    monkeypatch.setattr(suffix_dedup, "segments", narrowed)
    got = settled_marks(texts)
    by_place = lambda rows: sorted((r["doc_id"], r["start"], r["strings"], r["anchor"] is None) for r in rows)
    assert by_place(got) == by_place(want) and any(r["anchor"] is not None for r in want)
    assert sum(r["anchor"] is None for r in want) >= 3


def test_op3_periods_and_crowds(spark):
    rows, docs = made_up(spark)
    want = brute_removed([(d, (t or "").encode()) for d, t in rows])
    for crowd in (1000, 3):
        cut = suffix_dedup.remove_repeats(docs, crowd).collect()
        got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in cut}
        assert got == want


def test_op3_long_periods_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_LONGEST", 100)
    rows, docs = made_up(spark)
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == {d: v[:2] for d, v in brute_removed([(d, (t or "").encode()) for d, t in rows]).items()}


def test_op3_odd(odd, nothing):
    got = {}
    for r in suffix_dedup.remove_repeats(odd).collect():
        got.setdefault(r.doc_id, []).append(r.n_removed)
    assert sum(map(len, got.values())) == 15
    assert got[8] == [0] or got[8][0] < 1000
    assert got[9][0] > 200_000 and got[1] == got[2] == [0]
    # Without a doc_id it is the first of all: the other documents lose the sentence.
    assert got[None] == [0] and got[4][0] == got[4][1] > 60
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_op3_texts_that_share_a_doc_id(spark):
    """Rows without a doc_id, or with the same one, have their own spans; none of them loses another's."""
    rng = np.random.default_rng(6)
    noise = lambda n: "".join(rng.choice(list("abcdefgh éß"), n))
    passage = noise(150)
    rows = [(None, noise(3000) + passage + noise(100)), (None, noise(200)), (None, noise(30) + passage)]
    rows += [(7, noise(500) + passage + noise(60)), (7, noise(90)), (7, passage[:90] + noise(700)), (8, passage + noise(9)), (8, passage + noise(9))]
    want = {}
    for doc_id, text in rows:
        removed = brute_removed([(k, t.encode()) for k, t in enumerate(u for d, u in rows if (d or 0) < (doc_id or 0))] + [(10**6, text.encode())])
        want[text] = (doc_id, *removed[10**6]) if doc_id else (None, *brute_removed([(0, text.encode())])[0])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for crowd in (1000, 1):
        cut = suffix_dedup.remove_repeats(docs, crowd).collect()
        got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in cut]
        assert sorted(got, key=repr) == sorted(want.values(), key=repr)


def op3_in_process(rows, crowd):
    """The steps of op3 on ``rows`` (doc_id, text) one after the other, without Spark; of each document what brute_removed says."""
    press, ids = zstandard.ZstdCompressor(), pa.array([d for d, _ in rows], pa.int64())
    packed = pa.array([press.compress(t.encode()) for _, t in rows], pa.binary())
    versions = pa.array([0] * len(rows), pa.int64())
    docs = pa.RecordBatch.from_arrays([ids, pa.array([t for _, t in rows]), versions], ["doc_id", "text", "version"])
    dealt = pa.Table.from_batches(suffix_dedup._dealt(3)(iter([docs.slice(k, 5) for k in range(0, len(rows), 5)])))
    groups = [dealt.filter(pc.equal(dealt.column("bucket"), k)) for k in set(dealt.column("bucket").to_pylist())]
    marks = [m for group in groups for m in suffix_dedup._settled(crowd)(group).to_pylist()]

    def with_texts(name, lists, kind):
        columns = [ids, versions, packed, pa.array([lists.get(d) for d, _ in rows], pa.list_(kind))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "version", "packed", name])

    place = [("start", pa.int64()), ("strings", pa.int64())]
    wanted, spans = {d: [] for d, _ in rows}, {}
    for m in marks:
        (spans.setdefault(m["doc_id"], []) if m["anchor"] is None else wanted[m["doc_id"]]).append(m)
    texts = with_texts("wanted", wanted, pa.struct([*place, ("anchor", pa.int64()), ("crowd", pa.bool_())]))
    cut = pa.Table.from_batches(suffix_dedup._cut_out(iter([texts.slice(3), texts.slice(0, 3)]))).sort_by("anchor")
    for m in pa.Table.from_batches(suffix_dedup._compared(iter(cut.to_batches(7)))).to_pylist():
        spans.setdefault(m["doc_id"], []).append(m)
    removed = suffix_dedup._removed(iter([with_texts("marks", spans, pa.struct(place))]))
    found = [r for batch in removed for r in batch.to_pylist()]
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in found}


@pytest.mark.parametrize("limits", [{}, {"_TOGETHER": 2, "_STRINGS": 9, "_COMPARED": 300, "_ROWS": 4, "_SLICE": 700}, {"_string_names": lambda data, at: np.zeros(len(at), np.uint64)}])
def test_op3_in_pieces_of_any_size(spark, monkeypatch, limits):
    """Where the pieces that a task holds are cut, or strings have one hash, changes nothing."""
    rows = [(d, t or "") for d, t in made_up(spark)[0]]
    for name, value in limits.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    want = brute_removed([(d, t.encode()) for d, t in rows])
    for crowd in (1000, 3):
        assert op3_in_process(rows, crowd) == want


def held_mb(run):
    """The most that Python and numpy hold at once while ``run`` is read to its end, and what it gave."""
    tracemalloc.start()
    try:
        n = sum(batch.num_rows for batch in run())
        return tracemalloc.get_traced_memory()[1] / 1e6, n
    finally:
        tracemalloc.stop()


def test_op3_tasks_hold_few_marks_and_strings_at_once():
    """Memory of a task does not follow how many segments of its texts repeat."""
    rng = np.random.default_rng(12)
    press, n = zstandard.ZstdCompressor(), 400
    texts = [rng.integers(97, 123, 1000, np.uint8).tobytes() for _ in range(n)]
    columns = [pa.array(range(n), pa.int64()), pa.array([0] * n, pa.int64()), pa.array([press.compress(t) for t in texts], pa.binary())]
    place = [("start", pa.int64()), ("strings", pa.int64())]
    every = [{"start": k, "strings": 1, "anchor": 5, "crowd": True} for k in range(951)]
    wanted = pa.array([every] * n, pa.list_(pa.struct([*place, ("anchor", pa.int64()), ("crowd", pa.bool_())])))
    batch = pa.RecordBatch.from_arrays([*columns, wanted], ["doc_id", "version", "packed", "wanted"])
    mb, rows = held_mb(lambda: suffix_dedup._cut_out(iter([batch])))
    assert rows == 951 * n and mb < 80
    marks = pa.array([[{"start": k, "strings": 1} for k in range(0, 951, 2)]] * n, pa.list_(pa.struct(place)))
    batch = pa.RecordBatch.from_arrays([*columns, marks], ["doc_id", "version", "packed", "marks"])
    mb, rows = held_mb(lambda: suffix_dedup._removed(iter([batch])))
    assert rows == n and mb < 30


def test_op3_bucket_holds_few_repeated_segments_at_once():
    rng, n, blocks = np.random.default_rng(13), 50_000, []
    hashes = [rng.integers(0, 2**63, n, np.uint64) for _ in range(3)]
    for k in range(20):
        doc, zero = np.arange(k * n, (k + 1) * n), np.zeros(n, np.int64)
        packed = suffix_dedup._packed(doc, zero, zero, zero + 7, *hashes)
        blocks.append({"bucket": 0, "open": n, "settled": 0, "stored": zstandard.ZstdCompressor(level=1).compress(packed)})
    mb, rows = held_mb(lambda: suffix_dedup._settled(1000)(pa.Table.from_pylist(blocks)).to_batches())
    assert rows == 19 * n and mb < 120


def brute_units(texts):
    """Characters that line and sentence hashing removes, unit by unit in the order of the documents."""
    seen, out = set(), {}
    for doc_id, text in texts:
        gone = np.zeros(len(text), bool)
        for digest, start, end in sorted(substring_dedup.units(text), key=lambda u: u[1]):
            if digest in seen:
                gone[start:end] = True
            seen.add(digest)
        out[doc_id] = (int(gone.sum()), "".join(c for c, g in zip(text, gone, strict=True) if not g))
    return out


def test_op6_equals_brute_force(spark, texts):
    got = queries.QUERIES["op6_substring_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.n_removed, r.kept_text) for r in got} == brute_units(texts)
    by_id = dict(texts)
    for r in got:
        edges = [0, *(x for s in r.spans for x in (s.begin, s.stop)), r.n_chars]
        assert "".join(by_id[r.doc_id][a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) == r.kept_text


def test_op6_finds_a_passage_inside_other_lines(spark):
    passage = "Here is a first sentence of some length indeed, with words. And here is a second one that has enough words too."
    docs = spark.createDataFrame([(1, "Begin. " + passage + " Ende."), (2, "Other words come before. " + passage.upper() + " After.")], "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.dedup_units(docs).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == len(passage) - 1 or got[2].n_removed == len(passage)
    assert "SECOND" not in got[2].kept_text and "Other words come before." in got[2].kept_text


def test_op6_short_units_and_scripts_without_spaces(spark):
    """Lines and sentences of a word or two lose their later copies, and so do those of any length without spaces."""
    chinese, japanese = "这是一个没有空格的很长的句子用来测试重复内容的删除", "これは空白のない文です。次の文もここにあります。"
    rows = [(1, "Of.\nFirst text. Yes indeed. End"), (2, "And ornd.\nOf.\nSecond text. Yes indeed. Stop"), (3, "And ornd."), (4, chinese + "\nx"), (5, "y\n" + chinese)]
    rows += [(6, japanese), (7, "別の文。" + japanese)]
    got = {r.doc_id: r.kept_text for r in substring_dedup.dedup_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {1: rows[0][1], 2: "And ornd.\n\nSecond text.  Stop", 3: "", 4: rows[3][1], 5: "y\n", 6: japanese, 7: "別の文。"}
    assert got == want


def test_op6_odd(odd, nothing):
    got = substring_dedup.dedup_units(odd).collect()
    assert len(got) == 15
    by_id = {r.doc_id: r for r in got}
    assert by_id[None].n_removed == 0 and by_id[4].kept_text == "" and by_id[9].kept_text == "" and by_id[8].n_removed == 0
    assert by_id[1].kept_text == by_id[2].kept_text == "" and by_id[10].n_removed > 0
    assert substring_dedup.dedup_units(nothing).count() == 0


def brute_lines(texts, min_lines=2):
    seen, out = set(), {}
    for doc_id, text in texts:
        lines = [" ".join(x.split()) for x in text.split("\n") if x.split()]
        gone = np.zeros(len(lines), bool)
        for k in range(len(lines) - min_lines + 1):
            run = tuple(lines[k : k + min_lines])
            if run in seen:
                gone[k : k + min_lines] = True
            seen.add(run)
        out[doc_id] = (len(lines), int(gone.sum()), [x for x, g in zip(lines, gone, strict=True) if not g])
    return out


def lines_found(df):
    return {r.doc_id: (r.n_lines, r.n_removed, [" ".join(x.split()) for x in r.kept_text.split("\n") if x.split()]) for r in df.collect()}


def test_op9_single_lines_between_others(spark, texts, tmp_path):
    """The registered query removes later copies of runs of one line too."""
    assert lines_found(queries.QUERIES["op9_line_dedup"](spark, SF)) == brute_lines(texts, 1)
    rows = [(1, "first\nshared line\nsecond"), (2, "third\nshared  line\nfourth\nthird"), (3, "shared line")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in queries.QUERIES["op9_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {1: (0, rows[0][1]), 2: (2, "third\nfourth\n"), 3: (1, "")}


def test_op9_runs_of_any_length(spark):
    rng = np.random.default_rng(1)
    rows = [(k, "\n".join(rng.choice(list("abcd"), int(rng.integers(0, 25))))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for min_lines in (1, 3, 4):
        assert lines_found(line_dedup.dedup_lines(docs, min_lines)) == brute_lines(rows, min_lines)


def brute_runs(texts):
    """Each maximal run of lines that also starts earlier, with the first place it starts at, by comparing all places."""
    docs = [(d, [" ".join(x.split()) for x in text.split("\n") if x.split()]) for d, text in texts]
    places = [(d, lines, k) for d, lines in docs for k in range(len(lines))]
    out = {d: [] for d, _ in docs}
    for at, (d, lines, k) in enumerate(places):
        common = []
        for e, other, j in places[:at]:
            n = 0
            while k + n < len(lines) and j + n < len(other) and lines[k + n] == other[j + n]:
                n += 1
            common.append((n, e, j))
        longest = max((n for n, _, _ in common), default=0)
        before = out[d][-1] if out[d] else (0, 0, None, None)
        if longest and k + longest > before[0] + before[1]:
            out[d].append((k, longest, *next((e, j) for n, e, j in common if n == longest)))
    return out


def runs_found(df):
    return {r.doc_id: [tuple(x) for x in r.runs] for r in df.collect()}


def test_op9_maximal_runs_and_where_they_come_from(spark):
    rows = [(1, "a\nx"), (2, "b\ny"), (3, "a\nb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert runs_found(line_dedup.dedup_lines(docs, 1)) == {1: [], 2: [], 3: [(0, 1, 1, 0), (1, 1, 2, 0)]}
    rng = np.random.default_rng(7)
    for letters, longest in (("ab", 12), ("abcdefgh", 24)):
        rows = [(k, "\n".join(rng.choice(list(letters), int(rng.integers(0, longest))))) for k in range(30)]
        rows += [(100, rows[3][1]), (101, rows[4][1] + "\n" + rows[5][1]), (102, "\n".join(["z"] * 21))]
        docs = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string")
        assert runs_found(line_dedup.dedup_lines(docs, 1)) == brute_runs(rows)


def test_op9_long_runs_take_few_turns(spark):
    """Runs of hundreds of lines, with ends of all lengths, and no set of stored tables for each doubling."""
    rng = np.random.default_rng(11)
    long = [str(x) for x in rng.integers(0, 400, 300)]
    rows = [(0, "\n".join(long)), (1, "\n".join(["u", *long[:257], "v"])), (2, "\n".join(long[3:]))]
    rows += [(10 + n, "\n".join(long[300 - n :])) for n in (1, 2, 15, 16, 17, 31, 32, 33, 64, 65)]
    rows += [(30 + n, "\n".join([*long[40 : 40 + n], "w"])) for n in (15, 16, 17, 129)]
    before = len(session._made)
    assert runs_found(line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 1)) == brute_runs(rows)
    assert len(session._made) - before < 45


def test_op9_rows_without_id_come_first(spark):
    rows = [(None, "p\nq\nr"), (1, "p\nq\ns"), (2, "s\np\nq\nr")]
    got = runs_found(line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 1))
    assert got == {None: [], 1: [(0, 2, None, 0)], 2: [(0, 1, 1, 2), (1, 3, None, 0)]}


def test_op9_odd(odd, nothing):
    got = line_dedup.dedup_lines(odd).collect()
    assert len(got) == 15
    by_id = {r.doc_id: r for r in got}
    # A run that overlaps itself loses all but its first line.
    assert (by_id[10].n_lines, by_id[10].n_removed, by_id[10].runs[0].first_line) == (3, 2, 1)
    assert by_id[1].n_lines == by_id[3].n_lines == 0 and by_id[9].n_removed == 0
    assert line_dedup.dedup_lines(nothing).count() == 0
