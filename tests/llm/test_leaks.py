import hashlib
import re

import pytest
from hypothesis import given, settings, strategies as st

from tests.conftest import SF
from volscribe.llm import decontaminate as dc, queries
from volscribe.llm.terms import terms_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(words, items, window=10):
    """Hit places and the ids of items, by comparing every window with every place."""
    hit, names = set(), set()
    for item_id, text in items:
        own = brute_words(text)
        n = min(window, len(own))
        windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
        for k in range(len(words) - n + 1):
            if tuple(words[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                if item_id is not None:
                    names.add(str(item_id))
    return hit, names


def test_op13_equals_brute_force(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words = brute_words(r.text)
        hit, names = brute_hits(words, items)
        want[r.doc_id] = (len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op13_decontaminate"](spark, SF).collect()}
    assert got == want and any(w[1] for w in want.values())


words = st.lists(st.sampled_from("ab"), max_size=14)


@settings(max_examples=300, deadline=None)
@given(st.lists(words, max_size=5), st.lists(st.sampled_from("abc"), max_size=40), st.integers(1, 5))
def test_automaton_equals_comparing_all(items, doc, window):
    named = [(str(k), [w.encode() for w in own]) for k, own in enumerate(items)]
    automaton = dc.SuffixAutomaton(named, window)
    runs, names = automaton.found([w.encode() for w in doc])
    hit, want = brute_hits(doc, [(k, " ".join(own)) for k, own in enumerate(items)], window)
    assert sorted(k for low, high in runs for k in range(low, high)) == sorted(hit) and names == want
    # The longest run that ends at each word and stands in some item.
    texts = [" " + " ".join(own) + " " for own in items]
    for k, (_, matched, _) in enumerate(automaton.streamed([w.encode() for w in doc])):
        held = [n for n in range(1, k + 2) if any(" " + " ".join(doc[k + 1 - n : k + 1]) + " " in t for t in texts)]
        assert matched == max(held, default=0)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aZ0 .@`{é 漢", max_size=30))
def test_terms_equal_pattern(text):
    assert [t.decode() for t in terms_of(text)] == brute_words(text)


@pytest.mark.parametrize("block_words", [13, 1000])
def test_blocks_of_items_find_the_same(spark, block_words):
    """Small automata, with long items cut between windows, find what a large one does."""
    long = " ".join(f"w{k % 37} x{k % 11}" for k in range(60))
    items = [(1, long), (2, "short one"), (2, "Short, one"), (None, "nameless words here"), (3, None), (4, "..."), (5, "a b c d e f g h i j k")]
    docs = [(1, long), (2, "A short one; nameless words here"), (2, "x a b c d e f g h i j y"), (3, None), (4, long[60:200] + " short one"), (None, long)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = dc.find_contamination(docs, frame, block_words=block_words).select("doc_id", "text", "spans", "items").collect()
    for r in got:
        hit, names = brute_hits(brute_words(r.text), items)
        assert sorted(k for s in r.spans for k in range(s["first"], s["first"] + s["words"])) == sorted(hit) and set(r["items"]) == names
        for s in r.spans:
            assert brute_words((r.text.encode()[s["start"] : s["end"]]).decode()) == brute_words(r.text)[s["first"] : s["first"] + s["words"]]
    assert len(got) == 6


def test_spans_are_cut_out_and_covered_documents_go(spark):
    passage = "one two three four five six seven eight nine ten"
    rows = [(1, f"é Before, {passage.upper()}! After it come many more words than stood in the passage that was cut out."), (2, passage), (3, "nothing é")]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, passage)], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.kept, r.kept_text) for r in dc.remove_contamination(docs, items).collect()}
    assert got == {1: (10, True, rows[0][1].replace(passage.upper(), "")), 2: (10, False, None), 3: (0, True, "nothing é")}
    left = {r.doc_id: r.kept_text for r in dc.remove_contamination(docs, items, longest=10, coverage=1.0).collect()}
    assert left == dict(rows)


def test_op13_odd(spark, odd, nothing):
    items = odd.selectExpr("doc_id AS item_id", "text", "lang AS spans", "source AS items")
    got = dc.find_contamination(odd, items).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == 15 and by_id[1].n_words == 0 and by_id[1].spans == by_id[2].spans == []
    assert len(by_id[4]["items"]) == 3 and by_id[8]["items"] == ["8", "9"] and by_id[-5].spans[0]["words"] == 1
    assert dc.find_contamination(nothing, items).count() == 0
    assert all(not r["items"] for r in dc.find_contamination(odd, items.where("false")).collect())
