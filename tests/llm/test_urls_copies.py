import random

import duckdb
import pytest
from hypothesis import given, settings, strategies as st

from tests.conftest import SF, rows_of
from volscribe.llm import exact_dedup, queries, url_filter


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = duck.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.collect())


def brute_verdict(rules, host, path):
    fits = []
    for verdict, rule in rules:
        rule_host, slash, rule_path = rule.partition("/")
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(slash + rule_path):
            fits.append((rule_host.count("."), len(slash + rule_path), verdict == "block", verdict, rule))
    return max(fits)[-2:] if fits else None


parts = st.lists(st.sampled_from(["a", "b", "ab", "com"]), min_size=1, max_size=3)
paths = st.lists(st.sampled_from(["", "a", "ab", "b1"]), max_size=3).map(lambda p: "".join("/" + x for x in p))
rule = st.tuples(st.sampled_from(["allow", "block"]), st.tuples(parts.map(".".join), paths).map(lambda x: x[0] + (x[1] or "/")))


@settings(max_examples=300, deadline=None)
@given(st.lists(rule, max_size=6, unique_by=lambda r: r[1]), parts.map(".".join), paths)
def test_trie_equals_trying_all_rules(rules, host, path):
    assert url_filter.UrlTrie(rules).match(host, path) == brute_verdict(rules, host, path)


def test_urls_odd(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.ORG", "http://A.Org/X?y", "http://x.org#/es/", "a://b.org://c/", "http://org/"]
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)] * 2, "page_id long, url string, host string, rule string")
    got = rows_of(url_filter.judge_urls(pages, queries.URL_RULES))
    assert len(got) == 2 * len(urls)
    assert got[0] == (0, "", "", None, "allow")
    assert dict((r[0], r[1:3]) for r in got)[5] == ("a.org", "/X")
    assert dict((r[0], r[3]) for r in got) == {**dict.fromkeys(range(9)), 5: "org/", 7: None, 8: "org/"}
    assert url_filter.judge_urls(pages.where("false"), queries.URL_RULES).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \t\n\v\f\rab\u2003\x1c", max_size=30))
def test_normalised_equals_pattern(text):
    import re

    assert exact_dedup.normalised(text.encode()).decode() == re.sub(r"[\x20\x09-\x0D]+", " ", text)


def test_chunks_make_up_the_text_and_do_not_depend_on_its_place():
    text = random.Random(1).randbytes(60_000)
    found = exact_dedup.chunks(text)
    assert b"".join(found) == text and max(map(len, found)) <= exact_dedup.MOST
    shifted = set(exact_dedup.chunks(b"new start " * 30 + text))
    assert len(shifted & set(found)) > 0.8 * len(set(found))


def test_digests_that_different_chunks_share_are_widened(spark, odd):
    # One byte cannot name so many chunks; the result stays right.
    many = spark.createDataFrame([(k, f"text {k // 2} " * 60) for k in range(800)], "doc_id long, text string")
    assert not exact_dedup.shared_by_different(many, 1).isEmpty()
    got = exact_dedup.exact_groups(many, digest_bytes=1)
    assert rows_of(got.select("doc_id", "keep_id", "group_size")) == sorted(((k, k - k % 2, 2) for k in range(800)), key=repr)


def test_copies_odd(odd, nothing):
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_groups(odd).collect()}
    by_id = {k[0]: r for k, r in got.items()}
    assert len(got) == 14  # the repeated row is one
    assert (by_id[1].keep_id, by_id[1].group_size, by_id[2].kept) == (1, 2, False)
    assert (by_id[4].group_size, by_id[5].keep_id, by_id[5].kept) == (4, 4, False)
    assert by_id[None].keep_id == 4 and not by_id[None].kept
    assert by_id[9].keep_id == 8 and by_id[3].kept and by_id[-5].kept
    assert exact_dedup.exact_groups(nothing).count() == 0


def test_first_copies_of_ids_that_several_rows_share(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (1, "b  c", "y"), (2, "a", "z"), (3, "b c", "z"), (4, "d", None), (None, "e", None), (None, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = exact_dedup.first_copies(docs)
    assert got.columns == docs.columns
    assert rows_of(got) == sorted([(1, "a", "x"), (1, "b  c", "y"), (4, "d", None), (None, "e", None)], key=repr)


def test_op2_returns_each_repeated_row(spark, tmp_path):
    rows = [(1, "a  b"), (1, "a  b"), (2, "a b"), (2, None), (3, ""), (3, ""), (4, "c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = queries.QUERIES["op2_exact_dedup"](spark, str(tmp_path))
    want = duck.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES['op2_exact_dedup']})").fetchall()
    assert len(want) == 7 and sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.collect())
