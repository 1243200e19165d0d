import pytest
from pyspark.sql import functions as F

from volscribe import session
from volscribe.operators import mentions

from tests.conftest import plan_of, rows_of

DAY = 86400
POSTS = "id string, created_utc long, subreddit string, title string, selftext string, is_comment boolean"
SPANS = "ticker string, start_ts long, end_ts long"


@pytest.fixture(scope="module")
def spans(spark):
    return spark.createDataFrame(
        [("GME", 100, 200), ("F", 0, 1000), ("TWO", 0, 50), ("TWO", 40, 90), ("BAD", None, 100)], SPANS
    )


def posts(spark, *rows):
    return spark.createDataFrame(
        [(str(n), at, "s", title, body, comment) for n, (at, title, body, comment) in enumerate(rows)], POSTS
    )


@pytest.mark.parametrize("at, kept", [(99, 0), (100, 1), (150, 1), (200, 1), (201, 0)])
def test_life_span_bounds_are_inclusive(spark, spans, at, kept):
    assert mentions.mine_mentions(posts(spark, (at, None, "GME", False)), spans).count() == kept


@pytest.mark.parametrize("at, kept", [(200, 1), (200 + DAY - 1, 1), (200 + DAY, 0)])
def test_last_day_can_be_included(spark, spans, at, kept):
    found = mentions.mine_mentions(posts(spark, (at, None, "GME", False)), spans, end_inclusive_day=True)
    assert found.count() == kept


def test_repeats_spellings_and_single_letters(spark, spans):
    df = posts(spark, (150, "GME", "$GME and F and $F", False))
    assert rows_of(mentions.mine_mentions(df, spans), "ticker") == [("F",), ("GME",), ("GME",)]
    assert rows_of(mentions.mine_mentions(df, spans, distinct=True), "ticker") == [("F",), ("GME",)]


def test_overlapping_spans_repeat_unless_distinct(spark, spans):
    df = posts(spark, (45, None, "TWO", False))
    assert mentions.mine_mentions(df, spans).count() == 2
    assert mentions.mine_mentions(df, spans, distinct=True).count() == 1


def test_unknown_start_never_matches(spark, spans):
    assert mentions.mine_mentions(posts(spark, (50, None, "BAD", False)), spans).count() == 0


def test_sources(spark, spans):
    df = posts(spark, (150, None, "GME", False), (150, None, "GME", True))
    assert rows_of(mentions.mine_mentions(df, spans, source="posts"), "is_comment") == [(False,)]
    assert rows_of(mentions.mine_mentions(df, spans, source="comments"), "is_comment") == [(True,)]
    assert mentions.mine_mentions(df, spans).count() == 2


def test_partitioning_does_not_matter(inputs):
    few = mentions.mine_mentions(inputs.texts().coalesce(1), inputs.securities())
    many = mentions.mine_mentions(inputs.texts().repartition(13), inputs.securities())
    assert rows_of(few) == rows_of(many)


def test_large_security_table_is_not_broadcast(inputs, monkeypatch):
    small = mentions.mine_mentions(inputs.texts(), inputs.securities())
    assert "BroadcastHashJoin" in plan_of(small)
    monkeypatch.setattr(mentions, "broadcast_if_small", lambda df: session.broadcast_if_small(df, limit=10))
    before = inputs.spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    inputs.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = mentions.mine_mentions(inputs.texts(), inputs.securities())
        assert "SortMergeJoin" in plan_of(large)
        assert rows_of(large) == rows_of(small)
    finally:
        inputs.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_no_shuffle_with_a_broadcast_security_table(spark, spans, tmp_path):
    posts(spark, (150, None, "GME", False)).write.parquet(str(tmp_path / "p"))
    plan = plan_of(mentions.mine_mentions(spark.read.parquet(str(tmp_path / "p")), spans, distinct=True))
    assert "Exchange hashpartitioning" not in plan
    assert "LeftSemi" in plan


def test_explode_keeps_repeats(spark):
    df = mentions.extract_candidates(posts(spark, (1, None, "AA AA", False), (1, None, "none", False)))
    assert rows_of(mentions.explode_mentions(df), "token") == [("AA",), ("AA",)]
    assert rows_of(mentions.explode_mentions(df, distinct=True), "token") == [("AA",)]


def test_lookup_fans_out_over_spans(spark, spans):
    df = mentions.with_ticker(mentions.explode_mentions(mentions.extract_candidates(posts(spark, (1, None, "TWO", False)))))
    assert mentions.join_securities(df, spans).agg(F.count("*")).first()[0] == 2
