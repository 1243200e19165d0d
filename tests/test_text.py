import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from volscribe.functions import dates, numeric, text as tx
from volscribe.operators import cleaning

from tests.conftest import rows_of


def one(spark, value, column):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("$GME to the moon", ["$GME"]),
        ("ABCDEFGH", ["DEFGH"]),
        ("iPHONE", ["PHONE"]),
        ("A_B", ["B"]),
        ("GME2", []),
        ("DERÄ", ["DER"]),
        ("$F F", ["$F", "F"]),
        ("AA AA $AA", ["AA", "AA", "$AA"]),
        ("", []),
        ("ABCx", []),
    ],
)
def test_ticker_tokens(spark, text, tokens):
    assert one(spark, text, tx.ticker_tokens("t")) == tokens


def test_missing_text_has_no_tokens(spark):
    assert one(spark, None, tx.ticker_tokens(tx.raw_text("t", "t"))) == []


def test_normalize_strips_one_dollar(spark):
    assert one(spark, "$gme", tx.normalize_ticker("t")) == "GME"
    assert one(spark, "$$GME", tx.normalize_ticker("t")) == "$GME"


@pytest.mark.parametrize("token, counts", [("$F", True), ("F", False), ("GM", True)])
def test_single_letters_need_a_dollar(spark, token, counts):
    assert one(spark, token, tx.plausible_token("t")) is counts


@pytest.mark.parametrize(
    "text, kept",
    [(None, False), ("", False), ("   ", False), ("\t", True), ("[Removed]", False), (" [deleted] ", False), ("x", True)],
)
def test_real_text(spark, text, kept):
    assert one(spark, text, tx.has_real_text("t")) is kept


@pytest.mark.parametrize(
    "text, cleaned",
    [
        ("Buy at https://x.org/a?b=1", "buy at"),
        ("WWW.site.com www.site.com/z end", "www.site.com end"),
        ("**[A](b)** `c` ~d~ >e _f_", "a b c d e f"),
        ("a\n\n\tb \x0b c\r\nd", "a b c d"),
        ("https://only.link", ""),
        ("plain text", "plain text"),
    ],
)
def test_clean(spark, text, cleaned):
    assert one(spark, text, tx.clean("t")) == cleaned


def reference_clean(text):
    text = re.sub(r"https?://[^ \t\n\x0b\f\r]+|www\.[^ \t\n\x0b\f\r]+", " ", text).lower()
    text = re.sub(r"[*_`>~\[\]()]", " ", text)
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip(" ")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="aB *_`>~[]()\t\n\r\x0bhtps:/w.$", max_size=40), min_size=1, max_size=60))
def test_clean_matches_plain_regex_and_is_idempotent(spark, texts):
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    out = df.select("n", "t", tx.clean("t").alias("c")).select("*", tx.squeeze_space(tx.strip_markdown("c")).alias("again"))
    for row in out.collect():
        assert row.c == reference_clean(row.t)
        assert row.again == row.c


def test_clean_text_operator(spark):
    df = spark.createDataFrame(
        [("1", 0, "s", None, "Hello *World*", "GME"), ("2", 0, "s", "t", "[removed]", "GME"), ("3", 0, "s", None, "www.x.y", "GME")],
        "id string, created_utc long, subreddit string, title string, selftext string, ticker string",
    )
    out = cleaning.clean_text(df)
    assert out.columns == ["id", "created_utc", "subreddit", "ticker", "clean_text"]
    assert rows_of(out, "id", "clean_text") == [("1", "hello world"), ("3", "")]
    assert rows_of(cleaning.clean_text(df, drop_empty=True), "id") == [("1",)]


@pytest.mark.parametrize(
    "text, value",
    [("0.01", 0.01), ("-0.02", -0.02), ("C", None), ("B", None), ("", None), (None, None), ("CC", None), ("c", None), ("1.5E-4", 1.5e-4)],
)
def test_numeric_with_flags(spark, text, value):
    assert one(spark, text, numeric.numeric_with_flags("t")) == value


@pytest.mark.parametrize("text, seconds", [("20120103", 1325548800), ("19700101", 0), ("bad", None), ("", None), (None, None)])
def test_compact_date_epoch(spark, text, seconds):
    assert one(spark, text, dates.compact_date_epoch("t")) == seconds


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_dates_ignore_the_session_time_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(1325548799,), (1325548800,), (-1,)], "s long")
        got = [str(r[0]) for r in df.select(dates.epoch_to_date("s")).collect()]
        assert got == ["2012-01-02", "2012-01-03", "1969-12-31"]
        assert one(spark, "20120103", dates.compact_date_epoch("t")) == 1325548800
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_year_range_is_half_open(spark):
    df = spark.createDataFrame([("1994-12-31",), ("1995-01-01",), ("1996-12-31",), ("1997-01-01",)], "d string")
    out = df.select(F.col("d").cast("date").alias("d")).filter(dates.year_range("d", 1995, 1996))
    assert [str(r.d) for r in out.collect()] == ["1995-01-01", "1996-12-31"]
