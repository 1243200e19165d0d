import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of, rows_of
from volscribe.operators import link, mentions
from volscribe.plans import pipelines

POSTS = "id string, ticker string, created_utc long"


@pytest.fixture(scope="module")
def posts(spark):
    return link.with_created_date(
        spark.createDataFrame([("a", "X", 0), ("a", "Y", 10), ("b", "X", 86400), ("c", "Z", 0)], POSTS)
    )


@pytest.fixture(scope="module")
def ticker_map(spark):
    return spark.createDataFrame(
        [("1970-01-01", "X", 1), ("1970-01-02", "X", 2), ("1970-01-01", "Y", 3)], "DATE string, TICKER string, PERMNO long"
    )


def test_created_date_and_stamp(posts):
    row = posts.filter("id = 'b'").first()
    assert (str(row.created_date), str(row.created_ts)) == ("1970-01-02", "1970-01-02 00:00:00")


def test_security_depends_on_the_day(posts, ticker_map):
    assert rows_of(link.attach_security(posts, ticker_map), "id", "ticker", "PERMNO") == [("a", "X", 1), ("a", "Y", 3), ("b", "X", 2)]
    kept = link.attach_security(posts, ticker_map, keep_unmapped=True)
    assert ("c", "Z", None) in rows_of(kept, "id", "ticker", "PERMNO")
    assert kept.columns == [*posts.columns, "PERMNO"]


def test_embeddings_by_mention_or_by_text(spark, posts):
    vectors = spark.createDataFrame([("a", "X", [1.0]), ("a", "Y", [2.0])], "id string, ticker string, embed array<float>")
    assert rows_of(link.attach_embeddings(posts, vectors), "id", "ticker", "embed") == [
        ("a", "X", [1.0]), ("a", "Y", [2.0]), ("b", "X", None), ("c", "Z", None)
    ]
    # On the text alone, two mentions meet two vectors: four rows.
    assert link.attach_embeddings(posts, vectors, on=("id",), unique=False).filter("id = 'a'").count() == 4


def test_stored_copies_of_a_vector_count_once(spark, posts):
    copies = spark.range(3000).selectExpr("'a' AS id", "'X' AS ticker", "array(1.0F) AS embed")
    assert link.attach_embeddings(posts, copies).count() == posts.count()
    many = spark.range(1000).selectExpr("'a' AS id", "'X' AS ticker", "0L AS created_utc")
    assert link.attach_embeddings(many, copies).filter("embed[0] = 1.0").count() == 1000


def test_the_same_one_of_several_vectors_on_any_layout(spark, posts):
    several = spark.range(200).selectExpr("'a' AS id", "'X' AS ticker", "array(cast(id AS float)) AS embed")
    chosen = {
        link.attach_embeddings(posts, several.repartition(n, "embed")).filter("id = 'a' AND ticker = 'X'").first().embed[0] for n in (1, 7, 30)
    }
    assert len(chosen) == 1


def test_prefix(spark):
    assert link.prefix_columns(spark.range(1).withColumn("b c", F.lit(1)), "r").columns == ["r_id", "r_b c"]


@pytest.fixture(scope="module")
def days(spark):
    return spark.createDataFrame(
        [(1, "1970-01-01", 0.1), (2, "1970-01-02", 0.2), (2, "1970-01-03", 0.3), (9, "1970-01-01", 0.9)],
        "PERMNO long, date string, vol_1 double",
    ).withColumn("date", F.col("date").cast("date"))


def test_inner_link(posts, ticker_map, days):
    out = link.link_panel(link.attach_security(posts, ticker_map), days)
    assert rows_of(out, "r_id", "PERMNO", "c_vol_1") == [("a", 1, 0.1), ("b", 2, 0.2)]
    assert {"r_created_date", "c_date", "r_PERMNO", "c_PERMNO"} <= set(out.columns)


def test_left_link_keeps_all_texts(posts, ticker_map, days):
    mapped = link.attach_security(posts, ticker_map, keep_unmapped=True)
    out = link.link_panel(mapped, days, how="left")
    assert out.count() == mapped.count()
    assert rows_of(out.filter("c_vol_1 is not null"), "r_id", "PERMNO", "c_vol_1") == [("a", 1, 0.1), ("b", 2, 0.2)]


def test_full_outer_equals_sparks_own(posts, ticker_map, days):
    mapped = link.attach_security(posts, ticker_map, keep_unmapped=True)
    got = link.link_panel(mapped, days, how="outer")
    r, c = link.prefix_columns(mapped, "r"), link.prefix_columns(days, "c")
    want = r.join(c, (F.col("r_PERMNO") == F.col("c_PERMNO")) & (F.col("r_created_date") == F.col("c_date")), "full")
    assert rows_of(got.drop("PERMNO"), *want.columns) == rows_of(want)
    assert got.filter("PERMNO is null").count() == 1


def test_unknown_join_kind(posts, days):
    with pytest.raises(ValueError):
        link.link_panel(posts.withColumn("PERMNO", F.lit(1)), days, how="cross")


def test_hot_security_day_is_split(spark, days):
    """A day that holds nearly all texts is divided among tasks, with all rows kept."""
    names = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        texts = spark.range(0, 200_000, 1, 16).select(
            F.col("id").cast("string").alias("id"), F.lit("X").alias("ticker"),
            F.when(F.col("id") % 100 == 0, 2).otherwise(1).cast("long").alias("PERMNO"),
            F.when(F.col("id") % 100 == 0, F.lit("1970-01-02")).otherwise(F.lit("1970-01-01")).cast("date").alias("created_date"),
            F.sha2(F.col("id").cast("string"), 256).alias("pad"),
        )
        linked = link.link_panel(texts, days).groupBy("r_id").agg(F.max("r_pad"), F.max("c_vol_1"))
        assert linked.count() == 200_000
        joined = link.link_panel(texts, days)
        joined.collect()
        assert "skew=true" in plan_of(joined)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def test_ids_are_kept_by_join(posts, spark):
    ids = spark.createDataFrame([("a",), ("a",)], "id string")
    assert rows_of(link.keep_ids(posts, ids), "id", "ticker") == [("a", "X"), ("a", "Y")]


def test_vectors_are_joined_last(inputs):
    frames = (inputs.texts(), inputs.securities(), inputs.ticker_map(), inputs.panel("symbol"), inputs.embeddings())
    plan = pipelines.linked_with_vectors(*frames)._jdf.queryExecution().optimizedPlan().toString()
    top = next(line for line in plan.splitlines() if "Join" in line)
    assert "r_id" in top and "LeftOuter" in top


def test_clean_mentions_agree_with_separate_steps(inputs):
    from volscribe.operators.cleaning import clean_text

    got = pipelines.clean_mentions(inputs.texts(), inputs.securities())
    found = mentions.mine_mentions(inputs.texts(), inputs.securities(), distinct=True)
    want = clean_text(inputs.texts()).select("id", "clean_text").join(found, "id")
    assert rows_of(got, "id", "ticker", "clean_text") == rows_of(want, "id", "ticker", "clean_text")
