import hashlib

import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of, rows_of
from volscribe.operators import aggregates, diagnostics, sampling


def brute_order(n, seed):
    return sorted(range(n), key=lambda k: hashlib.md5(f"{k}|{seed}".encode()).hexdigest())


@pytest.mark.parametrize("n", [1, 10, 500, 999, 1000, 5000])
def test_topn_is_the_hash_order(spark, n):
    got = {r.id for r in sampling.sample_topn_random(spark.range(1000), ["id"], n).collect()}
    assert got == set(brute_order(1000, "42")[:n])


def test_zero_means_all(spark):
    assert sampling.sample_topn_random(spark.range(50), ["id"], 0).count() == 50


def test_topn_on_other_layouts_and_seeds(spark):
    df = spark.range(2000)
    one = rows_of(sampling.sample_topn_random(df.coalesce(1), ["id"], 100))
    assert rows_of(sampling.sample_topn_random(df.repartition(17), ["id"], 100)) == one
    assert rows_of(sampling.sample_topn_random(df, ["id"], 100, seed="other")) != one


def test_the_cut_is_the_first_prefix_that_reaches_n(spark):
    places = spark.range(5000).select(F.expr("(id * 7919) % 5000 * 800000").alias("place"))
    width = sampling.MD5_HEAD_RANGE >> sampling.PREFIX_BITS
    for n in (1, 50, 4999, 5000):
        cut = sampling.hash_cut(places, "place", n)
        below = [k * 800000 for k in range(5000) if k * 800000 < cut]
        assert len(below) >= n and sum(k < cut - width for k in below) < n
    assert sampling.hash_cut(places, "place", 5001) == sampling.MD5_HEAD_RANGE


def test_topn_with_copies_of_one_row(spark):
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("id"))
    assert sampling.sample_topn_random(df, ["id"], 450).count() == 450


def test_bernoulli(spark):
    df = spark.range(20_000)
    got = rows_of(sampling.sample_bernoulli(df, ["id"], 0.2))
    assert rows_of(sampling.sample_bernoulli(df.repartition(9), ["id"], 0.2)) == got
    assert abs(len(got) - 4000) < 300
    smaller = rows_of(sampling.sample_bernoulli(df, ["id"], 0.1))
    assert set(smaller) < set(got)
    assert sampling.sample_bernoulli(df, ["id"], 1.0).count() == 20_000


def test_first_rows_is_a_bounded_sort(spark):
    df = sampling.first_rows(spark.range(100).withColumn("v", -F.col("id")), ["v"], 3)
    assert [r.id for r in df.collect()] == [99, 98, 97]
    assert "TakeOrderedAndProject" in plan_of(df)


def test_density_counts_every_row_once(spark):
    df = spark.range(1001).select((F.col("id") / 10).alias("a"), F.lit(5.0).alias("b"))
    rows = diagnostics.density(df, ("a", "b"), bins=10).collect()
    assert sum(r.row_count for r in rows if r.metric == "a") == 1001
    assert {(r.bin, r.row_count) for r in rows if r.metric == "b"} == {(0, 1001)}
    assert {r.bin: r.row_count for r in rows if r.metric == "a"}[9] == 101


def test_correlations(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("a"), (-F.col("id")).cast("double").alias("b"))
    assert abs(diagnostics.correlations(df, ("a", "b")).first()["corr"] + 1) < 1e-12


def test_stage_counts(spark):
    out = aggregates.stage_counts({"x": spark.range(3), "y": spark.range(0)})
    assert rows_of(out) == [("x", 3), ("y", 0)]


def test_distinct_keys(spark):
    df = spark.createDataFrame([(3,), (1,), (3,)], "k int")
    assert [r.k for r in aggregates.distinct_keys_sorted(df, "k").collect()] == [1, 3]


def test_metrics_without_spread(spark):
    df = spark.createDataFrame([(1.0, 1.5), (1.0, 0.5)], "label double, prediction double")
    row = aggregates.regression_metrics(df).first()
    assert (row.n, row.mse, row.r2) == (2, 0.25, None)
