import re
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from tests.conftest import plan_of, rows_of
from volscribe.operators import link
from volscribe.plans.datasets import write_archive
from volscribe.sources import ndjson, sinks, tables

LINES = [
    '{"id":"a","created_utc":"12","subreddit":"s","title":"t","selftext":"x","extra":{"k":1}}',
    "not json",
    '{"id":"b","created_utc":13,"subreddit":"s","selftext":"y"}',
    '{"id":"c","created_utc":"soon","title":null}',
]
WANT = [("a", 12, "s", "t", "x"), ("b", 13, "s", None, "y"), ("c", None, None, None, None)]


def archive(folder, name, data):
    (folder / name).write_bytes(data)
    return str(folder / name)


def test_archive_is_read(spark, tmp_path):
    archive(tmp_path, "p.ndjson.zst", zstandard.compress(("\n".join(LINES) + "\n").encode()))
    df = ndjson.read_archive(spark, str(tmp_path), "post")
    assert df.count() == 4
    assert rows_of(ndjson.drop_malformed(df)) == WANT
    assert df.columns == ["id", "created_utc", "subreddit", "title", "selftext"]


def test_comments_and_spread(spark, tmp_path):
    lines = "".join('{"id":"%d","created_utc":"5","body":"b%d"}\n' % (n, n) for n in range(20_000))
    archive(tmp_path, "c.zst", zstandard.compress(lines.encode()))
    df = ndjson.read_archive(spark, str(tmp_path), "COMMENT", spread=6)
    assert df.rdd.getNumPartitions() == 6
    assert df.select("id").distinct().count() == 20_000
    assert df.filter("title is null and selftext = concat('b', id)").count() == 20_000


def test_written_archive_has_one_file_per_task(inputs):
    path = write_archive(inputs.raw_comments().repartition(3), "three")
    files = inputs.spark.read.format("binaryFile").load(path).select("path")
    assert files.count() == 3
    assert ndjson.read_archive(inputs.spark, path, "comment").count() == inputs.comments().count()


def test_union_tags_sources(inputs):
    counted = {r.is_comment: r.n for r in inputs.texts().groupBy("is_comment").agg(F.count("*").alias("n")).collect()}
    assert counted == {False: inputs.posts().count(), True: inputs.comments().count()}


def test_securities_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text(
        "Other,Ticker,SecInfoStartDt,SecInfoEndDt\n1,gme,20120103,20120104\n2,,20120103,20120104\n3,BAD,n/a,\n"
    )
    out = tables.read_securities(spark, str(tmp_path / "s.csv"))
    assert rows_of(out) == [("BAD", None, None), ("GME", 1325548800, 1325635200)]


def test_returns_csv_is_pruned_text(spark, tmp_path):
    (tmp_path / "r.csv").write_text("PERMNO,date,X,RET,RETX,DLRET\n1,20120103,9,C,0.1,\n")
    out = tables.read_returns(spark, str(tmp_path / "r.csv"))
    assert rows_of(out) == [("1", "20120103", "C", "0.1", None)]
    assert "ReadSchema: struct<PERMNO:string,date:string,RET:string,RETX:string,DLRET:string>" in plan_of(out)


def panel(spark, rows=2000):
    # Two thirds of the rows belong to one key.
    return spark.range(rows).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(1).alias("PERMNO"), F.col("id").alias("date"), F.rand(1).alias("v")
    )


def test_partition_pruning_by_list_and_by_table(spark, tmp_path):
    path = str(tmp_path / "p")
    sinks.write_by_key(panel(spark), path, "PERMNO", ["date"])
    listed = tables.read_partitions(spark, path, "PERMNO", [0, 2])
    assert re.search(r"PartitionFilters: \[PERMNO#\d+ IN \(0,2\)\]", plan_of(listed))
    wanted = spark.createDataFrame([(0,), (2,), (2,)], "PERMNO int")
    joined = tables.read_partitions(spark, path, "PERMNO", wanted)
    assert re.search(r"PartitionFilters: \[[^]]*dynamicpruning", plan_of(joined))
    assert tables.read_partitions(spark, path, "PERMNO", wanted.limit(0)).count() == 0
    assert rows_of(listed, "date") == rows_of(joined, "date")


def test_hot_key_is_written_by_several_tasks(spark, tmp_path):
    path = tmp_path / "hot"
    names = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16KB",
    }
    before = {n: spark.conf.get(n) for n in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        df = panel(spark, 200_000).repartition(16)
        sinks.write_by_key(df, str(path), "PERMNO", ["date"])
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    files = {k.name: len(list(k.glob("*.parquet"))) for k in path.glob("PERMNO=*")}
    assert files["PERMNO=1"] > 3
    assert spark.read.parquet(str(path)).count() == 200_000


def test_rerun_replaces_and_other_folders_stay(spark, tmp_path):
    path = str(tmp_path / "p")
    df = panel(spark)
    sinks.write_sized(df, path, "PERMNO")
    sinks.write_sized(df, path, "PERMNO")
    sinks.write_sized(df.filter("PERMNO = 0"), path, "PERMNO", dynamic=True)
    assert spark.read.parquet(path).count() == 2000
    sinks.write_sized(df, path, "PERMNO", append=True)
    assert spark.read.parquet(path).count() == 4000


def test_overwrite_replaces_vanished_keys(spark, tmp_path):
    path = str(tmp_path / "k")
    three = spark.range(30).selectExpr("id", "id % 3 AS PERMNO")
    sinks.write_by_key(three, path, "PERMNO")
    sinks.write_by_key(three.filter("PERMNO < 2"), path, "PERMNO")
    assert rows_of(spark.read.parquet(path).groupBy("PERMNO").count()) == [(0, 10), (1, 10)]


def test_another_number_of_buckets_leaves_no_old_rows(spark, tmp_path):
    path = str(tmp_path / "n")
    for buckets in (40, 20):
        sinks.write_bucketed(spark.range(1000).withColumnRenamed("id", "PERMNO"), path, "PERMNO", buckets)
        assert spark.read.parquet(path).count() == 1000


def test_files_stay_below_the_record_limit(spark, tmp_path):
    path = tmp_path / "p"
    sinks.write_layout(spark.range(1000).withColumn("k", F.lit(1)), str(path), key="k", max_records=300)
    sizes = [spark.read.parquet(str(f)).count() for f in (path / "k=1").glob("*.parquet")]
    assert sum(sizes) == 1000 and max(sizes) <= 300


def test_bucket_is_crc32_of_the_text(spark, tmp_path):
    df = spark.createDataFrame([(n,) for n in range(200)] + [(None,)], "PERMNO long")
    path = str(tmp_path / "b")
    sinks.write_bucketed(df, path, "PERMNO")
    for row in spark.read.parquet(path).collect():
        want = None if row.PERMNO is None else zlib.crc32(str(row.PERMNO).encode()) % 40
        assert row.bucket == want


def test_zstd_files(spark, tmp_path):
    path = tmp_path / "z"
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "ticker string, t string")
    sinks.write_zstd(df, str(path))
    assert list(path.glob("*.zstd.parquet"))
    assert rows_of(spark.read.parquet(str(path))) == [("a", "x"), ("b", "y")]


def test_plain_overwrite(spark, tmp_path):
    path = str(tmp_path / "o")
    sinks.write_overwrite(spark.range(5), path)
    sinks.write_overwrite(spark.range(3), path)
    assert spark.read.parquet(path).count() == 3


def test_colocated_tables_join_without_an_exchange(spark, tmp_path):
    left = spark.range(5000).selectExpr("id % 700 AS k", "id % 5 AS day", "id AS v")
    right = spark.range(700).selectExpr("id AS k", "id % 5 AS day", "id * 2 AS w")
    tables = [sinks.write_colocated(df, name, str(tmp_path / name), ("k", "day"), 7) for name, df in (("near_l", left), ("near_r", right))]
    joined = link.join_colocated(*tables, ("k", "day"))
    assert "Exchange" not in plan_of(joined) and plan_of(joined).count("SelectedBucketsCount: 7 out of 7") == 2
    assert rows_of(joined, "k", "day", "v", "w") == rows_of(left.join(right, ["k", "day"]), "k", "day", "v", "w")
    # Written anew with other rows, the table has those only.
    again = sinks.write_colocated(right.where("k < 10"), "near_r", str(tmp_path / "near_r"), ("k", "day"), 7)
    assert again.count() == 10


def test_model_table_keeps_other_windows(spark, tmp_path):
    path = str(tmp_path / "models")
    sinks.write_models(spark.createDataFrame([(1, 0.5), (2, 0.6)], "train_start int, mse double"), path)
    sinks.write_models(spark.createDataFrame([(2, 0.7)], "train_start int, mse double"), path)
    assert rows_of(spark.read.parquet(path), "train_start", "mse") == [(1, 0.5), (2, 0.7)]
