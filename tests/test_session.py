from pathlib import Path

import pytest
from pyspark.sql import functions as F

from volscribe import session


def test_work_folders_lie_in_the_shared_folder_and_differ(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    one, two = session.work_folder(spark), session.work_folder(spark)
    assert one != two and one.startswith(shared) and two.startswith(shared)


def test_a_cluster_needs_the_shared_folder():
    class Conf:
        def get(self, name, default):
            return default

    class Context:
        master = "yarn"

    class Remote:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.work_folder(Remote())


def test_written_reads_back(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    again = session.written(df)
    assert again.agg(F.sum("x")).first()[0] == 9900
    assert "Range" not in again._jdf.queryExecution().optimizedPlan().toString()


def test_measured_bytes_grow_with_rows_and_text(spark):
    small = session.measured_bytes(spark.range(10))
    assert session.measured_bytes(spark.range(1000)) == 100 * small
    text = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("t"))
    assert session.measured_bytes(text) > 10_000
    assert session.measured_bytes(spark.range(0)) == 0
    with pytest.raises(TypeError):
        session.measured_bytes(spark.range(1).select(F.struct("id").alias("s")))


def test_broadcast_only_when_small(spark):
    df = spark.range(1000)
    hinted = lambda frame: "ResolvedHint" in frame._jdf.queryExecution().analyzed().toString()
    assert hinted(session.broadcast_if_small(df))
    assert not hinted(session.broadcast_if_small(df, limit=100))


def test_work_folders_are_removed_on_request(spark, monkeypatch):
    monkeypatch.setattr(session, "_made", [])
    stored = session.written(spark.range(5), "gone")
    assert stored.count() == 5 and len(session._made) == 1
    path = session._made[0].removeprefix("file://")
    assert Path(path).is_dir() and session.remove_work(spark) == 1
    assert not Path(path).exists() and session.remove_work(spark) == 0
