from volscribe.functions.text import clean, has_real_text
from volscribe.operators import mentions

from tests.conftest import rows_of


def test_row_wise_operators_accept_a_stream(inputs, tmp_path):
    """Mining and cleaning hold no state, so the batch code runs on a stream as is."""
    spark, source = inputs.spark, str(tmp_path / "in")
    inputs.texts().repartition(3).write.parquet(source)
    stream = spark.readStream.schema(inputs.texts().schema).option("maxFilesPerTrigger", 1).parquet(source)
    ready = stream.filter(has_real_text("selftext")).withColumn("clean_text", clean("selftext"))
    keep = ("id", "created_utc", "clean_text")
    found = mentions.mine_mentions(ready, inputs.securities(), keep, distinct=True)
    query = (
        found.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    batch = inputs.texts().filter(has_real_text("selftext")).withColumn("clean_text", clean("selftext"))
    want = mentions.mine_mentions(batch, inputs.securities(), keep, distinct=True)
    assert rows_of(spark.read.parquet(str(tmp_path / "out"))) == rows_of(want)
