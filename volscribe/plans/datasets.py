"""Posts, comments, securities, returns and vectors derived from the test tables.

Every frame is a lazy view of the given Parquet tables, so it grows with them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from volscribe.operators.panel import parse_returns, volatility_panel
from volscribe.session import configure, work_folder
from volscribe.sources.ndjson import open_filesystem, standardize, union_posts_comments
from volscribe.sources.tables import prepare_securities

# Securities whose tickers occur in the texts.
CORE_SECURITIES = """
    ('the', '19950101', '20011231', 0),
    ('OF', '19950101', '19981231', 1),
    ('OF', '19990101', '20011231', 1),
    ('DE', '19960101', '20001231', 2),
    ('TO', '19950101', '20011231', 3),
    ('AND', '19970615', '20011231', 4),
    ('LA', '19950101', '20011231', 5),
    ('IN', '19950101', '19991231', 6),
    ('DER', '19950101', '20011231', 7),
    ('A', '19950101', '20011231', 8),
    ('WAS', '19950101', '20011231', 9),
    ('ON', 'bad', '20011231', 9),
    (NULL, '19950101', '20011231', 9)
"""
ADVERT = "**Buy** $A now https://x.example.org/a?b=1 (see [this](www.y.example.com/z)) "
FIRST_SECOND = 788918400

_schemas: dict[str, StructType] = {}


class Inputs:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        if path not in _schemas:
            _schemas[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_schemas[path]).parquet(path)

    # -- texts -----------------------------------------------------------------

    def raw_posts(self) -> DataFrame:
        documents = self.table("documents").select("doc_id", "text", "source")
        return documents.selectExpr(
            "concat('p', doc_id) AS id",
            f"cast({FIRST_SECOND} + ((doc_id * 37) % 2400) * 86400 + (doc_id % 24) * 3600 AS string) AS created_utc",
            "source AS subreddit",
            "CASE WHEN doc_id % 3 = 0 THEN concat('Title $OF ', doc_id) END AS title",
            f"""CASE WHEN doc_id % 25 = 1 THEN '[removed]' WHEN doc_id % 25 = 2 THEN ' [Deleted] '
                     WHEN doc_id % 25 = 3 THEN '   ' WHEN doc_id % 25 = 4 THEN NULL
                     WHEN doc_id % 10 = 0 THEN concat('{ADVERT}', text) ELSE text END AS selftext""",
        )

    def raw_comments(self) -> DataFrame:
        return self.table("conversations").selectExpr(
            "concat('c', conv_id, '_', turn) AS id",
            f"cast({FIRST_SECOND} + ((conv_id * 53 + turn) % 2400) * 86400 + (turn % 24) * 3600 AS string) AS created_utc",
            "role AS subreddit",
            "CASE WHEN (conv_id + turn) % 4 = 0 THEN concat(text, ' $TO $OF moon') ELSE text END AS body",
        )

    def posts(self) -> DataFrame:
        return standardize(self.raw_posts(), "post")

    def comments(self) -> DataFrame:
        return standardize(self.raw_comments(), "comment")

    def texts(self) -> DataFrame:
        return union_posts_comments(self.posts(), self.comments())

    # -- securities ------------------------------------------------------------

    def core_securities(self) -> DataFrame:
        return self.spark.sql(
            f"""SELECT Ticker, SecInfoStartDt, SecInfoEndDt, cast(PERMNO AS bigint) AS PERMNO
                FROM VALUES {CORE_SECURITIES} AS v(Ticker, SecInfoStartDt, SecInfoEndDt, PERMNO)"""
        )

    def raw_securities(self) -> DataFrame:
        """The core securities and one more per supplier, some with bad or no data."""
        listed = self.table("supplier").selectExpr(
            "CASE WHEN s_suppkey % 7 <> 0 THEN concat('zq', s_suppkey) END AS Ticker",
            """CASE WHEN s_suppkey % 11 = 0 THEN 'n/a'
               ELSE date_format(date_add(DATE '1995-01-01', cast(s_suppkey % 1000 AS int)), 'yyyyMMdd') END AS SecInfoStartDt""",
            "'20011231' AS SecInfoEndDt",
            "s_suppkey % 10 AS PERMNO",
        )
        return self.core_securities().unionByName(listed)

    def securities(self) -> DataFrame:
        return prepare_securities(self.raw_securities())

    # -- returns ---------------------------------------------------------------

    def prices(self, grain: str) -> DataFrame:
        """Mean unit price per security and day; 'symbol' folds securities into ten."""
        key = "l_suppkey" if grain == "wide" else "l_suppkey % 10"
        lines = self.table("lineitem").selectExpr(
            f"{key} AS PERMNO", "cast(l_shipdate AS date) AS date", "l_extendedprice / l_quantity AS unit"
        )
        return lines.groupBy("PERMNO", "date").agg(F.avg("unit").alias("p"))

    def raw_returns(self, grain: str = "wide") -> DataFrame:
        digits = "cast(cast(round(r, 6) AS decimal(12, 6)) AS string)"
        change = self.prices(grain).selectExpr(
            "PERMNO", "date", "0.02D * ln(p / lag(p) OVER (PARTITION BY PERMNO ORDER BY date)) AS r"
        )
        return change.selectExpr(
            "PERMNO",
            "date_format(date, 'yyyyMMdd') AS date",
            f"CASE WHEN day(date) % 11 = 0 THEN 'C' WHEN day(date) % 13 = 0 THEN '' ELSE {digits} END AS RET",
            f"CASE WHEN day(date) % 22 = 0 THEN 'B' ELSE {digits} END AS RETX",
            "CASE WHEN day(date) = 22 AND month(date) = 6 THEN '-0.5' END AS DLRET",
        )

    def returns(self, grain: str = "wide") -> DataFrame:
        return parse_returns(self.raw_returns(grain))

    def panel(self, grain: str = "wide") -> DataFrame:
        # Prices are averaged per security and day, so days are unique.
        return volatility_panel(self.returns(grain))

    # -- vectors and the ticker map ----------------------------------------------

    def embeddings(self) -> DataFrame:
        vectors = self.table("embeddings")
        number = vectors.agg(F.count("*")).scalar()
        docs = self.table("documents").select(
            F.expr("concat('p', doc_id)").alias("id"), (F.col("doc_id") % number).alias("vec_id")
        )
        return docs.join(vectors.selectExpr("vec_id", "embedding AS embed"), "vec_id").select("id", "embed")

    def ticker_map(self) -> DataFrame:
        core = self.core_securities().selectExpr("upper(Ticker) AS TICKER", "PERMNO").na.drop(subset=["TICKER"])
        days = self.table("lineitem").selectExpr("l_suppkey % 10 AS PERMNO", "cast(l_shipdate AS date) AS DATE")
        # Ten or so tickers from a list in this file; days are made distinct first.
        return days.distinct().join(F.broadcast(core.distinct()), "PERMNO").select("DATE", "TICKER", "PERMNO")


def write_archive(records: DataFrame, label: str) -> str:
    """Write records as zstd-compressed NDJSON into the shared folder, one file per task.

    Files are written under a temporary name and moved, so a repeated task attempt
    replaces its own file.
    """
    path = work_folder(records.sparkSession, label)
    lines = records.select(F.to_json(F.struct(*records.columns)).alias("value"))

    def write(batches: Iterator) -> Iterator:
        import uuid

        import pandas as pd
        import zstandard
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        filesystem, folder = open_filesystem(path)
        filesystem.create_dir(folder)
        final = f"{folder}/part-{number:05d}.ndjson.zst"
        draft = f"{folder}/_draft-{number:05d}-{uuid.uuid4().hex}"
        rows = 0
        with filesystem.open_output_stream(draft) as raw, zstandard.ZstdCompressor().stream_writer(raw) as out:
            for batch in batches:
                rows += len(batch)
                out.write("".join(line + "\n" for line in batch["value"]).encode("utf-8"))
        filesystem.move(draft, final)
        yield pd.DataFrame({"rows": [rows]})

    lines.mapInPandas(write, "rows long").agg(F.sum("rows")).first()
    return path
