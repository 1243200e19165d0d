"""One registered query per operator, with equivalent SQL where SQL can say it.

Dates leave as text and arrays as rows or text, so that both engines hand over
the same plain values; floating-point results are rounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from volscribe.functions import dates as dt, numeric as nm, text as tx
from volscribe.operators import (
    accounting, aggregates, cleaning, diagnostics, embed, link, mentions, ols, panel, ridge, sampling, tokens, windows,
)
from volscribe.plans import oracle as sql, pipelines
from volscribe.plans.datasets import Inputs, write_archive
from volscribe.session import work_folder, written
from volscribe.sources import ndjson, sinks, tables

WIDEST = 1e10

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function of ``Inputs`` under ``name``."""

    def register(build: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Inputs(spark, folder))
        if oracle is not None:
            ORACLES[name] = sql.with_tables(oracle)
        return build

    return register


def rounded(c: Column | str, digits: int = 6) -> Column:
    """The counterpart of ``oracle.rounded``, the same arithmetic on doubles."""
    scale = float(10**digits)
    value = F.expr(c) if isinstance(c, str) else c
    # What is no number, infinite or too large to round stays as it is.
    return F.when(F.abs(value) < WIDEST, F.floor(value * F.lit(scale) + F.lit(sql.EDGE)) / F.lit(scale)).otherwise(value)


def day(c: Column | str) -> Column:
    return F.expr(f"cast({c} AS string)") if isinstance(c, str) else c.cast("string")


R, DAY = sql.rounded, "CAST({} AS VARCHAR)".format

# ---------------------------------------------------------------- sources, sinks

POST_COLUMNS = "id, created_utc, subreddit, title, selftext"


@query("scan_ndjson_compressed", f"SELECT {POST_COLUMNS} FROM posts")
def scan_ndjson_compressed(i: Inputs) -> DataFrame:
    path = write_archive(i.raw_posts(), "posts")
    tasks = int(i.spark.conf.get("spark.sql.shuffle.partitions"))
    return ndjson.drop_malformed(ndjson.read_archive(i.spark, path, "post", spread=tasks))


@query("json_schema_for_kind", "SELECT id, created_utc, subreddit, body FROM raw_comments")
def json_schema_for_kind(i: Inputs) -> DataFrame:
    raw = i.raw_comments()
    return ndjson.parse_records(raw.select(F.to_json(F.struct(*raw.columns)).alias("value")), "Comment")


@query(
    "scan_security_master",
    "SELECT ticker, coalesce(start_ts, -1) AS start_ts, coalesce(end_ts, -1) AS end_ts FROM securities",
)
def scan_security_master(i: Inputs) -> DataFrame:
    path = work_folder(i.spark, "securities")
    i.raw_securities().drop("PERMNO").write.option("header", True).csv(path)
    read = tables.read_securities(i.spark, path)
    return read.select("ticker", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("start_ts", "end_ts")])


# A CSV file knows no difference between a blank and a missing cell.
@query("scan_returns_csv", "SELECT CAST(PERMNO AS VARCHAR) AS PERMNO, date, nullif(RET, '') AS RET, RETX, DLRET FROM raw_symbol")
def scan_returns_csv(i: Inputs) -> DataFrame:
    path = work_folder(i.spark, "returns")
    i.raw_returns("symbol").write.option("header", True).csv(path)
    return tables.read_returns(i.spark, path)


@query("scan_parquet_projected", "SELECT l_suppkey, l_extendedprice FROM lineitem")
def scan_parquet_projected(i: Inputs) -> DataFrame:
    return tables.read_projected(i.spark, f"{i.folder}/lineitem.parquet", ["l_suppkey", "l_extendedprice"])


PANEL_OUT = f"PERMNO, {DAY('date')} AS date, " + ", ".join(
    f"{R(c)} AS {c}" for c in ("ret", "vol_1", "vol_5", "vol_22", "vol_63", "y_1", "y_5", "y_22", "y_63")
)


def panel_out(df: DataFrame) -> DataFrame:
    values = [c for c in df.columns if c not in ("PERMNO", "date")]
    return df.select(
        F.col("PERMNO").cast("bigint").alias("PERMNO"), F.col("date").cast("string").alias("date"),
        *[rounded(c).alias(c) for c in values],
    )


@query(
    "scan_partition_pruned",
    f"SELECT {PANEL_OUT} FROM panel_symbol WHERE PERMNO IN "
    "(SELECT c.PERMNO FROM core_securities c JOIN mentions m ON upper(c.Ticker) = m.ticker WHERE m.is_comment)",
)
def scan_partition_pruned(i: Inputs) -> DataFrame:
    path = work_folder(i.spark, "panel")
    sinks.write_by_key(i.panel("symbol"), path, "PERMNO", ["date"])
    named = mentions.mine_mentions(i.texts(), i.securities(), source="comments", distinct=True)
    core = i.core_securities().select(F.upper("Ticker").alias("ticker"), F.col("PERMNO").cast("int").alias("PERMNO"))
    wanted = named.join(core, "ticker").select("PERMNO")
    return panel_out(tables.read_partitions(i.spark, path, "PERMNO", wanted))


MENTION_OUT = "id, created_utc, subreddit, is_comment, ticker"


@query("sink_parquet_overwrite", f"SELECT {MENTION_OUT} FROM mentions")
def sink_parquet_overwrite(i: Inputs) -> DataFrame:
    path = work_folder(i.spark, "mentions")
    sinks.write_overwrite(mentions.mine_mentions(i.texts(), i.securities()), path)
    return i.spark.read.parquet(path)


@query("sink_partitioned_by_key", f"SELECT {PANEL_OUT} FROM panel_symbol")
def sink_partitioned_by_key(i: Inputs) -> DataFrame:
    path = work_folder(i.spark, "panel")
    sinks.write_by_key(i.panel("symbol"), path, "PERMNO", ["date"])
    return panel_out(i.spark.read.parquet(path))


@query("sink_append_sized", f"SELECT {MENTION_OUT} FROM mentions")
def sink_append_sized(i: Inputs) -> DataFrame:
    path = work_folder(i.spark, "sized")
    found = mentions.mine_mentions(i.texts(), i.securities())
    found = written(found, "mentions")
    # Written twice: the second run replaces the folders of the first.
    sinks.write_sized(found, path, "ticker", dynamic=True)
    sinks.write_sized(found, path, "ticker", dynamic=True)
    return i.spark.read.parquet(path)


@query(
    "sink_hash_bucketed",
    "SELECT id, ticker, PERMNO, CAST(CAST('0x' || substr(md5(CAST(PERMNO AS VARCHAR)), 1, 8) AS BIGINT) % 40 AS INTEGER) AS bucket FROM mapped",
)
def sink_hash_bucketed(i: Inputs) -> DataFrame:
    path = work_folder(i.spark, "buckets")
    sinks.write_bucketed(_mapped(i), path, "PERMNO", method="md5")
    return i.spark.read.parquet(path).select("id", "ticker", "PERMNO", "bucket")


@query("sink_parquet_zstd", "SELECT id, ticker, clean_text FROM clean_mentions")
def sink_parquet_zstd(i: Inputs) -> DataFrame:
    path = work_folder(i.spark, "clean")
    sinks.write_zstd(_clean_mentions(i).select("id", "ticker", "clean_text"), path)
    return i.spark.read.parquet(path)


@query("sink_model")
def sink_model(i: Inputs) -> DataFrame:
    """The last window's model, saved, read back and scored on that window's test year."""
    rows = written(_design(i), "design")
    fits = ridge.ridge_walk_forward(rows)
    model, test = ridge.last_window_model(rows, fits)
    path = work_folder(i.spark, "model")
    sinks.save_model(model, path)
    scored = aggregates.regression_metrics(LinearRegressionModel.load(path).transform(test))
    return scored.select("n", rounded("mse", 8).alias("mse"), rounded("r2").alias("r2"))


@query("sink_model_table")
def sink_model_table(i: Inputs) -> DataFrame:
    """The models of all windows, saved, read back, and each scored on the rows of its test year."""
    rows = written(_design(i), "design")
    path = work_folder(i.spark, "models")
    fits = ridge.ridge_walk_forward(rows)
    sinks.write_models(fits, path)
    scored = ridge.scored_rows(rows, i.spark.read.schema(fits.schema).parquet(path))
    out = aggregates.regression_metrics(scored, "y", by=("train_start",))
    return out.select("train_start", "n", rounded("mse", 8).alias("mse"), rounded("r2").alias("r2"))


# ------------------------------------------------------------- filters, projections


@query("standardize_posts", f"SELECT {POST_COLUMNS} FROM posts")
def standardize_posts(i: Inputs) -> DataFrame:
    return ndjson.standardize(i.raw_posts(), "post")


@query("standardize_comments", f"SELECT {POST_COLUMNS} FROM comments")
def standardize_comments(i: Inputs) -> DataFrame:
    return ndjson.standardize(i.raw_comments(), "comment")


@query("tag_is_comment", "SELECT id, true AS is_comment FROM comments")
def tag_is_comment(i: Inputs) -> DataFrame:
    return ndjson.tag_source(i.comments(), True).select("id", "is_comment")


@query("raw_text_concat", "SELECT id, concat_ws(' ', title, selftext) AS raw_text FROM texts")
def raw_text_concat(i: Inputs) -> DataFrame:
    return i.texts().select("id", tx.raw_text("title", "selftext").alias("raw_text"))


@query("filter_placeholder_text", f"SELECT id, selftext FROM texts WHERE {sql.has_real_text('selftext')}")
def filter_placeholder_text(i: Inputs) -> DataFrame:
    return cleaning.filter_placeholder_text(i.texts()).select("id", "selftext")


@query(
    "filter_mention_lifespan",
    "SELECT n.id, n.token, n.ticker FROM named n JOIN securities s ON n.ticker = s.ticker "
    "WHERE n.created_utc >= s.start_ts AND n.created_utc <= s.end_ts "
    "AND (length(n.ticker) >= 2 OR n.token LIKE '$%')",
)
def filter_mention_lifespan(i: Inputs) -> DataFrame:
    joined = mentions.join_securities(_named(i), i.securities())
    return joined.filter(mentions.within_life_span() & tx.plausible_token("token")).select("id", "token", "ticker")


HAR_COLUMNS = ("y_1", "vol_1", "vol_5", "vol_22", "vol_63")


@query(
    "drop_null_any",
    f"SELECT PERMNO, {DAY('date')} AS date, " + ", ".join(f"{R(c)} AS {c}" for c in HAR_COLUMNS)
    + " FROM panel_wide WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in HAR_COLUMNS),
)
def drop_null_any(i: Inputs) -> DataFrame:
    return panel_out(_har_rows(i))


@query("drop_null_subset", "SELECT upper(Ticker) AS ticker, SecInfoStartDt AS start FROM raw_securities WHERE Ticker IS NOT NULL")
def drop_null_subset(i: Inputs) -> DataFrame:
    return i.raw_securities().na.drop(subset=["Ticker"]).select(F.upper("Ticker").alias("ticker"), F.col("SecInfoStartDt").alias("start"))


@query(
    "filter_year_window",
    f"SELECT PERMNO, {DAY('date')} AS date, {R('vol_1')} AS vol_1 FROM panel_wide WHERE year(date) IN (1995, 1996, 1997, 1998)",
)
def filter_year_window(i: Inputs) -> DataFrame:
    return panel_out(i.panel().filter(dt.year_range("date", 1995, 1998)).select("PERMNO", "date", "vol_1"))


@query(
    "filter_date_range",
    f"SELECT PERMNO, {DAY('date')} AS date, {R('y_1')} AS y_1 FROM panel_wide "
    "WHERE date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'",
)
def filter_date_range(i: Inputs) -> DataFrame:
    first, last = (F.lit(d).cast("date") for d in ("1999-01-01", "1999-12-31"))
    return panel_out(i.panel().filter(F.col("date").between(first, last)).select("PERMNO", "date", "y_1"))


@query("prefix_columns", f"SELECT PERMNO AS c_PERMNO, {DAY('date')} AS c_date, {R('ret')} AS c_ret FROM ret_symbol")
def prefix_columns(i: Inputs) -> DataFrame:
    df = i.returns("symbol").select("PERMNO", day("date").alias("date"), rounded("ret").alias("ret"))
    return link.prefix_columns(df, "c")


@query(
    "project_rename",
    f"SELECT {DAY('c_date')} AS date, {R('c_vol_1')} AS vol_1, {R('c_y_1')} AS y_1 FROM linked WHERE c_date IS NOT NULL",
)
def project_rename(i: Inputs) -> DataFrame:
    return _linked(i).na.drop(subset=["c_date"]).select(
        day("c_date").alias("date"), rounded("c_vol_1").alias("vol_1"), rounded("c_y_1").alias("y_1")
    )


@query("drop_columns", "SELECT id, created_utc, subreddit FROM posts")
def drop_columns(i: Inputs) -> DataFrame:
    return i.posts().drop("title", "selftext")


# --------------------------------------------------------------------------- joins


@query(
    "join_lookup_broadcast",
    "SELECT n.id, n.token, n.ticker, coalesce(s.start_ts, -1) AS start_ts FROM named n JOIN securities s ON n.ticker = s.ticker",
)
def join_lookup_broadcast(i: Inputs) -> DataFrame:
    joined = mentions.join_securities(_named(i), i.securities())
    return joined.select("id", "token", "ticker", F.coalesce("start_ts", F.lit(-1)).alias("start_ts"))


@query(
    "join_validity_interval",
    "SELECT n.id, n.token, n.ticker FROM named n JOIN securities s "
    "ON n.ticker = s.ticker AND n.created_utc BETWEEN s.start_ts AND s.end_ts",
)
def join_validity_interval(i: Inputs) -> DataFrame:
    return mentions.join_validity_interval(_named(i), i.securities()).select("id", "token", "ticker")


EMBED_LEFT = (
    f"SELECT m.id, m.ticker, coalesce(len(e.embed), 0) AS dimensions, "
    f"coalesce({R('CAST(e.embed[1] AS DOUBLE)', 5)}, 0.0) AS first_value FROM mention_keys m LEFT JOIN emb e ON e.id = m.id"
)


@query("join_embed_left", EMBED_LEFT)
def join_embed_left(i: Inputs) -> DataFrame:
    joined = link.attach_embeddings(_mention_keys(i), i.embeddings(), on=("id",))
    return joined.select(
        "id", "ticker", F.when(F.col("embed").isNull(), 0).otherwise(F.size("embed")).cast("bigint").alias("dimensions"),
        F.coalesce(rounded(F.get("embed", F.lit(0)).cast("double"), 5), F.lit(0.0)).alias("first_value"),
    )


def _colocated(i: Inputs, df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    path = work_folder(i.spark, "colocated")
    return sinks.write_colocated(df, path.rsplit("/", 1)[1].replace("-", "_"), path, keys)


@query("join_embed_colocated", EMBED_LEFT)
def join_embed_colocated(i: Inputs) -> DataFrame:
    texts, vectors = _colocated(i, _mention_keys(i), ("id",)), _colocated(i, i.embeddings(), ("id",))
    joined = link.join_colocated(texts, vectors, ("id",), "left")
    return joined.select(
        "id", "ticker", F.when(F.col("embed").isNull(), 0).otherwise(F.size("embed")).cast("bigint").alias("dimensions"),
        F.coalesce(rounded(F.get("embed", F.lit(0)).cast("double"), 5), F.lit(0.0)).alias("first_value"),
    )


@query(
    "join_date_ticker_broadcast",
    f"SELECT k.id, k.ticker, {DAY(sql.day_of('k.created_utc'))} AS created_date, coalesce(t.PERMNO, -1) AS PERMNO "
    f"FROM mention_keys k LEFT JOIN ticker_map t ON t.DATE = {sql.day_of('k.created_utc')} AND t.TICKER = k.ticker",
)
def join_date_ticker_broadcast(i: Inputs) -> DataFrame:
    joined = link.attach_security(link.with_created_date(_mention_keys(i)), i.ticker_map(), keep_unmapped=True)
    return joined.select("id", "ticker", day("created_date").alias("created_date"), F.coalesce("PERMNO", F.lit(-1)).alias("PERMNO"))


LINKED_OUT = f"r_id, r_ticker, PERMNO, {DAY('c_date')} AS c_date, {R('c_vol_22')} AS c_vol_22, {R('c_y_1')} AS c_y_1"


@query("join_panel_inner", f"SELECT {LINKED_OUT} FROM linked")
def join_panel_inner(i: Inputs) -> DataFrame:
    return _linked_out(_linked(i))


@query("join_panel_colocated", f"SELECT {LINKED_OUT} FROM linked")
def join_panel_colocated(i: Inputs) -> DataFrame:
    keys = ("PERMNO", "day")
    texts = link.prefix_columns(_mapped(i), "r").withColumnsRenamed({"r_PERMNO": "PERMNO", "r_created_date": "day"})
    days = link.prefix_columns(i.panel("symbol"), "c").withColumnsRenamed({"c_PERMNO": "PERMNO"}).withColumn("day", F.col("c_date"))
    joined = link.join_colocated(_colocated(i, texts, keys), _colocated(i, days, keys), keys)
    return _linked_out(joined)


@query(
    "join_panel_full_outer",
    f"SELECT m.id AS r_id, m.ticker AS r_ticker, coalesce(m.PERMNO, p.PERMNO) AS PERMNO, {DAY('p.date')} AS c_date, "
    f"{R('p.vol_22')} AS c_vol_22, {R('p.y_1')} AS c_y_1 "
    "FROM mapped m FULL OUTER JOIN panel_symbol p ON p.PERMNO = m.PERMNO AND p.date = m.created_date",
)
def join_panel_full_outer(i: Inputs) -> DataFrame:
    return _linked_out(link.link_panel(_mapped(i), i.panel("symbol"), how="outer"))


@query("semi_join_ids", "SELECT id, subreddit FROM texts WHERE id IN (SELECT id FROM emb)")
def semi_join_ids(i: Inputs) -> DataFrame:
    return link.keep_ids(i.texts(), i.embeddings()).select("id", "subreddit")


# -------------------------------------------------------------------- aggregations


@query(
    "count_rows",
    "SELECT 'texts' AS stage, count(*) AS row_count FROM texts UNION ALL "
    "SELECT 'mentions', count(*) FROM mentions UNION ALL "
    "SELECT 'clean', count(*) FROM clean_mentions UNION ALL SELECT 'linked', count(*) FROM linked",
)
def count_rows(i: Inputs) -> DataFrame:
    accounts = accounting.Accounts(i.spark)
    pipelines.counted_stages(i.texts(), i.securities(), i.ticker_map(), i.panel("symbol"), accounts)
    counts = accounts.counts()
    keys, placeholder = counts["keys"]
    rows = [(name, counts[name][0]) for name in ("texts", "mentions", "linked")] + [("clean", keys - placeholder["placeholder"])]
    return i.spark.createDataFrame(rows, "stage string, row_count bigint")


# Every fiftieth post is a line that is no record.
BAD_POST = "(id LIKE 'p%' AND TRY_CAST(substr(id, 2) AS BIGINT) % 50 = 7)"


@query(
    "row_accounts",
    f"""
    , kept_keys AS (SELECT * FROM mention_keys WHERE NOT {BAD_POST}),
    kept_mapped AS (SELECT k.*, t.PERMNO FROM kept_keys k LEFT JOIN ticker_map t ON t.DATE = {sql.day_of('k.created_utc')} AND t.TICKER = k.ticker),
    kept_linked AS (
      SELECT m.id, p.date, p.y_1, p.vol_1, p.vol_5, p.vol_22, p.vol_63, e.embed
      FROM kept_mapped m LEFT JOIN panel_symbol p ON p.PERMNO = m.PERMNO AND p.date = {sql.day_of('m.created_utc')}
      LEFT JOIN emb e ON e.id = m.id WHERE m.PERMNO IS NOT NULL)
    SELECT 'texts' AS stage, 'malformed' AS reason, count(*) AS rows, count(*) FILTER ({BAD_POST}) AS dropped FROM texts UNION ALL
    SELECT 'mentions', 'unmapped_security', count(*), count(*) FILTER (PERMNO IS NULL) FROM kept_mapped UNION ALL
    SELECT 'linked', 'no_panel_row', count(*), count(*) FILTER (date IS NULL) FROM kept_linked UNION ALL
    SELECT 'design', 'null_vector', count(*), count(*) FILTER (embed IS NULL) FROM kept_linked WHERE date IS NOT NULL UNION ALL
    SELECT 'design', 'incomplete', count(*),
           count(*) FILTER (embed IS NOT NULL AND (y_1 IS NULL OR vol_1 IS NULL OR vol_5 IS NULL OR vol_22 IS NULL OR vol_63 IS NULL))
    FROM kept_linked WHERE date IS NOT NULL""",
)
def row_accounts(i: Inputs) -> DataFrame:
    raw = i.raw_posts()
    broken = F.expr("TRY_CAST(substr(id, 2) AS BIGINT) % 50 = 7")
    lines = raw.select(F.when(broken, F.concat(F.lit("no record: {"), "id")).otherwise(F.to_json(F.struct(*raw.columns))).alias("value"))
    posts = ndjson.standardize(ndjson.parse_records(lines, "post"), "post")
    accounts = accounting.Accounts(i.spark)
    texts = ndjson.union_posts_comments(posts, i.comments())
    pipelines.accounted_design(texts, i.securities(), i.ticker_map(), i.panel("symbol"), i.embeddings(), accounts)
    return accounts.frame()


@query("distinct_keys_sorted", "SELECT DISTINCT PERMNO FROM ret_wide ORDER BY PERMNO")
def distinct_keys_sorted(i: Inputs) -> DataFrame:
    return aggregates.distinct_keys_sorted(i.returns(), "PERMNO")


DAILY = f"SELECT {DAY('date')} AS date, " + ", ".join(
    f"{R(f'avg(vol_{w})')} AS v{w}" for w in (1, 5, 22, 63)
) + " FROM panel_wide WHERE date IS NOT NULL GROUP BY panel_wide.date"


@query("daily_mean_vol", DAILY)
def daily_mean_vol(i: Inputs) -> DataFrame:
    return _daily_out(panel.daily_mean_vol(i.panel()))


METRICS = (
    f"count(*) AS n, {R('avg((y - prediction) * (y - prediction))', 8)} AS mse, "
    f"{R('1 - sum((y - prediction) * (y - prediction)) / (var_pop(y) * count(*))')} AS r2"
)


@query("regression_metrics", f"SELECT CAST(g AS INTEGER) AS test_year, {METRICS} FROM har_pred GROUP BY g")
def regression_metrics(i: Inputs) -> DataFrame:
    rows = written(_har_rows(i), "har")
    scored = ols.predict(rows, ols.walk_forward(rows))
    out = aggregates.regression_metrics(scored, "y_1", by=("year",))
    return out.select(F.col("year").alias("test_year"), "n", rounded("mse", 8).alias("mse"), rounded("r2").alias("r2"))


WINDOW_METRICS = (
    "SELECT g, avg((y - prediction) * (y - prediction)) AS mse, count(*) AS n, "
    "1 - sum((y - prediction) * (y - prediction)) / (var_pop(y) * count(*)) AS r2 FROM har_pred GROUP BY g"
)


@query(
    "mean_window_metrics",
    f"SELECT count(*) AS windows, {R('avg(mse)', 8)} AS mse, {R('avg(r2)')} AS r2, "
    f"{R('sum(mse * n) / sum(n)', 8)} AS mse_by_row FROM ({WINDOW_METRICS})",
)
def mean_window_metrics(i: Inputs) -> DataFrame:
    out = aggregates.mean_window_metrics(ols.walk_forward(_har_rows(i)))
    return out.select("windows", rounded("mse", 8).alias("mse"), rounded("r2").alias("r2"), rounded("mse_by_row", 8).alias("mse_by_row"))


GUARD = """
    SELECT CAST(s AS INTEGER) AS train_start, CAST(s + {train} - 1 AS INTEGER) AS train_end,
           CAST(s + {offset} AS INTEGER) AS test_start,
           coalesce(sum(n) FILTER (WHERE yr BETWEEN s AND s + {train} - 1), 0)::BIGINT AS n_train,
           coalesce(sum(n) FILTER (WHERE yr = s + {offset}), 0)::BIGINT AS n_test,
           coalesce(sum(n) FILTER (WHERE yr BETWEEN s AND s + {train} - 1), 0) >= {rows}
             AND coalesce(sum(n) FILTER (WHERE yr = s + {offset}), 0) > 0
             AND (NOT {whole} OR count(*) FILTER (WHERE yr BETWEEN s AND s + {train} - 1) = {train}) AS usable
    FROM (SELECT yr, count(*) AS n FROM {source} GROUP BY yr) c
    JOIN (SELECT DISTINCT yr - k AS s FROM {source}, (SELECT unnest(range({train})) AS k UNION SELECT {offset}) o) w
      ON yr BETWEEN s AND s + {train} - 1 OR yr = s + {offset}
    GROUP BY s"""


def _guard_out(df: DataFrame) -> DataFrame:
    return df.select("train_start", "train_end", "test_start", "n_train", "n_test", "usable")


@query("window_row_guards", GUARD.format(train=4, offset=4, rows=1, whole="true", source="har_rows"))
def window_row_guards(i: Inputs) -> DataFrame:
    return _guard_out(windows.window_row_guards(_har_rows(i), windows.ROLLING_FOUR))


@query(
    "window_row_guards_ridge",
    GUARD.format(train=3, offset=4, rows=100, whole="false", source="(SELECT year(date) AS yr FROM design)"),
)
def window_row_guards_ridge(i: Inputs) -> DataFrame:
    return _guard_out(
        windows.window_row_guards(_design(i), windows.THREE_AND_GAP, all_train_years=False, min_train_rows=windows.MIN_TRAIN_ROWS)
    )


@query(
    "security_day_mean_embedding",
    f"SELECT PERMNO, {DAY('c_date')} AS date, CAST(dim AS INTEGER) AS dim, {R('avg(v)', 5)} AS mean_value FROM ("
    "SELECT PERMNO, c_date, unnest(range(len(r_embed))) AS dim, CAST(unnest(r_embed) AS DOUBLE) AS v FROM linked_vec "
    "WHERE r_embed IS NOT NULL) GROUP BY PERMNO, c_date, dim",
)
def security_day_mean_embedding(i: Inputs) -> DataFrame:
    mean = embed.security_day_mean(_linked_with_vectors(i), ("PERMNO", "c_date"), "r_embed")
    return mean.select("PERMNO", day("c_date").alias("date"), F.posexplode("r_embed").alias("dim", "v")).select(
        "PERMNO", "date", "dim", rounded("v", 5).alias("mean_value")
    )


TERMS = {"one": "1.0", "vol_1": "x1", "vol_5": "x2", "vol_22": "x3", "vol_63": "x4", "y_1": "y"}


@query(
    "gram_matrix",
    " UNION ALL ".join(
        f"SELECT CAST(yr AS INTEGER) AS year, '{a}' AS left_term, '{b}' AS right_term, {R(f'sum({TERMS[a]} * {TERMS[b]})', 4)} AS total "
        "FROM har_rows GROUP BY yr"
        for n, a in enumerate(TERMS)
        for b in list(TERMS)[n:]
    ),
)
def gram_matrix(i: Inputs) -> DataFrame:
    out = ols.gram_matrix(_har_rows(i), F.year("date").alias("year"))
    return out.select("year", "left_term", "right_term", rounded("total", 4).alias("total"))


@query(
    "gram_matrix_vectors",
    f"SELECT CAST(year AS INTEGER) AS year, fold, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {R('sum(a * b)', 4)} AS total FROM ("
    "SELECT year, fold, i, unnest(range(i, len(z))) AS j, unnest(z[i + 1:]) AS b, z[i + 1] AS a FROM ("
    "SELECT year(date) AS year, fold, list_concat(x, [y, 1.0]) AS z, unnest(range(len(x) + 2)) AS i FROM design)) "
    "GROUP BY year, fold, i, j",
)
def gram_matrix_vectors(i: Inputs) -> DataFrame:
    out = ridge.cross_products(written(_design(i), "design")).select("year", "fold", "i", F.posexplode("values").alias("k", "v"))
    return out.select("year", "fold", "i", (F.col("i") + F.col("k")).alias("j"), rounded("v", 4).alias("total"))


# ------------------------------------------------------------------------- windows


@query("rolling_realised_vol", f"SELECT {PANEL_OUT} FROM panel_wide")
def rolling_realised_vol(i: Inputs) -> DataFrame:
    return panel_out(i.panel())


@query("rolling_realised_vol_split", f"SELECT {PANEL_OUT} FROM panel_wide")
def rolling_realised_vol_split(i: Inputs) -> DataFrame:
    """The same panel by the plan for series too long for one task."""
    return panel_out(panel.volatility_panel(i.returns(), split=True, chunk_rows=128))


@query("lead_targets", f"SELECT PERMNO, {DAY('date')} AS date, {R('vol_1')} AS vol_1, {R('y_1')} AS y_1 FROM panel_symbol")
def lead_targets(i: Inputs) -> DataFrame:
    return panel_out(i.panel("symbol").select("PERMNO", "date", "vol_1", "y_1"))


BETA_FRAME = "ROWS BETWEEN 21 PRECEDING AND CURRENT ROW"
BETA = "covar_pop(vol_1, y_1) OVER w / nullif(var_pop(vol_1) OVER w, 0)"
BETA_DAILY = (
    f"SELECT {DAY('date')} AS date, {R('beta', 4)} AS beta FROM (SELECT date, {BETA} AS beta FROM "
    "(SELECT date, avg(vol_1) AS vol_1, avg(y_1) AS y_1 FROM panel_wide WHERE date IS NOT NULL GROUP BY date) "
    f"WINDOW w AS (ORDER BY date {BETA_FRAME}))"
)


@query("rolling_beta_daily", BETA_DAILY)
def rolling_beta_daily(i: Inputs) -> DataFrame:
    return panel.rolling_beta_daily(i.panel()).select(day("date").alias("date"), rounded("beta", 4).alias("beta"))


@query(
    "rolling_beta_by_security",
    f"SELECT PERMNO, {DAY('date')} AS date, {R('beta', 4)} AS beta FROM (SELECT PERMNO, date, {BETA} AS beta FROM panel_symbol "
    f"WHERE date IS NOT NULL WINDOW w AS (PARTITION BY PERMNO ORDER BY date {BETA_FRAME}))",
)
def rolling_beta_by_security(i: Inputs) -> DataFrame:
    out = panel.rolling_beta_by_security(i.panel("symbol"))
    return out.select("PERMNO", day("date").alias("date"), rounded("beta", 4).alias("beta"))


# ------------------------------------------------------------- sorts, limits, samples


@query("global_sort", f"SELECT PERMNO, {DAY('date')} AS date, {R('ret')} AS ret FROM ret_wide ORDER BY PERMNO, ret_wide.date")
def global_sort(i: Inputs) -> DataFrame:
    return i.returns().orderBy("PERMNO", "date").select("PERMNO", day("date").alias("date"), rounded("ret").alias("ret"))


def _sample_sql(n: int, seed: str, columns: str, source: str) -> str:
    return (
        f"SELECT PERMNO, {DAY('date')} AS date, {columns} FROM (SELECT * FROM {source} "
        f"ORDER BY md5(concat_ws('|', CAST(PERMNO AS VARCHAR), CAST(date AS VARCHAR), '{seed}')), PERMNO, date LIMIT {n})"
    )


@query("sample_topn_random", _sample_sql(20_000, "42", f"{R('ret')} AS ret", "ret_wide"))
def sample_topn_random(i: Inputs) -> DataFrame:
    return panel_out(sampling.sample_topn_random(i.returns(), ("PERMNO", "date"), 20_000))


@query(
    "scatter_sample",
    _sample_sql(5_000, "scatter", ", ".join(f"{R(c)} AS {c}" for c in diagnostics.SCATTER_COLUMNS), "panel_wide"),
)
def scatter_sample(i: Inputs) -> DataFrame:
    return panel_out(diagnostics.scatter_sample(i.panel(), ("PERMNO", "date")))


@query(
    "sample_bernoulli",
    f"SELECT PERMNO, {DAY('date')} AS date, {R('ret')} AS ret FROM ret_wide "
    f"WHERE {sql.md5_head('PERMNO', 'date', salt='2025')} < {int(0.2 * 2 ** 32)}",
)
def sample_bernoulli(i: Inputs) -> DataFrame:
    return panel_out(sampling.sample_bernoulli(i.returns(), ("PERMNO", "date"), 0.2))


@query("limit_n", "SELECT id, created_utc FROM texts ORDER BY created_utc, id LIMIT 20")
def limit_n(i: Inputs) -> DataFrame:
    return sampling.first_rows(i.texts().select("id", "created_utc"), ("created_utc", "id"), 20)


@query("union_posts_comments", "SELECT id, created_utc, subreddit, title, selftext, is_comment FROM texts")
def union_posts_comments(i: Inputs) -> DataFrame:
    return ndjson.union_posts_comments(i.posts(), i.comments())


# ---------------------------------------------------------------- scalars and arrays


@query(
    "extract_candidates",
    r"SELECT id, array_to_string(regexp_extract_all(concat_ws(' ', title, selftext), '\$?[A-Z]{1,5}\b'), ' ') AS candidates FROM texts",
)
def extract_candidates(i: Inputs) -> DataFrame:
    return mentions.extract_candidates(i.texts()).select("id", F.array_join("candidates", " ").alias("candidates"))


@query("explode_mentions", "SELECT id, is_comment, token FROM tokens_found")
def explode_mentions(i: Inputs) -> DataFrame:
    return mentions.explode_mentions(mentions.extract_candidates(i.texts())).select("id", "is_comment", "token")


@query("normalize_ticker", "SELECT id, token, ticker FROM named")
def normalize_ticker(i: Inputs) -> DataFrame:
    return _named(i).select("id", "token", "ticker")


@query("dollar_prefix_predicate", "SELECT id, token FROM named WHERE token LIKE '$%' OR length(ticker) >= 2")
def dollar_prefix_predicate(i: Inputs) -> DataFrame:
    return _named(i).filter(tx.has_dollar("token") | (F.length("ticker") >= 2)).select("id", "token")


@query("mine_mentions", f"SELECT {MENTION_OUT} FROM mentions")
def mine_mentions(i: Inputs) -> DataFrame:
    return mentions.mine_mentions(i.texts(), i.securities())


@query("mine_mentions_distinct", f"SELECT {MENTION_OUT} FROM mention_keys")
def mine_mentions_distinct(i: Inputs) -> DataFrame:
    return _mention_keys(i)


@query("strip_urls", r"SELECT id, regexp_replace(selftext, 'https?://\S+|www\.\S+', ' ', 'g') AS stripped FROM texts")
def strip_urls(i: Inputs) -> DataFrame:
    return i.texts().select("id", tx.strip_urls("selftext").alias("stripped"))


@query("strip_markdown", r"SELECT id, regexp_replace(selftext, '[*_`>~\[\]\(\)]', ' ', 'g') AS stripped FROM texts")
def strip_markdown(i: Inputs) -> DataFrame:
    return i.texts().select("id", tx.strip_markdown("selftext").alias("stripped"))


@query("collapse_space_lower_trim", r"SELECT id, trim(regexp_replace(lower(selftext), '\s+', ' ', 'g')) AS squeezed FROM texts")
def collapse_space_lower_trim(i: Inputs) -> DataFrame:
    return i.texts().select("id", tx.squeeze_space(F.lower("selftext")).alias("squeezed"))


@query(
    "clean_text",
    f"SELECT id, created_utc, subreddit, {sql.cleaned('selftext')} AS clean_text FROM texts WHERE {sql.has_real_text('selftext')}",
)
def clean_text(i: Inputs) -> DataFrame:
    return cleaning.clean_text(i.texts())


@query("clean_mentions", "SELECT id, created_utc, subreddit, ticker, clean_text FROM clean_mentions")
def clean_mentions(i: Inputs) -> DataFrame:
    return _clean_mentions(i)


@query(
    "parse_yyyymmdd_epoch",
    f"SELECT SecInfoStartDt AS start, coalesce({sql.epoch_of('SecInfoStartDt')}, -1) AS start_ts FROM raw_securities",
)
def parse_yyyymmdd_epoch(i: Inputs) -> DataFrame:
    return i.raw_securities().select(
        F.col("SecInfoStartDt").alias("start"), F.coalesce(dt.compact_date_epoch("SecInfoStartDt"), F.lit(-1)).alias("start_ts")
    )


@query("epoch_to_date", f"SELECT id, {DAY(sql.day_of('created_utc'))} AS created_date FROM texts")
def epoch_to_date(i: Inputs) -> DataFrame:
    return i.texts().select("id", day(dt.epoch_to_date("created_utc")).alias("created_date"))


@query("parse_date", "SELECT PERMNO, date AS text, CAST(CAST(strptime(date, '%Y%m%d') AS DATE) AS VARCHAR) AS date FROM raw_symbol")
def parse_date(i: Inputs) -> DataFrame:
    return i.raw_returns("symbol").select("PERMNO", F.col("date").alias("text"), day(dt.parse_compact_date("date")).alias("date"))


@query(
    "numeric_with_flags",
    "SELECT PERMNO, date, RET AS text, TRY_CAST(regexp_replace(RET, '^[A-Z]$', '') AS DOUBLE) AS number FROM raw_wide",
)
def numeric_with_flags(i: Inputs) -> DataFrame:
    return i.raw_returns().select("PERMNO", "date", F.col("RET").alias("text"), nm.numeric_with_flags("RET").alias("number"))


@query("coalesce_returns", f"SELECT PERMNO, {DAY('date')} AS date, ret FROM ret_wide")
def coalesce_returns(i: Inputs) -> DataFrame:
    return i.returns().select("PERMNO", day("date").alias("date"), "ret")


@query("square_sqrt", f"SELECT PERMNO, {DAY('date')} AS date, {R('ret * ret', 9)} AS ret_sq, {R('sqrt(ret * ret)')} AS size FROM ret_symbol")
def square_sqrt(i: Inputs) -> DataFrame:
    square = F.col("ret") * F.col("ret")
    return i.returns("symbol").select("PERMNO", day("date").alias("date"), rounded(square, 9).alias("ret_sq"), rounded(F.sqrt(square)).alias("size"))


@query("year_of_date", f"SELECT PERMNO, {DAY('date')} AS date, CAST(year(date) AS INTEGER) AS year FROM ret_symbol")
def year_of_date(i: Inputs) -> DataFrame:
    return i.returns("symbol").select("PERMNO", day("date").alias("date"), F.year("date").alias("year"))


@query(
    "hash_bucket",
    "SELECT DISTINCT PERMNO, CAST(CAST('0x' || substr(md5(CAST(PERMNO AS VARCHAR)), 1, 8) AS BIGINT) % 40 AS INTEGER) AS bucket FROM ret_wide",
)
def hash_bucket(i: Inputs) -> DataFrame:
    return i.returns().select("PERMNO").distinct().select("PERMNO", nm.hash_bucket("PERMNO", sinks.BUCKETS, "md5").alias("bucket"))


@query(
    "vector_from_array",
    f"SELECT id, len(embed) AS dimensions, {R('list_sum(CAST(embed AS DOUBLE[]))', 4)} AS total FROM emb WHERE embed IS NOT NULL",
)
def vector_from_array(i: Inputs) -> DataFrame:
    values = vector_to_array("embed_vec")
    return embed.vector_from_array(i.embeddings()).select("id", F.size(values).cast("bigint").alias("dimensions"), _total(values, 4).alias("total"))


# ---------------------------------------------------------------- tokens and vectors

HASHED_IDS = (
    "list_transform(list_filter(string_split(clean_text, ' '), lambda w: w <> '')[1:32], "
    "lambda w: CAST('0x' || substr(md5(w || '|'), 1, 8) AS BIGINT) % 30000 + 1)"
)
DIMENSIONS = embed.DIMENSIONS


@query(
    "tokenize_hashed",
    f"SELECT id, ticker, array_to_string(list_resize({HASHED_IDS}, 32, 0), ' ') AS input_ids, "
    f"array_to_string(list_resize(list_transform({HASHED_IDS}, lambda t: 1), 32, 0), ' ') AS attention_mask FROM clean_mentions",
)
def tokenize_hashed(i: Inputs) -> DataFrame:
    out = tokens.tokenize_hashed(_clean_mentions(i))
    return out.select("id", "ticker", *[F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("input_ids", "attention_mask")])


@query(
    "batch_embed",
    f"SELECT id, ticker, CAST(j AS INTEGER) AS dim, {R('CAST(CAST(CASE WHEN len(ids) = 0 THEN 0.0 ELSE list_sum(list_transform(ids, lambda t: (t * (7919 + 104729 * j)) % 10007)) / (len(ids) * 10007.0) - 0.5 END AS FLOAT) AS DOUBLE)', 5)} AS value "
    f"FROM (SELECT id, ticker, {HASHED_IDS} AS ids, unnest(range({DIMENSIONS})) AS j FROM clean_mentions)",
)
def batch_embed(i: Inputs) -> DataFrame:
    out = embed.batch_embed(tokens.tokenize_hashed(_clean_mentions(i)), dimensions=DIMENSIONS)
    return _values_out(out)


@query("round_robin_split", None)
def round_robin_split(i: Inputs) -> DataFrame:
    return _values_out(embed.batch_embed(tokens.tokenize_hashed(_clean_mentions(i)), dimensions=DIMENSIONS, tasks=8))


ORACLES["round_robin_split"] = ORACLES["batch_embed"]


def _values_out(out: DataFrame) -> DataFrame:
    return out.select("id", "ticker", F.posexplode("embed").alias("dim", "v")).select(
        "id", "ticker", "dim", rounded(F.col("v").cast("double"), 5).alias("value")
    )


# -------------------------------------------------------------------------- models


@query(
    "assemble_features",
    f"SELECT id, PERMNO, {DAY('date')} AS date, len(x) AS size, {R('list_sum(x)', 4)} AS total, {R('x[1]')} AS first_value FROM design",
)
def assemble_features(i: Inputs) -> DataFrame:
    vectors = _design(i).select(
        "id", "PERMNO", "date", *[F.col("x")[k].alias(c) for k, c in enumerate(ols.FEATURES)],
        array_to_vector(F.slice("x", 5, F.size("x") - 4)).alias("embed_vec"),
    )
    values = vector_to_array("features")
    out = ols.assemble_features(vectors, vector="embed_vec")
    return out.select(
        "id", "PERMNO", day("date").alias("date"), F.size(values).cast("bigint").alias("size"), _total(values, 4).alias("total"),
        rounded(values[0]).alias("first_value"),
    )


@query("ols_fit_predict", f"SELECT PERMNO, {DAY('date')} AS date, {R('prediction')} AS prediction FROM har_pred")
def ols_fit_predict(i: Inputs) -> DataFrame:
    rows = written(_har_rows(i), "har")
    return panel_out(ols.predict(rows, ols.walk_forward(rows)).select("PERMNO", "date", "prediction"))


@query(
    "har_walk_forward",
    "SELECT CAST(g - 4 AS INTEGER) AS train_start, CAST(g - 1 AS INTEGER) AS train_end, CAST(g AS INTEGER) AS test_start, "
    "CAST(g AS INTEGER) AS test_end, (SELECT count(*) FROM fit_rows f WHERE f.g = m.g) AS n_train, n AS n_test, "
    f"{R('mse', 8)} AS mse, {R('r2')} AS r2 FROM ({WINDOW_METRICS}) m",
)
def har_walk_forward(i: Inputs) -> DataFrame:
    fits = ols.walk_forward(_har_rows(i))
    return fits.select("train_start", "train_end", "test_start", "test_end", "n_train", "n_test", rounded("mse", 8).alias("mse"), rounded("r2").alias("r2"))


def _walk_sql(predictions: str) -> str:
    scores = WINDOW_METRICS.replace("har_pred", predictions)
    return (
        "SELECT CAST(g - 4 AS INTEGER) AS train_start, CAST(g AS INTEGER) AS test_start, (SELECT count(*) FROM fit_rows f WHERE f.g = m.g) AS n_train, "
        f"n AS n_test, {R('mse', 8)} AS mse, {R('r2')} AS r2 FROM ({scores}) m"
    )


def _walk_out(fits: DataFrame) -> DataFrame:
    return fits.select("train_start", "test_start", "n_train", "n_test", rounded("mse", 8).alias("mse"), rounded("r2").alias("r2"))


@query(
    "winsor_bounds",
    " UNION ALL ".join(
        f"SELECT CAST(g - 4 AS INTEGER) AS train_start, '{name}' AS metric, {R(f'quantile_disc({x}, 0.01)')} AS low, {R(f'quantile_disc({x}, 0.99)')} AS high FROM fit_rows GROUP BY g"
        for name, x in zip((*ols.FEATURES, ols.LABEL), ("x1", "x2", "x3", "x4", "y"), strict=True)
    ),
)
def winsor_bounds(i: Inputs) -> DataFrame:
    rows = written(_har_rows(i), "har")
    usable = windows.window_row_guards(rows, windows.ROLLING_FOUR).where("usable")
    return ols.winsor_bounds(rows).join(usable, "train_start", "left_semi").select("train_start", "metric", rounded("low").alias("low"), rounded("high").alias("high"))


@query("har_walk_forward_winsorised", _walk_sql("win_pred"))
def har_walk_forward_winsorised(i: Inputs) -> DataFrame:
    return _walk_out(ols.winsorised_walk_forward(written(_har_rows(i), "har")))


@query("har_walk_forward_log", _walk_sql("log_pred"))
def har_walk_forward_log(i: Inputs) -> DataFrame:
    return _walk_out(ols.walk_forward(ols.log_rows(_har_rows(i))))


@query(
    "har_pooled_refit",
    f"SELECT (SELECT CAST(min(test_year) AS INTEGER) FROM har_windows) AS first_year, {METRICS} FROM pooled_pred",
)
def har_pooled_refit(i: Inputs) -> DataFrame:
    out = ols.pooled_refit(_har_rows(i), shift=0)
    return out.select("first_year", "n", rounded("mse", 8).alias("mse"), rounded("r2").alias("r2"))


@query("har_pooled_oos", f"SELECT {METRICS} FROM har_pred")
def har_pooled_oos(i: Inputs) -> DataFrame:
    out = ols.pooled_out_of_sample(ols.walk_forward(_har_rows(i)))
    return out.select("n", rounded("mse", 8).alias("mse"), rounded("r2").alias("r2"))


@query("ridge_cv")
def ridge_cv(i: Inputs) -> DataFrame:
    return ridge.cv_scores(_ridge(i))


@query("ridge_cv_spark_ml")
def ridge_cv_spark_ml(i: Inputs) -> DataFrame:
    """The library's own cross-validation over all rows, for comparison."""
    rows = ridge.ml_rows(written(_design(i), "design"))
    errors = ridge.ridge_cv(rows).avgMetrics
    return i.spark.createDataFrame(list(zip(ridge.PENALTIES, map(float, errors))), "penalty double, cv_mse double")


@query("ridge_walk_forward")
def ridge_walk_forward(i: Inputs) -> DataFrame:
    return _ridge(i).select(
        "train_start", "train_end", "test_start", "test_end", "n_train", "n_test", "usable", "best_lambda", rounded("mse", 8).alias("mse"), rounded("r2").alias("r2")
    )


@query("mean_window_metrics_ridge")
def mean_window_metrics_ridge(i: Inputs) -> DataFrame:
    out = ridge.mean_metrics(_ridge(i))
    return out.select("windows", rounded("mse", 8).alias("mse"), rounded("r2").alias("r2"), rounded("mse_by_row", 8).alias("mse_by_row"))


@query("ridge_walk_forward_security_day")
def ridge_walk_forward_security_day(i: Inputs) -> DataFrame:
    rows = ridge.design_rows(_linked_with_vectors(i), grain="security_day")
    return ridge.ridge_walk_forward(rows).select("train_start", "n_train", "n_test", "usable", "best_lambda", rounded("mse", 8).alias("mse"))


@query("elastic_net_walk_forward")
def elastic_net_walk_forward(i: Inputs) -> DataFrame:
    """Half of the penalty on absolute values; how many slopes stay is part of the result."""
    fits = ridge.ridge_walk_forward(_design(i), alpha=0.5)
    kept = F.size(F.filter("coefficients", lambda c: c != 0))
    return fits.select(
        "train_start", "train_end", "test_start", "test_end", "n_train", "n_test", "usable", "best_lambda",
        F.when(F.col("usable"), kept).alias("n_kept"), rounded("mse", 8).alias("mse"), rounded("r2").alias("r2"),
    )


@query("best_lambda")
def best_lambda(i: Inputs) -> DataFrame:
    return ridge.best_lambda(_ridge(i))


@query("text_to_forecast")
def text_to_forecast(i: Inputs) -> DataFrame:
    out = pipelines.text_to_forecast(i.texts(), i.securities(), i.ticker_map(), i.panel("symbol"))
    return out.select("train_start", "train_end", "test_start", "test_end", "n_train", "n_test", "usable", "best_lambda", rounded("mse", 8).alias("mse"), rounded("r2").alias("r2"))


# -------------------------------------------------------------------- diagnostics


@query("fig_vol_timeseries", DAILY)
def fig_vol_timeseries(i: Inputs) -> DataFrame:
    return _daily_out(diagnostics.fig_vol_timeseries(i.panel()).orderBy("date"))


def _density_sql(columns, bins: int) -> str:
    spans = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in columns)
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS metric, CAST(least(coalesce(floor(({c} - lo_{c}) / nullif((hi_{c} - lo_{c}) / {bins}, 0)), 0), {bins - 1}) AS INTEGER) AS bin, "
        f"lo_{c} AS lo, hi_{c} AS hi FROM panel_wide, (SELECT {spans} FROM panel_wide) WHERE {c} IS NOT NULL"
        for c in columns
    )
    return f"SELECT metric, bin, count(*) AS row_count, {R(f'min(lo) + bin * (min(hi) - min(lo)) / {bins}')} AS bin_start FROM ({parts}) GROUP BY metric, bin"


@query("fig_scatter_density", _density_sql(diagnostics.SCATTER_COLUMNS, 50))
def fig_scatter_density(i: Inputs) -> DataFrame:
    return diagnostics.density(written(i.panel().select(*diagnostics.SCATTER_COLUMNS), "panel")).select("metric", "bin", "row_count", rounded("bin_start").alias("bin_start"))


def _kernel_sql(columns, points: int, cells: int, reach: int) -> str:
    spans = " UNION ALL ".join(
        f"SELECT '{c}' AS metric, count({c}) AS n, min({c}) AS lo, max({c}) AS hi, stddev_samp({c}) / pow(count({c}), 0.2) AS width FROM panel_wide" for c in columns
    )
    values = " UNION ALL ".join(f"SELECT '{c}' AS metric, {c} AS value FROM panel_wide WHERE {c} IS NOT NULL" for c in columns)
    return f"""
    , spans AS (SELECT * FROM ({spans}) WHERE width > 0),
    placed AS (SELECT metric, (value - lo) / (width / {cells}) AS place FROM ({values}) JOIN spans USING (metric)),
    grid AS (
      SELECT metric, cell, sum(weight) AS weight FROM (
        SELECT metric, floor(place) AS cell, 1 - (place - floor(place)) AS weight FROM placed UNION ALL
        SELECT metric, floor(place) + 1, place - floor(place) FROM placed) GROUP BY metric, cell),
    points AS (SELECT *, lo + point * ((hi - lo) / {points - 1}) AS x FROM spans, (SELECT unnest(range({points})) AS point))
    SELECT metric, CAST(point AS INTEGER) AS point, {R('min(x)')} AS x,
           {R(f"coalesce(sum(CASE WHEN cell BETWEEN floor((x - lo) / (width / {cells})) - {reach * cells} AND floor((x - lo) / (width / {cells})) + {reach * cells} + 1 "
              f"THEN weight * exp(-0.5 * pow((x - (lo + cell * (width / {cells}))) / width, 2)) END), 0) / (min(n) * min(width) * sqrt(2 * pi()))", 4)} AS density
    FROM points JOIN grid USING (metric) GROUP BY metric, point"""


@query("fig_scatter_kde", _kernel_sql(diagnostics.SCATTER_COLUMNS, diagnostics.DENSITY_POINTS, diagnostics.CELLS_PER_BANDWIDTH, diagnostics.KERNEL_REACH))
def fig_scatter_kde(i: Inputs) -> DataFrame:
    rows = written(i.panel().select(*diagnostics.SCATTER_COLUMNS), "panel")
    out = diagnostics.kernel_density(rows)
    return out.select("metric", "point", rounded("x").alias("x"), rounded("density", 4).alias("density"))


@query(
    "fig_scatter_correlation",
    " UNION ALL ".join(
        f"SELECT '{a}' AS left_metric, '{b}' AS right_metric, {R(f'corr({a}, {b})')} AS corr FROM panel_wide"
        for n, a in enumerate(diagnostics.SCATTER_COLUMNS)
        for b in diagnostics.SCATTER_COLUMNS[n + 1:]
    ),
)
def fig_scatter_correlation(i: Inputs) -> DataFrame:
    return diagnostics.correlations(i.panel()).select("left_metric", "right_metric", rounded("corr").alias("corr"))


@query("fig_beta_rolling", BETA_DAILY)
def fig_beta_rolling(i: Inputs) -> DataFrame:
    return diagnostics.fig_beta_rolling(i.panel()).select(day("date").alias("date"), rounded("beta", 4).alias("beta"))


@query(
    "mentions_on_panel",
    f"SELECT r_id, r_ticker, PERMNO, {DAY('c_date')} AS c_date, {R('c_vol_1')} AS c_vol_1, {R('c_vol_63')} AS c_vol_63, {R('c_y_1')} AS c_y_1 FROM linked",
)
def mentions_on_panel(i: Inputs) -> DataFrame:
    return _linked(i).select("r_id", "r_ticker", "PERMNO", day("c_date").alias("c_date"), *[rounded(c).alias(c) for c in ("c_vol_1", "c_vol_63", "c_y_1")])


# ------------------------------------------------------------------- shared pieces
# Queries that pass over a derived frame more than once store it first.


def _named(i: Inputs) -> DataFrame:
    return mentions.with_ticker(mentions.explode_mentions(mentions.extract_candidates(i.texts())))


def _mention_keys(i: Inputs) -> DataFrame:
    return mentions.mine_mentions(i.texts(), i.securities(), distinct=True)


def _clean_mentions(i: Inputs) -> DataFrame:
    return pipelines.clean_mentions(i.texts(), i.securities())


def _mapped(i: Inputs) -> DataFrame:
    return link.attach_security(link.with_created_date(_mention_keys(i)), i.ticker_map())


def _linked(i: Inputs) -> DataFrame:
    return pipelines.mentions_on_panel(i.texts(), i.securities(), i.ticker_map(), i.panel("symbol"))


def _linked_out(df: DataFrame) -> DataFrame:
    return df.select("r_id", "r_ticker", "PERMNO", day("c_date").alias("c_date"), rounded("c_vol_22").alias("c_vol_22"), rounded("c_y_1").alias("c_y_1"))


def _linked_with_vectors(i: Inputs) -> DataFrame:
    return pipelines.linked_with_vectors(i.texts(), i.securities(), i.ticker_map(), i.panel("symbol"), i.embeddings())


def _design(i: Inputs) -> DataFrame:
    return ridge.design_rows(_linked_with_vectors(i))


def _ridge(i: Inputs) -> DataFrame:
    return ridge.ridge_walk_forward(_design(i))


def _har_rows(i: Inputs) -> DataFrame:
    return ols.complete_rows(i.panel())


def _daily_out(df: DataFrame) -> DataFrame:
    return df.select(day("date").alias("date"), *[rounded(c).alias(c) for c in ("v1", "v5", "v22", "v63")])


def _total(values: Column, digits: int) -> Column:
    return rounded(F.aggregate(values, F.lit(0.0), lambda a, b: a + b), digits)
