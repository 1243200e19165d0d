"""The registered queries of this subpackage, over the whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from volscribe.llm import (
    decontaminate,
    exact_dedup,
    fingerprint,
    language,
    line_dedup,
    mixing,
    order_minhash,
    packing,
    prefix_trie,
    ranked_search,
    substring_dedup,
    suffix_dedup,
    url_filter,
)
from volscribe.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build):
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


URL_RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
)

# The longest rule in characters is also the one with the most labels here.
OP1_SQL = """
WITH rests AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rests),
rules(verdict, rule, rule_host, rule_path) AS (VALUES
  ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
  ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
fits AS (
  SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
  FROM parts JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
"""


@query("op1_url_filter", OP1_SQL)
def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, folder, "pages"), URL_RULES, default="allow")


OP2_SQL = r"""
WITH texts AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS plain FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(plain) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY plain)
"""


@query("op2_exact_dedup", OP2_SQL)
def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    # Rows that repeat a document are one group's member each.
    groups = exact_dedup.exact_groups(table(spark, folder, "documents"))
    return groups.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("times")


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    removed = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    return removed.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op4_near_dedup")
def op4_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.near_classes(table(spark, folder, "documents"))


@query("op5_fingerprints")
def op5_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.edited_neighbours(table(spark, folder, "documents"))


@query("op6_substring_dedup")
def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.dedup_units(table(spark, folder, "documents"))


@query("op7_packing")
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op8_mixing")
def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op9_line_dedup")
def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    # Every later copy of a repeated run goes, also where the run is one line.
    return line_dedup.dedup_lines(table(spark, folder, "documents"), min_lines=1)


@query("op10_language_id")
def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


OP11_SQL = r"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
item AS (
  SELECT item_id, row_number() OVER () AS q,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
total AS (SELECT CAST(count(*) FILTER (len(terms) > 0) AS BIGINT) AS docs, CAST(sum(len(terms)) AS BIGINT) AS all_terms FROM doc),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM doc) WHERE term IN (SELECT term FROM item) GROUP BY r, term),
weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, total GROUP BY term),
impact AS (
  SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * len(terms) * docs) // all_terms))) AS part
  FROM tf JOIN weight USING (term) JOIN doc USING (r), total),
score AS (SELECT q, any_value(item_id) AS item_id, r, CAST(sum(part) AS BIGINT) AS score FROM item JOIN impact USING (term) GROUP BY q, r),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
  FROM score JOIN doc USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


@query("op11_ranked_search", OP11_SQL)
def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


# The table has the remainders of single bytes, as CRC-32 with the reversed polynomial 0xEDB88320 defines them.
OP12_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, turn
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS i FROM turns),
convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS source,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda b: CAST(ascii(b) AS BIGINT))),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc),
parts AS (
  SELECT convs.conv_id, 0 AS part, i, digest, text FROM convs JOIN placed ON placed.conv_id = source AND i <= h
  UNION ALL
  SELECT convs.conv_id, 1 AS part, i, digest, text FROM convs JOIN placed USING (conv_id) WHERE i > h),
rebuilt AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS d, digest, strlen(text) AS bytes FROM parts),
path AS (
  SELECT conv_id, d, sha256(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY d)) AS node, bytes FROM rebuilt
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
nodes AS (SELECT d, node, min(conv_id) AS own, count(*) AS n, any_value(bytes) AS bytes FROM path GROUP BY d, node),
parents AS (
  SELECT nodes.d, nodes.node, up.node AS up, parent.own AS parent_own
  FROM nodes JOIN path up ON up.conv_id = nodes.own AND up.d = nodes.d - 1 JOIN nodes parent ON parent.node = up.node AND parent.d = up.d),
children AS (SELECT up AS node, count(*) AS n_children FROM parents GROUP BY up),
below AS (
  SELECT path.node, path.d, sum((x.n - 1) * x.bytes) AS saved, count(*) FILTER (children.node IS NULL) AS n_leaves
  FROM nodes x JOIN path ON path.conv_id = x.own AND path.d <= x.d LEFT JOIN children ON children.node = x.node GROUP BY path.node, path.d),
ends AS (
  SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
  FROM path JOIN (SELECT conv_id, max(d) AS d FROM path GROUP BY conv_id) USING (conv_id, d) GROUP BY node)
SELECT own AS conv_id, CAST(nodes.d AS BIGINT) AS depth, parent_own AS parent_conv_id, n AS n_convs, coalesce(n_children, 0) AS n_children,
       n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes JOIN below USING (d, node) LEFT JOIN parents USING (d, node) LEFT JOIN children USING (node) LEFT JOIN ends USING (node)
"""


@query("op12_prefix_trie", OP12_SQL)
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_nodes(table(spark, folder, "conversations"))


# Every document word at the end of an occurrence of a window, of each length that windows have, then the words it covers.
OP13_SQL = r"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
item AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
item_at AS (
  SELECT item_id, words, least(len(words), 10) AS n, unnest(range(1, greatest(len(words) - 10, 0) + 2)) AS k FROM item WHERE len(words) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(words[k : k + n - 1], ' ') AS win FROM item_at),
doc_at AS (
  SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS k FROM doc, (SELECT DISTINCT n FROM win) WHERE len(words) >= n),
occurrence AS (
  SELECT r, k, n, item_id FROM (SELECT r, k, n, array_to_string(words[k : k + n - 1], ' ') AS win FROM doc_at) JOIN win USING (n, win)),
hit AS (SELECT r, count(DISTINCT w) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS w FROM occurrence) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM occurrence WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""


@query("op13_decontaminate", OP13_SQL)
def op13_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    hit = found.select("doc_id", "n_words", decontaminate.hit_words().alias("n_hit"), "items")
    ids = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return hit.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
