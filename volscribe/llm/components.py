"""Connected components of links, by alternating large and small stars on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from volscribe.session import written


def components(links: DataFrame) -> DataFrame:
    """node, root: each node of ``links`` (a, b) with the smallest node it is connected to.

    Each turn links every node's neighbours to the smallest of them. Its neighbours are
    never gathered: the smallest is an aggregate, which then joins the links, and Spark
    splits nodes with many. The turns grow with the logarithm of the longest chain;
    each is written to the shared folder.
    """
    edges, before = written(_tidy(links.select("a", "b")), "links"), None
    while True:
        large = _star(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), above=True)
        after = written(_tidy(_star(_tidy(large), above=False)), "links")
        now = after.agg(F.count("*"), F.sum(F.hash("a", "b")), F.bit_xor(F.xxhash64("a", "b"))).first()
        edges = after
        if now == before:
            break
        before = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _tidy(links: DataFrame) -> DataFrame:
    """Each link once, from its larger to its smaller end."""
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _star(edges: DataFrame, above: bool) -> DataFrame:
    """Link what stands in ``b`` beside a node to the smallest of the node and its neighbours.

    ``above``: only neighbours larger than the node; else all of the given ones and the node itself.
    """
    least = edges.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    joined = edges.join(least, "a")
    out = joined.where("b > a") if above else joined
    out = out.select(F.col("b").alias("a"), F.col("low").alias("b"))
    return out if above else out.unionByName(least.select("a", F.col("low").alias("b")))
