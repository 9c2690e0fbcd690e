"""Connected components of a link table, on Spark: alternating large and small stars until they settle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b), a > b, each once. Every node's smaller or larger neighbours are linked to the least node next to it.

    The least neighbour is an aggregate joined back to the links, so that a node with very many links is never gathered.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = edges.join(least, edges["b"] == least["u"]).select("a", F.col("m").alias("b"))  # larger neighbours of u go to m
    else:
        least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        out = edges.join(least, edges["a"] == least["u"]).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component), the component being its least node, for every node of links (a, b, of one ordered type)."""
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    digest = lambda df: df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")).alias("s")).first()
    before = digest(edges)
    while before["n"]:
        edges = stored(_star(_star(edges, large=True), large=False), name)
        now = digest(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
