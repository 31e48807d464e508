"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvigil.session import stage


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``a, b``: the smallest node that it is connected with.

    Alternates large and small stars: neighbours above a node are hung under the smallest neighbour, then the
    neighbours below it likewise, until nothing changes. A round only regroups links, their number never grows, and the rounds
    grow with the logarithm of the longest path. Every round is written to the shared folder.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(low, "u")
        if large:
            hung = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            hung = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return hung.where("a <> b").distinct()

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = stage(links.select("a", "b").where("a <> b").distinct(), "links")
    before = None
    while True:
        edges = stage(star(star(edges, large=True), large=False), "stars")
        now = mark(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
