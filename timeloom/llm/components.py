"""Connected components of a table of links, by alternating stars, with every round kept in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """Rows (node, root) for every node of a link, root the smallest node reachable. links: a, b of one orderable type.

    A round is a large star (neighbours above a node join its least neighbour) and a small star (neighbours below it join the
    least of them). Minima are partial sums; what is joined back is split by adaptive execution where a node is hot.
    """
    edges = cut(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _digest(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select("a", F.col("m").alias("b")).union(small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        edges = cut(small)
        now = _digest(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
