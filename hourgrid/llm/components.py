"""Connected components of a graph that is too large for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.sources.scratch import store


def _lowest(edges: DataFrame) -> DataFrame:
    """The smallest node among each node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the node's lowest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    moved = both.where("b > a").join(_lowest(edges), "a")
    return moved.select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the lowest of them; edges run from large to small."""
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    moved = edges.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
    return moved.unionByName(low.select("a", F.col("low").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, low): the smallest node of the component, for every node of the links (a, b).

    Alternating large and small stars until nothing changes; each round's links are stored. Nodes may be of any
    ordered type. Only counts come to the driver. Loops and repeated links are allowed; nodes without a link
    to another one do not appear.
    """
    edges = store(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark(edges)
    while before[0]:
        edges = store(_small_star(_large_star(edges)), "links")
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("low")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("low"))
    ).distinct()
