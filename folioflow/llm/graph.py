"""Connected components of a table of links, in logarithmically many rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long); the root is the component's smallest node.

    Large-star and small-star rounds: each node hooks its neighbours to the smallest one it knows,
    until the links no longer change. Minima are combined before the shuffle, so a node with very many
    neighbours costs one row per task; the join back is an ordinary one that Spark may split.
    Every round is written, so a lost executor costs a re-read. No links give no rows.
    """
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    edges = written(links.filter("a <> b").select(hi.alias("a"), lo.alias("b")).distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.groupBy("a").agg(F.min("b").alias("root"))
    return roots.select(F.col("a").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
