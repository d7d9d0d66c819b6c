"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from localexplain.llm.common import forget, settled


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node that has a link: root is the smallest node it reaches; roots themselves are left out.

    links is (u, v), any order, repeats and loops allowed. Each round hangs all larger neighbours under the smallest
    one, then all smaller ones; the number of rounds grows with the logarithm of the nodes. Minima are taken by partial
    aggregation and joined back, so a node with very many neighbours is never one group. Rounds are written to the
    shared folder, where they survive lost executors.
    """
    u, v = F.col("u"), F.col("v")
    edges = settled(links.filter(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), name)
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        smallest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter(v > u).join(smallest, "u").select(v.alias("u"), F.col("m").alias("v"))
        large = large.unionByName(edges.join(smallest, "u").select("u", F.col("m").alias("v"))).filter(u != v).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.select(v.alias("u"), F.col("m").alias("v")))
        new = settled(small.filter(u != v).distinct(), name)
        before, mark = mark, _mark(new)
        forget(edges)
        edges = new
        if mark == before:
            break
    return edges.select(u.alias("node"), v.alias("root"))
