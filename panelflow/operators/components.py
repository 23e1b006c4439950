"""Connected components by alternating large-star / small-star contraction.

After Kiveris et al., "Connected Components in MapReduce and Beyond" (2014):
every round only groups edges by an end point and joins the minimum back, so no
neighbourhood is ever gathered, and the number of rounds grows with the
logarithm of the graph, not with its diameter. What is joined is kept while a
round lasts: it is computed once, and adaptive execution can split the edges of
a hub. Each round's edges are written, which ends its lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.session import discard, files_for, materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("g", "u", "v").unionByName(
        edges.select("g", F.col("v").alias("u"), F.col("u").alias("v"))
    )


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    around = _both_ways(edges)
    lowest = around.groupBy("g", "u").agg(F.least(F.min("v"), F.col("u")).alias("m")).persist()
    return around.filter("v > u").join(lowest, ["g", "u"]).select("g", F.col("v").alias("u"), F.col("m").alias("v")).persist(), lowest


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    down = edges.select("g", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = down.groupBy("g", "u").agg(F.min("v").alias("m")).persist()
    linked = down.join(lowest, ["g", "u"]).filter("v <> m").select("g", F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(lowest.select("g", "u", F.col("m").alias("v"))).distinct(), lowest


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("g", "u", "v"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(g, u, v) edges -> (g, node, component): the least node reachable inside group ``g``.

    Nodes without an edge do not appear; they are their own component.
    """
    current = materialize(edges.filter("u <> v").distinct(), "edges")
    seen, before = _fingerprint(current), None
    while seen != before:
        stars, above = _large_star(current)
        smaller, below = _small_star(stars)
        following = materialize(smaller.coalesce(files_for(2 * seen[0])), "edges")
        for kept in (below, stars, above):
            kept.unpersist()
        discard(current)
        current, before = following, seen
        seen = _fingerprint(current)
    members = current.select("g", F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select("g", F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)
