"""Connected components of an edge table by alternating star contractions.

Every round is two joins and two partial aggregations keyed by node, so no node's
neighbour list is ever gathered; a hub's rows can be split by the skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import written


def _star(pairs: DataFrame, keep: Column) -> DataFrame:
    """``pairs(u, v)`` lists v as neighbour of u; link the kept v to the least neighbour of u."""
    least = pairs.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return (
        pairs.join(least, "u")
        .where(keep)
        .select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        .where("u <> v")
        .distinct()
    )


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of long node ids -> ``(node, component)``, component = least node reachable.

    Only nodes that occur in an edge between different nodes are returned. Null ends are
    ignored; repeated and reversed edges count once. No edges give an empty table.
    """
    edges = written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("a is not null and b is not null and a <> b")
        .distinct(),
        "edges",
    )
    before = _signature(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(_star(both, F.col("v") > F.col("u")), "large")
        # small star: neighbours not above u, and u itself, go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        after = _signature(edges)
        if after == before:
            break
        before = after
    own = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return own.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
