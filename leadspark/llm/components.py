"""Connected components of a table of edges by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.session import stage


def _least(both: DataFrame, name: str) -> DataFrame:
    """Per vertex ``u`` the least of itself and its neighbours ``v``, as a written table.

    Written, so that the join that follows shuffles both sides from scans and adaptive execution may split a hub.
    """
    return stage(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), name)


def _stars(edges: DataFrame) -> bool:
    """Whether no vertex has an edge down to two others, or one down and one up."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("down")))).alias("e"))
    each = ends.groupBy("e.x").agg(F.sum("e.down").alias("downs"), F.count("*").alias("n"))
    return each.where("downs > 1 OR (downs = 1 AND n > 1)").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component) for every vertex with an edge; the component is its least vertex.

    Vertices are longs. Nulls, loops and repeated edges are allowed and add nothing. Each half step is written to the
    shared folder; nothing is gathered. Large-star hangs every larger neighbour on the least one, small-star every
    smaller one; the number of rounds grows with the logarithm of the longest chain. Rounds end once every vertex is
    either a centre or hangs on exactly one. An empty table gives none.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    edges = stage(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(u.isNotNull() & v.isNotNull() & (u != v)).distinct(), "edges")
    while not _stars(edges):
        # large star: both directions, larger neighbours go to the least one
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(_least(both, "large"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large-star")
        # small star: u > v in every row; smaller neighbours and u itself go to the least one
        joined = large.join(_least(large, "small"), "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(joined.select("u", F.col("m").alias("v"))).distinct()
        edges = stage(small, "small-star")
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
