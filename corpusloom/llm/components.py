"""Connected components of an edge table by alternating stars.

Every round hangs the neighbours of a node onto its smallest neighbour, first
the larger ones, then the smaller ones, until nothing moves: about log2(n)
rounds of one aggregate and one join each.  No neighbourhood is collected, and
each round is written to the shared folder, so lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialise


def _hang(edges: DataFrame) -> DataFrame:
    """``(u, v)``: every v onto the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    least = least.select("u", F.least("u", "least").alias("m"))
    return edges.join(least, "u")


def connected(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``(u, v)``; component is the least node.

    Edges may be repeated, in any direction; a null end or a loop is ignored.
    """
    once = edges.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).where("u <> v AND v IS NOT NULL")
    # each edge points from the larger end to the smaller one
    now = materialise(once.distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hang(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u <> v").distinct(), "edges")
        hung = _hang(large)
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            hung.select("u", F.col("m").alias("v"))
        )
        now = materialise(small.where("u <> v").distinct(), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
