"""Connected components by randomised contraction, in DataFrame operations only.

Every round gives each node a pseudo-random priority, points it at the neighbour (or itself) of least priority, and
contracts the edges along the pointers. A star vanishes in one round and a path shrinks by a constant share, so the number of
rounds is logarithmic. All state is in tables: nothing is gathered on the driver or in one task; hot nodes are pre-aggregated
before the shuffle (min) or split by adaptive execution (joins).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.llm.common import cut, drop


def connected_components(edges: DataFrame) -> DataFrame:
    """(src long, dst long) -> (node, root), one row for each node that has an edge to another one.

    Nulls and self-loops are ignored; repeated and reversed edges count once. No edges give an empty result.
    """
    edges = cut(edges.select("src", "dst").where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "edges")
    first, pointers, turn = edges, [], 0
    while turn == 0 or not edges.isEmpty():
        turn += 1
        ranked = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("p"), F.col(c).alias("v"))
        both = edges.select("src", "dst").union(edges.select("dst", "src"))
        best = both.groupBy("src").agg(F.min(ranked("dst")).alias("best"))
        step = cut(best.select(F.col("src").alias("node"), F.least(F.col("best"), ranked("src"))["v"].alias("to")), "pointers")
        pointers.append(step)
        moved = edges.join(step.select(F.col("node").alias("src"), F.col("to").alias("a")), "src").join(step.select(F.col("node").alias("dst"), F.col("to").alias("b")), "dst")
        moved = cut(moved.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "edges")
        drop(edges)
        edges = moved
    roots = pointers.pop()
    roots = roots.select("node", F.col("to").alias("root"))
    while pointers:
        step = pointers.pop()
        known = roots.select(F.col("node").alias("to"), F.col("root").alias("further"))
        roots = step.join(known, "to", "left").select("node", F.coalesce("further", "to").alias("root"))
    return roots
