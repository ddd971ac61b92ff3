"""Connected components by alternating large-star and small-star steps, wholly in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.session import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node reachable, itself included.

    Every round joins edges to the minimum of each node's neighbours; minima are pre-aggregated, and no node's
    neighbours are ever collected. Minima are written before they are joined: then both sides of the join are fresh
    exchanges, and adaptive execution can split a node that a third of all edges meet at. Rounds are written to the shared folder, so lineage stays short; their number
    grows with the logarithm of the longest chain. Edges with a null end and loops are left out.
    """
    at = materialize(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    before = None
    while True:
        state = at.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        both = at.union(at.select("v", "u"))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        after = materialize(small.where("u > v").distinct(), "edges")
        discard(at, least)
        at = after
    roots = at.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select("root", "root").distinct())
