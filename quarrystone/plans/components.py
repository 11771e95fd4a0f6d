"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.session import cut


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """Rows ``(node, component)`` for every node of ``edges``; the component is its least node.

    Edges with a null end are ignored; repeated edges and loops do no harm; an empty input
    gives no rows. Lineage is cut after each round. Raises if ``rounds`` do not suffice.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    # state: each node points to a smaller one
    ptr = e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    ptr = cut(ptr)
    before = None
    for _ in range(rounds):
        both = ptr.union(ptr.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ptr = cut(small.union(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        state = ptr.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            heads = ptr.groupBy("u").agg(F.min("v").alias("v"))
            return nodes.join(heads, nodes.node == heads.u, "left").select("node", F.coalesce("v", "node").alias("component"))
        before = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
