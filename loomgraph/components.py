"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.runtime import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` are (u, v) with u > v.  Every neighbour is linked to the least node around its centre."""
    if large:
        around = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = around.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            least.select("u", F.col("m").alias("v"))
        )
    return out.where("u > v").distinct()


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, component) for every node that an edge names; the component is its least node.

    Edges are undirected; null ends, loops and repeats are ignored.  Each round ends in a
    table of the shared folder, so a lost executor costs one round at most.
    """
    a, b = F.col(src), F.col(dst)
    now = (
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    now = stage(now, "edges")
    seen = None
    while True:
        now = stage(_star(_star(now, True), False), "edges")
        sums = now.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if seen == tuple(sums):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = tuple(sums)
