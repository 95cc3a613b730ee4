"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.storage import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    # joined on an expression, so that both sides are shuffled for the join and the rows of a hub can be split between tasks
    key = F.col("u").bitwiseXOR(F.lit(-1)).alias("key")
    moved = near.withColumn("key", key).join(low.select(key, "m"), "key").drop("key")
    out = moved.where("v > u") if large else moved.where("v <> m")
    out = out.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, label: str) -> DataFrame:
    """Edges (a long, b long) to (id, component): each linked node with the smallest node it can reach.

    Every round writes its edges to the shared folder, so a lost executor costs one round. Nodes without an edge are not
    returned; null ends and self loops are ignored. A hub's edges stay separate rows throughout.
    """
    edges = materialize(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), f"{label}-edges")
    mark = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == mark or not state[0]:
            return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()).groupBy("id").agg(F.min("component").alias("component"))
        mark = tuple(state)
        edges = materialize(_star(materialize(_star(edges, True), f"{label}-large"), False), f"{label}-small")
