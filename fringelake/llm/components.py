"""Connected components of an edge table, without gathering links on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .session import checkpointed


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable.

    Large-star and small-star rounds alternate until the edges stay the same;
    each row's work is an aggregate over a node's neighbours, and the
    minimum is taken before rows are dealt out, so hubs do not gather in a task.
    """
    current = checkpointed(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    mark = None
    for _ in range(most_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpointed(both.groupBy("u").agg(F.min(F.least("v", "u")).alias("m")))  # written, so that the join can split a hub
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = checkpointed(large.where("u <> v").distinct())
        low = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        current = checkpointed(small.select("e.u", "e.v").where("u <> v").distinct())
        now = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == tuple(now):
            break
        mark = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()).distinct()
