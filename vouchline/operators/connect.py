"""Connected components as rounds of joins: least label over the neighbours, then the label of the label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchline.storage import cut


def components(vertices: DataFrame, edges: DataFrame, keys: list[str], node: str, alias: str = "region") -> DataFrame:
    """vertices (keys, node), edges (keys, a, b) within a group of keys -> keys, node and the least node reachable.

    Every vertex comes back. A group is one image or page, so keys spread the work; rounds grow with the logarithm of
    the longest path, and a round's state is checkpointed, so a lost executor repeats one round at most.
    """
    both = cut(edges.select(*keys, "a", "b").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))))
    state = vertices.select(*keys, F.col(node).alias("v"), F.col(node).alias("l"))
    while True:
        near = both.join(state.select(*keys, F.col("v").alias("a"), "l"), [*keys, "a"]).groupBy(*keys, F.col("b").alias("v")).agg(F.min("l").alias("near"))
        lower = cut(state.join(near, [*keys, "v"], "left").select(*keys, "v", F.col("l").alias("was"), F.least("l", F.coalesce("near", "l")).alias("l")))
        beyond = lower.select(*keys, F.col("v").alias("l"), F.col("l").alias("beyond"))
        state = cut(lower.join(beyond, [*keys, "l"]).select(*keys, "v", "was", F.least("l", "beyond").alias("l")))
        if not state.where("l <> was").take(1):
            return state.select(*keys, F.col("v").alias(node), F.col("l").alias(alias))
