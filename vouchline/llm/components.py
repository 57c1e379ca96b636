"""Connected components by least label and pointer jumping over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchline.llm.common import forget, join_hot, materialise

#: Up to so many vertices or labels, a table of them is broadcast (under 40 bytes each).
SMALL = 50_000


def least_reachable(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """vertices (v bigint, label struct<rep bigint, v bigint>), edges (a bigint, b bigint) -> v, label.

    Only vertices on an edge come back. Each round takes the least label over the neighbours, then the label
    of the label, so rounds grow with the logarithm of a component's diameter. A round's state is a written
    table: lineage stays flat and a lost executor repeats one round at most.

    A vertex with a great share of the edges, and a label that a great share of the vertices has, are met where
    the edges and vertices are (``join_hot``), not by key, and the neighbour minimum is combined before its shuffle.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    degree = both.groupBy(F.col("a").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    state = materialise(vertices.join(degree, "v").select("v", "label", "n"), "labels")
    while True:
        near = join_hot(both, state.select(F.col("v").alias("a"), "label", "n"), "a", "n", SMALL).groupBy("b").agg(F.min("label").alias("near"))
        lower = state.join(near, state.v == near.b).select("v", "n", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        lower = materialise(lower.withColumn("lv", F.col("label.v")), "labels")
        held = lower.groupBy("lv").agg(F.count(F.lit(1)).alias("m"))
        jump = materialise(held.join(lower.select(F.col("v").alias("lv"), F.col("label").alias("beyond")), "lv"), "jumps")
        jumped = join_hot(lower, jump, "lv", "m", SMALL).select("v", "n", "old", F.least("label", "beyond").alias("label"))
        after = materialise(jumped.withColumn("moved", F.col("label") != F.col("old")).drop("old"), "labels")
        for done in (state, lower, jump):
            forget(done)
        state = after
        if not state.where("moved").take(1):
            forget(both)
            return state.select("v", "label")
