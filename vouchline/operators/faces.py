"""The report of a face comparison: every model's attempt, failed ones included, and the decision over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchline.operators import vote


def _finite(c: Column) -> Column:
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c)


def attempts(df: DataFrame) -> DataFrame:
    """df (error, distance, threshold, ...) with status, passed and threshold_margin.

    An attempt with an error failed: no distance, no threshold, no margin, whatever it had by then. One without a
    distance (or with none that is finite) is no error, but doesn't pass and has no margin.
    """
    failed = F.col("error").isNotNull()
    distance, threshold = _finite(F.col("distance")), _finite(F.col("threshold"))
    return df.withColumns(
        {
            "status": F.when(failed, "error").otherwise("ok"),
            "passed": ~failed & F.coalesce(distance <= threshold, F.lit(False)),
            "threshold_margin": F.when(~failed, threshold - distance),
            "distance": F.when(~failed, distance),
            "threshold": F.when(~failed, threshold),
        }
    )


def decision(report: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, passed, used, failed, elapsed: the sequential vote over a case's attempts in order; failed ones vote against."""
    voted = vote.ordered_votes(report, keys, order, "passed").withColumn("__v", vote.sequential_vote(F.col("votes")))
    sums = report.groupBy(*keys).agg(F.count_if(F.col("status") == "error").alias("failed"), F.sum("elapsed").alias("elapsed"))
    return voted.select(*keys, F.col("__v.passed").alias("passed"), F.col("__v.used").alias("used")).join(sums, keys)
