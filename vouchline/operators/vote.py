"""Majority votes, plain and order-sensitive, and staged runs that skip decided cases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stage_vote(passed: Column) -> Column:
    """Aggregate: strict majority, false on ties and on nothing."""
    return F.coalesce(F.count_if(passed) > F.count_if(~passed), F.lit(False))


def sequential_vote(votes: Column) -> Column:
    """struct(passed, used) of an ordered array of booleans, with early exits.

    Two passes at the start decide at once, so four votes T T F F pass; otherwise a side wins as soon as the
    rest can't turn the result.
    """
    start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("t"), F.lit(False).alias("done"), F.lit(False).alias("r"))

    def step(s, b):
        k, t = s["k"] + 1, s["t"] + b.cast("int")
        f, rest = k - t, F.size(votes) - k
        win = ((k == 2) & (t == 2)) | (t > f + rest)
        lose = f >= t + rest
        moved = F.struct(k.alias("k"), t.alias("t"), (win | lose).alias("done"), win.alias("r"))
        return F.when(s["done"], s).otherwise(moved)

    return F.aggregate(votes, start, step, lambda s: F.struct(s["r"].alias("passed"), s["k"].alias("used")))


def ordered_votes(df: DataFrame, keys: list[str], order: str, passed: str) -> DataFrame:
    """keys, votes: each case's votes in order; a case holds one vote per model."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(passed).alias("v"))))
    return df.groupBy(*keys).agg(F.transform(packed, lambda s: s["v"]).alias("votes"))


def staged_vote(cases: DataFrame, key: str, models: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Runs models in order, each only on cases still open; key, passed, used.

    A model takes the cases and returns them with a boolean column ``vote``. With n models, case decisions are
    those of ``sequential_vote`` over all n votes, but later models see fewer rows.
    """
    n = len(models)
    state = cases.withColumns({"__t": F.lit(0), "__k": F.lit(0)})
    closed = []
    for k, model in enumerate(models, 1):
        voted = model(state).withColumns({"__t": F.col("__t") + F.col("vote").cast("int"), "__k": F.lit(k)}).drop("vote")
        t, f, rest = F.col("__t"), k - F.col("__t"), n - k
        win = ((F.lit(k) == 2) & (t == 2)) | (t > f + rest)
        done = win | (f >= t + rest)
        closed.append(voted.where(done).select(key, win.alias("passed"), F.col("__k").alias("used")))
        state = voted.where(~done)
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return out
