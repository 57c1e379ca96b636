"""First-best choices and positional ranks with explicit tie order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vouchline.functions.scoring import nan_safe


def best(df: DataFrame, keys: list[str], score: Column, order: Column, payload: Column, alias: str = "best") -> DataFrame:
    """Per key the payload of the largest score, the first in order on ties; an aggregate, not a window."""
    return df.groupBy(*keys).agg(F.max_by(payload, F.struct(nan_safe(score).alias("s"), (-order).alias("o"))).alias(alias))


def rank_by(df: DataFrame, keys: list[str], *order: Column, alias: str = "rank") -> DataFrame:
    """1..n by position within the keys; the order must end in a tie-breaker."""
    return df.withColumn(alias, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def largest_face(faces: DataFrame, keys: list[str], pos: Column, payload: Column, alias: str = "face") -> DataFrame:
    """Largest by w * h, first on ties; a missing or zero w or h falls back to width or height."""
    side = lambda short, long: F.coalesce(F.nullif(F.col(short), F.lit(0)), F.col(long), F.lit(0))
    return best(faces, keys, side("w", "width") * side("h", "height"), pos, payload, alias)


def best_alignment(candidates: DataFrame, keys: list[str], whole: DataFrame) -> DataFrame:
    """keys, name, score of the best of candidates (name, score, ord); the whole image takes its place.

    whole (keys, whole_score): images that may stand for themselves. One does if no candidate is valid (score over the
    sentinel) or the best is under 0.10.
    """
    top = best(candidates.where("score > -1e17"), keys, F.col("score"), F.col("ord"), F.struct("name", "score"))
    both = top.join(whole, keys, "full_outer")
    instead = F.col("whole_score").isNotNull() & (F.col("best").isNull() | (F.col("best.score") < 0.10))
    return both.select(*keys, F.when(instead, "full_image").otherwise(F.col("best.name")).alias("name"), F.when(instead, F.col("whole_score")).otherwise(F.col("best.score")).alias("score"))


def first_fit(rows: DataFrame, keys: list[str], fits: Column, order: str) -> DataFrame:
    """The first parameter in order for which the condition holds (a polygon of four corners, say)."""
    return rows.where(fits).groupBy(*keys).agg(F.min(order).alias(order))


def extremes(lines: DataFrame, keys: list[str], middle: Column, pos: Column, payload: Column) -> DataFrame:
    """First and last line of a group by its middle coordinate; of equal ones the earlier comes first."""
    order = F.struct(middle.alias("m"), pos.alias("p"))
    return lines.groupBy(*keys).agg(F.min_by(payload, order).alias("first"), F.max_by(payload, order).alias("last"))


def sweep(rows: DataFrame, keys: list[str], grid: DataFrame, score: Column, payload: Column, alias: str = "best") -> DataFrame:
    """Every row with every parameter of a small grid (ord, ...); per key the best score, the first in order on ties."""
    return best(rows.crossJoin(F.broadcast(grid)), keys, score, F.col("ord"), payload, alias)


def repeated_or_empty(names: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys, name, n, rejected: names without the white space around them; those that a group holds twice, or empty ones, are rejected."""
    bare = names.withColumn(name, F.btrim(name, F.lit(" \t\n\x0b\f\r")))
    return bare.groupBy(*keys, name).agg(F.count(F.lit(1)).alias("n")).withColumn("rejected", (F.col("n") > 1) | (F.col(name) == ""))
