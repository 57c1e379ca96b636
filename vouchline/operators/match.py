"""Feature matching over tables: model summaries, rankings, model choice, nearest descriptors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vouchline.functions import scoring

#: model -> ordinal and name; order is data (ties in a ranking).
MODELS = ((0, "sift"), (1, "akaze"), (2, "orb"))
#: preferred models by side, first is best; those without a backend are passed over.
PREFERRED = {"front": ("sift", "lightglue_superpoint", "akaze", "orb"), "back": ("akaze", "lightglue_superpoint", "sift", "orb")}
MIN_HIT_SHARE = 0.40


def scored(matches: DataFrame) -> DataFrame:
    s = scoring.match_score(F.col("inliers"), F.col("inlier_ratio"), F.col("quad_area_ratio"), F.col("confidence_mean"))
    with_score = matches.withColumn("score", s)
    return with_score.withColumn("found", scoring.match_found(F.col("inliers"), F.col("inlier_ratio"), F.col("score")))


def min_hits(n: Column) -> Column:
    """At least one, else two fifths of the features, rounded up."""
    return F.greatest(F.lit(1), F.ceil(n * MIN_HIT_SHARE)).cast("bigint")


def model_summary(matches: DataFrame, *keys: str) -> DataFrame:
    """Per key: features, runs, hits, means over runs that succeeded (0 if none), and the verdict."""
    s = matches
    ok = F.col("success")
    mean = lambda c: F.coalesce(F.avg(F.when(ok, F.col(c))), F.lit(0.0))
    out = s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("features_total"),
        F.count_if(ok).alias("features_ran"),
        F.count_if(ok & F.col("found")).alias("features_found"),
        mean("score").alias("avg_score"),
        mean("inlier_ratio").alias("avg_inlier_ratio"),
        F.coalesce(F.sum(F.when(ok, F.col("inliers"))), F.lit(0)).cast("bigint").alias("total_inliers"),
    )
    return out.withColumn("min_hits", min_hits(F.col("features_total"))).withColumn("valid_id", F.col("features_found") >= F.col("min_hits"))


def rank_models(summary: DataFrame, *keys: str) -> DataFrame:
    order = [F.col("valid_id").desc(), F.col("features_found").desc(), F.col("avg_score").desc(), F.col("total_inliers").desc(), F.col("model_ord")]
    return summary.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def preferred_models(preferred: DataFrame, ready: DataFrame, *keys: str, k: int = 4) -> DataFrame:
    """preferred (side, ord, model), ready (keys, ord, model) -> keys, side, place, model: the key's ready models, preferred
    ones in the side's order, then the others in theirs; a model once, k a side. The preferences are few and broadcast."""
    once = ready.groupBy(*keys, "model").agg(F.min("ord").alias("ord"))
    sides = preferred.groupBy("side").agg(F.map_from_entries(F.collect_list(F.struct("model", "ord"))).alias("wish"))
    wish = F.try_element_at("wish", F.col("model"))
    each = once.join(F.broadcast(sides), how="cross").select(*keys, "side", "model", wish.isNull().alias("other"), F.coalesce(wish, "ord").alias("ord"))
    at = F.row_number().over(Window.partitionBy(*keys, "side").orderBy("other", "ord", "model"))
    return each.withColumn("place", at).where(F.col("place") <= k).select(*keys, "side", "place", "model")


#: Queries that one broadcast holds; more are dealt into blocks of so many.
QUERY_BLOCK = 20_000


def two_nearest(queries: DataFrame, train: DataFrame, distance: Column, block: int = QUERY_BLOCK, most: int | None = None) -> DataFrame:
    """queries (q, qe) against train (t, te): the two nearest per query, by distance and t.

    Exact: every query meets every row. Up to ``block`` queries are broadcast to the tasks of the train side; more
    are dealt into blocks, and a block meets the train rows by key. Each pair's distance is computed once, and two
    rows a query and task are left before the shuffle. ``most`` is the number of queries at most, counted if not given.
    """
    blocks = max(1, -(-(queries.count() if most is None else most) // block))
    if blocks == 1:
        met = train.join(F.broadcast(queries), F.col("q") != F.col("t"))
    else:
        dealt = queries.withColumn("__b", F.pmod(F.xxhash64("q"), F.lit(blocks)))
        met = train.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))).join(dealt, "__b").where(F.col("q") != F.col("t"))
    pairs = met.select("q", "t", distance.alias("d"))
    place = F.row_number().over(Window.partitionBy("q").orderBy("d", "t"))
    at = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    two = pairs.withColumn("k", place).where("k <= 2").groupBy("q").agg(at("t", 1).alias("t1"), at("d", 1).alias("d1"), at("t", 2).alias("t2"), at("d", 2).alias("d2"))
    return two


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two binary descriptors of 64 bits."""
    return F.bit_count(a.bitwiseXOR(b))


def keypoint_pairs(matches: DataFrame, query_points: DataFrame, train_points: DataFrame, *keys: str) -> DataFrame:
    """matches (query_idx, train_idx) with the points of both sides: two equi-joins on the keys and the index."""
    a = query_points.select(*keys, F.col("idx").alias("query_idx"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    b = train_points.select(*keys, F.col("idx").alias("train_idx"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    return matches.join(a, [*keys, "query_idx"]).join(b, [*keys, "train_idx"])


def drawn(matches: DataFrame, keys: list[str], *order: Column, most: int = 80) -> DataFrame:
    """The matches that a picture shows: the first ``most`` of each key."""
    return matches.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__at") <= most).drop("__at")


def ratio_test(nearest: DataFrame, ratio: float) -> DataFrame:
    """Keeps queries whose nearest is clearly nearer than the second; those with one neighbour go."""
    return nearest.where(F.col("d1") < ratio * F.col("d2"))
