"""Colour clusters of whole images by Lloyd's rounds over their histograms, and the quads in their masks.

An image is reduced to its distinct colours with counts before anything iterates, so a round costs colours times
clusters, not pixels, and gives the same means as over the pixels. All rounds of an image are one Column over that
histogram: pixels are counted in their own tasks and shuffled as counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vouchline.functions.geometry import let
from vouchline.operators import outlines

#: Numbers of clusters tried, and rounds at most.
CLUSTERS = (3, 4, 5)
ROUNDS = 20


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def nearest(centres: Column, colour: Column) -> Column:
    """The place of the centre nearest to a colour, the first of equal ones."""
    far = lambda c: _total(F.zip_with(c, colour, lambda a, b: (a - b) * (a - b)))
    return F.array_min(F.transform(centres, lambda c, j: F.struct(far(c).alias("d"), j.alias("j"))))["j"]


def _round(h: Column, centres: Column) -> Column:
    """Centres moved to the mean of the colours nearest to them; one that no colour is nearest to stays."""

    def mean(mine: Column, old: Column) -> Column:
        n = _total(F.transform(mine, lambda e: e["n"]))
        return F.when(F.size(mine) > 0, F.transform(old, lambda _, i: _total(F.transform(mine, lambda e: F.get(e["v"], i) * e["n"])) / n)).otherwise(old)

    dealt = F.transform(h, lambda e: F.struct(nearest(centres, e["v"]).alias("j"), e["v"].alias("v"), e["n"].alias("n")))
    return let(dealt, lambda d: F.transform(centres, lambda c, j: let(F.filter(d, lambda e: e["j"] == j), lambda mine: mean(mine, c))))


def clusters(histogram: DataFrame, ks: tuple[int, ...] = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """histogram (image, v: the channels of a colour in an array, n) -> image, k, ord, centre, n.

    The centres start at k evenly spaced quantiles of the image's pixels, by the sum of a colour's channels and then by
    the channels, so a result doesn't depend on chance or partitioning. An image with fewer colours than clusters has
    clusters with no pixel (n = 0), which stay where they started.
    """
    colours = histogram.select("image", _total(F.col("v").cast("array<double>")).alias("s"), F.col("v").cast("array<double>").alias("v"), F.col("n").cast("double").alias("n"))
    counted = colours.withColumn("upto", F.sum("n").over(Window.partitionBy("image").orderBy("s", "v")))
    whole = counted.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("s", "v", "n", "upto"))).alias("h"), F.sum("n").alias("total"))
    start = lambda k, j: F.get(F.filter("h", lambda e: e["upto"] * (2 * k) >= F.col("total") * (2 * j + 1)), F.lit(0))["v"]
    each = whole.withColumn("t", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.array_compact(F.array(*(start(k, j) for j in range(k)))).alias("c")) for k in ks))))
    settled = each.select("image", "h", "t.k", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.col("t.c"), lambda c, _: _round(F.col("h"), c)).alias("c"))
    dealt = settled.withColumn("d", F.transform("h", lambda e: F.struct(nearest(F.col("c"), e["v"]).alias("j"), e["n"].alias("n"))))
    with_count = F.transform("c", lambda c, j: F.struct(j.alias("ord"), c.alias("centre"), _total(F.transform(F.filter("d", lambda e: e["j"] == j), lambda e: e["n"])).cast("bigint").alias("n")))
    return dealt.select("image", "k", F.inline(with_count))


def cluster_masks(rasters: DataFrame, found: DataFrame) -> DataFrame:
    """rasters (image, w, h, v) and their clusters of one channel -> image (image, k, ord), w, h, mask: 1 where a pixel is of the cluster."""
    packed = found.groupBy("image", "k").agg(F.array_sort(F.collect_list(F.struct("ord", "centre"))).alias("c"))
    centres = F.transform("c", lambda c: c["centre"])
    label = let(centres, lambda c: F.transform("v", lambda p: nearest(c, F.array(p.cast("double")))))
    each = rasters.join(packed, "image").withColumn("label", label).select("image", "k", "w", "h", "label", F.explode(F.transform("c", lambda c: c["ord"])).alias("ord"))
    return each.select(F.struct("image", "k", "ord").alias("image"), "w", "h", F.transform("label", lambda v: (v == F.col("ord")).cast("int")).alias("mask"))


def cluster_quads(rasters: DataFrame, found: DataFrame, close: int = 15, times: int = 3) -> DataFrame:
    """image, k, ord, contour, score: the best quad in the mask of any cluster; of equal scores the first k and cluster."""
    quads = outlines.mask_quads(cluster_masks(rasters, found), close, times)
    order = F.struct("score", -F.col("image.k"), -F.col("image.ord"))
    best = quads.groupBy(F.col("image.image").alias("image")).agg(F.max_by(F.struct("image.k", "image.ord", "contour", "score"), order).alias("b"))
    return best.select("image", "b.*")
