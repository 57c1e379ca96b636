"""Raster work as table work: an image is rows (image, y, x, v), so pixels are grouped, windowed and joined by Spark.

``v`` is a grey level of 0 to 255. Neighbourhoods are cut at the image's border.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vouchline.functions import geometry as geo
from vouchline.operators.rank import best


def pixels(images: DataFrame, key: str, values: str, width: int) -> DataFrame:
    """One row a pixel from a flat array in row order."""
    at = images.select(F.col(key).alias("image"), F.posexplode(values).alias("i", "v"))
    return at.select("image", F.expr(f"CAST(i DIV {width} AS int)").alias("y"), (F.col("i") % width).alias("x"), "v")


def clip8(v: Column) -> Column:
    return F.least(F.greatest(F.rint(v), F.lit(0.0)), F.lit(255.0)).cast("int")


def luma(b: Column, g: Column, r: Column) -> Column:
    return clip8(0.114 * b + 0.587 * g + 0.299 * r)


def to_bgr(channels: Column, unit: Column) -> Column:
    """Blue, green, red of one to four channels: grey is repeated, alpha dropped, values of 0..1 (``unit``) scaled."""
    scaled = F.transform(channels, lambda c: clip8(F.when(unit, c * 255.0).otherwise(c.cast("double"))))
    return F.when(F.size(channels) < 3, F.array_repeat(F.get(scaled, F.lit(0)), 3)).otherwise(F.slice(scaled, 1, 3))


def _near(columns: tuple[str, str], k: int):
    """Along one axis: the k pixels before and after."""
    across, along = columns
    return Window.partitionBy("image", across).orderBy(along).rangeBetween(-k, k)


def blurred(px: DataFrame, k: int, alias: str = "blur") -> DataFrame:
    """Mean over a square of 2k + 1 pixels, one axis after the other."""
    rows = px.withColumn("__s", F.sum("v").over(_near(("y", "x"), k))).withColumn("__n", F.count("v").over(_near(("y", "x"), k)))
    down = _near(("x", "y"), k)
    return rows.withColumn(alias, F.sum("__s").over(down) / F.sum("__n").over(down)).drop("__s", "__n")


def gradient(px: DataFrame, k: int) -> DataFrame:
    """Morphological gradient: largest less least value over a square of 2k + 1 pixels."""
    rows = px.withColumn("__a", F.max("v").over(_near(("y", "x"), k))).withColumn("__b", F.min("v").over(_near(("y", "x"), k)))
    down = _near(("x", "y"), k)
    return rows.withColumn("gradient", F.max("__a").over(down) - F.min("__b").over(down)).drop("__a", "__b")


def sharpened(px: DataFrame, k: int = 1) -> DataFrame:
    return blurred(px, k, "__blur").withColumn("sharp", clip8(1.6 * F.col("v") - 0.6 * F.col("__blur"))).drop("__blur")


def otsu(px: DataFrame) -> DataFrame:
    """image, level: the grey level that maximises the variance between the two classes, the first on ties."""
    counts = px.groupBy("image", "v").agg(F.count(F.lit(1)).alias("n"))
    up, every = Window.partitionBy("image").orderBy("v"), Window.partitionBy("image")
    c = counts.withColumns({"below": F.sum("n").over(up), "mass": F.sum(F.col("n") * F.col("v")).over(up), "total": F.sum("n").over(every), "all_mass": F.sum(F.col("n") * F.col("v")).over(every)})
    above = F.col("total") - F.col("below")
    apart = F.col("mass") / F.col("below") - F.try_divide(F.col("all_mass") - F.col("mass"), above)
    spread = F.when(above > 0, F.col("below") * above * apart * apart).otherwise(0.0)
    return best(c.withColumn("spread", F.round(spread, 6)), ["image"], F.col("spread"), F.col("v"), F.col("v"), "level")


def adaptive(px: DataFrame, grid: DataFrame) -> DataFrame:
    """px x grid (ord, k, c): ``on`` where a pixel is over its neighbourhood's mean less c; one pass a neighbourhood size."""
    sizes = [r[0] for r in grid.select("k").distinct().orderBy("k").collect()]  # the parameter grid, not the data
    out = None
    for k in sizes:
        one = blurred(px, k).withColumn("k", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out.join(F.broadcast(grid), "k").withColumn("on", F.col("v") > F.col("blur") - F.col("c"))


def region_means(px: DataFrame, regions: DataFrame) -> DataFrame:
    """regions (region, x1, y1, x2, y2; ends exclusive): the mean grey of each region of each image."""
    inside = (F.col("x") >= F.col("x1")) & (F.col("x") < F.col("x2")) & (F.col("y") >= F.col("y1")) & (F.col("y") < F.col("y2"))
    return px.join(F.broadcast(regions), inside).groupBy("image", "region").agg(F.avg("v").alias("mean"))


def quadrants(w: int, h: int) -> list[tuple]:
    return [("tl", 0, 0, w // 2, h // 2), ("tr", w // 2, 0, w, h // 2), ("bl", 0, h // 2, w // 2, h), ("br", w // 2, h // 2, w, h)]


def thirds(w: int, h: int) -> list[tuple]:
    return [("left", 0, 0, max(1, w // 3), h), ("right", w - max(1, w // 3), 0, w, h)]


def turned(px: DataFrame, degrees: int, w: int, h: int) -> DataFrame:
    """Clockwise quarter turns of a w x h image."""
    if degrees % 90:
        raise ValueError(f"rotation {degrees} is no multiple of 90")
    x, y = F.col("x"), F.col("y")
    nx, ny = {0: (x, y), 1: (h - 1 - y, x), 2: (w - 1 - x, h - 1 - y), 3: (y, w - 1 - x)}[degrees // 90 % 4]
    return px.withColumns({"x": nx, "y": ny})


def only_inside(px: DataFrame, boxes: DataFrame, blank: int = 255) -> DataFrame:
    """Everything outside the boxes (x1, y1, x2, y2; ends exclusive) blank."""
    b = boxes.select(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("__boxes"))  # the regions of one side
    inside = F.exists("__boxes", lambda r: (F.col("x") >= r["x1"]) & (F.col("x") < r["x2"]) & (F.col("y") >= r["y1"]) & (F.col("y") < r["y2"]))
    return px.crossJoin(F.broadcast(b)).withColumn("v", F.when(inside, F.col("v")).otherwise(blank)).drop("__boxes")


def correlation(a: Column, b: Column) -> Column:
    """Normalised correlation as an aggregate; 0 where either side is flat."""
    return F.coalesce(F.nanvl(F.corr(a.cast("double"), b.cast("double")), F.lit(0.0)), F.lit(0.0))


def strip_scores(px: DataFrame, template: DataFrame, h: int) -> DataFrame:
    """image, strip: how much better the top and bottom fifths agree with the template's upright than upside down.

    template (y, x, v) has the images' size; strips are compared pixel by pixel.
    """
    fifth = max(1, h // 5)
    strip = lambda df, y: df.where((F.col(y) < fifth) | (F.col(y) >= h - fifth)).withColumn("part", F.when(F.col(y) < fifth, "top").otherwise("bottom")).withColumn("r", F.when(F.col(y) < fifth, F.col(y)).otherwise(F.col(y) - (h - fifth)))
    t = strip(template.select("y", "x", F.col("v").alias("t")), "y").select("x", "r", F.col("part").alias("tpart"), "t")
    both = strip(px, "y").join(F.broadcast(t), ["x", "r"]).groupBy("image", "part", "tpart").agg(correlation(F.col("v"), F.col("t")).alias("c"))
    return both.groupBy("image").agg(F.sum(F.when(F.col("part") == F.col("tpart"), F.col("c")).otherwise(-F.col("c"))).alias("strip"))


def best_match(px: DataFrame, template: DataFrame, w: int, h: int, tw: int, th: int) -> DataFrame:
    """image, x, y, score: where a tw x th template agrees best with a w x h image, top-left first on ties."""
    t = template.select(F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("v").alias("t"))
    met = px.crossJoin(F.broadcast(t)).select("image", (F.col("x") - F.col("tx")).alias("x0"), (F.col("y") - F.col("ty")).alias("y0"), "v", "t")
    placed = met.where(F.col("x0").between(0, w - tw) & F.col("y0").between(0, h - th)).groupBy("image", "x0", "y0").agg(F.round(correlation(F.col("v"), F.col("t")), 9).alias("score"))
    top = best(placed, ["image"], F.col("score"), F.col("y0") * w + F.col("x0"), F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"), "score"))
    return top.select("image", "best.*")


def tight_box(px: DataFrame, w: int, h: int, level: int = 185, pad: int = 6) -> DataFrame:
    """image, x1, y1, x2, y2: the padded, clamped box of the dark pixels, or the whole image where it would be too small."""
    dark = px.groupBy("image").agg(*(f(F.when(F.col("v") <= level, F.col(c))).alias(n) for n, f, c in (("a", F.min, "x"), ("b", F.min, "y"), ("c", F.max, "x"), ("d", F.max, "y"))))
    box = {"x1": F.greatest(F.col("a") - pad, F.lit(0)), "y1": F.greatest(F.col("b") - pad, F.lit(0)), "x2": F.least(F.col("c") + 1 + pad, F.lit(w)), "y2": F.least(F.col("d") + 1 + pad, F.lit(h))}
    ok = F.coalesce(geo.refined_ok(box["x2"] - box["x1"], box["y2"] - box["y1"], F.lit(w), F.lit(h)), F.lit(False))
    whole = {"x1": 0, "y1": 0, "x2": w, "y2": h}
    return dark.select("image", *(F.when(ok, c).otherwise(F.lit(whole[n])).alias(n) for n, c in box.items()))


def warped(px: DataFrame, matrix: list[list[float]], w: int, h: int) -> DataFrame:
    """The w x h image whose pixel (x, y) is the source's nearest one to the matrix's image of (x, y); 0 outside it."""
    spark = px.sparkSession
    grid = spark.range(w * h).select((F.col("id") % w).cast("int").alias("x"), F.expr(f"CAST(id DIV {w} AS int)").alias("y"))
    p = geo.project(F.col("x").cast("double"), F.col("y").cast("double"), matrix)
    source = grid.select("x", "y", F.rint(p["x"]).cast("int").alias("sx"), F.rint(p["y"]).cast("int").alias("sy"))
    there = px.select("image", F.col("x").alias("sx"), F.col("y").alias("sy"), "v")
    found = there.join(F.broadcast(source), ["sx", "sy"]).select("image", "y", "x", "v")
    every = px.select("image").distinct().crossJoin(F.broadcast(grid))
    return every.join(found, ["image", "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(0)))


def lines_quad(segments: DataFrame, w: int | str, h: int | str) -> DataFrame:
    """segments (image, pos, x1, y1, x2, y2) -> image, contour, score: the quad of the outermost level and upright lines.

    The images' size is the same for all, or in two columns of the segments.

    Null and the sentinel where an image has fewer than two of either class or parallel outermost lines.
    """
    kind = geo.line_class(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    middle = F.when(F.col("kind") == "h", (F.col("y1") + F.col("y2")) / 2.0).otherwise((F.col("x1") + F.col("x2")) / 2.0)
    a, b = (F.col("y2") - F.col("y1")).cast("double"), (F.col("x1") - F.col("x2")).cast("double")
    line = F.struct(a.alias("a"), b.alias("b"), (a * F.col("x1") + b * F.col("y1")).alias("c"))
    order = F.struct(middle.alias("m"), F.col("pos").alias("p"))
    ends = segments.withColumn("kind", kind).where("kind IS NOT NULL").groupBy("image", "kind").agg(F.count(F.lit(1)).alias("n"), F.min_by(line, order).alias("first"), F.max_by(line, order).alias("last"))
    enough = ends.where("n >= 2")
    hs, vs = (enough.where(F.col("kind") == k).select("image", F.col("first").alias(f"{k}1"), F.col("last").alias(f"{k}2")) for k in ("h", "v"))
    cut = lambda p, q: geo.line_intersection(p["a"], p["b"], p["c"], q["a"], q["b"], q["c"])
    corners = F.array(*(cut(F.col(i), F.col(j)) for i in ("h1", "h2") for j in ("v1", "v2")))
    found = hs.join(vs, "image").withColumn("q", corners).where(~F.exists("q", lambda p: p.isNull()))
    side = lambda s, name: (F.first(s) if isinstance(s, str) else F.max(F.lit(s))).cast("double").alias(name)
    found = found.join(segments.groupBy("image").agg(side(w, "__w"), side(h, "__h")), "image")
    contour = geo.let(geo.clip_quad(F.col("q"), F.col("__w"), F.col("__h")), geo.order_points)
    scored = found.select("image", "__w", "__h", contour.alias("contour")).withColumn("score", geo.rect_score(F.col("contour"), F.col("__w") * F.col("__h"))).drop("__w", "__h")
    return segments.select("image").distinct().join(scored, "image", "left").withColumn("score", F.coalesce("score", F.lit(geo.NO_CANDIDATE)))


def contours_quad(contours: DataFrame, image_area: float | str, most: int = 8) -> DataFrame:
    """contours (image, pos, area, eps_ord, polygon) -> image, contour, score: the best quad of the largest contours.

    A contour has one row for each simplification in order; the first with four corners stands for it, ordered and
    scored; among the ``most`` largest contours the best score wins, the first on ties. The images' area is one number
    or a column.
    """
    whole = (F.col(image_area) if isinstance(image_area, str) else F.lit(float(image_area))).alias("__whole")
    large = contours.withColumn("__k", F.dense_rank().over(Window.partitionBy("image").orderBy(F.col("area").desc(), "pos"))).where(F.col("__k") <= most)
    four = large.where("size(polygon) = 4").select("*", whole).groupBy("image", "pos", "__k").agg(F.min_by("polygon", "eps_ord").alias("polygon"), F.first("__whole").alias("__whole"))
    scored = four.withColumn("contour", geo.let(F.col("polygon"), geo.order_points)).withColumn("score", geo.rect_score(F.col("contour"), F.col("__whole"))).where("score > -1e17")
    return best(scored, ["image"], F.col("score"), F.col("__k"), F.struct("contour", "score")).select("image", "best.contour", "best.score")
