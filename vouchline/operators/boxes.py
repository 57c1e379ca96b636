"""Boxes on a page: overlap pairs by grid cells, merging to a fixpoint, regions of interest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchline.functions.geometry import crop_norm
from vouchline.storage import cut

# Regions of the card (side, field, order, x1, y1, x2, y2, numeric, photo).
ROIS = (
    ("front", "photo", 0, 0.02, 0.07, 0.33, 0.67, False, True),
    ("front", "name", 1, 0.33, 0.24, 0.98, 0.47, False, False),
    ("front", "address", 2, 0.33, 0.48, 0.98, 0.67, False, False),
    ("front", "id_number", 3, 0.42, 0.69, 0.98, 0.96, True, False),
    ("front", "birth_date", 4, 0.03, 0.70, 0.35, 0.87, True, False),
    ("back", "back_id_number", 0, 0.48, 0.06, 0.86, 0.20, False, False),
    ("back", "back_issue_date", 1, 0.20, 0.06, 0.48, 0.20, False, False),
    ("back", "profession", 2, 0.25, 0.15, 0.82, 0.31, False, False),
    ("back", "gender", 3, 0.70, 0.30, 0.85, 0.45, False, False),
    ("back", "religion", 4, 0.53, 0.30, 0.70, 0.45, False, False),
    ("back", "marital_status", 5, 0.25, 0.30, 0.53, 0.45, False, False),
    ("back", "expiry_date", 6, 0.05, 0.46, 0.89, 0.63, False, False),
)
ROI_PAD = 4
ROI_SCHEMA = "side string, field string, ord int, x1 double, y1 double, x2 double, y2 double, is_numeric boolean, is_photo boolean"


def roi_table(spark) -> DataFrame:
    return spark.createDataFrame(list(ROIS), ROI_SCHEMA)


def overlaps(a: str, b: str, gap: float = 0) -> Column:
    """Strict overlap of boxes under aliases a and b, each grown by the gap."""
    c = lambda s, n: F.col(f"{s}.{n}")
    return (
        (c(a, "x1") - gap < c(b, "x2") + gap) & (c(b, "x1") - gap < c(a, "x2") + gap) & (c(a, "y1") - gap < c(b, "y2") + gap) & (c(b, "y1") - gap < c(a, "y2") + gap)
    )


def overlap_pairs(boxes: DataFrame, page: str, box_id: str, gap: int, cell: int) -> DataFrame:
    """page, a, b (a < b) of overlapping boxes: an equi-join on grid cells instead of every pair of a page.

    A pair that shares several cells is reported in the cell of its overlap's corner only, so nothing is
    counted twice and no distinct is needed.
    """
    lo = lambda c: F.floor((F.col(c) - gap) / cell).cast("int")
    hi = lambda c: F.floor((F.col(c) + gap) / cell).cast("int")
    placed = boxes.withColumn("cx", F.explode(F.sequence(lo("x1"), hi("x2")))).withColumn("cy", F.explode(F.sequence(lo("y1"), hi("y2"))))
    a, b = placed.alias("a"), placed.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (page, "cx", "cy")] + [F.col(f"a.{box_id}") < F.col(f"b.{box_id}"), overlaps("a", "b", gap)]
    corner = lambda c: F.floor((F.greatest(F.col(f"a.{c}"), F.col(f"b.{c}")) - gap) / cell).cast("int")
    first = (F.col("a.cx") == corner("x1")) & (F.col("a.cy") == corner("y1"))
    return a.join(b, on).where(first).select(F.col(f"a.{page}").alias(page), F.col(f"a.{box_id}").alias("a"), F.col(f"b.{box_id}").alias("b"))


def _near(a: Column, b: Column, gap: int) -> Column:
    return (a["x1"] - gap < b["x2"] + gap) & (b["x1"] - gap < a["x2"] + gap) & (a["y1"] - gap < b["y2"] + gap) & (b["y1"] - gap < a["y2"] + gap)


def _around(a: Column, b: Column) -> Column:
    least, most = (lambda c: F.least(a[c], b[c]).alias(c)), (lambda c: F.greatest(a[c], b[c]).alias(c))
    return F.struct(least("x1"), least("y1"), most("x2"), most("y2"), (a["members"] + b["members"]).alias("members"))


def merge_boxes(boxes: DataFrame, page: str, gap: int) -> DataFrame:
    """Overlapping boxes of a page united until none overlap; page, x1, y1, x2, y2, members.

    A page's boxes stand in one array, and a round goes through it four times: each box takes in what it overlaps of
    those before it. What has grown may overlap others, so rounds go on over the pages that still changed. The result
    doesn't depend on any order: whatever overlaps must end in one box. A page is one image's boxes and one row.
    """
    sides = ("x1", "y1", "x2", "y2")
    kind = "array<struct<x1:bigint,y1:bigint,x2:bigint,y2:bigint,members:bigint>>"

    def take_in(done: Column, box: Column) -> Column:
        met = F.filter(done, lambda d: _near(d, box, gap))
        return F.when(F.size(met) == 0, F.concat(done, F.array(box))).otherwise(F.concat(F.filter(done, lambda d: ~_near(d, box, gap)), F.array(F.aggregate(met, box, _around))))

    first = boxes.select(page, *(F.col(c).cast("bigint").alias(c) for c in sides)).groupBy(page, *sides).agg(F.count(F.lit(1)).alias("members"))
    now, settled = first.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(*sides, "members"))).cast(kind).alias("b")), []
    while True:
        after = F.col("b")
        for _ in range(4):
            after = F.aggregate(after, F.array().cast(kind), take_in)
        now = cut(now.withColumn("after", after))
        same = F.size("b") == F.size("after")
        settled.append(now.where(same).select(page, "b"))
        now = now.where(~same).select(page, F.col("after").alias("b"))
        if not now.take(1):
            break
    every = settled[0]
    for more in settled[1:]:
        every = every.unionByName(more)
    return every.select(page, F.explode("b").alias("b")).select(page, "b.*")


def text_region(x1: Column, y1: Column, x2: Column, y2: Column, w: int, h: int) -> Column:
    """Plausible text boxes by area, size and aspect; bounds included."""
    bw, bh = x2 - x1, y2 - y1
    area, aspect = bw * bh / float(w * h), bw / F.greatest(bh, F.lit(1))
    return area.between(0.0003, 0.55) & (bw >= 0.02 * w) & (bh >= 0.015 * h) & aspect.between(0.2, 40.0)


def hit_test(points: DataFrame, rois: DataFrame, key: str) -> DataFrame:
    """The last drawn region that holds each point, borders included; empty if none."""
    inside = points.join(F.broadcast(rois), F.col("px").between(F.col("x1"), F.col("x2")) & F.col("py").between(F.col("y1"), F.col("y2")), "left")
    return inside.groupBy(key).agg(F.coalesce(F.max_by("field", "ord"), F.lit("")).alias("field"))


def drag_box(x1: Column, y1: Column, x2: Column, y2: Column, w: float, h: float) -> Column:
    """A dragged rectangle as a 0..1 box, corners in order; null for drags under five pixels."""
    norm = lambda v, most: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / most)), 6)
    box = F.struct(norm(F.least(x1, x2), w).alias("x1"), norm(F.least(y1, y2), h).alias("y1"), norm(F.greatest(x1, x2), w).alias("x2"), norm(F.greatest(y1, y2), h).alias("y2"))
    return F.when((F.abs(x2 - x1) >= 5) & (F.abs(y2 - y1) >= 5), box)


def artifact_plan(images: DataFrame, rois: DataFrame, refine_numeric: bool = True, refine_text: bool = True) -> DataFrame:
    """images (case_id, side, aligned, has_matrix) x regions of the side: how each crop is cut and refined.

    A crop is taken from the source in perspective where the alignment gave a matrix, else from the aligned image;
    numeric and text fields have their own refinement, photos that of text.
    """
    mode = F.when(F.col("aligned") & F.col("has_matrix"), "perspective").otherwise("plain")
    numeric = F.when(F.lit(refine_numeric), "numeric").otherwise("none")
    worded = F.when(F.lit(refine_text), "text").otherwise("none")
    refine = F.when(F.col("is_photo"), "text").when(F.col("is_numeric"), numeric).otherwise(worded)
    return images.join(F.broadcast(rois), "side").select("case_id", "side", "field", F.when(F.col("is_photo"), "photo").otherwise("crop").alias("artifact"), mode.alias("mode"), refine.alias("refine"))


def generated_regions(rois: DataFrame, templates: DataFrame) -> DataFrame:
    """templates (template, side, w, h) -> template, side, field, ord and the pixels of each region of its side: what feature
    files are cut from; empty ones are left out."""
    px = crop_norm(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col("w").cast("double"), F.col("h").cast("double"))
    placed = templates.join(F.broadcast(rois), "side").select("template", "side", "field", "ord", px.alias("px"))
    return placed.where("px.x2 > px.x1 AND px.y2 > px.y1").select("template", "side", "field", "ord", "px.*")
