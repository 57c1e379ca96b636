"""From masks to quads: closing, thresholds, region outlines, polyline simplification.

Masks are arrays within an image's row; a region leaves them as runs, its outline is one array of points, and
a task simplifies its outlines in rounds over those that still change. No pixel is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchline.functions import geometry as geo
from vouchline.functions.geometry import let
from vouchline.operators import edges, pixels, stacks
from vouchline.storage import cut

# Shares of the perimeter that are tried as tolerance, in order.
TOLERANCES = (0.01, 0.015, 0.02, 0.03, 0.04, 0.05, 0.06)
MOST = 8
#: Outlines that are simplified at once.
RINGS = 2_000
_POINTS = "array<struct<x:double,y:double>>"


def extreme(rasters: DataFrame, column: str, size: int, largest: bool) -> DataFrame:
    """Largest (or least) value over size x size pixels, cut at the border: dilation or erosion, one axis after the other."""
    return stacks.replaced(rasters, column, lambda v: stacks.extreme(v, size, largest))


def closed(rasters: DataFrame, column: str, size: int, times: int = 1) -> DataFrame:
    """``times`` dilations, then as many erosions, which a kernel of their joint reach does at once."""
    reach = times * (size - 1) + 1
    return stacks.replaced(rasters, column, lambda v: stacks.extreme(stacks.extreme(v, reach, True), reach, False))


def morph_gradient(rasters: DataFrame, size: int) -> DataFrame:
    """v becomes the largest less the least value around it."""
    return stacks.replaced(rasters, "v", lambda v: stacks.extreme(v, size, True) - stacks.extreme(v, size, False))


def otsu_mask(rasters: DataFrame, inverted: bool = False) -> DataFrame:
    """Adds ``mask``: 1 over each image's own Otsu level, 0 up to it (or the other way round)."""
    return stacks.replaced(rasters, "v", lambda v: stacks.over_otsu(v, inverted), "mask")


def level_mask(rasters: DataFrame, level: int) -> DataFrame:
    return rasters.withColumn("mask", F.transform("v", lambda v: (v > level).cast("int")))


def outlines(of_runs: DataFrame) -> DataFrame:
    """runs with regions -> image, w, h, region, pixels, outline, area, perimeter.

    The outline goes down a region's right ends and up its left ones, through pixel centres; hollows that open to a
    side are part of it, as the row they lie in is.
    """
    lines = of_runs.groupBy("image", "w", "h", "region", "y").agg(F.min("x1").alias("a"), F.max("x2").alias("b"), F.sum(F.col("x2") - F.col("x1") + 1).alias("n"))
    whole = lines.groupBy("image", "w", "h", "region").agg(F.array_sort(F.collect_list(F.struct("y", "a", "b"))).alias("l"), F.sum("n").alias("pixels"))
    ring = F.concat(F.transform("l", lambda r: geo.point(r["b"], r["y"])), F.transform(F.reverse("l"), lambda r: geo.point(r["a"], r["y"])))
    # rings are bound before their points are looked at, or they would be put together again for every point
    fresh = let(ring, lambda r: F.filter(F.transform(r, lambda p, i: F.when((i == 0) | (p != F.get(r, i - 1)), p)), lambda p: p.isNotNull()))
    df = whole.withColumn("outline", fresh.cast(_POINTS)).drop("l")
    around = let(F.col("outline"), lambda o: F.aggregate(F.transform(o, lambda p, i: _far(p, F.get(o, (i + 1) % F.size(o)))), F.lit(0.0), lambda a, d: a + d))
    return df.withColumns({"area": geo.polygon_area(F.col("outline")), "perimeter": around})


def _far(p: Column, q: Column) -> Column:
    return F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))


def _chord(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of each point from the line through two others; from the first where they are one."""
    dx, dy = x[b] - x[a], y[b] - y[a]
    span, px, py = np.sqrt((x[a] - x[b]) * (x[a] - x[b]) + (y[a] - y[b]) * (y[a] - y[b])), x[a] - x, y[a] - y
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(span == 0, np.sqrt(px * px + py * py), np.abs(dx * py - px * dy) / span)


def _farthest(x: np.ndarray, y: np.ndarray, off: np.ndarray, row: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of each ring the place of the point farthest from the one at ``start``, the first of equal ones."""
    dx, dy = x - x[start][row], y - y[start][row]
    d = np.sqrt(dx * dx + dy * dy)
    at = np.flatnonzero(d == np.maximum.reduceat(d, off[:-1])[row])
    return at[np.unique(row[at], return_index=True)[1]]


def kept_corners(x: np.ndarray, y: np.ndarray, off: np.ndarray, tolerance: np.ndarray) -> np.ndarray:
    """Flags of the points that rings, laid end to end and none empty, keep within their tolerances.

    All stretches of all rings are cut at once, round by round; rings that a round leaves as they were drop out.
    """
    keep = np.zeros(len(x), bool)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    first = _farthest(x, y, off, row, _farthest(x, y, off, row, off[:-1]))
    other = _farthest(x, y, off, row, first)
    keep[first] = keep[other] = True
    # each ring from its first corner on, and that once more
    size, begin = np.diff(off) + 1, np.minimum(first, other)
    live = np.arange(len(off) - 1)
    while len(live):
        n = size[live]
        starts = np.cumsum(n) - n
        ring = np.repeat(np.arange(len(live)), n)
        place = np.arange(n.sum()) - starts[ring]
        home = off[:-1][live][ring]
        at = home + (begin[live][ring] - home + place) % (n[ring] - 1)
        corner = np.flatnonzero(keep[at])
        stretch = np.cumsum(keep[at]) - 1
        last = place == n[ring] - 1
        a, b = corner[stretch], corner[np.minimum(stretch + 1, len(corner) - 1)]
        px, py = x[at], y[at]
        d = np.where(keep[at] | last, -1.0, _chord(px, py, a, b))
        most = np.maximum.reduceat(d, corner)[stretch]
        cut_at = np.flatnonzero((d == most) & (d > tolerance[live][ring]) & ~keep[at])
        cut_at = cut_at[np.unique(stretch[cut_at], return_index=True)[1]]
        keep[at[cut_at]] = True
        live = live[np.unique(ring[cut_at])]
    return keep


def simplified(polygons: DataFrame, outline: str, tolerance: str, alias: str = "polygon") -> DataFrame:
    """Adds the corners that a closed outline keeps within a tolerance; none of one that is null or empty.

    It starts from two points far apart (three times the farthest from the one before). A stretch whose farthest
    point is over the tolerance from its chord is cut there, the first of equal ones, until none is.
    """
    rest = polygons.columns
    fields = [f"`{c}` {polygons.schema[c].dataType.simpleString()}" for c in rest] + [f"`{alias}` {_POINTS}"]

    def rows(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, RINGS):
                part = batch.slice(i, RINGS)
                rings = part.column(outline)
                size = np.asarray(pc.list_value_length(rings).fill_null(0)).astype(np.int64)
                points, off = rings.flatten(), np.append(0, np.cumsum(size))
                x, y = (np.asarray(points.field(k), np.float64) for k in (0, 1))
                full = np.flatnonzero(size)
                keep = np.empty(0, bool)
                if len(full):
                    keep = kept_corners(x, y, np.append(off[:-1][full], off[-1]), np.asarray(part.column(tolerance), np.float64)[full])
                at = np.append(0, np.cumsum(keep))[off].astype(np.int32)
                corners = pa.StructArray.from_arrays([pa.array(x[keep]), pa.array(y[keep])], ["x", "y"])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(at), corners)], names=[*rest, alias])

    return polygons.mapInArrow(rows, ", ".join(fields))


def mask_quads(masks: DataFrame, close: int = 15, times: int = 3, most: int = MOST) -> DataFrame:
    """image, contour, score: the best four-cornered outline of each image's ``most`` largest regions.

    The mask is closed first; of a region the first tolerance with four corners counts, outlines under ten pixels
    around don't. Images without such a quad are left out.
    """
    found = edges.mask_regions(closed(masks, "mask", close, times), "mask")
    rings = cut(outlines(found).where("perimeter >= 10").withColumn("pos", F.col("region")))
    tried = rings.withColumn("t", F.explode(F.array(*(F.struct(F.lit(i).alias("eps_ord"), F.lit(t).alias("share")) for i, t in enumerate(TOLERANCES)))))
    tried = tried.select("image", "pos", "area", "outline", "t.eps_ord", (F.col("t.share") * F.col("perimeter")).alias("eps"), (F.col("w") * F.col("h")).cast("double").alias("image_area"))
    return pixels.contours_quad(simplified(tried, "outline", "eps"), "image_area", most)
