"""Edges, lines and regions of rasters, worked out on runs, edge points and votes.

A mask leaves its raster as runs (image, y, x1, x2), which are what regions are made of; edge points vote for lines.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchline.operators import stacks
from vouchline.operators.connect import components
from vouchline.operators.raster import _places
from vouchline.storage import cut

# Tangents of 22.5 and 67.5 degrees in 15 fractional bits, as gradient sectors are told apart.
TAN_22, TAN_67 = 13573, 13573 + (1 << 16)


def edge_states(rasters: DataFrame, low: int, high: int) -> DataFrame:
    """image, w, h, state: 2 for a strong edge pixel, 1 for a weak one, 0 for none.

    A pixel is an edge if its magnitude is over ``low`` and largest across the edge: over the one before, at least the
    one after (in a diagonal sector over both); strong over ``high``.
    """
    return stacks.replaced(rasters.select("image", "w", "h", "v"), "v", lambda v: stacks.states(v, low, high, TAN_22, TAN_67), "state").drop("v")


def runs(masks: DataFrame, mask: str, least: int = 1) -> DataFrame:
    """image, w, h, run, y, x1, x2, top: maximal horizontal runs of values of at least ``least``; ``top`` is a run's largest.

    ``run`` numbers an image's runs by their first pixel, so names are the same however rows are dealt.
    """
    w = F.col("w")
    on = lambda i: F.get(mask, i) >= least
    starts = F.filter(_places(w, F.col("h")), lambda i: on(i) & ((i % w == 0) | ~on(i - 1)))
    ends = F.filter(_places(w, F.col("h")), lambda i: on(i) & ((i % w == w - 1) | ~on(i + 1)))
    each = masks.select("image", "w", "h", mask, F.explode(F.arrays_zip(starts.alias("a"), ends.alias("b"))).alias("r"))
    a, b = F.col("r.a"), F.col("r.b")
    return each.select("image", "w", "h", a.cast("bigint").alias("run"), (a / w).cast("int").alias("y"), (a % w).alias("x1"), (b % w).alias("x2"), F.array_max(F.slice(mask, a + 1, b - a + 1)).alias("top"))


def regions(of_runs: DataFrame, diagonal: bool = True) -> DataFrame:
    """Adds ``region``, the least run of the connected region that a run belongs to."""
    of_runs, gap = cut(of_runs), 1 if diagonal else 0
    above, below = of_runs.select("image", "y", "x1", "x2", F.col("run").alias("a")), of_runs.select("image", (F.col("y") - 1).alias("y"), F.col("x1").alias("u1"), F.col("x2").alias("u2"), F.col("run").alias("b"))
    touching = above.join(below, ["image", "y"]).where((F.col("u1") <= F.col("x2") + gap) & (F.col("u2") >= F.col("x1") - gap)).select("image", "a", "b")
    return of_runs.join(components(of_runs, touching, ["image"], "run"), ["image", "run"])


def mask_regions(masks: DataFrame, mask: str, diagonal: bool = True) -> DataFrame:
    """The runs of masks with their regions, both found in the image's own task."""

    def of(stack: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        image, found = stacks.runs(stack)
        return image, found | {"region": found["run"][stacks.regions(image, found, 1 if diagonal else 0)]}

    return stacks.told(masks, mask, of, _RUN)


_RUN = "run bigint, y int, x1 int, x2 int, top int, region bigint"


def canny(rasters: DataFrame, low: int, high: int) -> DataFrame:
    """Edges as runs: weak edge pixels count if a strong one is reachable through edge pixels. No pixel leaves the image's task."""

    def of(stack: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        image, found = stacks.runs(stacks.states(stack, low, high, TAN_22, TAN_67))
        root, most = stacks.regions(image, found), np.zeros(len(image), np.int32)
        np.maximum.at(most, root, found["top"])
        kept = most[root] == 2
        return image[kept], {c: x[kept] for c, x in (found | {"region": found["run"][root]}).items()}

    return stacks.told(rasters, "v", of, _RUN)


def points(of_runs: DataFrame) -> DataFrame:
    return of_runs.select("image", F.explode(F.sequence("x1", "x2")).alias("x"), "y")


#: Votes that are counted at once, one for each point and angle.
_VOTES = 4_000_000


def _angles(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array([f(k * math.pi / n) for k in range(n)]) for f in (math.cos, math.sin))


def _rho(x: np.ndarray, y: np.ndarray, c: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Distance of each point's line at each angle, (points, angles)."""
    return stacks.level(x[:, None] * c + y[:, None] * s).astype(np.int64)


def _lines(x: np.ndarray, y: np.ndarray, threshold: int, angles: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """angle, rho, votes of one image's lines; its points are taken piece by piece."""
    c, s = _angles(angles)
    reach = int(max(np.abs(x).max() + np.abs(y).max(), 0)) + 2
    wide, step = 2 * reach + 1, max(1, _VOTES // angles)
    votes = np.zeros((angles + 2) * wide, np.int64)  # an empty angle on both sides
    for i in range(0, len(x), step):
        at = _rho(x[i : i + step], y[i : i + step], c, s) + (np.arange(1, angles + 1) * wide + reach)
        votes += np.bincount(at.ravel(), minlength=len(votes))
    v = votes.reshape(angles + 2, wide)
    angle, rho = np.nonzero(v >= threshold)
    n = v[angle, rho]
    stands = (n > v[angle - 1, rho]) & (n >= v[angle + 1, rho]) & (n > v[angle, rho - 1]) & (n >= v[angle, rho + 1])
    return angle[stands] - 1, rho[stands] - reach, n[stands]


def _by_image(edge_points: DataFrame, f: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """image and what ``f`` tells of its points: an image's points meet in one task, as its pixels do."""
    kind = edge_points.schema["image"].dataType.simpleString()
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(batches):
        for batch in batches:
            off = np.asarray(batch.column("x").offsets)
            x, y = (np.asarray(batch.column(c).values).astype(np.int64) for c in "xy")
            told = [f(x[i:j], y[i:j]) for i, j in zip(off[:-1], off[1:], strict=True)]
            at = np.repeat(np.arange(len(told)), [len(t[names[0]]) for t in told])
            yield pa.RecordBatch.from_arrays([batch.column("image").take(pa.array(at))] + [pa.array(np.concatenate([t[c] for t in told])) for c in names], names=["image", *names])

    # both coordinates from one list, so that they stay together
    sets = edge_points.where("x IS NOT NULL AND y IS NOT NULL").groupBy("image").agg(F.collect_list(F.struct("x", "y")).alias("p"))
    return sets.select("image", F.col("p.x").alias("x"), F.col("p.y").alias("y")).mapInArrow(rows, f"image {kind}, {schema}")


def hough_lines(edge_points: DataFrame, threshold: int, angles: int = 180) -> DataFrame:
    """image, angle, rho, votes: lines x * cos + y * sin = rho that ``threshold`` edge points or more lie on.

    Every point votes once an angle; a line stands if it has more votes than its neighbours before it and no fewer
    than those after it, in distance and in angle. Votes are counted in an image's own task and only lines leave it.
    """

    def of(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        angle, rho, votes = _lines(x, y, max(threshold, 1), angles)
        return {"angle": angle.astype(np.int32), "rho": rho.astype(np.int32), "votes": votes}

    return _by_image(edge_points, of, "angle int, rho int, votes bigint")


def hough_segments(edge_points: DataFrame, threshold: int, min_length: int, max_gap: int, angles: int = 180) -> DataFrame:
    """image, pos, x1, y1, x2, y2: the stretches of each line's own points with no gap over ``max_gap``, of at least ``min_length``.

    They are numbered by votes, the most first, then by angle, rho and place on the line.
    """

    def of(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        angle, rho, votes = _lines(x, y, max(threshold, 1), angles)
        order = np.lexsort((rho, angle, -votes))
        c, s = (a[angle[order]] for a in _angles(angles))
        found, step = [], max(1, _VOTES // max(len(x), 1))
        for i in range(0, len(order), step):
            on = _rho(x, y, c[i : i + step], s[i : i + step]) == rho[order[i : i + step]]
            line, p = np.nonzero(on.T)
            t = np.round(y[p] * c[i + line] - x[p] * s[i + line], 6)
            by = np.lexsort((y[p], x[p], t, line))
            line, p, t = line[by], p[by], t[by]
            first = np.append(True, (line[1:] != line[:-1]) | (t[1:] - t[:-1] > max_gap)) if len(t) else np.empty(0, bool)
            a = np.flatnonzero(first)
            b = np.append(a[1:], len(t)) - 1
            long = t[b] - t[a] >= min_length if len(t) else np.empty(0, bool)
            found.append((p[a[long]], p[b[long]]) if len(t) else (a, a))
        a, b = (np.concatenate([f[k] for f in found] or [np.empty(0, np.int64)]) for k in (0, 1))
        ends = {"x1": x[a], "y1": y[a], "x2": x[b], "y2": y[b]}
        return {"pos": np.arange(1, len(a) + 1, dtype=np.int32)} | {k: v.astype(np.int32) for k, v in ends.items()}

    return _by_image(edge_points, of, "pos int, x1 int, y1 int, x2 int, y2 int")
