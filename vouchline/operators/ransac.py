"""Homographies from point matches by random sample consensus, one group of matches a time.

Each round's hypothesis is four matches of the group, chosen by a hash of round and match; its map, from the closed
form, is held against all matches of the group, and the round with most inliers wins. Matches are shuffled once, by
group; rounds are made and counted in the group's own task, so neither they nor their errors are ever rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchline.functions import geometry as geo
from vouchline.functions import homography as hg

THRESHOLD = 4.0
#: Pairs of round and match that are looked at at once.
PAIRS = 500_000


def _mixed(match: np.ndarray, rounds: int) -> np.ndarray:
    """A 64-bit hash of each round and match (rounds, matches)."""
    z = match.astype(np.int64).view(np.uint64)[None, :] ^ (np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return z ^ (z >> np.uint64(31))


def chosen(match: np.ndarray, rounds: int) -> np.ndarray:
    """(rounds, 4): the places of the four matches of least hash in each round, least first; of equal ones the first."""
    best, least = np.empty((rounds, 0), np.int64), np.empty((rounds, 0), np.uint64)
    step = max(4, PAIRS // rounds)
    for i in range(0, len(match), step):
        h = _mixed(match[i : i + step], rounds)
        few = np.argpartition(h, 3, 1)[:, :4] if h.shape[1] > 4 else np.broadcast_to(np.arange(h.shape[1]), h.shape)
        best, least = np.hstack([best, few + i]), np.hstack([least, np.take_along_axis(h, few, 1)])
        order = np.lexsort((best, least), 1)[:, :4]
        best, least = np.take_along_axis(best, order, 1), np.take_along_axis(least, order, 1)
    return best


def _square_to(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Quads (4, n) -> the nine entries of the map of the unit square's corners; not a number if three corners are in line."""
    (ax, bx, sx), (ay, by, sy) = ((c[1] - c[2], c[3] - c[2], c[0] - c[1] + c[2] - c[3]) for c in (x, y))
    det = ax * by - bx * ay
    turn = lambda i, j, k: (x[j] - x[i]) * (y[k] - y[i]) - (x[k] - x[i]) * (y[j] - y[i])
    det = np.where((turn(0, 1, 2) != 0) & (turn(0, 1, 3) != 0) & (turn(0, 2, 3) != 0) & (det != 0), det, np.nan)
    g, h = (sx * by - bx * sy) / det, (ax * sy - sx * ay) / det
    return [x[1] - x[0] + g * x[1], x[3] - x[0] + h * x[3], x[0], y[1] - y[0] + g * y[1], y[3] - y[0] + h * y[3], y[0], g, h, np.ones_like(g)]


def maps(source: tuple[np.ndarray, np.ndarray], target: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Quads' x and y (4, n) each -> (9, n): the same maps as ``homography.with_homography``, not a number where there is none."""
    with np.errstate(all="ignore"):
        a, b, c, d, e, f, g, h, i = _square_to(*source)
        back = [e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d]
        t = _square_to(*target)
        m = np.stack([t[3 * r] * back[k] + t[3 * r + 1] * back[3 + k] + t[3 * r + 2] * back[6 + k] for r in range(3) for k in range(3)])
        return m / np.where(m[8] == 0, 1.0, m[8])


def consensus(match: np.ndarray, p: np.ndarray, rounds: int, threshold: float) -> tuple[np.ndarray, int] | None:
    """The map with most inliers of matches (4, n: x0, y0, x1, y1) and their number, the first round's of equal ones; None without a map."""
    if len(match) < 4:
        return None
    four = chosen(match, rounds).T
    m = maps((p[0][four], p[1][four]), (p[2][four], p[3][four]))
    m = m[:, ~np.isnan(m).any(0)]
    if not m.shape[1]:
        return None
    inliers = np.zeros(m.shape[1], np.int64)
    step, k = max(1, PAIRS // m.shape[1]), m[:, :, None]
    with np.errstate(all="ignore"):
        for i in range(0, len(match), step):
            x, y, u, v = (c[i : i + step] for c in p)
            w = k[6] * x + k[7] * y + k[8]
            du, dv = (k[0] * x + k[1] * y + k[2]) / w - u, (k[3] * x + k[4] * y + k[5]) / w - v
            inliers += (np.sqrt(du * du + dv * dv) <= threshold).sum(1)
    best = int(inliers.argmax())
    return m[:, best], int(inliers[best])


def ransac(matches: DataFrame, keys: list[str], pos: str, sizes: DataFrame, rounds: int = 64, threshold: float = THRESHOLD) -> DataFrame:
    """keys, ok, m, quad, inliers, inlier_ratio, quad_area_ratio for every group in sizes (keys, w0, h0, w1, h1).

    ``quad`` is the first image's outline in the second. A group with under four matches, or whose hypotheses are all
    flat, is not ok: no quad, no inliers, ratios 0. Of equal rounds the first wins. The choice depends on the match's
    ``pos`` and the round only, never on how rows are partitioned. A group is the matches of one pair of images; its
    task holds 40 bytes for each.
    """
    kinds = {k: matches.schema[k].dataType.simpleString() for k in keys}

    def best(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.asarray(b.column("__h")), np.stack([np.asarray(b.column(c).fill_null(float("nan"))) for c in ("x0", "y0", "x1", "y1")])) for b in batches]
        h, p = np.concatenate([a for a, _ in parts]), np.hstack([b for _, b in parts])
        order = np.lexsort((*p[::-1], h))
        found = consensus(h[order], p[:, order], rounds, threshold)
        if found:
            values = [pa.array([k.as_py()], k.type) for k in key]
            yield pa.RecordBatch.from_arrays([*values, pa.array([found[0].tolist()]), pa.array([found[1]]), pa.array([len(h)])], names=[*keys, "m", "inliers", "n"])

    slim = matches.select(*keys, F.xxhash64(pos).alias("__h"), *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
    won = slim.groupBy(*keys).applyInArrow(best, ", ".join(f"`{k}` {t}" for k, t in kinds.items()) + ", m array<double>, inliers bigint, n bigint")
    found = sizes.join(won, keys, "left")
    m = F.col("m")
    corners = [(F.lit(0.0), F.lit(0.0)), (F.col("w0") - 1.0, F.lit(0.0)), (F.col("w0") - 1.0, F.col("h0") - 1.0), (F.lit(0.0), F.col("h0") - 1.0)]
    quad = F.when(m.isNotNull(), F.array(*(hg.apply(m, x, y) for x, y in corners)))
    found = found.withColumn("quad", quad).withColumn("ok", m.isNotNull())
    area = geo.area_ratio(F.col("quad"), F.col("w1").cast("double"), F.col("h1").cast("double"))
    return found.select(*keys, "ok", "m", "quad", F.coalesce("inliers", F.lit(0)).alias("inliers"), F.coalesce(F.col("inliers") / F.col("n"), F.lit(0.0)).alias("inlier_ratio"), F.coalesce(area, F.lit(0.0)).alias("quad_area_ratio"))
