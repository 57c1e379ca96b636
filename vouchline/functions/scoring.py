"""Evidence scores and verdict predicates as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def match_score(inliers: Column, ratio: Column, area: Column, confidence: Column) -> Column:
    return 0.45 * F.least(inliers / 30.0, F.lit(1.0)) + 0.35 * clamp01(ratio) + 0.10 * F.least(area / 0.06, F.lit(1.0)) + 0.10 * clamp01(confidence)


def match_found(inliers: Column, ratio: Column, score: Column) -> Column:
    return ((ratio >= 0.65) & (inliers >= 4) & (score >= 0.30)) | ((inliers >= 8) & (ratio >= 0.20) & (score >= 0.35))


def match_reason(descriptors: Column, good: Column, homography: Column) -> Column:
    """Why a match run ends; a failed homography still counts as a success with score zero."""
    return F.when(descriptors < 4, "not enough descriptors").when(good < 4, "not enough good matches").when(~homography, "homography failed").otherwise("ok")


def detector_guard(keypoints: Column, good: Column, inliers: Column, ratio: Column) -> Column:
    return (keypoints >= 10) & (good >= 8) & (inliers >= 6) & (ratio >= 0.15)


def text_score(arabic: Column, mean_confidence: Column) -> Column:
    return arabic + 10 * mean_confidence


def expiry_score(matched: Column, label: Column, date: Column, mean_confidence: Column) -> Column:
    return 100.0 * matched.cast("int") + 10 * label + F.length(date) + 5 * mean_confidence


def nan_safe(c: Column) -> Column:
    """A score that can't win: NaN and null become the sentinel."""
    return F.when(c.isNull() | F.isnan(c), -1e18).otherwise(c)


def live(face_count: Column, is_real: Column, score: Column) -> Column:
    """One face, real, and a score of at least one half if there is one."""
    return (face_count == 1) & F.coalesce(is_real, F.lit(False)) & (score.isNull() | (score >= 0.5))


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, 1 - F.try_divide(dot(a, b), norm)).otherwise(float("nan"))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.try_divide(x, n))


def margin(threshold: Column, distance: Column) -> Column:
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.when(finite(threshold) & finite(distance), threshold - distance).otherwise(float("nan"))
