"""Boxes, quads and projections as Column builders; a quad is array<struct<x:double,y:double>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the card format.
CARD_RATIO = 85.6 / 54.0
MIN_AREA, MAX_AREA, MAX_RATIO_ERROR = 0.05, 0.97, 0.5
NO_CANDIDATE = -1e18


def let(value: Column, body) -> Column:
    """``body`` of a value that stands once in the expression, however often the body uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))  # a body with defaults must not get the index


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def quad(*points: tuple[Column, Column]) -> Column:
    return F.array(*(point(x, y) for x, y in points))


def _get(q: Column, i: int, axis: str) -> Column:
    return F.get(q, F.lit(i))[axis]


def _dist(q: Column, i: int, j: int) -> Column:
    return F.sqrt(F.pow(_get(q, i, "x") - _get(q, j, "x"), F.lit(2.0)) + F.pow(_get(q, i, "y") - _get(q, j, "y"), F.lit(2.0)))


def polygon_area(q: Column) -> Column:
    """Shoelace, absolute."""

    def of(q):
        n = F.size(q)
        terms = F.transform(q, lambda p, i: p.x * F.get(q, (i + 1) % n)["y"] - F.get(q, (i + 1) % n)["x"] * p.y)
        return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)) / 2

    return let(q, of)


def _first_least(q: Column, key) -> Column:
    """The first point of least key."""
    return F.array_min(F.transform(q, lambda p, i: F.struct(key(p).alias("k"), i.alias("i"), p.alias("p"))))["p"]


def order_points(q: Column) -> Column:
    """Top-left, top-right, bottom-right, bottom-left by coordinate sums and differences; first index on ties."""
    keys = (lambda p: p.x + p.y, lambda p: p.y - p.x, lambda p: -(p.x + p.y), lambda p: -(p.y - p.x))
    return let(q, lambda q: F.array(*(_first_least(q, key) for key in keys)))


def width(q: Column) -> Column:
    return F.greatest(_dist(q, 1, 0), _dist(q, 2, 3))


def height(q: Column) -> Column:
    return F.greatest(_dist(q, 3, 0), _dist(q, 2, 1))


def rect_score(q: Column, image_area: Column) -> Column:
    """Area fraction less a penalty for the aspect; the sentinel where inadmissible."""

    def of(m):
        w, h, frac = m["w"], m["h"], m["frac"]
        err = F.abs(F.greatest(w, h) / F.greatest(F.least(w, h), F.lit(1.0)) - CARD_RATIO) / CARD_RATIO
        ok = (h >= 1) & frac.between(MIN_AREA, MAX_AREA) & (err <= MAX_RATIO_ERROR)
        return F.when(ok, frac - err * 0.8).otherwise(NO_CANDIDATE)

    # the quad stands once: a caller's column may be a long expression that a filter on the score writes out again
    fraction = lambda q: polygon_area(q) / F.greatest(image_area, F.lit(1.0))
    return let(let(q, lambda q: F.struct(width(q).alias("w"), height(q).alias("h"), fraction(q).alias("frac"))), of)


def aspect_score(q: Column) -> Column:
    err = F.abs(width(q) / F.greatest(height(q), F.lit(1.0)) - CARD_RATIO) / CARD_RATIO
    return F.when(height(q) < 1, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - err * 2.0))


def contour_score(fraction: Column, vertices: Column, error: Column) -> Column:
    """Legacy contour rule: four vertices, area fraction 0.10 to 0.97."""
    return F.when((vertices == 4) & fraction.between(0.10, 0.97), fraction - 0.8 * error).otherwise(NO_CANDIDATE)


def yolo_score(w: Column, h: Column, image_area: Column, confidence: Column) -> Column:
    frac = w * h / image_area
    err = F.abs(F.greatest(w, h) / F.greatest(F.least(w, h), F.lit(1.0)) - CARD_RATIO) / CARD_RATIO
    return F.when(frac.between(MIN_AREA, MAX_AREA) & (err <= MAX_RATIO_ERROR), frac - err * 0.8 + confidence * 0.3).otherwise(NO_CANDIDATE)


def inlier_boost(score: Column, ratio: Column, inliers: Column) -> Column:
    return score + 0.5 * ratio + F.least(inliers / 50.0, F.lit(0.5))


def template_blend(geometry: Column, correlation: Column) -> Column:
    return F.when(geometry <= -1e17, NO_CANDIDATE).otherwise(geometry + 0.5 * correlation)


def alignment_score(correlation: Column, edge: Column, left_right: Column) -> Column:
    return 0.35 * correlation + 0.50 * edge + 0.15 * left_right


def norm_box_px(x1: Column, y1: Column, x2: Column, y2: Column, w: int, h: int, pad: int = 0) -> Column:
    """Pixels of a 0..1 box: half-even rounding, padded, clamped, at least one pixel."""
    a = F.greatest(F.lit(0.0), F.rint(x1 * w) - pad)
    b = F.greatest(F.lit(0.0), F.rint(y1 * h) - pad)
    c = F.least(F.lit(float(w)), F.rint(x2 * w) + pad)
    d = F.least(F.lit(float(h)), F.rint(y2 * h) + pad)
    return F.struct(a.cast("int").alias("x1"), b.cast("int").alias("y1"), F.greatest(c, a + 1).cast("int").alias("x2"), F.greatest(d, b + 1).cast("int").alias("y2"))


def project(x: Column, y: Column, m: list[list[float]]) -> Column:
    """A point under a 3x3 matrix."""
    row = lambda r: r[0] * x + r[1] * y + r[2]
    w = row(m[2])
    return F.when(w != 0, F.struct((row(m[0]) / w).alias("x"), (row(m[1]) / w).alias("y")))


def unrotate(x: Column, y: Column, rotation: Column, w: Column, h: Column) -> Column:
    """Where a point of a rotated image lies in the original of size w x h, clipped to it."""
    ox = F.when(rotation == 90, y).when(rotation == 180, w - 1 - x).when(rotation == 270, w - 1 - y).otherwise(x)
    oy = F.when(rotation == 90, h - 1 - x).when(rotation == 180, h - 1 - y).when(rotation == 270, x).otherwise(y)
    clip = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most - 1)
    return point(clip(ox, w), clip(oy, h))


def rotate_corners(q: Column, turns: int) -> Column:
    return F.array(*(F.get(q, F.lit((i + turns) % 4)) for i in range(4)))


def line_intersection(a1: Column, b1: Column, c1: Column, a2: Column, b2: Column, c2: Column) -> Column:
    """Of a*x + b*y = c; null if nearly parallel."""
    det = a1 * b2 - a2 * b1
    return F.when(F.abs(det) >= 1e-6, point((c1 * b2 - c2 * b1) / det, (a1 * c2 - a2 * c1) / det))


def line_class(dx: Column, dy: Column) -> Column:
    """'h' under 30 or over 150 degrees, 'v' between 60 and 120, bounds excluded."""
    angle = F.abs(F.degrees(F.atan2(dy, dx)))
    return F.when((angle < 30) | (angle > 150), "h").when((angle > 60) & (angle < 120), "v")


def centroid(q: Column) -> Column:
    mean = lambda axis: F.aggregate(q, F.lit(0.0), lambda a, p: a + p[axis]) / F.size(q)
    return point(mean("x"), mean("y"))


def shrink(q: Column, by: float = 2.0) -> Column:
    """Every corner moved towards the centroid."""

    def move(p, c):
        dx, dy = c["x"] - p["x"], c["y"] - p["y"]
        n = F.sqrt(dx * dx + dy * dy)
        return F.when(n > 0, point(p["x"] + F.try_divide(dx, n) * by, p["y"] + F.try_divide(dy, n) * by)).otherwise(p)

    return let(centroid(q), lambda c: F.transform(q, lambda p: move(p, c)))


def corner_distance(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda p, q: F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])))
    return F.aggregate(d, F.lit(0.0), lambda s, v: s + v) / F.size(d)


def clip_quad(q: Column, w: Column, h: Column) -> Column:
    return F.transform(q, lambda p: point(F.least(F.greatest(p["x"], F.lit(0.0)), w - 1), F.least(F.greatest(p["y"], F.lit(0.0)), h - 1)))


def fused(a: Column, sa: Column, b: Column, sb: Column, c: Column, w: Column, h: Column) -> Column:
    """Fusion of two detections with a fallback: struct(contour, score, branch).

    Agreeing corners (under 25 px) are averaged, and the bonus grows with their distance, as specified.
    """
    area = w * h
    a_ok, b_ok = a.isNotNull() & (sa > -1e17), b.isNotNull() & (sb > -1e17)
    ordered = lambda q: let(q, order_points)

    def pack(q, bonus, name):
        return let(q, lambda o: F.struct(o.alias("contour"), (rect_score(o, area) + bonus).alias("score"), F.lit(name).alias("branch")))

    def two(d):
        mean = clip_quad(ordered(F.zip_with(a, b, lambda p, q: point((p["x"] + q["x"]) / 2, (p["y"] + q["y"]) / 2))), w, h)
        winner = clip_quad(ordered(let(F.when(sa >= sb, a).otherwise(b), shrink)), w, h)
        return F.when(d < 25, pack(mean, 0.5 + F.least(d, F.lit(25.0)) / 50.0, "agree")).otherwise(pack(winner, F.lit(0.2), "winner"))

    none = F.struct(F.lit(None).cast("array<struct<x:double,y:double>>").alias("contour"), F.lit(NO_CANDIDATE).alias("score"), F.lit("none").alias("branch"))
    return (
        F.when(a_ok & b_ok, let(corner_distance(a, b), two))
        .when(a_ok, pack(ordered(a), F.lit(0.1), "first"))
        .when(b_ok, pack(ordered(b), F.lit(0.1), "second"))
        .when(c.isNotNull(), pack(ordered(c), F.lit(0.0), "fallback"))
        .otherwise(none)
    )


# Guards, crops and scales of the alignment steps.


def whole_image_ok(w: Column, h: Column) -> Column:
    """Whether a whole image is near enough to the card's shape to stand for it."""
    return F.abs(w / F.greatest(h, F.lit(1.0)) - CARD_RATIO) / CARD_RATIO <= 0.12


def refined_ok(w: Column, h: Column, whole_w: Column, whole_h: Column) -> Column:
    """A tighter crop is kept if both sides have twenty pixels and a quarter of the crop's."""
    return (w >= F.greatest(F.lit(20.0), 0.25 * whole_w)) & (h >= F.greatest(F.lit(20.0), 0.25 * whole_h))


def corners_turned(top: Column, left: Column) -> Column:
    """A quad that is taller than wide has its corners in the wrong order."""
    return left > 1.1 * top


def face_bonus(faces: Column, w: Column, h: Column) -> Column:
    """0.5 if any face (struct x, y, w, h) is large and where the photo belongs, however many are."""
    fits = lambda f: (f["h"] > 0.15 * h) & (f["x"] + f["w"] / 2 < 0.40 * w) & (f["y"] + f["h"] / 2 < 0.80 * h)
    return F.when(F.exists(faces, fits), 0.5).otherwise(0.0)


def ordering_vote(aspect: Column, strip: Column, bonus: Column) -> Column:
    return 0.4 * aspect + 0.6 * strip + bonus


def strip_score(top_top: Column, bottom_bottom: Column, top_bottom: Column, bottom_top: Column) -> Column:
    """Correlations of an image's top and bottom strips with the template's: upright less upside down."""
    return top_top + bottom_bottom - (top_bottom + bottom_top)


def flip_vote(strip: Column, score_0: Column, score_180: Column, tl: Column, tr: Column, bl: Column, br: Column) -> Column:
    """180 where the strips, the turned score and the quadrant means together speak for it, else 0."""
    dark = lambda a, b: F.greatest(F.lit(0.0), (a - b) / 255.0)
    vote = -0.50 * strip + 0.35 * (score_180 - score_0) + 0.15 * (dark(bl, br) - dark(tr, tl))
    return F.when(vote > 0.02, 180).otherwise(0)


def other_rotations(w: Column, h: Column) -> Column:
    """The quarter turns that are not tried first: first come 0 and 180 for upright images, 90 and 270 for others."""
    every = F.array(*map(F.lit, (0, 90, 180, 270)))
    return F.array_except(every, F.when(h >= w, F.array(F.lit(0), F.lit(180))).otherwise(F.array(F.lit(90), F.lit(270))))


def crop_norm(x1: Column, y1: Column, x2: Column, y2: Column, w: Column, h: Column) -> Column:
    """Pixels of a 0..1 box without padding, clamped; it may be empty."""
    px = lambda v, most: F.least(F.greatest(F.rint(v * most), F.lit(0.0)), most).cast("int")
    return F.struct(px(x1, w).alias("x1"), px(y1, h).alias("y1"), px(x2, w).alias("x2"), px(y2, h).alias("y2"))


def box_corners(box: Column) -> Column:
    """Top-left, top-right, bottom-right, bottom-left of a pixel box (struct x1, y1, x2, y2)."""
    return quad((box["x1"], box["y1"]), (box["x2"], box["y1"]), (box["x2"], box["y2"]), (box["x1"], box["y2"]))


def crop_size(q: Column) -> Column:
    """Width and height of an upright crop of a quad: the longer of opposite edges, half-even, at least one pixel."""
    least = lambda v: F.greatest(F.rint(v), F.lit(1.0)).cast("int")
    return F.struct(least(width(q)).alias("w"), least(height(q)).alias("h"))


def fit_scale(w: Column, h: Column, most_w: Column | float, most_h: Column | float, limit: float | None = None) -> Column:
    """The scale that fits an image into a frame, up to ``limit`` times its size."""
    parts = [(most_w if isinstance(most_w, Column) else F.lit(float(most_w))) / w, (most_h if isinstance(most_h, Column) else F.lit(float(most_h))) / h]
    return F.least(*parts, *([F.lit(float(limit))] if limit is not None else []))


def shrink_scale(w: Column, h: Column, most: float) -> Column:
    """The scale that brings the longer side down to ``most``; never up."""
    return most / F.greatest(w, h, F.lit(float(most)))


def grow_scale(w: Column, h: Column, least: float, limit: float = 4.0) -> Column:
    """The scale that brings the shorter side up to ``least``, at most ``limit`` times; never down."""
    short = F.least(w, h)
    return F.when(short >= least, 1.0).otherwise(F.least(least / F.greatest(short, F.lit(1.0)), F.lit(limit)))


def quad_norm(q: Column, w: Column, h: Column) -> Column:
    return F.transform(q, lambda p: point(p["x"] / w, p["y"] / h))


def share(value: Column, most: Column | float) -> Column:
    """A coordinate as a share of its axis at four places, half-even."""
    return F.bround((value / most).cast("decimal(18,12)"), 4).cast("double")


def area_ratio(q: Column, w: Column, h: Column) -> Column:
    return polygon_area(q) / F.greatest(w * h, F.lit(1.0))
