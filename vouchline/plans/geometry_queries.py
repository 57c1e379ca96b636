"""Quad, detection and alignment queries over synthetic outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from vouchline.functions import geometry as geo
from vouchline.operators import rank
from vouchline.plans.adapters import cte, view

QUERIES, ORACLES = {}, {}
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "tie"]
_K = ", ".join(KEY)


def query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


# corners in the order bottom-right, top-left, bottom-left, top-right, slightly skewed
_XY = (("px + pw", "py + ph"), ("px", "py"), ("px - sk", "py + ph - sk"), ("px + pw - sk", "py + sk"))
_Q = cte("v_quad") + """, q AS (SELECT *, px + pw AS ax, py + ph AS ay, px AS bx, py AS by_, px - sk AS cx, py + ph - sk AS cy, px + pw - sk AS dx, py + sk AS dy FROM v_quad)"""
# tl = b, tr = d, br = a, bl = c in the ordered quad wherever the outline is wider than its skew; the oracle orders by keys
_ORD = _Q + """, p AS (SELECT q.*, [{'i': 0, 'x': ax, 'y': ay}, {'i': 1, 'x': bx, 'y': by_}, {'i': 2, 'x': cx, 'y': cy}, {'i': 3, 'x': dx, 'y': dy}] AS pts FROM q),
o AS (SELECT *, list_sort(list_transform(pts, lambda p: {'k': p.x + p.y, 'i': p.i, 'x': p.x, 'y': p.y}))[1] AS tl, list_sort(list_transform(pts, lambda p: {'k': p.y - p.x, 'i': p.i, 'x': p.x, 'y': p.y}))[1] AS tr,
  list_sort(list_transform(pts, lambda p: {'k': -(p.x + p.y), 'i': p.i, 'x': p.x, 'y': p.y}))[1] AS br, list_sort(list_transform(pts, lambda p: {'k': -(p.y - p.x), 'i': p.i, 'x': p.x, 'y': p.y}))[1] AS bl FROM p),
d AS (SELECT *, greatest(sqrt(pow(tr.x - tl.x, 2) + pow(tr.y - tl.y, 2)), sqrt(pow(br.x - bl.x, 2) + pow(br.y - bl.y, 2))) AS w, greatest(sqrt(pow(bl.x - tl.x, 2) + pow(bl.y - tl.y, 2)), sqrt(pow(br.x - tr.x, 2) + pow(br.y - tr.y, 2))) AS h,
  abs(tl.x * tr.y - tr.x * tl.y + tr.x * br.y - br.x * tr.y + br.x * bl.y - bl.x * br.y + bl.x * tl.y - tl.x * bl.y) / 2 AS area FROM o)"""
_RATIO = "(85.6::DOUBLE / 54.0::DOUBLE)"
_RECT = f"""CASE WHEN h >= 1 AND area / 1000000.0 BETWEEN 0.05 AND 0.97 AND abs(greatest(w, h) / greatest(least(w, h), 1) - {_RATIO}) / {_RATIO} <= 0.5
  THEN area / 1000000.0 - abs(greatest(w, h) / greatest(least(w, h), 1) - {_RATIO}) / {_RATIO} * 0.8 ELSE -1e18 END"""


def _quads(spark, sf):
    q = geo.quad(*((F.expr(x), F.expr(y)) for x, y in _XY))
    return view(spark, sf, "v_quad").withColumn("raw", q).withColumn("q", geo.order_points(F.col("raw")))


def _at(i, axis, name):
    return F.get("q", F.lit(i))[axis].alias(name)


@query("order_points", _ORD + f" SELECT {_K}, tl.x AS tlx, tl.y AS tly, tr.x AS trx, tr.y AS try_, br.x AS brx, br.y AS bry, bl.x AS blx, bl.y AS bly FROM o")
def order_points(spark, sf):
    names = (("tlx", "tly"), ("trx", "try_"), ("brx", "bry"), ("blx", "bly"))
    return _quads(spark, sf).select(*KEY, *(_at(i, a, n) for i, pair in enumerate(names) for a, n in zip("xy", pair, strict=True)))


@query("polygon_area", _ORD + f" SELECT {_K}, round(area, 6) AS area, round(w, 6) AS w, round(h, 6) AS h FROM d")
def polygon_area(spark, sf):
    q = F.col("q")
    return _quads(spark, sf).select(*KEY, F.round(geo.polygon_area(q), 6).alias("area"), F.round(geo.width(q), 6).alias("w"), F.round(geo.height(q), 6).alias("h"))


@query("rect_score", _ORD + f" SELECT {_K}, round({_RECT}, 6) AS score, round(CASE WHEN h < 1 THEN 0.0 ELSE greatest(0.0, 1.0 - abs(w / greatest(h, 1) - {_RATIO}) / {_RATIO} * 2.0) END, 6) AS aspect FROM d")
def rect_score(spark, sf):
    q = F.col("q")
    return _quads(spark, sf).select(*KEY, F.round(geo.rect_score(q, F.lit(1e6)), 6).alias("score"), F.round(geo.aspect_score(q), 6).alias("aspect"))


_M = [[1.1, 0.02, 5.0], [-0.01, 0.95, 7.0], [0.0001, 0.0002, 1.0]]


@query("project_points", _Q + f" SELECT {_K}, round((1.1 * bx + 0.02 * by_ + 5.0) / (0.0001 * bx + 0.0002 * by_ + 1.0), 6) AS x, round((-0.01 * bx + 0.95 * by_ + 7.0) / (0.0001 * bx + 0.0002 * by_ + 1.0), 6) AS y FROM q".replace("0.0001 ", "0.0001::DOUBLE ").replace("1.1 ", "1.1::DOUBLE ").replace("-0.01 ", "-0.01::DOUBLE "))
def project_points(spark, sf):
    p = geo.project(F.col("px"), F.col("py"), _M)
    return view(spark, sf, "v_quad").select(*KEY, F.round(p["x"], 6).alias("x"), F.round(p["y"], 6).alias("y"))


@query(
    "inverse_rotation",
    cte("v_quad") + f""", r AS (SELECT *, l_linenumber % 4 * 90 AS rot FROM v_quad) SELECT {_K}, least(greatest(CASE rot WHEN 90 THEN py WHEN 180 THEN 639 - px WHEN 270 THEN 639 - py ELSE px END, 0), 639)::DOUBLE AS x,
  least(greatest(CASE rot WHEN 90 THEN 479 - px WHEN 180 THEN 479 - py WHEN 270 THEN px ELSE py END, 0), 479)::DOUBLE AS y FROM r""",
)
def inverse_rotation(spark, sf):
    p = geo.unrotate(F.col("px"), F.col("py"), F.col("l_linenumber") % 4 * 90, F.lit(640.0), F.lit(480.0))
    return view(spark, sf, "v_quad").withColumn("p", p).select(*KEY, "p.x", "p.y")


@query("rotate_corners", _ORD + f" SELECT {_K}, tr.x AS x0, tl.x AS x3, round((tl.x + tr.x + br.x + bl.x) / 4, 6) AS cx, round((tl.y + tr.y + br.y + bl.y) / 4, 6) AS cy FROM o")
def rotate_corners(spark, sf):
    turned, c = geo.rotate_corners(F.col("q"), 1), geo.centroid(F.col("q"))
    return _quads(spark, sf).select(*KEY, F.get(turned, F.lit(0))["x"].alias("x0"), F.get(turned, F.lit(3))["x"].alias("x3"), F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"))


@query(
    "line_intersection",
    cte("v_quad") + f""", l AS (SELECT *, pw - 100 AS a1, ph - 60 AS b1, px AS c1, sk AS a2, py - 90 AS b2, 7.0::DOUBLE AS c2 FROM v_quad), m AS (SELECT *, a1 * b2 - a2 * b1 AS det FROM l)
SELECT {_K}, round(CASE WHEN abs(det) >= 1e-6 THEN (c1 * b2 - c2 * b1) / det END, 6) AS x, round(CASE WHEN abs(det) >= 1e-6 THEN (a1 * c2 - a2 * c1) / det END, 6) AS y,
  CASE WHEN abs(degrees(atan2(b1, a1))) < 30 OR abs(degrees(atan2(b1, a1))) > 150 THEN 'h' WHEN abs(degrees(atan2(b1, a1))) > 60 AND abs(degrees(atan2(b1, a1))) < 120 THEN 'v' END AS kind FROM m""",
)
def line_intersection(spark, sf):
    v = view(spark, sf, "v_quad").selectExpr(*KEY, "pw - 100 AS a1", "ph - 60 AS b1", "px AS c1", "sk AS a2", "py - 90 AS b2", "7.0D AS c2")
    p = geo.line_intersection(*(F.col(c) for c in ("a1", "b1", "c1", "a2", "b2", "c2")))
    guarded = v.withColumn("par", F.abs(F.expr("a1 * b2 - a2 * b1")) >= 1e-6)
    return guarded.select(*KEY, F.round(F.when(F.col("par"), p)["x"], 6).alias("x"), F.round(F.when(F.col("par"), p)["y"], 6).alias("y"), geo.line_class(F.col("a1"), F.col("b1")).alias("kind"))


_B = "{{'x': ({0}).x + t * 400, 'y': ({0}).y - t * 300}}"
_FUSED = _ORD + """, f AS (SELECT *, [tl, tr, br, bl] AS a, CASE WHEN r < 1 THEN list_transform([tl, tr, br, bl], lambda p: {'k': p.k, 'i': p.i, 'x': p.x + t * 400, 'y': p.y - t * 300}) END AS b, CASE WHEN r = 0 THEN -1e18 ELSE r END AS sa, t * 10 AS sb FROM o),
g AS (SELECT *, sa > -1e17 AS a_ok, b IS NOT NULL AND sb > -1e17 AS b_ok, (sqrt(pow(a[1].x - b[1].x, 2) + pow(a[1].y - b[1].y, 2)) + sqrt(pow(a[2].x - b[2].x, 2) + pow(a[2].y - b[2].y, 2)) + sqrt(pow(a[3].x - b[3].x, 2) + pow(a[3].y - b[3].y, 2)) + sqrt(pow(a[4].x - b[4].x, 2) + pow(a[4].y - b[4].y, 2))) / 4 AS dist FROM f)"""


def _fusion(spark, sf):
    v = _quads(spark, sf)
    moved = F.transform("q", lambda p: geo.point(p["x"] + F.col("t") * 400, p["y"] - F.col("t") * 300))
    return v.withColumn("b", F.when(F.col("r") < 1, moved)).withColumn("sa", F.when(F.col("r") == 0, geo.NO_CANDIDATE).otherwise(F.col("r"))).withColumn("sb", F.col("t") * 10)


@query("fused_branch", _FUSED + f" SELECT {_K}, CASE WHEN a_ok AND b_ok AND dist < 25 THEN 'agree' WHEN a_ok AND b_ok THEN 'winner' WHEN a_ok THEN 'first' WHEN b_ok THEN 'second' ELSE 'fallback' END AS branch, CASE WHEN a_ok AND b_ok THEN round(dist, 6) END AS distance FROM g")
def fused_branch(spark, sf):
    v = _fusion(spark, sf)
    f = geo.fused(F.col("q"), F.col("sa"), F.col("b"), F.col("sb"), F.col("q"), F.lit(1200.0), F.lit(900.0))
    both = F.col("b").isNotNull() & (F.col("sa") > -1e17)
    return v.withColumn("f", f).select(*KEY, F.col("f.branch").alias("branch"), F.when(both, F.round(geo.corner_distance(F.col("q"), F.col("b")), 6)).alias("distance"))


_CORNER = "list_sort(list_transform(range(1, 5), lambda j: {{'k': {0}, 'i': j, 'x': raw[j].x, 'y': raw[j].y}}))[1]"
_CLIP = "{{'x': CASE WHEN a_ok AND b_ok THEN least(greatest({0}.x, 0), 1199) ELSE {0}.x END, 'y': CASE WHEN a_ok AND b_ok THEN least(greatest({0}.y, 0), 899) ELSE {0}.y END}}"


@query(
    "fused_detection",
    _FUSED + f""", w AS (SELECT *, CASE WHEN sa >= sb THEN a ELSE b END AS win FROM g), z AS (SELECT *, list_sum(list_transform(win, lambda p: p.x)) / 4 AS mx, list_sum(list_transform(win, lambda p: p.y)) / 4 AS my FROM w),
n AS (SELECT *, list_transform(win, lambda p: {{'p': p, 'n': sqrt(pow(mx - p.x, 2) + pow(my - p.y, 2))}}) AS moved FROM z),
raws AS (SELECT * EXCLUDE (tl, tr, br, bl), CASE WHEN a_ok AND b_ok AND dist < 25 THEN list_transform(range(1, 5), lambda j: {{'x': (a[j].x + b[j].x) / 2, 'y': (a[j].y + b[j].y) / 2}})
  WHEN a_ok AND b_ok THEN list_transform(moved, lambda m: {{'x': CASE WHEN m.n > 0 THEN m.p.x + (mx - m.p.x) / m.n * 2 ELSE m.p.x END, 'y': CASE WHEN m.n > 0 THEN m.p.y + (my - m.p.y) / m.n * 2 ELSE m.p.y END}})
  WHEN b_ok AND NOT a_ok THEN list_transform(b, lambda p: {{'x': p.x, 'y': p.y}}) ELSE list_transform(a, lambda p: {{'x': p.x, 'y': p.y}}) END AS raw FROM n),
c4 AS (SELECT *, {_CORNER.format("raw[j].x + raw[j].y")} AS tl0, {_CORNER.format("raw[j].y - raw[j].x")} AS tr0, {_CORNER.format("-(raw[j].x + raw[j].y)")} AS br0, {_CORNER.format("-(raw[j].y - raw[j].x)")} AS bl0 FROM raws),
q4 AS (SELECT *, {_CLIP.format("tl0")} AS tl, {_CLIP.format("tr0")} AS tr, {_CLIP.format("br0")} AS br, {_CLIP.format("bl0")} AS bl FROM c4),
d4 AS (SELECT *, greatest(sqrt(pow(tr.x - tl.x, 2) + pow(tr.y - tl.y, 2)), sqrt(pow(br.x - bl.x, 2) + pow(br.y - bl.y, 2))) AS w, greatest(sqrt(pow(bl.x - tl.x, 2) + pow(bl.y - tl.y, 2)), sqrt(pow(br.x - tr.x, 2) + pow(br.y - tr.y, 2))) AS h,
  abs(tl.x * tr.y - tr.x * tl.y + tr.x * br.y - br.x * tr.y + br.x * bl.y - bl.x * br.y + bl.x * tl.y - tl.x * bl.y) / 2 * 1000000 / 1080000 AS area,
  CASE WHEN a_ok AND b_ok AND dist < 25 THEN 'agree' WHEN a_ok AND b_ok THEN 'winner' WHEN a_ok THEN 'first' WHEN b_ok THEN 'second' ELSE 'fallback' END AS branch FROM q4)
SELECT {_K}, branch, round({_RECT} + CASE branch WHEN 'agree' THEN 0.5 + least(dist, 25) / 50.0 WHEN 'winner' THEN 0.2 WHEN 'fallback' THEN 0.0 ELSE 0.1 END, 6) AS score, round(tl.x, 4) AS tlx, round(tl.y, 4) AS tly, round(br.x, 4) AS brx, round(br.y, 4) AS bry FROM d4""",
)
def fused_detection(spark, sf):
    f = geo.fused(F.col("q"), F.col("sa"), F.col("b"), F.col("sb"), F.col("q"), F.lit(1200.0), F.lit(900.0))
    at = lambda i, axis, name: F.round(F.get("f.contour", F.lit(i))[axis], 4).alias(name)
    out = _fusion(spark, sf).withColumn("f", f)
    return out.select(*KEY, F.col("f.branch").alias("branch"), F.round("f.score", 6).alias("score"), at(0, "x", "tlx"), at(0, "y", "tly"), at(2, "x", "brx"), at(2, "y", "bry"))


@query(
    "detector_scores",
    _ORD + f""" SELECT {_K}, round(r + 0.5 * t + least(l_linenumber / 50.0::DOUBLE, 0.5), 6) AS boosted, round(CASE WHEN {_RECT} <= -1e17 THEN -1e18 ELSE {_RECT} + 0.5 * r END, 6) AS blended, round(0.35 * r + 0.50 * t + 0.15::DOUBLE * sk, 6) AS aligned,
  round(CASE WHEN pw * ph / 1000000.0::DOUBLE BETWEEN 0.05 AND 0.97 AND abs(greatest(pw, ph) / greatest(least(pw, ph), 1) - {_RATIO}) / {_RATIO} <= 0.5 THEN pw * ph / 1000000.0::DOUBLE - abs(greatest(pw, ph) / greatest(least(pw, ph), 1) - {_RATIO}) / {_RATIO} * 0.8 + r * 0.3 ELSE -1e18 END, 6) AS boxed,
  round(CASE WHEN l_linenumber = 4 AND r BETWEEN 0.10 AND 0.97 THEN r - 0.8 * t ELSE -1e18 END, 6) AS contour FROM d""",
)
def detector_scores(spark, sf):
    r, t, rnd = F.col("r"), F.col("t"), lambda c, n: F.round(c, 6).alias(n)
    rect = geo.rect_score(F.col("q"), F.lit(1e6))
    return _quads(spark, sf).select(
        *KEY, rnd(geo.inlier_boost(r, t, F.col("l_linenumber")), "boosted"), rnd(geo.template_blend(rect, r), "blended"), rnd(geo.alignment_score(r, t, F.col("sk")), "aligned"),
        rnd(geo.yolo_score(F.col("pw"), F.col("ph"), F.lit(1e6), r), "boxed"), rnd(geo.contour_score(r, F.col("l_linenumber"), t), "contour"),
    )


#: methods in registration order, and whether they need a template
METHODS = (
    ("otsu_contour", False), ("adaptive_contour", False), ("canny_contour", False), ("grabcut", False), ("color_cluster", False), ("hough_lines", False), ("morph_gradient", False), ("yolo_card", False),
    ("sift_homography", True), ("akaze_homography", True), ("orb_homography", True), ("template_match", True), ("ensemble_best", True), ("pipeline_fused", True),
)
_METHODS = "(VALUES " + ", ".join(f"({i}, '{m}', {str(n).lower()})" for i, (m, n) in enumerate(METHODS)) + ") m(ord, method, needs_template)"
_RUNS = f"""WITH r AS (SELECT p_partkey AS image_id, ord, method, CASE WHEN needs_template AND p_partkey % 3 = 0 THEN -1e18 ELSE (p_partkey * (ord + 3) % 17)::DOUBLE / 16 END AS score FROM part, {_METHODS})"""


def _runs(spark, sf):
    """Every image with every method; those that need a template have no result where there is none."""
    methods = F.broadcast(spark.createDataFrame([(i, m, n) for i, (m, n) in enumerate(METHODS)], "ord int, method string, needs_template boolean"))
    images = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("image_id"))
    score = F.expr("CASE WHEN needs_template AND image_id % 3 = 0 THEN -1e18 ELSE CAST(image_id * (ord + 3) % 17 AS DOUBLE) / 16 END")
    return images.crossJoin(methods).withColumn("score", score)


def _table_images(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("image_id"))


@query("rank_methods", _RUNS + " SELECT image_id, method, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, ord)::INT AS rank FROM r")
def rank_methods(spark, sf):
    return rank.rank_by(_runs(spark, sf), ["image_id"], F.col("score").desc(), F.col("ord")).select("image_id", "method", "rank")


@query("best_method", _RUNS + " SELECT image_id, arg_max(method, struct_pack(s := score, o := -ord)) AS method FROM r GROUP BY image_id")
def best_method(spark, sf):
    return rank.best(_runs(spark, sf), ["image_id"], F.col("score"), F.col("ord"), F.col("method"), "method")


@query("ensemble_best", _RUNS + " SELECT image_id, arg_max(method, struct_pack(s := score, o := -ord)) AS method, max(score) AS score FROM r WHERE ord BETWEEN 8 AND 10 GROUP BY image_id")
def ensemble_best(spark, sf):
    three = _runs(spark, sf).where("ord BETWEEN 8 AND 10")
    return rank.best(three, ["image_id"], F.col("score"), F.col("ord"), F.struct("method", "score")).select("image_id", "best.method", "best.score")


@query("top_contours", _RUNS + " SELECT image_id, ord, k FROM (SELECT image_id, ord, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, ord)::INT AS k FROM r) WHERE k <= 5")
def top_contours(spark, sf):
    """The five largest contours of an image, by area, first on ties."""
    return rank.rank_by(_runs(spark, sf), ["image_id"], F.col("score").desc(), F.col("ord"), alias="k").where("k <= 5").select("image_id", "ord", "k")


@query("first_fit_epsilon", _RUNS + " SELECT image_id, min(ord) AS ord FROM r WHERE score BETWEEN 0.25 AND 0.5 GROUP BY image_id")
def first_fit_epsilon(spark, sf):
    """The first parameter of a sweep whose polygon has four corners."""
    return rank.first_fit(_runs(spark, sf), ["image_id"], F.col("score").between(0.25, 0.5), "ord")


@query(
    "best_alignment",
    _RUNS + """, b AS (SELECT image_id, arg_max(ord, struct_pack(s := score, o := -ord)) AS o, max(score) AS s FROM r WHERE ord < 3 GROUP BY image_id)
SELECT image_id, CASE WHEN image_id % 5 < 2 AND s < 0.10::DOUBLE THEN 'full_image' WHEN s <= -1e17 THEN NULL ELSE 'candidate_' || o::VARCHAR END AS choice FROM b""",
)
def best_alignment(spark, sf):
    """The best candidate; the whole image takes its place where it is eligible and the best is below 0.10."""
    runs = _runs(spark, sf).where("ord < 3").withColumn("name", F.concat(F.lit("candidate_"), F.col("ord").cast("string")))
    whole = _table_images(spark, sf).where("image_id % 5 < 2").withColumn("whole_score", F.lit(1.0))
    return rank.best_alignment(runs, ["image_id"], whole).select("image_id", F.col("name").alias("choice"))


@query(
    "corner_ordering",
    cte("v_quad") + f""", c AS (SELECT {_K}, r, t, sk, unnest(range(0, 6)) AS v FROM v_quad), s AS (SELECT *, 0.4::DOUBLE * r * (v % 3) + 0.6::DOUBLE * t * 10 * (v % 2) + CASE WHEN sk = v THEN 0.5 ELSE 0 END AS s FROM c)
SELECT {_K}, arg_max(v, struct_pack(s := s, o := -v))::INT AS ordering FROM s GROUP BY {_K}""",
)
def corner_ordering(spark, sf):
    """Six corner orders, scored by aspect, strip and a face in place."""
    c = view(spark, sf, "v_quad").withColumn("v", F.explode(F.array(*map(F.lit, range(6)))))
    s = geo.ordering_vote(F.expr("r * (v % 3)"), F.expr("t * 10 * (v % 2)"), F.expr("CASE WHEN sk = v THEN 0.5D ELSE 0D END"))
    return rank.best(c, KEY, s, F.col("v"), F.col("v"), "ordering")


@query(
    "scale_and_guards",
    cte("v_quad") + f""" SELECT {_K}, round(least(600 / pw, 400 / ph), 6) AS fit, round(least(least(1600 / pw, 1600 / ph), 4.0), 6) AS upscale, round(2048 / greatest(pw, ph, 2048), 6) AS shrink, pw - 40 >= greatest(20, 0.25::DOUBLE * pw) AND ph - 40 >= greatest(20, 0.25::DOUBLE * ph) AS refined,
  ph > 1.1::DOUBLE * pw AS turned, abs(pw / ph - {_RATIO}) / {_RATIO} <= 0.12 AS whole, round(px / 700, 6) AS nx, round_even((px / 700)::DECIMAL(18, 12), 4)::DOUBLE AS nx4, (py / 200 > 0.15 AND px / 300 < 0.40) AS face_ok FROM v_quad""",
)
def scale_and_guards(spark, sf):
    """Resize scales, crop and orientation guards, and normalised coordinates."""
    w, h, x, y = (F.col(c) for c in ("pw", "ph", "px", "py"))
    return view(spark, sf, "v_quad").select(
        *KEY, F.round(geo.fit_scale(w, h, 600, 400), 6).alias("fit"), F.round(geo.fit_scale(w, h, 1600, 1600, 4.0), 6).alias("upscale"), F.round(geo.shrink_scale(w, h, 2048), 6).alias("shrink"),
        geo.refined_ok(w - 40, h - 40, w, h).alias("refined"), geo.corners_turned(w, h).alias("turned"), geo.whole_image_ok(w, h).alias("whole"),
        F.round(F.get(geo.quad_norm(geo.quad((x, y)), F.lit(700.0), F.lit(700.0)), F.lit(0))["x"], 6).alias("nx"), geo.share(x, 700).alias("nx4"), ((y / 200 > 0.15) & (x / 300 < 0.40)).alias("face_ok"),
    )
