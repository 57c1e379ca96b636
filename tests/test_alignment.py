"""Homographies, consensus, merging, edges and lines against plain computations."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from vouchline.functions import geometry as geo
from vouchline.functions import homography as hg
from vouchline.functions import text
from vouchline.operators import boxes, connect, edges, faces, ocr, outlines, ransac, raster


def solved(source, target):
    """The eight equations of four point pairs."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1.0)


def test_homography_solves_the_eight_equations(spark):
    rng = np.random.default_rng(2)
    pairs = []
    for i in range(40):
        square = np.array([[0, 0], [100, 0], [100, 60], [0, 60]], float)
        pairs.append((i, (square + rng.uniform(-20, 20, (4, 2))).tolist(), (square * 3 + rng.uniform(-40, 40, (4, 2))).tolist()))
    pairs.append((99, [[0, 0], [10, 10], [20, 20], [0, 5]], [[0, 0], [1, 0], [1, 1], [0, 1]]))  # three in line
    pairs.append((98, [[0, 0], [1, 0], [1, 1], [0, 1]], [[5, 5], [5, 5], [9, 9], [5, 9]]))
    df = spark.createDataFrame([(i, *([{"x": float(p[0]), "y": float(p[1])} for p in q] for q in (a, b))) for i, a, b in pairs], "i int, a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>")
    got = {r.i: r.m for r in hg.with_homography(df, "a", "b").collect()}
    assert got[99] is None and got[98] is None
    for i, a, b in pairs[:40]:
        assert np.allclose(got[i], solved(a, b), rtol=1e-9, atol=1e-9)
    assert {r.i for r in hg.only_mapped(hg.with_homography(df, "a", "b")).collect()} == set(range(40))


def test_ransac_rejects_strays_at_any_partitioning(spark):
    rng = np.random.default_rng(6)
    m = np.array([1.1, 0.1, 20, 0.05, 0.9, 10, 0.0003, 0.0001, 1])
    rows = []
    for i in range(60):
        x, y = rng.uniform(0, 400, 2).tolist()
        w = m[6] * x + m[7] * y + 1
        u, v = (m[0] * x + m[1] * y + m[2]) / w, (m[3] * x + m[4] * y + m[5]) / w
        rows.append((1, i, x, y, *((float(rng.uniform(0, 400)), float(rng.uniform(0, 400))) if i % 3 == 0 else (float(u), float(v)))))
    rows += [(2, i, float(i), 0.0, float(i), 0.0) for i in range(10)] + [(3, i, 0.0, 1.0, 2.0, 3.0) for i in range(3)]  # all in line, and three only
    kind = "image int, pos int, x0 double, y0 double, x1 double, y1 double"
    sizes = spark.createDataFrame([(k, 400, 300, 500, 400) for k in (1, 2, 3, 4)], "image int, w0 int, h0 int, w1 int, h1 int")
    results = []
    for parts in (1, 5):
        found = ransac.ransac(spark.createDataFrame(rows, kind).repartition(parts), ["image"], "pos", sizes)
        results.append({r.image: r.asDict(recursive=True) for r in found.collect()})
    assert results[0] == results[1]
    one = results[0][1]
    assert one["ok"] and one["inliers"] == 40 and math.isclose(one["inlier_ratio"], 2 / 3)
    assert np.allclose(one["m"], m, atol=1e-6) and 0 < one["quad_area_ratio"] < 2
    for k in (2, 3, 4):
        assert results[0][k] == {"image": k, "ok": False, "m": None, "quad": None, "inliers": 0, "inlier_ratio": 0.0, "quad_area_ratio": 0.0}


def slow_merge(rows, gap):
    todo = [[*r, 1] for r in rows]
    while True:
        for a, b in itertools.combinations(todo, 2):
            if max(a[0], b[0]) - gap < min(a[2], b[2]) + gap and max(a[1], b[1]) - gap < min(a[3], b[3]) + gap:
                todo = [c for c in todo if c is not a and c is not b] + [[min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]), a[4] + b[4]]]
                break
        else:
            return sorted(map(tuple, todo))


def test_boxes_merge_to_the_fixpoint(spark):
    rng = np.random.default_rng(9)
    pages = {p: [(int(x), int(y), int(x + w), int(y + h)) for x, y, w, h in zip(*(rng.integers(0, m, n) for m in (400, 300, 40, 30)), strict=True)] for p, n in ((1, 5), (2, 40), (3, 1))}
    pages[4] = [(0, 0, 10, 100), (0, 90, 100, 100), (50, 20, 60, 30), (50, 20, 60, 30)]  # the L's box takes in what neither arm meets
    df = spark.createDataFrame([(p, *b) for p, bs in pages.items() for b in bs], "page int, x1 int, y1 int, x2 int, y2 int")
    for gap in (0, 8):
        got = {}
        for r in boxes.merge_boxes(df, "page", gap).collect():
            got.setdefault(r.page, []).append(tuple(r)[1:])
        assert {p: sorted(b) for p, b in got.items()} == {p: slow_merge(bs, gap) for p, bs in pages.items()}
    assert boxes.merge_boxes(df.limit(0), "page", 2).count() == 0


def test_components_of_chains_and_lone_nodes(spark):
    nodes = spark.createDataFrame([(g, n) for g in (1, 2) for n in range(40)], "g int, n long")
    links = spark.createDataFrame([(1, n, n + 1) for n in range(0, 30)] + [(2, 39, 5), (2, 5, 20)], "g int, a long, b long")
    got = {(r.g, r.n): r.region for r in connect.components(nodes, links, ["g"], "n").collect()}
    assert all(got[1, n] == (0 if n <= 30 else n) for n in range(40))
    assert all(got[2, n] == (5 if n in (5, 20, 39) else n) for n in range(40))


def test_warp_mixes_neighbours_and_knows_its_border(spark):
    df = spark.createDataFrame([(1, 3, 2, [0, 100, 200, 50, 60, 70], [1.0, 0.0, 0.5, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]), (2, 1, 1, [9], None)], "image int, w int, h int, v array<int>, m array<double>")
    got = {r.image: r.v for r in raster.warp(df, "m", 3, 2).collect()}
    assert got == {1: [50, 150, 100, 55, 65, 35], 2: None}


def test_blur_keeps_flat_images_and_weighs_like_a_bell(spark):
    spike = [0] * 81
    spike[40] = 255
    df = spark.createDataFrame([(1, 9, 9, [7] * 81), (2, 9, 9, spike), (3, 1, 1, [5])], "image int, w int, h int, v array<int>")
    got = {r.image: r.v for r in raster.blur(df, 5).collect()}
    g = raster.gaussian_weights(5)
    assert got[1] == [7] * 81 and got[3] == [5] and got[2][40] == round(255 * g[2] * g[2]) and got[2][38] == round(255 * g[0] * g[2]) and got[2][20] == round(255 * g[0] * g[0])


def test_canny_needs_a_strong_pixel_and_lines_are_found(spark):
    strong = [0 if x < 10 else 200 for y in range(20) for x in range(20)]
    weak = [0 if x < 10 else 20 for y in range(20) for x in range(20)]
    joined = [0 if x < 10 else (200 if y < 10 else 20) for y in range(20) for x in range(20)]
    df = spark.createDataFrame([(1, 20, 20, strong), (2, 20, 20, weak), (3, 20, 20, joined), (4, 20, 20, [5] * 400)], "image int, w int, h int, v array<int>")
    found = edges.canny(df, 40, 200)
    rows = {}
    for r in edges.points(found).collect():
        rows.setdefault(r.image, set()).add((r.x, r.y))
    assert rows[1] == {(9, y) for y in range(20)} or rows[1] == {(10, y) for y in range(20)}
    assert 2 not in rows and 4 not in rows  # weak only, and none
    assert len({y for _, y in rows[3]}) == 20  # the weak half hangs on the strong one
    lines = {(r.image, r.angle, r.rho): r.votes for r in edges.hough_lines(edges.points(found), 15).collect()}
    x = next(iter(rows[1]))[0]
    assert lines[1, 0, x] == 20
    segment = edges.hough_segments(edges.points(found), 15, 10, 2).where("image = 1").orderBy("pos").first()
    assert {segment.y1, segment.y2} == {0, 19} and segment.x1 == segment.x2 == x


def test_a_third_line_beyond_the_labels_own_height_stays_out(spark):
    rows = [(1, 0, "البطاقة", 0.0, 20.0), (1, 1, "سارية حتى", 20.0, 40.0), (1, 2, "2030-01-02", 40.0, 20.0), (2, 0, "البطاقة", 0.0, 0.0), (2, 1, "حتى", 1.0, 5.0), (2, 2, "2030-01-02", 1.3, 5.0)]
    df = spark.createDataFrame(rows, "c int, pos int, line string, cy double, h double")
    got = {(r.c, r.pos): (r.merged, r.date) for r in ocr.expiry_anchors(df, ["c"], "pos", "line", F.col("cy"), F.col("h")).collect()}
    assert "2030" not in got[1, 0][0] and got[1, 1][1] == "20300102"
    assert got[2, 0][1] == "20300102"  # no height counts as one pixel, and 1.3 is the last place


def test_dates_have_two_digits_for_month_and_day(spark):
    df = spark.createDataFrame([("2024/5/6",), ("2024/05/6",), ("2024/05/06",), ("2024/13/01 20240507",)], "t string")
    assert [r.d for r in df.select(text.extract_yyyymmdd(F.col("t")).alias("d")).collect()] == ["", "", "20240506", "20240507"]


def test_area_of_a_flat_quad(spark):
    flat = geo.quad(*((F.lit(1.0), F.lit(2.0)),) * 4)
    assert spark.range(1).select(geo.polygon_area(flat).alias("a")).first().a == 0.0


def test_closing_fills_small_gaps_only(spark):
    row = [1, 1, 0, 1, 1, 0, 0, 0, 0, 1, 1]
    df = spark.createDataFrame([(1, 11, 3, row * 3)], "image int, w int, h int, mask array<int>")
    assert outlines.closed(df, "mask", 3).first()["mask"] == [1, 1, 1, 1, 1, 0, 0, 0, 0, 1, 1] * 3
    assert outlines.closed(df, "mask", 3, 2).first()["mask"] == [1] * 33


def test_regions_touch_at_corners_and_outlines_are_simplified(spark):
    picture = [
        "##......",
        "##......",
        "..####..",  # touches the square above at a corner only
        "..####..",
        "......#.",
    ]
    mask = [int(c == "#") for line in picture for c in line]
    runs = edges.runs(spark.createDataFrame([(1, 8, 5, mask)], "image int, w int, h int, mask array<int>"), "mask")
    assert runs.count() == 5
    assert edges.regions(runs).select("region").distinct().count() == 1
    assert edges.regions(runs, diagonal=False).select("region").distinct().count() == 3
    ring = [(float(x), 0.0) for x in range(21)] + [(20.0, float(y)) for y in range(1, 11)] + [(float(x), 10.0) for x in range(19, -1, -1)] + [(0.0, float(y)) for y in range(9, 0, -1)]
    ring[5] = (5.0, 1.0)  # a dent of one pixel
    df = spark.createDataFrame([(e, ring, float(e)) for e in (2, 0)], "i int, o array<struct<x:double,y:double>>, eps double")
    got = {r.i: {(p.x, p.y) for p in r.polygon} for r in outlines.simplified(df, "o", "eps").collect()}
    corners = {(0.0, 0.0), (20.0, 0.0), (20.0, 10.0), (0.0, 10.0)}
    assert got[2] == corners and corners | {(5.0, 1.0)} < got[0]


def test_failed_attempts_vote_against_and_keep_their_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0, None, 0.3, 0.5, 2), (1, 1, "no face", 0.1, 0.5, 3), (1, 2, None, None, 0.5, 4), (1, 3, None, 0.5, 0.5, 5), (2, 0, None, nan, 0.5, 1), (2, 1, None, 0.1, inf, 1), (3, 0, None, 0.1, 0.2, 1), (3, 1, None, 0.2, 0.2, 1)]
    report = faces.attempts(spark.createDataFrame(rows, "c int, o int, error string, distance double, threshold double, elapsed int"))
    got = {(r.c, r.o): (r.status, r.passed, r.distance, r.threshold_margin) for r in report.collect()}
    assert got[1, 1] == ("error", False, None, None) and got[1, 2] == ("ok", False, None, None) and got[1, 3] == ("ok", True, 0.5, 0.0)
    assert got[2, 0] == ("ok", False, None, None) and got[2, 1] == ("ok", False, 0.1, None)
    decided = {r.c: (r.passed, r.failed, r.elapsed) for r in faces.decision(report, ["c"], "o").collect()}
    assert decided == {1: (False, 1, 14), 2: (False, 0, 2), 3: (True, 0, 2)}
