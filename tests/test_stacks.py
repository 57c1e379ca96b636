"""Whole-image work stays in the images' tasks, and these are many."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from vouchline.operators import contrast, edges, outlines, pixels, stacks
from vouchline.plans.adapters import view

SF = "/root/testdata/sf0.01"
RASTER = "image int, w int, h int, v array<int>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_images_are_dealt_to_many_tasks(spark):
    tasks = view(spark, SF, "v_raster").groupBy(F.spark_partition_id()).count().count()
    assert tasks > 4


def test_equalising_shuffles_nothing_and_keeps_odd_images(spark):
    rows = [(1, 8, 8, [9] * 64), (2, 8, 8, [9] * 63), (3, 8, 8, None), (4, 1, 1, [200]), (5, 0, 0, []), (6, 2, 1, [3, None])]
    got = contrast.equalised(spark.createDataFrame(rows, RASTER))
    assert "Exchange" not in plan(got)
    got = {r.image: r.v for r in got.collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6} and len(got[1]) == 64 and len(got[4]) == 1
    assert got[2] is got[3] is got[6] is None


def test_places_are_mirrored_as_often_as_it_takes():
    assert stacks.mirrored(np.arange(-4, 6), 2).tolist() == [0, 1, 0, 1, 0, 1, 0, 1, 0, 1]
    assert stacks.mirrored(np.arange(-2, 7), 5).tolist() == [2, 1, 0, 1, 2, 3, 4, 3, 2]
    assert stacks.mirrored(np.arange(-2, 3), 1).tolist() == [0] * 5


def test_edges_stay_in_the_image_and_equal_plain_floods(spark):
    rng = np.random.default_rng(5)
    rows = [(i, w, h, rng.integers(0, 80, w * h).tolist()) for i, (w, h) in enumerate(((9, 7), (16, 12), (1, 5), (2, 2)))] + [(9, 3, 3, None)]
    df = spark.createDataFrame(rows, RASTER)
    found = edges.canny(df, 60, 150)
    assert "Exchange" not in plan(found)
    states = {r.image: r.state for r in edges.edge_states(df, 60, 150).collect()}
    want = set()
    for i, w, h, _ in rows[:4]:
        todo, seen = [k for k, s in enumerate(states[i]) if s == 2], set()
        while todo:
            k = todo.pop()
            if k not in seen:
                seen.add(k)
                x, y = k % w, k // w
                todo += [b * w + a for a in range(max(x - 1, 0), min(x + 2, w)) for b in range(max(y - 1, 0), min(y + 2, h)) if states[i][b * w + a]]
        want |= {(i, k % w, k // w) for k in seen}
    assert {tuple(r) for r in edges.points(found).collect()} == want and want


def test_regions_of_stacks_are_those_of_the_joins(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, 14, 11, (rng.random(154) < 0.4).astype(int).tolist()) for i in range(5)], "image int, w int, h int, mask array<int>")
    for diagonal in (True, False):
        joined = edges.regions(edges.runs(df, "mask"), diagonal).select("image", "run", "region", "x2", "top")
        assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, edges.mask_regions(df, "mask", diagonal).select("image", "run", "region", "x2", "top").collect()))


def test_an_images_votes_are_counted_in_one_task(spark, monkeypatch):
    points = spark.createDataFrame([(7, 3, y) for y in range(12)] + [(7, x, 5) for x in range(20)] + [(8, 1, 1), (8, None, 2)], "image int, x int, y int")
    lines = edges.hough_lines(points, 10)
    assert plan(lines).count("Exchange hashpartitioning") == 1  # the points', never the votes'
    at = [(3, y) for y in range(12)] + [(x, 5) for x in range(20)]
    votes = Counter((k, round(round(x * math.cos(k * math.pi / 180) + y * math.sin(k * math.pi / 180), 6))) for x, y in at for k in range(180))
    want = {(7, k, r, n) for (k, r), n in votes.items() if n >= 10 and n > max(votes[k - 1, r], votes[k, r - 1]) and n >= max(votes[k + 1, r], votes[k, r + 1])}
    assert {tuple(r) for r in lines.collect()} == want
    x, y = np.array(at).T
    whole = edges._lines(x, y, 10, 180)
    monkeypatch.setattr(edges, "_VOTES", 500)  # an image's points piece by piece
    assert all(map(np.array_equal, whole, edges._lines(x, y, 10, 180)))


def test_segments_of_a_line_end_at_gaps(spark):
    points = spark.createDataFrame([(7, 3, y) for y in (*range(12), *range(20, 33), 40)], "image int, x int, y int")
    got = {tuple(r)[2:] for r in edges.hough_segments(points, 20, 8, 2).collect()}
    assert {(3, 0, 3, 11), (3, 20, 3, 32)} <= got and not any(40 in s for s in got)


def test_otsu_masks_shuffle_nothing_and_take_the_first_best_level(spark):
    rng = np.random.default_rng(7)
    rows = [(1, 9, 8, rng.choice([20, 25, 180, 200], 72).tolist()), (2, 4, 1, [0, 0, 255, 255]), (3, 2, 2, [7] * 4)]
    masks = outlines.otsu_mask(spark.createDataFrame(rows, RASTER))
    assert "Exchange" not in plan(masks)
    levels = {r.image: r.level for r in pixels.otsu(masks.select("image", F.explode("v").alias("v"))).collect()}
    for r in masks.collect():
        assert r["mask"] == [int(v > levels[r.image]) for v in rows[r.image - 1][3]]


def cut(ring, keep, tolerance):
    """The corners of a ring by recursion, from two to start with."""
    n, more = len(ring), set(keep)
    for i, j in zip(keep, [*keep[1:], keep[0] + n], strict=True):
        (ax, ay), (bx, by) = ring[i], ring[j % n]
        span = math.hypot(bx - ax, by - ay)
        off = [(abs((bx - ax) * (ay - y) - (ax - x) * (by - ay)) / span if span else math.hypot(x - ax, y - ay), -k) for k in range(i + 1, j) for x, y in (ring[k % n],)]
        if off and max(off)[0] > tolerance:
            more.add(-max(off)[1] % n)
    return keep if len(more) == len(keep) else cut(ring, sorted(more), tolerance)


def test_outlines_are_simplified_in_one_pass_over_all(spark):
    rng = np.random.default_rng(8)
    rings = [[tuple(map(float, p)) for p in rng.integers(0, 30, (n, 2))] for n in (1, 2, 3, 9, 40, 80)] + [[(1.0, 2.0)] * 4]
    far = lambda r, i: min(range(len(r)), key=lambda k: (-math.dist(r[k], r[i]), k))
    rows = [(i, r, t) for i, r in enumerate(rings) for t in (0.0, 1.5, 6.0)] + [(99, [], 1.0), (98, None, 1.0)]
    found = outlines.simplified(spark.createDataFrame(rows, "i int, o array<struct<x:double,y:double>>, eps double"), "o", "eps")
    assert "MapInArrow" in plan(found)
    got = {(r.i, r.eps): [tuple(p) for p in r.polygon] for r in found.collect()}
    for i, r, t in rows[:-2]:
        p = far(r, far(r, 0))
        assert got[i, t] == [r[k] for k in cut(r, sorted({p, far(r, p)}), t)], (i, t)
    assert got[99, 1.0] == got[98, 1.0] == []
