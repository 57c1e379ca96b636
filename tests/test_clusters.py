"""Clusters against Lloyd's rounds over all pixels; a card found in the mask of its own cluster."""

import random

import numpy as np
from pyspark.sql import functions as F

from vouchline.operators import clusters, raster


def lloyd(pixels, k, rounds=clusters.ROUNDS):
    p = np.array(sorted(pixels, key=lambda c: (sum(c), c)), float)
    centres = np.array([p[-(-(2 * j + 1) * len(p) // (2 * k)) - 1] for j in range(k)])
    label = lambda: ((p[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
    for _ in range(rounds):
        near = label()
        centres = np.array([p[near == j].mean(0) if (near == j).any() else centres[j] for j in range(k)])
    return centres, np.bincount(label(), minlength=k)


def test_colours_of_three_channels(spark):
    rng = random.Random(8)
    images = {1: [tuple(rng.choice((20, 120, 230)) + rng.randint(-9, 9) for _ in range(3)) for _ in range(120)], 2: [(5, 5, 5)] * 7 + [(9, 1, 1)] * 2}
    rows = [(i, list(c), 1) for i, ps in images.items() for c in ps]
    seen = spark.createDataFrame(rows, "image int, v array<int>, one int").groupBy("image", "v").agg(F.count("one").alias("n"))
    got = {}
    for r in clusters.clusters(seen).orderBy("ord").collect():
        got.setdefault((r.image, r.k), []).append((r.centre, r.n))
    assert sorted(got) == [(i, k) for i in (1, 2) for k in clusters.CLUSTERS]
    for (i, k), found in got.items():
        centres, n = lloyd(images[i], k)
        assert np.allclose([c for c, _ in found], centres) and [m for _, m in found] == n.tolist()
        assert sum(m for _, m in found) == len(images[i])
    assert clusters.clusters(seen.limit(0)).count() == 0


def test_card_between_two_grounds(spark):
    """No single threshold parts a middle grey card from a ground that is darker on one side and brighter on the other."""
    w, h = 48, 40
    levels = [120 if 10 <= x <= 36 and 8 <= y <= 30 else 20 if x < 24 else 230 for y in range(h) for x in range(w)]
    slim = spark.createDataFrame([(1, w, h, levels)], "image int, w int, h int, v array<int>")
    found = clusters.clusters(raster.histogram(slim).select("image", F.array("v").alias("v"), "n"), (3,))
    (quad,) = clusters.cluster_quads(slim, found, 3, 1).collect()
    assert quad.ord == 1 and quad.k == 3
    corners = {(round(p.x), round(p.y)) for p in quad.contour}
    assert all(min(abs(a - x) + abs(b - y) for x, y in corners) <= 2 for a, b in ((10, 8), (36, 8), (36, 30), (10, 30)))
