"""Consensus makes no rows of rounds: matches are shuffled once and a group is worked on piece by piece."""

import numpy as np

from vouchline.operators import ransac
from vouchline.plans.raster_queries import ransac_homography


def test_rounds_are_no_rows_and_lines_are_shuffled_once(spark):
    plan = ransac_homography(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning") == 2  # the lines, and the distinct suppliers


def test_pieces_choose_and_count_the_same(monkeypatch):
    rng = np.random.default_rng(4)
    match = rng.integers(-(2**62), 2**62, 300)
    p = rng.uniform(0, 300, (4, 300))
    p[2:, :200] = p[:2, :200] * 1.5 + 7
    whole, best = ransac.chosen(match, 16), ransac.consensus(match, p, 64, 4.0)
    h = ransac._mixed(match, 16)
    assert np.array_equal(whole, np.argsort(h, 1)[:, :4])
    assert best[1] >= 200 and np.allclose(best[0], [1.5, 0, 7, 0, 1.5, 7, 0, 0, 1], atol=1e-6)
    monkeypatch.setattr(ransac, "PAIRS", 100)
    assert np.array_equal(whole, ransac.chosen(match, 16))
    again = ransac.consensus(match, p, 64, 4.0)
    assert again[1] == best[1] and np.array_equal(again[0], best[0])
    assert ransac.consensus(match[:3], p[:, :3], 64, 4.0) is None and ransac.consensus(match, p * 0, 64, 4.0) is None
