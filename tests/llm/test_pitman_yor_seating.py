"""Table counts drawn against enumeration of the conditional; numbers of long queues against the recurrence."""

import itertools
import math

import numpy as np
import pytest

from vouchline.llm import pitman_yor as py

D, STRENGTH = 0.8, 1.0


def enumerated(c, other, above):
    """P(t) over all ways to sit down one after the other, unnormalised weights multiplied."""
    weight = np.zeros(c)
    for opens in itertools.product((False, True), repeat=c - 1):
        t, w = 1, 1.0
        for n, new in enumerate(opens, 1):
            w *= (STRENGTH + D * (other + t)) * above if new else n - D * t
            t += new
        weight[t - 1] += w
    return weight / weight.sum()


@pytest.mark.parametrize("c, other, above", [(2, 3, 0.2), (6, 50, 0.02), (9, 400, 0.01), (9, 0, 0.9)])
def test_small_queues_follow_the_conditional(c, other, above):
    n = 40_000
    t = py.reseat(np.full(n, c), np.full(n, other), np.full(n, above), D, STRENGTH, np.random.default_rng(5))
    want = enumerated(c, other, above)
    got = np.bincount(t, minlength=c + 1)[1:] / n
    assert (np.abs(got - want) < 5 * np.sqrt(want * (1 - want) / n) + 1e-4).all()


@pytest.mark.parametrize("c, other, above", [(100, 1000, 0.001), (500, 10_000, 0.001), (1500, 10_000, 0.001), (1500, 100_000, 0.05), (1500, 0, 0.9)])
def test_long_queues_follow_the_conditional(c, other, above):
    row = np.zeros(1)
    for k in range(1, c):
        row = np.logaddexp(np.append(row + np.log(k - D * np.arange(1, k + 1)), -np.inf), np.append(-np.inf, row))
    weight = row + np.cumsum(np.log((STRENGTH + D * (other + np.arange(c))) * above))
    p = np.exp(weight - weight.max())
    p /= p.sum()
    mean = p @ np.arange(1, c + 1)
    sd = math.sqrt(p @ (np.arange(1, c + 1) - mean) ** 2)
    n = 4000
    t = py.reseat(np.full(n, c), np.full(n, other), np.full(n, above), D, STRENGTH, np.random.default_rng(6))
    assert abs(t.mean() - mean) < 5 * sd / math.sqrt(n) and abs(t.std() - sd) < 0.1 * sd
