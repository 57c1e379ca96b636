"""Runs of chosen bytes over documents laid end to end."""

from __future__ import annotations

import numpy as np


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans; ranges are inclusive."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of marked bytes, cut at document bounds, and the number in each document."""
    before = np.zeros(len(inside) + 1, bool)
    before[1:] = inside
    before[offsets] = False  # a document's first byte has nothing before it
    start = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(inside) + 1, bool)
    after[:-1] = inside
    after[offsets] = False
    end = np.flatnonzero(inside & ~after[1:]) + 1
    return start, end, np.diff(np.searchsorted(start, offsets))
