"""Contrast-limited equalisation of whole images: clipped histograms of tiles, their lookups, and a blend of four."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from vouchline.operators import stacks

LEVELS = 256


def tile_lookups(v: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """A stack of images -> (n, tiles, tiles, 256): each tile's level for every level.

    Unless both sides are multiples of ``tiles``, the image is continued to the next one on both (by a whole ``tiles``
    where a side is one already), mirrored at its last pixels. A level's count over the limit is dealt to all levels
    evenly, what is left of it to every so-manieth.
    """
    n, h, w = v.shape
    tw, th = tile_sides(w, h, tiles)
    area, last = tw * th, lambda k: np.maximum(np.where(np.arange(k[1]) > k[0] - 1, 2 * (k[0] - 1) - np.arange(k[1]), np.arange(k[1])), 0)
    wide = v[:, last((h, th * tiles))][:, :, last((w, tw * tiles))]
    tile = np.arange(tiles).repeat(th)[:, None] * tiles + np.arange(tiles).repeat(tw)
    at = (np.arange(n)[:, None, None] * tiles * tiles + tile) * LEVELS + wide
    full = np.bincount(at.ravel(), minlength=n * tiles * tiles * LEVELS).reshape(-1, LEVELS)
    limit = max(1, int(clip * area / LEVELS))
    over = np.maximum(full - limit, 0).sum(1, keepdims=True)
    rest = over % LEVELS
    step, l = LEVELS // np.maximum(rest, 1), np.arange(LEVELS)
    flat = np.minimum(full, limit) + over // LEVELS + ((l % step == 0) & (l // step < rest))
    return np.minimum(stacks.level(np.cumsum(flat, 1) * (LEVELS - 1) / area), LEVELS - 1).reshape(n, tiles, tiles, LEVELS)


def tile_sides(w: int, h: int, tiles: int) -> tuple[int, int]:
    even = w % tiles == 0 and h % tiles == 0
    return tuple(n // tiles if even else (n + tiles - n % tiles) // tiles for n in (w, h))


def equalised(rasters: DataFrame, clip: float = 2.0, tiles: int = 8) -> DataFrame:
    """v becomes the blend of what the four tiles around a pixel make of its level, by their centres' nearness; at the border of fewer.

    An image's lookups are made and used in its own task; nothing is shuffled.
    """

    def blend(v: np.ndarray) -> np.ndarray:
        n, h, w = v.shape
        luts = tile_lookups(v, clip, tiles)
        fx, fy = (np.arange(k) / side - 0.5 for k, side in zip((w, h), tile_sides(w, h, tiles), strict=True))
        x0, y0 = np.floor(fx).astype(int), np.floor(fy).astype(int)
        a, b = fx - x0, (fy - y0)[:, None]
        clamp = lambda k: np.clip(k, 0, tiles - 1)
        at = lambda y, x: luts[np.arange(n)[:, None, None], clamp(y)[:, None], clamp(x), v]
        mixed = (at(y0, x0) * (1 - a) + at(y0, x0 + 1) * a) * (1 - b) + (at(y0 + 1, x0) * (1 - a) + at(y0 + 1, x0 + 1) * a) * b
        return np.minimum(stacks.level(mixed), LEVELS - 1)

    return stacks.replaced(rasters, "v", blend, room=tiles * tiles * LEVELS)
