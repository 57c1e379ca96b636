"""Rasters of one size as numpy stacks (n, h, w) inside a task: the pixel work of whole images, batch by batch.

A batch of rows is parted by size and into stacks of some ``PIXELS`` pixels, so a task holds one stack's arrays beside
the batch. Images that are null, hold nulls or don't have w * h values are left as null, or tell nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Pixels of a stack; an image of more is a stack of its own.
PIXELS = 500_000


def _parts(batch: pa.RecordBatch, column: str, room: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one size and their stack; an image takes the room of so many pixels at least."""
    v = batch.column(column)
    flat = v.values if isinstance(v, pa.ListArray) else v.flatten()
    off = np.asarray(v.offsets, np.int64)
    w, h = (np.asarray(batch.column(c).fill_null(0), np.int64) for c in "wh")
    whole = np.asarray(v.is_valid()) & (w > 0) & (h > 0) & (np.diff(off) == w * h)
    if flat.null_count:
        holes = np.append(0, np.cumsum(np.asarray(flat.is_null())))
        whole &= holes[off[1:]] == holes[off[:-1]]
        flat = flat.fill_null(0)
    values = np.asarray(flat)
    for width, height in np.unique(np.stack([w, h], 1)[whole], axis=0).tolist():
        rows = np.flatnonzero(whole & (w == width) & (h == height))
        step = max(1, PIXELS // max(width * height, room))
        for i in range(0, len(rows), step):
            some = rows[i : i + step]
            yield some, values[off[some][:, None] + np.arange(width * height)].reshape(-1, height, width)


def replaced(rasters: DataFrame, column: str, f: Callable[[np.ndarray], np.ndarray], alias: str | None = None, room: int = 1) -> DataFrame:
    """The rasters with ``column`` (or ``alias``) made of the stacks of ``column``."""
    alias = alias or column
    rest = [c for c in rasters.columns if c != alias]
    fields = [f"`{c}` {rasters.schema[c].dataType.simpleString()}" for c in rest] + [f"`{alias}` array<int>"]

    def rows(batches):
        for batch in batches:
            done = [np.empty(0, np.int64)]
            for some, stack in _parts(batch, column, room):
                done.append(some)
                new = np.ascontiguousarray(f(stack), np.int32).reshape(len(some), -1)
                at = pa.array(np.arange(len(some) + 1, dtype=np.int32) * new.shape[1])
                yield _beside(batch, rest, some, alias, pa.ListArray.from_arrays(at, pa.array(new.ravel())))
            left = np.setdiff1d(np.arange(batch.num_rows), np.concatenate(done))
            if len(left):
                yield _beside(batch, rest, left, alias, pa.nulls(len(left), pa.list_(pa.int32())))

    return rasters.mapInArrow(rows, ", ".join(fields))


def _beside(batch: pa.RecordBatch, rest: list[str], rows: np.ndarray, alias: str, column: pa.Array) -> pa.RecordBatch:
    at = pa.array(rows)
    return pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in rest] + [column], names=[*rest, alias])


def told(rasters: DataFrame, column: str, f: Callable[[np.ndarray], tuple[np.ndarray, dict[str, np.ndarray]]], schema: str) -> DataFrame:
    """image, w, h and what ``f`` tells of a stack: the place of the image there, and columns of ``schema``."""
    kinds = {c: rasters.schema[c].dataType.simpleString() for c in ("image", "w", "h")}

    def rows(batches):
        for batch in batches:
            for some, stack in _parts(batch, column):
                which, columns = f(stack)
                at = pa.array(some[which])
                yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in kinds] + [pa.array(c) for c in columns.values()], names=[*kinds, *columns])

    return rasters.select("image", "w", "h", column).mapInArrow(rows, ", ".join(f"{c} {k}" for c, k in kinds.items()) + f", {schema}")


def mirrored(at: np.ndarray, n: int) -> np.ndarray:
    """Places beyond a border reflected about the outermost pixel's centre, as often as it takes."""
    m = np.abs(at) % max(1, 2 * (n - 1))
    return np.where(m > n - 1, 2 * (n - 1) - m, m)


def level(v: np.ndarray) -> np.ndarray:
    """To whole levels, half to even; values next to a half count as one."""
    return np.rint(np.round(v, 6))


def blurred(v: np.ndarray, weights: list[float]) -> np.ndarray:
    """Weighted mean over a window, one axis after the other, rounded once at the end."""
    r = len(weights) // 2
    for axis in (2, 1):
        n, total = v.shape[axis], np.zeros(v.shape)
        for k, g in enumerate(weights):
            total += np.take(v, mirrored(np.arange(n) + k - r, n), axis) * g
        v = total
    return level(v).astype(np.int32)


def extreme(v: np.ndarray, size: int, largest: bool) -> np.ndarray:
    """Largest (or least) value over size x size pixels, cut at the border."""
    pick = np.maximum if largest else np.minimum
    for axis in (2, 1):
        out = v.copy()
        for d in range(1, min(size // 2, v.shape[axis] - 1) + 1):
            ahead, behind = (slice(None),) * axis + (slice(d, None),), (slice(None),) * axis + (slice(None, -d),)
            pick(out[behind], v[ahead], out=out[behind])
            pick(out[ahead], v[behind], out=out[ahead])
        v = out
    return v


def over_otsu(v: np.ndarray, inverted: bool = False) -> np.ndarray:
    """1 over each image's own Otsu level, the first of equal ones that occur, 0 up to it (or the other way round)."""
    n, flat = len(v), v.reshape(len(v), -1)
    count = np.bincount((flat + 256 * np.arange(n)[:, None]).ravel(), minlength=256 * n).reshape(n, 256)
    below, mass = np.cumsum(count, 1), np.cumsum(count * np.arange(256), 1)
    above = below[:, -1:] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = mass / below - (mass[:, -1:] - mass) / above
        spread = np.where(above > 0, below * above * apart * apart, 0.0)
    best = np.where(count > 0, np.round(spread, 6), -1.0).argmax(1)
    over = flat > best[:, None]
    return (~over if inverted else over).astype(np.int32).reshape(v.shape)


def states(v: np.ndarray, low: int, high: int, flat: int, steep: int) -> np.ndarray:
    """2 for a strong edge pixel, 1 for a weak one, 0 for none: 3 x 3 Sobel with the border repeated, largest across the edge."""
    p = np.pad(v, ((0, 0), (1, 1), (1, 1)), "edge").astype(np.int64)
    across, down = p[:, :, 2:] - p[:, :, :-2], p[:, 2:] - p[:, :-2]
    gx = across[:, :-2] + 2 * across[:, 1:-1] + across[:, 2:]
    gy = down[:, :, :-2] + 2 * down[:, :, 1:-1] + down[:, :, 2:]
    m = np.abs(gx) + np.abs(gy)
    q = np.pad(m, ((0, 0), (1, 1), (1, 1)))
    at = lambda dx, dy: q[:, 1 + dy : q.shape[1] - 1 + dy, 1 + dx : q.shape[2] - 1 + dx]
    ax, ay = np.abs(gx), np.abs(gy) << 15
    falls = (gx < 0) != (gy < 0)
    rising, falling = (m > at(-1, -1)) & (m > at(1, 1)), (m > at(1, -1)) & (m > at(-1, 1))
    peak = np.where(ay < ax * flat, (m > at(-1, 0)) & (m >= at(1, 0)), np.where(ay > ax * steep, (m > at(0, -1)) & (m >= at(0, 1)), np.where(falls, falling, rising)))
    return ((m > low) & peak) * (1 + (m > high)).astype(np.int32)


def runs(mask: np.ndarray, least: int = 1) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Maximal horizontal runs of values of at least ``least``, by image and first pixel."""
    w = mask.shape[2]
    p = np.pad(mask >= least, ((0, 0), (0, 0), (1, 1)))
    on = p[:, :, 1:-1]
    image, y, x1 = np.nonzero(on & ~p[:, :, :-2])
    x2 = np.nonzero(on & ~p[:, :, 2:])[2]
    start = (image * mask.shape[1] + y) * w + x1
    top = np.maximum.reduceat(np.append(mask.ravel(), 0), np.stack([start, start + x2 - x1 + 1], 1).ravel())[::2] if len(start) else start
    return image, {"run": y * w + x1, "y": y.astype(np.int32), "x1": x1.astype(np.int32), "x2": x2.astype(np.int32), "top": top.astype(np.int32)}


def regions(image: np.ndarray, of: dict[str, np.ndarray], gap: int = 1) -> np.ndarray:
    """For each run the place of the first run of its connected region; ``gap`` 1 joins corners too.

    Runs that touch take the least place of both and of what both hang on, until none changes; hanging on the least
    of a whole tree, rounds grow with the logarithm of the longest path.
    """
    n = len(image)
    if not n:
        return np.empty(0, np.int64)
    line = image * (int(of["y"].max()) + 2) + of["y"]
    wide = int(of["x2"].max()) + 4
    x1, x2 = of["x1"].astype(np.int64), of["x2"].astype(np.int64)
    first = np.searchsorted(line * wide + x2, (line + 1) * wide + x1 - gap, "left")
    met = np.maximum(np.searchsorted(line * wide + x1, (line + 1) * wide + x2 + gap, "right") - first, 0)
    a = np.repeat(np.arange(n), met)
    b = np.repeat(first - np.cumsum(met) + met, met) + np.arange(met.sum())
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        least, new = np.minimum(ra, rb), root.copy()
        for to in (a, b, ra, rb):
            np.minimum.at(new, to, least)
        while not np.array_equal(new, hop := new[new]):
            new = hop
        if np.array_equal(new, root):
            return root
        root = new
