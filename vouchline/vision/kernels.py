"""Raster and geometry kernels on numpy arrays, for use inside pandas UDFs."""

from __future__ import annotations

import numpy as np


def gray(bgr: np.ndarray) -> np.ndarray:
    """Luma of a BGR raster; single-channel rasters pass."""
    return bgr.astype(np.float64) if bgr.ndim == 2 else bgr[..., :3].astype(np.float64) @ np.array([0.114, 0.587, 0.299])


def rotate(image: np.ndarray, degrees: int) -> np.ndarray:
    """Clockwise quarter turns only."""
    if degrees % 90:
        raise ValueError(f"rotation {degrees} is no multiple of 90")
    return np.rot90(image, -(degrees // 90) % 4)


def fit_within(w: int, h: int, most: int) -> float:
    """Scale that brings the longer side down to ``most``; never up."""
    return min(1.0, most / max(w, h))


def resize_nearest(image: np.ndarray, w: int, h: int) -> np.ndarray:
    ys = np.minimum((np.arange(h) + 0.5) * image.shape[0] / h, image.shape[0] - 1).astype(int)
    xs = np.minimum((np.arange(w) + 0.5) * image.shape[1] / w, image.shape[1] - 1).astype(int)
    return image[ys][:, xs]


def crop(image: np.ndarray, x1: int, y1: int, x2: int, y2: int) -> np.ndarray:
    return image[max(0, y1) : max(0, y2), max(0, x1) : max(0, x2)]


def otsu(values: np.ndarray) -> int:
    """The grey level that maximises the variance between the two classes."""
    count = np.bincount(values.astype(np.uint8).ravel(), minlength=256).astype(float)
    below = np.cumsum(count)
    mass = np.cumsum(count * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = np.nan_to_num(below * above * (mass / below - (mass[-1] - mass) / above) ** 2)
    return int(spread.argmax())


def ncc(a: np.ndarray, b: np.ndarray) -> float:
    """Normalised correlation of two rasters of one size; 0 if either is flat."""
    x, y = a.astype(float).ravel() - a.mean(), b.astype(float).ravel() - b.mean()
    n = np.sqrt((x * x).sum() * (y * y).sum())
    return float((x * y).sum() / n) if n > 0 else 0.0


def mask_outside(image: np.ndarray, boxes: list[tuple[int, int, int, int]]) -> np.ndarray:
    """The raster with everything outside the boxes blank (white)."""
    out = np.full_like(image, 255)
    for x1, y1, x2, y2 in boxes:
        out[y1:y2, x1:x2] = image[y1:y2, x1:x2]
    return out


def perspective(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3x3 matrix that takes four points to four points."""
    rows, values = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        values += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(values, float)), 1.0).reshape(3, 3)


def apply_matrix(m: np.ndarray, points: np.ndarray) -> np.ndarray:
    p = np.column_stack([points, np.ones(len(points))]) @ m.T
    return p[:, :2] / p[:, 2:]


def ransac_homography(source: np.ndarray, target: np.ndarray, threshold: float = 4.0, rounds: int = 500, seed: int = 0) -> tuple[np.ndarray | None, np.ndarray]:
    """Best matrix and inlier flags over seeded samples of four pairs; None with fewer than four."""
    n = len(source)
    best, flags = None, np.zeros(n, bool)
    rng = np.random.default_rng(seed)
    for _ in range(rounds if n >= 4 else 0):
        pick = rng.choice(n, 4, replace=False)
        try:
            m = perspective(source[pick], target[pick])
        except np.linalg.LinAlgError:
            continue
        with np.errstate(all="ignore"):
            near = np.linalg.norm(apply_matrix(m, source) - target, axis=1) < threshold
        if near.sum() > flags.sum():
            best, flags = m, near
    return best, flags
