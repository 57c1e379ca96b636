"""Equalisation against plain loops, on a side that is a multiple of the tiles and one that isn't."""

import math
import random

from vouchline.operators import contrast


def plain(w, h, v, clip=2.0, t=8):
    ew, eh = (w, h) if w % t == 0 and h % t == 0 else (w + t - w % t, h + t - h % t)
    back = lambda k, n: k if k < n else 2 * (n - 1) - k
    tw, th = ew // t, eh // t
    luts = []
    for ty in range(t):
        for tx in range(t):
            n = [0] * 256
            for y in range(ty * th, ty * th + th):
                for x in range(tx * tw, tx * tw + tw):
                    n[v[back(y, h) * w + back(x, w)]] += 1
            most = max(1, int(clip * tw * th / 256))
            over = sum(max(0, c - most) for c in n)
            n = [min(c, most) + over // 256 for c in n]
            rest, at = over % 256, 0
            step = max(256 // rest, 1) if rest else 0
            while rest and at < 256:
                n[at] += 1
                rest, at = rest - 1, at + step
            luts.append([min(255, round(round(sum(n[: k + 1]) * 255 / (tw * th), 6))) for k in range(256)])
    out = []
    for i, g in enumerate(v):
        fx, fy = (i % w) / tw - 0.5, (i // w) / th - 0.5
        x, y = math.floor(fx), math.floor(fy)
        a, b = fx - x, fy - y
        at = lambda r, c: luts[min(max(r, 0), t - 1) * t + min(max(c, 0), t - 1)][g]  # noqa: E731, B023
        out.append(min(255, round(round((at(y, x) * (1 - a) + at(y, x + 1) * a) * (1 - b) + (at(y + 1, x) * (1 - a) + at(y + 1, x + 1) * a) * b, 6))))
    return out


def test_equalised(spark):
    rng = random.Random(4)
    rows = [(i, w, h, [min(255, max(0, int(rng.gauss(90 + x % w, 12)))) for x in range(w * h)]) for i, (w, h) in enumerate(((64, 48), (57, 33), (64, 33)))]
    got = contrast.equalised(spark.createDataFrame(rows, "image int, w int, h int, v array<int>")).collect()
    assert sorted(r.image for r in got) == [0, 1, 2]
    for r in got:
        assert r.v == plain(*rows[r.image][1:])
