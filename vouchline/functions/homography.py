"""Perspective maps of four points as plain Columns: closed form from the unit square, and its adjugate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchline.functions.geometry import point


def _square_to(df: DataFrame, quad: str, n: str) -> DataFrame:
    """Adds the nine entries n0..n8 of the map of the unit square's corners, in turn, to the quad's; null if three of them are in line."""
    at = {f"{n}{axis}{i}": F.get(quad, F.lit(i))[axis] for i in range(4) for axis in "xy"}
    df = df.withColumns(at)
    x, y = ([F.col(f"{n}{axis}{i}") for i in range(4)] for axis in "xy")
    a, b, s = ([c[1] - c[2] for c in (x, y)], [c[3] - c[2] for c in (x, y)], [c[0] - c[1] + c[2] - c[3] for c in (x, y)])
    det = a[0] * b[1] - b[0] * a[1]
    turn = lambda i, j, k: (x[j] - x[i]) * (y[k] - y[i]) - (x[k] - x[i]) * (y[j] - y[i])
    apart = (det != 0) & (turn(0, 1, 2) != 0) & (turn(0, 1, 3) != 0) & (turn(0, 2, 3) != 0)
    df = df.withColumns({f"{n}6": F.when(apart, (s[0] * b[1] - b[0] * s[1]) / det), f"{n}7": F.when(apart, (a[0] * s[1] - s[0] * a[1]) / det)})
    g, h = F.col(f"{n}6"), F.col(f"{n}7")
    entries = {f"{n}{3 * k}": c[1] - c[0] + g * c[1] for k, c in enumerate((x, y))} | {f"{n}{3 * k + 1}": c[3] - c[0] + h * c[3] for k, c in enumerate((x, y))} | {f"{n}{3 * k + 2}": c[0] for k, c in enumerate((x, y))}
    return df.withColumns(entries).withColumn(f"{n}8", F.lit(1.0)).drop(*at)


def _adjugate(m: list[Column]) -> list[Column]:
    a, b, c, d, e, f, g, h, i = m
    return [e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d]


def with_homography(df: DataFrame, source: str, target: str, alias: str = "m") -> DataFrame:
    """Adds the 3 x 3 map (array of nine, row by row) that takes the corners of one quad to another's.

    Its last entry is 1; or 0 where the source's origin goes to infinity, as it may while all corners have a place.
    Null where three corners of either quad are in line: there is no map that leads back.
    """
    names = [f"__{s}{i}" for s in "st" for i in range(9)]
    df = _square_to(_square_to(df, source, "__s"), target, "__t")
    back = _adjugate([F.col(f"__s{i}") for i in range(9)])
    df = df.withColumns({f"__b{i}": c for i, c in enumerate(back)})
    t, b = ([F.col(f"__{n}{i}") for i in range(9)] for n in "tb")
    df = df.withColumns({f"__m{3 * r + c}": t[3 * r] * b[c] + t[3 * r + 1] * b[3 + c] + t[3 * r + 2] * b[6 + c] for r in range(3) for c in range(3)})
    m = [F.col(f"__m{i}") for i in range(9)]
    df = df.withColumn("__scale", F.when(m[8] == 0, 1.0).otherwise(m[8]))
    whole = F.array(*(c / F.col("__scale") for c in m))
    return df.withColumn(alias, F.when(m[8].isNotNull(), whole)).drop(*names, *(f"__b{i}" for i in range(9)), *(f"__m{i}" for i in range(9)), "__scale")


def apply(m: Column, x: Column, y: Column) -> Column:
    """A point under a map; null where it goes to infinity."""
    row = lambda r: m[3 * r] * x + m[3 * r + 1] * y + m[3 * r + 2]
    w = row(2)
    return F.when(w != 0, point(row(0) / w, row(1) / w))


def inverse(m: Column) -> Column:
    """The map back (up to scale)."""
    return F.array(*_adjugate([m[i] for i in range(9)]))


def rectangle(w: float, h: float) -> Column:
    """The corners of a w x h image: the centres of its outermost pixels."""
    return F.array(*(point(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1))))


def only_mapped(df: DataFrame, alias: str = "m") -> DataFrame:
    """Rows with a map. A filter would be pushed below the steps that make it and write all of them out again."""
    return df.withColumn(alias, F.explode(F.filter(F.array(alias), lambda m: m.isNotNull())))
