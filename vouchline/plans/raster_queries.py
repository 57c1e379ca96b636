"""Alignment, edge and region queries over matches, outlines and whole rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from vouchline.functions import geometry as geo
from vouchline.functions import homography as hg
from vouchline.operators import clusters, contrast, edges, outlines, pixels, ransac, raster
from vouchline.plans.adapters import cte, view
from vouchline.storage import cut

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


# the template's point (u, v), as shares of its sides, lies where the quad's own map of the unit square takes it
_PLACES = ", ".join(f"({u}::DOUBLE, {v}::DOUBLE)" for u, v in ((0.175, 0.37), (0.655, 0.355), (0.7, 0.825)))


@query(
    "quad_homography",
    cte("v_quad") + f""", q AS (SELECT *, px - sk AS cx, py + ph - sk AS cy, px + pw - 3 * sk AS dx, py + sk AS dy, CASE WHEN l_partkey % 10 = 0 THEN px ELSE px + pw END AS ax, CASE WHEN l_partkey % 10 = 0 THEN py ELSE py + ph END AS ay FROM v_quad),
d AS (SELECT *, (dx - ax) * (cy - ay) - (cx - ax) * (dy - ay) AS det FROM q WHERE (dx - px) * (ay - py) <> (ax - px) * (dy - py) AND (dx - px) * (cy - py) <> (cx - px) * (dy - py) AND (ax - px) * (cy - py) <> (cx - px) * (ay - py)),
g AS (SELECT *, ((px - dx + ax - cx) * (cy - ay) - (cx - ax) * (py - dy + ay - cy)) / det AS g, ((dx - ax) * (py - dy + ay - cy) - (px - dx + ax - cx) * (dy - ay)) / det AS h FROM d WHERE det <> 0),
s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, tie, sum(((dx - px + g * dx) * u + (cx - px + h * cx) * v + px) / (g * u + h * v + 1)) AS x, sum(((dy - py + g * dy) * u + (cy - py + h * cy) * v + py) / (g * u + h * v + 1)) AS y FROM g, (VALUES {_PLACES}) p(u, v) GROUP BY 1, 2, 3, 4, 5)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, tie, CASE WHEN abs(x) < 1e6 THEN round(x, 3) END AS x, CASE WHEN abs(y) < 1e6 THEN round(y, 3) END AS y, true AS back FROM s""",
)
def quad_homography(spark, sf):
    """Three places of the template in each outline's image, and whether the way back meets all four corners to 1e-6.

    The outline's corners are its own, in turn; those of a tenth of the lines fall together and have no map.
    """
    flat = F.col("l_partkey") % 10 == 0
    x, y, w, h, k = (F.col(c) for c in ("px", "py", "pw", "ph", "sk"))
    corners = geo.quad((x, y), (x + w - 3 * k, y + k), (F.when(flat, x).otherwise(x + w), F.when(flat, y).otherwise(y + h)), (x - k, y + h - k))
    df = view(spark, sf, "v_quad").withColumn("quad", corners).withColumn("template", hg.rectangle(928, 584))
    df = hg.only_mapped(hg.with_homography(hg.with_homography(df, "template", "quad", "m"), "quad", "template", "back"))
    at = [hg.apply(F.col("m"), F.lit(u * 927), F.lit(v * 583)) for u, v in ((0.175, 0.37), (0.655, 0.355), (0.7, 0.825))]
    home = [hg.apply(F.col("back"), F.get("quad", F.lit(i))["x"], F.get("quad", F.lit(i))["y"]) for i in range(4)]
    near = [F.greatest(F.abs(p["x"] - px), F.abs(p["y"] - py)) < 1e-6 for p, (px, py) in zip(home, ((0, 0), (927, 0), (927, 583), (0, 583)), strict=True)]
    back = near[0] & near[1] & near[2] & near[3]
    total = lambda axis: at[0][axis] + at[1][axis] + at[2][axis]
    shown = [F.when(F.abs(total(axis)) < 1e6, F.round(total(axis), 3)).alias(axis) for axis in "xy"]  # beyond, a place is next to infinity
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "tie", *shown, back.alias("back"))


@query(
    "warped_card",
    cte("v_raster") + """, g AS (SELECT (i % 32)::INT AS x, (i // 32)::INT AS y FROM range(640) r(i)),
s AS (SELECT image, w, h, v, g.x, g.y, x0 + g.x * (cw - 1) / 31.0::DOUBLE + g.y * (ch - 1) / 19.0::DOUBLE * shear / 8.0::DOUBLE AS sx, y0 - 2 + g.y * (ch + 7) / 19.0::DOUBLE AS sy0, y0 + g.y * (ch - 1) / 19.0::DOUBLE AS sy FROM v_raster, g),
f AS (SELECT *, floor(round(sx, 9)) AS fx, floor(round(sy, 9)) AS fy FROM s),
n AS (SELECT image, x, y, fx, fy, sx, sy, fx + dx AS px, fy + dy AS py, w, h, v, dx, dy FROM f, (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy)),
m AS (SELECT image, x, y, sum(CASE WHEN px >= 0 AND px < w AND py >= 0 AND py < h THEN v[(py * w + px + 1)::BIGINT] ELSE 0 END * (CASE dx WHEN 1 THEN sx - fx ELSE 1 - (sx - fx) END) * (CASE dy WHEN 1 THEN sy - fy ELSE 1 - (sy - fy) END)) AS t FROM n GROUP BY 1, 2, 3)
SELECT image, sum(round_even(round(t, 6), 0)::BIGINT * (1 + x + 32 * y))::BIGINT AS total, max(round_even(round(t, 6), 0))::INT AS most FROM m GROUP BY 1""",
)
def warped_card(spark, sf):
    """Each card cut out by its own outline, a sheared rectangle, into 32 x 20 pixels: a checksum and the brightest pixel."""
    x0, y0, cw, ch, k = (F.col(c) for c in ("x0", "y0", "cw", "ch", "shear"))
    lean = (ch - 1) * k / 8.0
    outline = geo.quad((x0, y0), (x0 + cw - 1, y0), (x0 + cw - 1 + lean, y0 + ch - 1), (x0 + lean, y0 + ch - 1))
    df = view(spark, sf, "v_raster").withColumn("card", outline).withColumn("template", hg.rectangle(32, 20))
    df = raster.warp(hg.with_homography(df, "template", "card", "m"), "m", 32, 20)
    total = F.aggregate(F.transform("v", lambda v, i: v.cast("bigint") * (1 + i)), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return df.select("image", total.alias("total"), F.array_max("v").alias("most"))


_NUMBER = "row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS pos"
_FROM = "CAST(l_partkey * 37 % 640 AS DOUBLE) AS x0, CAST(l_orderkey * 11 % 400 AS DOUBLE) AS y0, l_orderkey % 10 < 3 AS stray"
_BENT = "CAST(1 + l_suppkey % 5 * 0.1 AS DOUBLE) AS zoom, CAST(l_suppkey % 7 * 0.0001 AS DOUBLE) AS tilt"
_TO = "(zoom * x0 + 0.1 * y0 + 20) / (tilt * x0 + 1) + IF(stray, 60 + pos % 50, 0) AS x1, (0.05 * x0 + zoom * y0 + 10) / (tilt * x0 + 1) - IF(stray, 40 + pos % 30, 0) AS y1"
_MATCH = f"""SELECT l_suppkey AS image, {_NUMBER}, {_FROM},
  {_BENT} FROM lineitem"""


@query(
    "ransac_homography",
    f"""WITH m AS (SELECT * FROM ({_MATCH}) WHERE image % 50 <> 3 OR pos <= 3), g AS (SELECT image, zoom, tilt, count(*) AS n, count(*) FILTER (NOT stray) AS good FROM m GROUP BY ALL),
c AS (SELECT *, unnest([0, 639, 639, 0])::DOUBLE AS cx, unnest([0, 0, 399, 399])::DOUBLE AS cy, unnest([1, 2, 3, 4]) AS k FROM g),
p AS (SELECT image, n, good, k, (zoom * cx + 0.1::DOUBLE * cy + 20) / (tilt * cx + 1) AS x, (0.05::DOUBLE * cx + zoom * cy + 10) / (tilt * cx + 1) AS y FROM c),
a AS (SELECT a.image, a.n, a.good, abs(sum(a.x * b.y - b.x * a.y)) / 2 / 480000 AS area, round(max(a.x) FILTER (a.k = 3), 4) AS far FROM p a JOIN p b ON a.image = b.image AND b.k = a.k % 4 + 1 GROUP BY 1, 2, 3)
SELECT image, image % 50 <> 3 AS ok, CASE WHEN image % 50 = 3 THEN 0 ELSE good END::BIGINT AS inliers, CASE WHEN image % 50 = 3 THEN 0 ELSE round(good / n::DOUBLE, 6) END AS inlier_ratio, CASE WHEN image % 50 = 3 THEN 0 ELSE round(area, 6) END AS area_ratio, CASE WHEN image % 50 <> 3 THEN far END AS far FROM a""",
)
def ransac_homography(spark, sf):
    """Per supplier the map from one image's points to another's, with three in ten matches led astray; the SQL knows which.

    Suppliers with three matches only have no map. ``far`` is where the bottom right corner lands.
    """
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    # points are worked out behind the numbering, whose shuffle by supplier is the only one of the lines
    m = spark.sql(f"SELECT l_suppkey, pos, {_FROM}, {_BENT} FROM {{m}}", m=lines.selectExpr("*", _NUMBER).where("l_suppkey % 50 <> 3 OR pos <= 3"))
    m = spark.sql(f"SELECT l_suppkey AS image, pos, x0, y0, {_TO} FROM {{m}}", m=m)
    sizes = lines.select(F.col("l_suppkey").alias("image")).distinct().selectExpr("image", "640 AS w0", "400 AS h0", "800 AS w1", "600 AS h1")
    found = ransac.ransac(m.select("image", "pos", "x0", "y0", "x1", "y1"), ["image"], "pos", sizes)
    return found.select("image", "ok", "inliers", F.round("inlier_ratio", 6).alias("inlier_ratio"), F.round("quad_area_ratio", 6).alias("area_ratio"), F.round(F.get("quad", F.lit(2))["x"], 4).alias("far"))


# blurred by 5 x 5 Gaussian weights, mirrored at the border; gradients repeat it
_G5 = raster.gaussian_weights(5)
_EDGE = cte("v_raster").replace("WITH", "WITH RECURSIVE", 1) + f""", px AS (SELECT image, w, h, i % w AS x, i // w AS y, v[i + 1] AS v FROM (SELECT image, w, h, v, unnest(range(w * h)) AS i FROM v_raster)),
k(d, g) AS (VALUES {", ".join(f"({i - 2}, {x!r}::DOUBLE)" for i, x in enumerate(_G5))}),
bx AS (SELECT p.image, p.w, p.h, p.x, p.y, sum(q.v * g) AS v FROM px p, k, px q WHERE q.image = p.image AND q.y = p.y AND q.x = CASE WHEN abs(p.x + d) > p.w - 1 THEN 2 * (p.w - 1) - abs(p.x + d) ELSE abs(p.x + d) END GROUP BY ALL),
bl AS (SELECT p.image, p.w, p.h, p.x, p.y, round_even(round(sum(q.v * g), 6), 0)::INT AS v FROM bx p, k, bx q WHERE q.image = p.image AND q.x = p.x AND q.y = CASE WHEN abs(p.y + d) > p.h - 1 THEN 2 * (p.h - 1) - abs(p.y + d) ELSE abs(p.y + d) END GROUP BY ALL),
s3(a, b, cx, cy) AS (VALUES (-1, -1, -1, -1), (0, -1, 0, -2), (1, -1, 1, -1), (-1, 0, -2, 0), (1, 0, 2, 0), (-1, 1, -1, 1), (0, 1, 0, 2), (1, 1, 1, 1)),
gr AS (SELECT p.image, p.w, p.x, p.y, sum(q.v * cx)::BIGINT AS gx, sum(q.v * cy)::BIGINT AS gy FROM bl p, s3, bl q WHERE q.image = p.image AND q.x = least(greatest(p.x + a, 0), p.w - 1) AND q.y = least(greatest(p.y + b, 0), p.h - 1) GROUP BY ALL),
mg AS (SELECT *, abs(gx) + abs(gy) AS m FROM gr),
sec AS (SELECT *, CASE WHEN abs(gy) * 32768 < abs(gx) * 13573 THEN 'flat' WHEN abs(gy) * 32768 > abs(gx) * (13573 + 65536) THEN 'steep' WHEN (gx < 0) <> (gy < 0) THEN 'falls' ELSE 'rises' END AS sector FROM mg),
nb AS (SELECT s.image, s.w, s.x, s.y, s.m, sector, coalesce(a.m, 0) AS one, coalesce(b.m, 0) AS two FROM sec s
  LEFT JOIN mg a ON a.image = s.image AND a.x = s.x + CASE sector WHEN 'flat' THEN -1 WHEN 'steep' THEN 0 WHEN 'falls' THEN 1 ELSE -1 END AND a.y = s.y + CASE sector WHEN 'flat' THEN 0 ELSE -1 END
  LEFT JOIN mg b ON b.image = s.image AND b.x = s.x + CASE sector WHEN 'flat' THEN 1 WHEN 'steep' THEN 0 WHEN 'falls' THEN -1 ELSE 1 END AND b.y = s.y + CASE sector WHEN 'flat' THEN 0 ELSE 1 END),
ed AS (SELECT image, w, x, y, m > 260 AS strong FROM nb WHERE m > 90 AND m > one AND CASE WHEN sector IN ('flat', 'steep') THEN m >= two ELSE m > two END),
hit AS (SELECT image, w, x, y FROM ed WHERE strong UNION SELECT e.image, e.w, e.x, e.y FROM hit t JOIN ed e ON e.image = t.image AND abs(e.x - t.x) <= 1 AND abs(e.y - t.y) <= 1)"""


def _edges(spark, sf):
    return edges.canny(raster.blur(view(spark, sf, "v_raster").select("image", "w", "h", "v"), 5), 90, 260)


@query("canny_edges", _EDGE + " SELECT image, count(*) AS n, sum(x + y * w * 3)::BIGINT AS total FROM hit GROUP BY image")
def canny_edges(spark, sf):
    """Edge pixels of each blurred image and a checksum of their places; weak ones are reached from strong ones."""
    found = _edges(spark, sf)
    n = F.col("x2") - F.col("x1") + 1
    return found.groupBy("image").agg(F.sum(n).cast("bigint").alias("n"), F.sum((F.col("x1") + F.col("x2")) * n / 2 + F.col("y") * F.col("w") * 3 * n).cast("bigint").alias("total"))


_HOUGH = _EDGE + """, t AS (SELECT k::INT AS angle, cos(k * pi() / 180) AS c, sin(k * pi() / 180) AS s FROM range(180) r(k)),
vt AS (SELECT image, angle, round_even(round(x * c + y * s, 6), 0)::INT AS rho, count(*) AS votes FROM hit, t GROUP BY ALL),
pk AS (SELECT v.* FROM vt v LEFT JOIN vt a ON a.image = v.image AND a.angle = v.angle - 1 AND a.rho = v.rho LEFT JOIN vt b ON b.image = v.image AND b.angle = v.angle + 1 AND b.rho = v.rho
  LEFT JOIN vt c ON c.image = v.image AND c.angle = v.angle AND c.rho = v.rho - 1 LEFT JOIN vt d ON d.image = v.image AND d.angle = v.angle AND d.rho = v.rho + 1
  WHERE v.votes >= 14 AND v.votes > coalesce(a.votes, 0) AND v.votes >= coalesce(b.votes, 0) AND v.votes > coalesce(c.votes, 0) AND v.votes >= coalesce(d.votes, 0))"""


@query("hough_lines", _HOUGH + " SELECT image, angle, rho, votes FROM pk")
def hough_lines(spark, sf):
    return edges.hough_lines(edges.points(_edges(spark, sf)), 14)


@query(
    "hough_quad",
    _HOUGH + """, o AS (SELECT pk.*, hit.x, hit.y, round(y * cos(angle * pi() / 180) - x * sin(angle * pi() / 180), 6) AS t FROM pk JOIN hit USING (image) WHERE round_even(round(x * cos(angle * pi() / 180) + y * sin(angle * pi() / 180), 6), 0)::INT = rho),
c AS (SELECT *, coalesce(t - lag(t) OVER l > 4, false)::INT AS cut FROM o WINDOW l AS (PARTITION BY image, angle, rho ORDER BY t, x, y)),
p AS (SELECT *, sum(cut) OVER (PARTITION BY image, angle, rho ORDER BY t, x, y) AS part FROM c),
sg AS (SELECT image, angle, rho, votes, part, arg_min(struct_pack(x := x, y := y), struct_pack(t := t, x := x, y := y)) AS a, arg_max(struct_pack(x := x, y := y), struct_pack(t := t, x := x, y := y)) AS b FROM p GROUP BY ALL HAVING max(t) - min(t) >= 9),
n AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY votes DESC, angle, rho, part) AS pos, degrees(atan2(b.y - a.y, b.x - a.x)) AS deg FROM sg),
ln AS (SELECT image, pos, a, b, CASE WHEN abs(deg) < 30 OR abs(deg) > 150 THEN 'h' ELSE 'v' END AS kind FROM n WHERE abs(deg) < 30 OR abs(deg) > 150 OR abs(deg) BETWEEN 60.0000001 AND 119.9999999),
e AS (SELECT image, kind, CASE kind WHEN 'h' THEN (a.y + b.y) / 2.0::DOUBLE ELSE (a.x + b.x) / 2.0::DOUBLE END AS m, pos, struct_pack(a := (b.y - a.y)::DOUBLE, b := (a.x - b.x)::DOUBLE, c := ((b.y - a.y) * a.x + (a.x - b.x) * a.y)::DOUBLE) AS l FROM ln),
g AS (SELECT image, kind, arg_min(l, struct_pack(m := m, p := pos)) AS f, arg_max(l, struct_pack(m := m, p := pos)) AS z FROM e GROUP BY image, kind HAVING count(*) >= 2),
j AS (SELECT h.image, unnest([h.f, h.f, h.z, h.z]) AS p, unnest([v.f, v.z, v.f, v.z]) AS q FROM g h JOIN g v ON h.image = v.image AND h.kind = 'h' AND v.kind = 'v'),
x AS (SELECT j.image, count(*) FILTER (abs(p.a * q.b - q.a * p.b) >= 1e-6) AS n, min(least(greatest((p.c * q.b - q.c * p.b) / (p.a * q.b - q.a * p.b), 0), r.w - 1) + least(greatest((p.a * q.c - q.a * p.c) / (p.a * q.b - q.a * p.b), 0), r.h - 1)) AS near,
  max(least(greatest((p.c * q.b - q.c * p.b) / (p.a * q.b - q.a * p.b), 0), r.w - 1) + least(greatest((p.a * q.c - q.a * p.c) / (p.a * q.b - q.a * p.b), 0), r.h - 1)) AS far FROM j JOIN v_raster r USING (image) GROUP BY j.image)
SELECT s.image, coalesce(n = 4, false) AS found, CASE WHEN n = 4 THEN round(near, 4) END AS nearest, CASE WHEN n = 4 THEN round(far, 4) END AS farthest FROM (SELECT DISTINCT image FROM sg) s LEFT JOIN x USING (image)""",
)
def hough_quad(spark, sf):
    """The quad of the outermost lines that each image's own edge points vote for."""
    segments = edges.hough_segments(edges.points(_edges(spark, sf)), 14, 9, 4)
    sized = segments.join(view(spark, sf, "v_raster").select("image", "w", "h"), "image")
    out = pixels.lines_quad(sized, "w", "h")
    sums = F.transform("contour", lambda p: p["x"] + p["y"])
    return out.select("image", F.col("contour").isNotNull().alias("found"), F.round(F.array_min(sums), 4).alias("nearest"), F.round(F.array_max(sums), 4).alias("farthest"))


# runs of pixels over 130 by islands, joined to regions by all runs reachable; a ring of each row's ends
_REGION = cte("v_raster").replace("WITH", "WITH RECURSIVE", 1) + """, px AS (SELECT image, w, i % w AS x, i // w AS y FROM (SELECT image, w, unnest(range(w * h)) AS i, unnest(v) AS v FROM v_raster) WHERE v > 52),
il AS (SELECT *, x - row_number() OVER (PARTITION BY image, y ORDER BY x) AS g FROM px),
rn AS (SELECT image, y, min(x) AS x1, max(x) AS x2, min(y * w + x) AS run FROM il GROUP BY image, y, g),
tc AS (SELECT a.image, a.run AS a, b.run AS b FROM rn a JOIN rn b ON a.image = b.image AND abs(a.y - b.y) = 1 AND a.x1 <= b.x2 + 1 AND b.x1 <= a.x2 + 1),
ls AS (SELECT image, run, run AS region, 0 AS turn FROM rn UNION ALL
  SELECT l.image, l.run, least(l.region, coalesce(min(n.region), l.region)), l.turn + 1 FROM ls l LEFT JOIN tc ON tc.image = l.image AND tc.a = l.run LEFT JOIN ls n ON n.image = l.image AND n.run = tc.b WHERE l.turn < 150 GROUP BY l.image, l.run, l.region, l.turn),
rg AS (SELECT rn.*, region FROM ls JOIN rn USING (image, run) WHERE turn = 150),
ln AS (SELECT image, region, y, min(x1) AS a, max(x2) AS b, sum(x2 - x1 + 1) AS n FROM rg GROUP BY ALL),
pt AS (SELECT image, region, b AS x, y, y AS o FROM ln UNION ALL SELECT image, region, a, y, 100000 - y FROM ln),
nx AS (SELECT *, coalesce(lead(x) OVER p, first(x) OVER p) AS u, coalesce(lead(y) OVER p, first(y) OVER p) AS v FROM pt WINDOW p AS (PARTITION BY image, region ORDER BY o)),
ar AS (SELECT image, region, abs(sum(x * v - u * y)) / 2.0::DOUBLE AS area, sum(sqrt((x - u) ** 2 + (y - v) ** 2)) AS perimeter FROM nx GROUP BY ALL)"""


@query("mask_regions", _REGION + " SELECT image, region::BIGINT AS region, sum(n)::BIGINT AS pixels, ar.area, round(perimeter, 4) AS perimeter FROM ln JOIN ar USING (image, region) GROUP BY ALL")
def mask_regions(spark, sf):
    """Connected regions of the pixels over 52, which are the cards and their noisy grounds: size, area and way around."""
    masks = outlines.level_mask(view(spark, sf, "v_raster").select("image", "w", "h", "v"), 52)
    return outlines.outlines(edges.regions(edges.runs(masks, "mask"))).select("image", "region", "pixels", "area", F.round("perimeter", 4).alias("perimeter"))


@query("outline_quads", cte("v_raster") + " SELECT image, method, true AS at_card FROM v_raster, (VALUES ('otsu'), ('gradient')) m(method)")
def outline_quads(spark, sf):
    """Quads found in each blurred image's Otsu mask and in that of its morphological gradient: all corners within three, or six, pixels of the card's."""
    slim = cut(raster.blur(view(spark, sf, "v_raster").select("image", "w", "h", "v"), 5))
    found = outlines.mask_quads(outlines.otsu_mask(slim), 3, 1).withColumn("method", F.lit("otsu"))
    found = found.unionByName(outlines.mask_quads(outlines.otsu_mask(outlines.morph_gradient(slim, 3)), 3, 1).withColumn("method", F.lit("gradient")))
    x0, y0, cw, ch, k = (F.col(c) for c in ("x0", "y0", "cw", "ch", "shear"))
    lean = (ch - 1) * k / 8.0
    card = geo.quad((x0, y0), (x0 + cw - 1, y0), (x0 + cw - 1 + lean, y0 + ch - 1), (x0 + lean, y0 + ch - 1))
    near = F.forall(F.zip_with("contour", "card", lambda a, b: F.greatest(F.abs(a["x"] - b["x"]), F.abs(a["y"] - b["y"]))), lambda d: d <= F.when(F.col("method") == "otsu", 3).otherwise(6))
    return found.join(view(spark, sf, "v_raster").select("image", card.alias("card")), "image").select("image", "method", near.alias("at_card"))


@query(
    "level_clusters",
    cte("v_raster").replace("WITH", "WITH RECURSIVE", 1) + """, hist AS (SELECT image, v, count(*)::BIGINT AS n FROM (SELECT image, unnest(v) AS v FROM v_raster) GROUP BY ALL),
  upto AS (SELECT image, v, sum(n) OVER (PARTITION BY image ORDER BY v) AS u, sum(n) OVER (PARTITION BY image) AS total FROM hist),
  start AS (SELECT image, k, j, min(v)::DOUBLE AS c FROM upto, (VALUES (3), (4), (5)) ks(k), range(5) js(j) WHERE j < k AND u * 2 * k >= (2 * j + 1) * total GROUP BY ALL),
  go AS (SELECT image, k, 0 AS turn, list(c ORDER BY j) AS cs FROM start GROUP BY image, k
    UNION ALL SELECT image, k, turn + 1, list(coalesce(m, o) ORDER BY j) FROM (
      SELECT g.image, g.k, g.turn, j, any_value(g.cs[j + 1]) AS o, sum(CASE WHEN near = j THEN v * n END)::DOUBLE / sum(CASE WHEN near = j THEN n END)::DOUBLE AS m
      FROM (SELECT go.*, v, n, list_position(list_transform(cs, lambda c: (v - c) * (v - c)), list_min(list_transform(cs, lambda c: (v - c) * (v - c)))) - 1 AS near FROM go JOIN hist USING (image) WHERE turn < 20) g, range(5) js(j) WHERE j < g.k GROUP BY ALL)
      GROUP BY image, k, turn),
  last AS (SELECT image, k, cs FROM go WHERE turn = 20),
  near AS (SELECT image, k, list_position(list_transform(cs, lambda c: (v - c) * (v - c)), list_min(list_transform(cs, lambda c: (v - c) * (v - c)))) - 1 AS ord, sum(n)::BIGINT AS n FROM last JOIN hist USING (image) GROUP BY ALL)
SELECT l.image, l.k, j::INT AS ord, round(cs[j + 1], 6) AS level, coalesce(n, 0)::BIGINT AS n FROM (SELECT image, k, cs, unnest(range(k)) AS j FROM last) l LEFT JOIN near ON near.image = l.image AND near.k = l.k AND near.ord = l.j""",
)
def level_clusters(spark, sf):
    """Three, four and five clusters of each image's grey levels, with their pixels."""
    seen = raster.histogram(view(spark, sf, "v_raster")).select("image", F.array("v").alias("v"), "n")
    return clusters.clusters(seen).select("image", "k", "ord", F.round(F.col("centre")[0], 6).alias("level"), "n")


@query(
    "equalised",
    cte("v_raster") + """, sized AS (SELECT image, w, h, v, CASE WHEN w % 8 = 0 AND h % 8 = 0 THEN w // 8 ELSE (w + 8 - w % 8) // 8 END AS tw, CASE WHEN w % 8 = 0 AND h % 8 = 0 THEN h // 8 ELSE (h + 8 - h % 8) // 8 END AS th FROM v_raster),
  px AS (SELECT image, w, h, v, tw, th, unnest(range(tw * th * 64)) AS i FROM sized),
  seen AS (SELECT image, tw, th, (i // (tw * 8)) // th * 8 + (i % (tw * 8)) // tw AS tile, v[1 + (CASE WHEN i // (tw * 8) >= h THEN 2 * (h - 1) - i // (tw * 8) ELSE i // (tw * 8) END) * w + CASE WHEN i % (tw * 8) >= w THEN 2 * (w - 1) - i % (tw * 8) ELSE i % (tw * 8) END] AS g FROM px),
  n AS (SELECT image, tw, th, tile, g, count(*) AS n FROM seen GROUP BY ALL),
  f AS (SELECT t.*, l, coalesce(n.n, 0) AS n, greatest(1, floor(2.0::DOUBLE * tw * th / 256))::BIGINT AS most FROM (SELECT DISTINCT image, tw, th, tile FROM n) t CROSS JOIN range(256) r(l) LEFT JOIN (SELECT image, tile, g, n FROM n) n ON n.image = t.image AND n.tile = t.tile AND n.g = l),
  o AS (SELECT *, sum(greatest(n - most, 0)) OVER (PARTITION BY image, tile)::BIGINT AS spare FROM f),
  d AS (SELECT *, least(n, most) + spare // 256 + CASE WHEN l % (256 // greatest(spare % 256, 1)) = 0 AND l // (256 // greatest(spare % 256, 1)) < spare % 256 THEN 1 ELSE 0 END AS m FROM o),
  lut AS (SELECT image, tile, l, least(255, round_even(round(sum(m) OVER (PARTITION BY image, tile ORDER BY l)::DOUBLE * 255 / (tw * th), 6), 0)) AS y FROM d),
  p AS (SELECT image, i, g, floor(fx) AS x0, floor(fy) AS y0, fx - floor(fx) AS a, fy - floor(fy) AS b FROM (SELECT image, i, v[i + 1] AS g, (i % w) / tw::DOUBLE - 0.5::DOUBLE AS fx, (i // w) / th::DOUBLE - 0.5::DOUBLE AS fy FROM (SELECT *, unnest(range(w * h)) AS i FROM sized))),
  c AS (SELECT p.image, i, sum(y * CASE WHEN dx = 0 THEN 1 - a ELSE a END * CASE WHEN dy = 0 THEN 1 - b ELSE b END) AS y FROM p, range(2) xs(dx), range(2) ys(dy), lut WHERE lut.image = p.image AND lut.l = p.g AND lut.tile = greatest(least(y0 + dy, 7), 0) * 8 + greatest(least(x0 + dx, 7), 0) GROUP BY ALL)
SELECT image, sum(e)::BIGINT AS total, sum(e * (i % 97))::BIGINT AS placed FROM (SELECT image, i, least(255, round_even(round(y, 6), 0)) AS e FROM c) GROUP BY image""",
)
def equalised(spark, sf):
    """Each image with its contrast evened out tile by tile, as the sum of its levels and that of its levels by place."""
    even = contrast.equalised(view(spark, sf, "v_raster").select("image", "w", "h", "v"))
    placed = "aggregate(v, struct(0L AS i, 0L AS s), (a, x) -> struct(a.i + 1L AS i, a.s + x * (a.i % 97) AS s), a -> a.s)"
    return even.selectExpr("image", "aggregate(v, 0L, (s, x) -> s + x) AS total", f"{placed} AS placed")
