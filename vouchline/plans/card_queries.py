"""Records of whole cards, crop and orientation rules, keypoint joins, and raster work on pixel tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vouchline.functions import geometry as geo
from vouchline.functions import text
from vouchline.operators import boxes, match, nearest, pixels, rank, records
from vouchline.plans.adapters import cte, view

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- crops and orientation

_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "tie")
_K = ", ".join(_LINE)
_BOXN = "l_discount * 9 AS bx1, l_tax * 8 AS by1, l_quantity / 50 AS bx2, l_linenumber / 7.0::DOUBLE AS by2"


@query(
    "crop_bounds",
    f"""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS tie, {_BOXN} FROM lineitem),
p AS (SELECT *, least(greatest(round_even(bx1 * 928, 0), 0), 928)::INT AS x1, least(greatest(round_even(by1 * 584, 0), 0), 584)::INT AS y1, least(greatest(round_even(bx2 * 928, 0), 0), 928)::INT AS x2, least(greatest(round_even(by2 * 584, 0), 0), 584)::INT AS y2 FROM b)
SELECT {_K}, x1, y1, x2, y2, greatest(1, abs(x2 - x1))::INT AS w, greatest(1, abs(y2 - y1))::INT AS h, x1 || ',' || y1 || ' ' || x2 || ',' || y1 || ' ' || x2 || ',' || y2 || ' ' || x1 || ',' || y2 AS corners FROM p""",
)
def crop_bounds(spark, sf):
    """Unpadded pixel boxes (possibly empty), their corners, and the size of the upright crop of those."""
    b = _table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice AS tie", "l_discount * 9 AS bx1", "l_tax * 8 AS by1", "l_quantity / 50 AS bx2", "l_linenumber / 7.0D AS by2")
    px = b.withColumn("px", geo.crop_norm(F.col("bx1"), F.col("by1"), F.col("bx2"), F.col("by2"), F.lit(928.0), F.lit(584.0)))
    q = px.withColumn("q", geo.box_corners(F.col("px"))).withColumn("size", geo.crop_size(F.col("q")))
    shown = F.array_join(F.transform("q", lambda p: F.concat(p["x"].cast("int").cast("string"), F.lit(","), p["y"].cast("int").cast("string"))), " ")
    return q.select(*_LINE, "px.*", F.col("size.w").alias("w"), F.col("size.h").alias("h"), shown.alias("corners"))


@query(
    "orientation_rules",
    cte("v_quad") + f""" SELECT {_K}, round(CASE WHEN least(pw, ph) >= 320 THEN 1.0 ELSE least(320 / greatest(least(pw, ph), 1), 4.0) END, 6) AS grow, CASE WHEN ph >= pw THEN '90,270' ELSE '0,180' END AS later,
  round(2 * r - 2 * t, 6) AS strip, CASE WHEN -0.50::DOUBLE * (2 * r - 2 * t) + 0.35::DOUBLE * (t - r) + 0.15::DOUBLE * (greatest(0, (px - py) / 255.0::DOUBLE) - greatest(0, (py - px / 2) / 255.0::DOUBLE)) > 0.02 THEN 180 ELSE 0 END AS flip,
  round(0.4::DOUBLE * r + 0.6::DOUBLE * t + CASE WHEN ph / 4 > 0.15::DOUBLE * ph AND px + pw / 8 < 0.40::DOUBLE * pw AND py + ph / 8 < 0.80::DOUBLE * ph THEN 0.5 ELSE 0 END, 6) AS vote FROM v_quad""",
)
def orientation_rules(spark, sf):
    """Growth scale, the rotations left for later, strip score, flip vote, and the vote of a corner order with its face bonus."""
    w, h, x, y, r, t = (F.col(c) for c in ("pw", "ph", "px", "py", "r", "t"))
    faces = F.array(F.struct(x.alias("x"), y.alias("y"), (w / 4).alias("w"), (h / 4).alias("h")), F.struct((w * 2).alias("x"), y.alias("y"), w.alias("w"), h.alias("h")))
    strip = geo.strip_score(r, r, t, t)
    return view(spark, sf, "v_quad").select(
        *_LINE, F.round(geo.grow_scale(w, h, 320.0), 6).alias("grow"), F.array_join(geo.other_rotations(w, h).cast("array<string>"), ",").alias("later"), F.round(strip, 6).alias("strip"),
        geo.flip_vote(strip, r, t, x / 2, y, x, y).alias("flip"), F.round(geo.ordering_vote(r, t, geo.face_bonus(faces, w, h)), 6).alias("vote"),
    )


@query(
    "artifact_plan",
    "SELECT o_orderkey AS case_id, side, field, CASE WHEN is_photo THEN 'photo' ELSE 'crop' END AS artifact, CASE WHEN o_custkey % 13 <> 0 AND o_orderkey % 3 <> 0 THEN 'perspective' ELSE 'plain' END AS mode, CASE WHEN is_photo THEN 'text' WHEN is_numeric THEN 'numeric' ELSE 'text' END AS refine FROM orders, "
    + "(VALUES " + ", ".join(f"('{s}', '{f}', {str(n).lower()}, {str(p).lower()})" for s, f, _, _, _, _, _, n, p in boxes.ROIS) + ") roi(side, field, is_numeric, is_photo) WHERE side = CASE WHEN o_orderkey % 2 = 0 THEN 'front' ELSE 'back' END",
)
def artifact_plan(spark, sf):
    images = _table(spark, sf, "orders").selectExpr("o_orderkey AS case_id", "CASE WHEN o_orderkey % 2 = 0 THEN 'front' ELSE 'back' END AS side", "o_custkey % 13 <> 0 AS aligned", "o_orderkey % 3 <> 0 AS has_matrix")
    return boxes.artifact_plan(images, boxes.roi_table(spark))


@query(
    "generated_regions",
    "WITH t AS (SELECT s_suppkey AS template, CASE WHEN s_nationkey % 2 = 0 THEN 'front' ELSE 'back' END AS side, 20 + s_suppkey % 900 AS w, 4 + s_suppkey * 7 % 560 AS h FROM supplier), px AS (SELECT template, side, field, ord, "
    + ", ".join(f"round_even({n}{i} * {most}, 0)::INT AS {n}{i}" for i in (1, 2) for n, most in (("x", "w"), ("y", "h")))
    + " FROM t JOIN (VALUES " + ", ".join(f"('{s}', '{f}', {o}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for s, f, o, a, b, c, d, _, _ in boxes.ROIS) + ") roi(side, field, ord, x1, y1, x2, y2) USING (side)) SELECT * FROM px WHERE x2 > x1 AND y2 > y1",
)
def generated_regions(spark, sf):
    """Templates of many sizes, some so small that regions vanish."""
    templates = _table(spark, sf, "supplier").selectExpr("s_suppkey AS template", "CASE WHEN s_nationkey % 2 = 0 THEN 'front' ELSE 'back' END AS side", "20 + s_suppkey % 900 AS w", "4 + s_suppkey * 7 % 560 AS h")
    return boxes.generated_regions(boxes.roi_table(spark), templates)


# ---- matches

_DESC = "SELECT p_partkey AS id, p_partkey * 2654435761 % 4294967296 AS d FROM part"


@query(
    "hamming_nearest",
    f"""WITH v AS ({_DESC}), d AS (SELECT q.id AS q, t.id AS t, bit_count(xor(q.d, t.d))::INT AS d FROM v q JOIN v t ON q.id % 50 = 0 AND q.id <> t.id),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, t) AS k FROM d WHERE d <= 32) SELECT q, max(t) FILTER (k = 1) AS t1, max(d) FILTER (k = 1) AS d1, max(d) FILTER (k = 2) AS d2 FROM k WHERE k <= 2 GROUP BY q""",
)
def hamming_nearest(spark, sf):
    """Binary descriptors: every one whose id is divisible by 50 against all."""
    v = _table(spark, sf, "part").selectExpr("p_partkey AS id", "p_partkey * 2654435761L % 4294967296L AS d")
    queries = v.where("id % 50 = 0").select(F.col("id").alias("q"), F.array("d").alias("qe"))
    return nearest.two_nearest_bits(queries, v.select(F.col("id").alias("t"), F.array("d").alias("te"))).select("q", "t1", "d1", "d2")


@query(
    "keypoint_pairs",
    """SELECT l_orderkey, l_linenumber, l_partkey AS query_idx, l_suppkey AS train_idx, l_extendedprice AS tie, p_retailprice AS qx, p_size::DOUBLE AS qy, s_acctbal AS tx, s_nationkey::DOUBLE AS ty
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey""",
)
def keypoint_pairs(spark, sf):
    matches = _table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey AS query_idx", "l_suppkey AS train_idx", "l_extendedprice AS tie")
    a = _table(spark, sf, "part").selectExpr("p_partkey AS idx", "p_retailprice AS x", "double(p_size) AS y")
    b = _table(spark, sf, "supplier").selectExpr("s_suppkey AS idx", "s_acctbal AS x", "double(s_nationkey) AS y")
    return match.keypoint_pairs(matches, a, b)


@query("drawn_matches", cte("v_match") + ", k AS (SELECT *, row_number() OVER (PARTITION BY model_ord, feature_id % 20 ORDER BY subject_id, feature_ord, feature_id, tie, inliers) AS k FROM v_match) SELECT model_ord, feature_id % 20 AS g, count(*)::BIGINT AS n, max(subject_id) AS last_subject FROM k WHERE k <= 80 GROUP BY model_ord, feature_id % 20")
def drawn_matches(spark, sf):
    v = view(spark, sf, "v_match").withColumn("g", F.col("feature_id") % 20)
    shown = match.drawn(v, ["model_ord", "g"], *map(F.col, ("subject_id", "feature_ord", "feature_id", "tie", "inliers")))
    return shown.groupBy("model_ord", "g").agg(F.count(F.lit(1)).alias("n"), F.max("subject_id").alias("last_subject"))


# ---- records

_DIGITS = "lpad(o_orderkey::VARCHAR, 7, '0')"


@query(
    "side_union",
    "SELECT o_orderkey AS case_id, 'front' AS side, o_orderpriority AS reading, NULL::VARCHAR AS note FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'back', o_orderstatus, o_orderpriority || '!' FROM orders WHERE o_orderkey % 4 <> 0",
)
def side_union(spark, sf):
    o = _table(spark, sf, "orders")
    front = o.where("o_orderkey % 3 <> 0").selectExpr("o_orderkey AS case_id", "o_orderpriority AS reading")
    back = o.where("o_orderkey % 4 <> 0").selectExpr("o_orderkey AS case_id", "o_orderstatus AS reading", "concat(o_orderpriority, '!') AS note")
    return records.sides_union(front, back).select("case_id", "side", "reading", "note")


_F14, _B14 = "substr(id14, 1, CAST(14 - case_id % 3 AS INT))", "substr(id14, 1, CAST(11 + case_id % 5 AS INT))"


@query(
    "side_join",
    cte("v_id14") + f""", f AS (SELECT case_id, {_F14} AS f FROM v_id14 WHERE case_id % 7 <> 0), b AS (SELECT case_id, {_B14} AS b FROM v_id14 WHERE case_id % 5 <> 0),
j AS (SELECT coalesce(f.case_id, b.case_id) AS case_id, coalesce(f, '') AS f, coalesce(b, '') AS b FROM f FULL JOIN b ON f.case_id = b.case_id)
SELECT case_id, f AS front_id_number, b AS back_id_number, CASE WHEN length(b) = 14 AND length(f) <> 14 THEN b WHEN length(f) = 14 THEN f WHEN length(b) > length(f) THEN b ELSE f END AS id_number, length(f) = 14 AND length(b) = 14 AND f = b AS id_numbers_match FROM j""",
)
def side_join(spark, sf):
    """Two tables of readings, one a side, joined by case; either side may be missing."""
    v = view(spark, sf, "v_id14")
    front = v.where("case_id % 7 <> 0").select("case_id", F.expr(_F14).alias("front_id_number"))
    back = v.where("case_id % 5 <> 0").select("case_id", F.expr(_B14).alias("back_id_number"))
    return records.join_sides(front, back, "case_id").select("case_id", "front_id_number", "back_id_number", "id_number", "id_numbers_match")


_AR = "translate({}, '0123456789', '٠١٢٣٤٥٦٧٨٩')"


@query(
    "card_fields",
    cte("v_id14") + f""", t AS (SELECT case_id, day, cust, status, CASE WHEN case_id % 4 = 0 THEN '3' ELSE substr(id14, 1, 1) END || substr(id14, 2) AS raw, id14 FROM v_id14),
s AS (SELECT *, CASE WHEN case_id % 6 = 0 THEN '' ELSE raw END AS given, CASE WHEN case_id % 3 = 0 THEN substr(id14, 1, 12) ELSE '' END AS bfull, CASE WHEN case_id % 5 = 0 THEN id14 ELSE '12' END AS edge FROM t),
c AS (SELECT *, CASE WHEN given = '' THEN '' WHEN (CASE WHEN substr(given, 1, 1) = '2' THEN 2026 - 1900 - substr(given, 2, 2)::INT ELSE 2026 - 2000 - substr(given, 2, 2)::INT END) BETWEEN 0 AND 100 THEN given
    WHEN 2026 - 2000 - substr(given, 2, 2)::INT BETWEEN 0 AND 100 THEN '3' || substr(given, 2) WHEN 2026 - 1900 - substr(given, 2, 2)::INT BETWEEN 0 AND 100 THEN '2' || substr(given, 2) ELSE given END AS f,
  CASE WHEN length(edge) = 14 THEN edge WHEN length(bfull) = 14 THEN bfull WHEN length(edge) > length(bfull) THEN edge ELSE bfull END AS b FROM s),
r AS (SELECT *, CASE WHEN length(b) = 14 AND length(f) <> 14 THEN b WHEN length(f) = 14 THEN f WHEN length(b) > length(f) THEN b ELSE f END AS id_number FROM c),
d AS (SELECT *, CASE WHEN case_id % 2 = 0 THEN replace(day, '-', '') WHEN length(id_number) >= 7 AND substr(id_number, 1, 1) IN ('2', '3') AND substr(id_number, 4, 2)::INT BETWEEN 1 AND 12 AND substr(id_number, 6, 2)::INT BETWEEN 1 AND 31
    THEN CASE WHEN substr(id_number, 1, 1) = '2' THEN '19' ELSE '20' END || substr(id_number, 2, 6) ELSE '' END AS birth FROM r)
SELECT case_id, 'A' || status || ' B' AS name, CASE WHEN case_id % 9 = 0 THEN '' ELSE 'street ' || cust::VARCHAR END AS address, id_number, f AS front_id_number, b AS back_id_number, birth AS birth_date,
  CASE WHEN case_id % 8 = 0 THEN {_AR.format("replace(day, '-', '')")} ELSE 'none' END AS expiry_date, {_AR.format("replace(substr(day, 1, 7), '-', '/')")} AS issue_date, 'job' AS profession, 'ذكر' AS gender, '' AS religion, 'single' AS marital_status,
  trim(replace('A' || status || ' B ' || CASE WHEN case_id % 9 = 0 THEN '' ELSE 'street ' || cust::VARCHAR END || ' ' || id_number || ' ' || birth, '  ', ' ')) AS front_full_text, CASE WHEN case_id % 8 = 0 THEN 'valid ' || day ELSE '' END AS back_full_text FROM d""",
)
def card_fields(spark, sf):
    """The whole record of every card from the reads of its crops."""
    v = view(spark, sf, "v_id14")
    reads = v.selectExpr(
        "case_id", "array(concat('A', status), '', 'B') AS name", "CASE WHEN case_id % 9 <> 0 THEN array('street', CAST(cust AS string)) END AS address",
        "CASE WHEN case_id % 6 <> 0 THEN concat(CASE WHEN case_id % 4 = 0 THEN '3' ELSE substr(id14, 1, 1) END, substr(id14, 2)) END AS id_number", "CASE WHEN case_id % 2 = 0 THEN replace(day, '-', '') ELSE '99' END AS birth_date",
        "CASE WHEN case_id % 3 = 0 THEN substr(id14, 1, 12) END AS back_id_full", "CASE WHEN case_id % 5 = 0 THEN id14 ELSE '12' END AS back_id_edge", "array('issued', substr(day, 1, 7)) AS issue_date", "array('job') AS profession", "array('دكر') AS gender",
        "CAST(NULL AS array<string>) AS religion", "array(' single ') AS marital_status", "CASE WHEN case_id % 8 = 0 THEN array('valid', day) END AS back_text", "'none' AS expiry_date",
    )
    return records.card_fields(reads, 2026, "case_id")


@query("errors_kept", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN user_id END AS value, CASE WHEN event_id % 3 = 0 THEN 'not a number: ' || event_type END AS error FROM events")
def errors_kept(spark, sf):
    """Values that don't parse carry an error and the run goes on."""
    e = _table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("user_id").cast("string")).alias("raw"))
    return e.select("event_id", text.attempt(F.col("raw").try_cast("bigint"), F.concat(F.lit("not a number: "), F.col("raw"))).alias("r")).select("event_id", "r.*")


@query("trace_elapsed", "SELECT event_id, (event_id % 50) * 61001 AS ms, length(repeat(event_type, 60)[1:200])::INT AS shown FROM events")
def trace_elapsed(spark, sf):
    """Times of day as milliseconds, for elapsed times, and the shown head of long values."""
    ms = (F.col("event_id") % 50) * 61001
    clock = F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
    return _table(spark, sf, "events").select("event_id", text.clock_ms(clock).alias("ms"), F.length(text.traced(F.repeat("event_type", 60))).alias("shown"))


@query("without_raw", "SELECT event_id, '{\"kind\":\"' || event_type || '\",\"user\":' || user_id::VARCHAR || '}' AS doc FROM events")
def without_raw(spark, sf):
    """A result without its raw part."""
    r = F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user"), F.array("event_type").alias("raw"))
    return _table(spark, sf, "events").select("event_id", F.to_json(r.dropFields("raw")).alias("doc"))


# ---- rasters: an embedding as an 8 x 8 image

_PX = """WITH px AS (SELECT vec_id AS image, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x, floor((e[i] + 1) * 100)::INT AS v
  FROM (SELECT vec_id, list_transform(embedding, lambda a: a::DOUBLE) AS e, unnest(range(1, 65)) AS i FROM embeddings))"""


def _px(spark, sf):
    flat = _table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda a: F.floor((a.cast("double") + 1) * 100).cast("int")).alias("e"))
    return pixels.pixels(flat, "vec_id", "e", 8)


def _template(spark):
    return spark.range(64).selectExpr("CAST(id DIV 8 AS int) AS y", "CAST(id % 8 AS int) AS x", "CAST(id * 37 % 101 AS int) AS v")


@query("gray_levels", _PX + " SELECT image, y, x, least(255, round_even(0.114::DOUBLE * v + 0.587::DOUBLE * (v * 2 % 256) + 0.299::DOUBLE * (v * 3 % 256), 0))::INT AS gray, v || ',' || v || ',' || v AS bgr FROM px")
def gray_levels(spark, sf):
    v = F.col("v")
    return _px(spark, sf).select("image", "y", "x", pixels.luma(v, v * 2 % 256, v * 3 % 256).alias("gray"), F.array_join(pixels.to_bgr(F.array(v), F.lit(False)).cast("array<string>"), ",").alias("bgr"))


@query(
    "otsu_level",
    _PX + """, c AS (SELECT image, v, count(*) AS n FROM px GROUP BY image, v), a AS (SELECT *, sum(n) OVER u AS below, sum(n * v) OVER u AS mass, sum(n) OVER w AS total, sum(n * v) OVER w AS every FROM c WINDOW u AS (PARTITION BY image ORDER BY v), w AS (PARTITION BY image)),
s AS (SELECT image, v, CASE WHEN total > below THEN round((below * (total - below))::DOUBLE * (mass::DOUBLE / below - (every - mass)::DOUBLE / (total - below)) ^ 2, 6) ELSE 0 END AS s FROM a) SELECT image, arg_max(v, struct_pack(s := s, v := -v)) AS level FROM s GROUP BY image""",
)
def otsu_level(spark, sf):
    return pixels.otsu(_px(spark, sf))


@query(
    "adaptive_sweep",
    _PX + """, near AS (SELECT a.image, a.y, a.x, a.v, k, avg(b.v) AS m FROM px a, (VALUES (1), (2)) g(k), px b WHERE a.image = b.image AND abs(a.y - b.y) <= k AND abs(a.x - b.x) <= k GROUP BY ALL),
o AS (SELECT image, p.ord, count(*) FILTER (v > m - c)::BIGINT AS n FROM near JOIN (VALUES (0, 1, 2), (1, 1, 10), (2, 2, 2), (3, 2, 10)) p(ord, k, c) USING (k) GROUP BY image, p.ord) SELECT image, arg_max(struct_pack(o := ord, n := n), struct_pack(s := -abs(n - 40), o := -ord)).o AS ord, arg_max(n, struct_pack(s := -abs(n - 40), o := -ord)) AS n FROM o GROUP BY image""",
)
def adaptive_sweep(spark, sf):
    """Every neighbourhood and offset tried; per image the one that marks nearest to 40 pixels, the first on ties."""
    grid = spark.createDataFrame([(0, 1, 2), (1, 1, 10), (2, 2, 2), (3, 2, 10)], "ord int, k int, c int")
    tried = pixels.adaptive(_px(spark, sf), grid).groupBy("image", "ord").agg(F.count_if("on").alias("n"))
    return rank.best(tried, ["image"], -F.abs(F.col("n") - 40).cast("double"), F.col("ord"), F.struct("ord", "n")).select("image", "best.*")


@query("morph_gradient", _PX + ", g AS (SELECT a.image, a.y, a.x, max(b.v) - min(b.v) AS g FROM px a JOIN px b ON a.image = b.image AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL) SELECT image, sum(g)::BIGINT AS total, max(g) AS most FROM g GROUP BY image")
def morph_gradient(spark, sf):
    return pixels.gradient(_px(spark, sf), 1).groupBy("image").agg(F.sum("gradient").alias("total"), F.max("gradient").alias("most"))


@query("sharpened", _PX + ", g AS (SELECT a.image, a.y, a.x, a.v, avg(b.v) AS m FROM px a JOIN px b ON a.image = b.image AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL) SELECT image, sum(floor(least(greatest(1.6::DOUBLE * v - 0.6::DOUBLE * m, 0), 255)))::BIGINT AS total FROM g GROUP BY image")
def sharpened(spark, sf):
    px = pixels.blurred(_px(spark, sf), 1)
    return px.groupBy("image").agg(F.sum(F.floor(F.least(F.greatest(1.6 * F.col("v") - 0.6 * F.col("blur"), F.lit(0.0)), F.lit(255.0)))).alias("total"))


_REGIONS = pixels.quadrants(8, 8) + pixels.thirds(8, 8)


@query("region_means", _PX + " SELECT image, region, round(avg(v), 6) AS mean FROM px JOIN (VALUES " + ", ".join(map(str, _REGIONS)) + ") r(region, x1, y1, x2, y2) ON x >= x1 AND x < x2 AND y >= y1 AND y < y2 GROUP BY image, region")
def region_means(spark, sf):
    regions = spark.createDataFrame(_REGIONS, "region string, x1 int, y1 int, x2 int, y2 int")
    return pixels.region_means(_px(spark, sf), regions).select("image", "region", F.round("mean", 6).alias("mean"))


@query("turned_image", _PX + " SELECT image, sum(v * (1 + (7 - y) + 8 * x))::BIGINT AS quarter, sum(v * (1 + (7 - x) + 8 * (7 - y)))::BIGINT AS half, sum(CASE WHEN x BETWEEN 1 AND 3 AND y BETWEEN 2 AND 6 THEN v ELSE 255 END)::BIGINT AS masked FROM px GROUP BY image")
def turned_image(spark, sf):
    """Checksums of quarter and half turns, and of the image with everything outside one region blank."""
    px = _px(spark, sf)
    total = lambda df, n: df.groupBy("image").agg(F.sum(F.col("v") * (1 + F.col("x") + 8 * F.col("y"))).alias(n))
    masked = pixels.only_inside(px, spark.createDataFrame([(1, 2, 4, 7)], "x1 int, y1 int, x2 int, y2 int")).groupBy("image").agg(F.sum("v").alias("masked"))
    return total(pixels.turned(px, 90, 8, 8), "quarter").join(total(pixels.turned(px, 180, 8, 8), "half"), "image").join(masked, "image")


@query(
    "strip_orientation",
    _PX + """, t AS (SELECT (i // 8)::INT AS y, (i % 8)::INT AS x, (i * 37 % 101)::INT AS t FROM range(64) r(i)), s AS (SELECT image, CASE WHEN p.y = 0 THEN 'top' ELSE 'bottom' END AS a, CASE WHEN t.y = 0 THEN 'top' ELSE 'bottom' END AS b, coalesce(corr(v, t), 0) AS c
  FROM px p JOIN t ON p.x = t.x AND p.y IN (0, 7) AND t.y IN (0, 7) GROUP BY ALL) SELECT image, round(sum(CASE WHEN a = b THEN c ELSE -c END), 6) AS strip FROM s GROUP BY image""",
)
def strip_orientation(spark, sf):
    return pixels.strip_scores(_px(spark, sf), _template(spark), 8).select("image", F.round("strip", 6).alias("strip"))


@query(
    "template_match",
    _PX + """, t AS (SELECT (i // 8)::INT AS y, (i % 8)::INT AS x, (i * 37 % 101)::INT AS t FROM range(64) r(i)), m AS (SELECT image, p.x - t.x AS x0, p.y - t.y AS y0, round(coalesce(corr(v, t), 0), 9) AS s FROM px p JOIN t ON t.x < 4 AND t.y < 3 AND p.x - t.x BETWEEN 0 AND 4 AND p.y - t.y BETWEEN 0 AND 5 GROUP BY ALL)
SELECT image, arg_max(x0, struct_pack(s := s, o := -(y0 * 8 + x0))) AS x, arg_max(y0, struct_pack(s := s, o := -(y0 * 8 + x0))) AS y, round(max(s), 6) AS score FROM m GROUP BY image""",
)
def template_match(spark, sf):
    """The best place of a 4 x 3 template in every image."""
    t = _template(spark).where("x < 4 AND y < 3")
    return pixels.best_match(_px(spark, sf), t, 8, 8, 4, 3).select("image", "x", "y", F.round("score", 6).alias("score"))


@query("tight_crop", _PX + " SELECT image, greatest(min(x) FILTER (v <= 90) * 10 - 6, 0)::INT AS x1, greatest(min(y) FILTER (v <= 90) * 10 - 6, 0)::INT AS y1, least(max(x) FILTER (v <= 90) * 10 + 7, 80)::INT AS x2, least(max(y) FILTER (v <= 90) * 10 + 7, 80)::INT AS y2 FROM px GROUP BY image HAVING least(max(x) FILTER (v <= 90) * 10 + 7, 80) - greatest(min(x) FILTER (v <= 90) * 10 - 6, 0) >= 20 AND least(max(y) FILTER (v <= 90) * 10 + 7, 80) - greatest(min(y) FILTER (v <= 90) * 10 - 6, 0) >= 20 UNION ALL SELECT image, 0, 0, 80, 80 FROM px GROUP BY image HAVING NOT coalesce(least(max(x) FILTER (v <= 90) * 10 + 7, 80) - greatest(min(x) FILTER (v <= 90) * 10 - 6, 0) >= 20 AND least(max(y) FILTER (v <= 90) * 10 + 7, 80) - greatest(min(y) FILTER (v <= 90) * 10 - 6, 0) >= 20, false)")
def tight_crop(spark, sf):
    """The box around the dark pixels of a sparse 80 x 80 image, padded; the whole image where that is too small."""
    sparse = _px(spark, sf).withColumns({"x": F.col("x") * 10, "y": F.col("y") * 10})
    return pixels.tight_box(sparse, 80, 80, 90)


_WARP = [[0.5, 0.25, 1.0], [0.0, 0.75, 0.5], [0.0, 0.0, 1.0]]


@query("warped_image", _PX + ", g AS (SELECT (i % 10)::INT AS x, (i // 10)::INT AS y FROM range(60) r(i)), w AS (SELECT image, g.x, g.y, px.v FROM g JOIN px ON px.x = round_even(0.5::DOUBLE * g.x + 0.25::DOUBLE * g.y + 1, 0)::INT AND px.y = round_even(0.75::DOUBLE * g.y + 0.5, 0)::INT) SELECT image, sum(v * (1 + x + 10 * y))::BIGINT AS total, count(*)::BIGINT AS hit FROM w GROUP BY image")
def warped_image(spark, sf):
    """A perspective crop by inverse mapping: its checksum and how many of its pixels have a source."""
    out = pixels.warped(_px(spark, sf), _WARP, 10, 6)
    hit = pixels.warped(_px(spark, sf).withColumn("v", F.lit(1)), _WARP, 10, 6).groupBy("image").agg(F.sum("v").alias("hit"))
    return out.groupBy("image").agg(F.sum(F.col("v") * (1 + F.col("x") + 10 * F.col("y"))).alias("total")).join(hit, "image")


_SEG = """SELECT l_orderkey AS image, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS pos, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey % 700 ELSE 10 END::INT AS x1, CASE WHEN l_linenumber % 2 = 0 THEN 5 ELSE l_suppkey * 7 % 500 END::INT AS y1,
  CASE WHEN l_linenumber % 2 = 0 THEN l_partkey % 700 + l_linenumber ELSE 790 END::INT AS x2, CASE WHEN l_linenumber % 2 = 0 THEN 590 ELSE l_suppkey * 7 % 500 + l_linenumber END::INT AS y2 FROM lineitem"""


@query(
    "lines_quad",
    f"""WITH s AS ({_SEG}), k AS (SELECT *, CASE WHEN x2 = 790 THEN 'h' ELSE 'v' END AS kind, (y2 - y1)::DOUBLE AS a, (x1 - x2)::DOUBLE AS b FROM s), e AS (SELECT *, a * x1 + b * y1 AS c, CASE WHEN kind = 'h' THEN (y1 + y2) / 2.0::DOUBLE ELSE (x1 + x2) / 2.0::DOUBLE END AS m FROM k),
g AS (SELECT image, kind, count(*) AS n, arg_min(struct_pack(a := a, b := b, c := c), struct_pack(m := m, p := pos)) AS f, arg_max(struct_pack(a := a, b := b, c := c), struct_pack(m := m, p := pos)) AS l FROM e GROUP BY image, kind),
j AS (SELECT h.image, h.f AS h1, h.l AS h2, v.f AS v1, v.l AS v2 FROM g h JOIN g v ON h.image = v.image AND h.kind = 'h' AND v.kind = 'v' AND h.n >= 2 AND v.n >= 2),
c AS (SELECT image, unnest([h1, h1, h2, h2]) AS h, unnest([v1, v2, v1, v2]) AS v FROM j),
p AS (SELECT image, least(greatest((h.c * v.b - v.c * h.b) / (h.a * v.b - v.a * h.b), 0), 799) + least(greatest((h.a * v.c - v.a * h.c) / (h.a * v.b - v.a * h.b), 0), 599) AS s FROM c)
SELECT s.image, count(p.s) > 0 AS found, round(min(p.s), 4) AS nearest, round(max(p.s), 4) AS farthest FROM (SELECT DISTINCT image FROM s) s LEFT JOIN p ON p.image = s.image GROUP BY s.image""",
)
def lines_quad(spark, sf):
    """The quad of each image's outermost lines: whether there is one, and its corners nearest to and farthest from the origin."""
    seg = spark.sql(_SEG.replace("END::INT AS", "END AS").replace("l_extendedprice)::INT AS pos", "l_extendedprice) AS pos").replace("FROM lineitem", "FROM {l}"), l=_table(spark, sf, "lineitem"))
    out = pixels.lines_quad(seg, 800, 600)
    sums = F.transform("contour", lambda p: p["x"] + p["y"])
    return out.select("image", F.col("contour").isNotNull().alias("found"), F.round(F.array_min(sums), 4).alias("nearest"), F.round(F.array_max(sums), 4).alias("farthest"))


@query(
    "contours_quad",
    """WITH c AS (SELECT l_orderkey AS image, l_linenumber AS pos, (l_quantity * 1000)::DOUBLE AS area, l_partkey % 3 AS skip, (l_partkey % 100)::DOUBLE AS x, (l_suppkey % 50)::DOUBLE AS y, l_quantity * 8 AS w, l_quantity * 5 AS h FROM lineitem),
k AS (SELECT *, dense_rank() OVER (PARTITION BY image ORDER BY area DESC, pos) AS k FROM c), s AS (SELECT *, w * h / 160000.0::DOUBLE AS frac, abs(greatest(w, h) / greatest(least(w, h), 1) - 85.6::DOUBLE / 54) / (85.6::DOUBLE / 54) AS err FROM k WHERE k <= 8 AND skip < 2)
SELECT image, round(max(frac - err * 0.8::DOUBLE), 6) AS score FROM s WHERE frac BETWEEN 0.05 AND 0.97 AND h >= 1 AND err <= 0.5 GROUP BY image""",
)
def contours_quad(spark, sf):
    """Contours with three simplifications each, of which the first with four corners counts (none for a third of them)."""
    c = _table(spark, sf, "lineitem").selectExpr("l_orderkey AS image", "l_linenumber AS pos", "double(l_quantity * 1000) AS area", "l_partkey % 3 AS skip", "double(l_partkey % 100) AS x", "double(l_suppkey % 50) AS y", "l_quantity * 8 AS w", "l_quantity * 5 AS h")
    x, y, w, h = (F.col(n) for n in ("x", "y", "w", "h"))
    four, five = geo.quad((x + w, y), (x, y), (x, y + h), (x + w, y + h)), geo.quad((x, y), (x + 1, y), (x + w, y), (x + w, y + h), (x, y + h))
    every = c.withColumn("eps_ord", F.explode(F.array(*map(F.lit, range(3))))).withColumn("polygon", F.when((F.col("skip") < 2) & (F.col("eps_ord") >= F.col("skip")), four).otherwise(five))
    return pixels.contours_quad(every, 160000.0).select("image", F.round("score", 6).alias("score"))
