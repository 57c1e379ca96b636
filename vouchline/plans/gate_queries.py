"""Gate, liveness, vector, box and region queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vouchline.functions import geometry as geo
from vouchline.functions import scoring
from vouchline.operators import boxes, faces, gates, match, nearest, rank, vote
from vouchline.plans.adapters import cte, view

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


_S = cte("v_stage")
_GATE = _S + """, g AS (SELECT *, NOT feature_error AND feature_front AND feature_back AS fe FROM v_stage), h AS (SELECT *, fe AND NOT align_error AND photo_present AS runs FROM g)"""


@query(
    "pipeline_gate",
    _GATE + """ SELECT case_id, fe AND NOT (runs AND ocr_error) AS card_valid, CASE WHEN runs AND NOT face_error THEN face_passed END AS face_match, CASE WHEN runs AND NOT liveness_error THEN liveness_passed END AS liveness,
  CASE WHEN NOT fe THEN 'features' WHEN align_error THEN 'alignment' WHEN NOT runs THEN 'photo' END AS stopped_at, fe AND NOT (runs AND ocr_error) AND coalesce(runs AND NOT face_error AND face_passed, false) AS overall FROM h""",
)
def pipeline_gate(spark, sf):
    return gates.pipeline_gate(view(spark, sf, "v_stage")).select("case_id", "card_valid", "face_match", "liveness", "stopped_at", "overall")


_WEB = _S + """, w AS (SELECT case_id, CASE WHEN NOT (has_front AND has_back AND has_selfie) THEN 'error' WHEN align_error THEN 'alignment_failed' WHEN ocr_error OR id_digits <> 14 THEN 'invalid_card'
  WHEN face_error OR NOT face_passed THEN 'face_match_failed' ELSE 'completed' END AS stage FROM v_stage)"""


@query("web_gate", _WEB + " SELECT case_id, stage, CASE stage WHEN 'error' THEN 0 WHEN 'alignment_failed' THEN 1 WHEN 'invalid_card' THEN 2 WHEN 'face_match_failed' THEN 3 END AS gate, stage = 'completed' AS overall_passed FROM w")
def web_gate(spark, sf):
    return gates.web_gate(view(spark, sf, "v_stage")).select("case_id", "stage", "gate", "overall_passed")


@query("gate_timeline", _WEB + """, f AS (SELECT *, CASE stage WHEN 'alignment_failed' THEN 1 WHEN 'invalid_card' THEN 2 WHEN 'face_match_failed' THEN 3 END AS fg FROM w)
SELECT case_id, g AS gate_no, n AS gate_name, CASE WHEN g > fg THEN 'skipped' WHEN g = fg THEN 'failed' ELSE 'ok' END AS status FROM f, (VALUES (1, 'alignment'), (2, 'ocr'), (3, 'face_match'), (4, 'liveness')) t(g, n)""")
def gate_timeline(spark, sf):
    return gates.gate_timeline(gates.web_gate(view(spark, sf, "v_stage"))).select("case_id", "gate_no", "gate_name", "status")


@query(
    "stage_toggles",
    _S + """ SELECT case_id, CASE WHEN has_front THEN CASE WHEN feature_error THEN 'error' WHEN feature_front THEN 'passed' ELSE 'failed' END END AS front_features, NULL::VARCHAR AS back_features,
  CASE WHEN has_front THEN CASE WHEN align_error THEN 'error' ELSE 'passed' END END AS alignment, CASE WHEN align_error OR NOT (has_front OR has_back) THEN 'skipped' WHEN ocr_error THEN 'error' ELSE 'passed' END AS ocr,
  CASE WHEN has_selfie AND has_front AND NOT align_error THEN CASE WHEN NOT photo_present THEN 'skipped' WHEN face_error THEN 'error' WHEN face_passed THEN 'passed' ELSE 'failed' END END AS face,
  CASE WHEN has_selfie THEN CASE WHEN liveness_error THEN 'error' WHEN liveness_passed THEN 'passed' ELSE 'failed' END END AS live FROM v_stage""",
)
def stage_toggles(spark, sf):
    """A configuration that turns one stage off; missing keys count as on."""
    return gates.stage_toggles(view(spark, sf, "v_stage"), {"feature_back": False, "ocr": True}).select("case_id", "front_features", "back_features", "alignment", "ocr", "face", "live")


@query("batch_totals", _S + " SELECT count(*)::BIGINT AS images, count(*) FILTER (NOT align_error)::BIGINT AS detected, count(*) FILTER (photo_present)::BIGINT AS photo_ok, count(*) FILTER (id_digits = 14)::BIGINT AS crops_ok FROM v_stage")
def batch_totals(spark, sf):
    return view(spark, sf, "v_stage").agg(F.count(F.lit(1)).alias("images"), F.count_if(~F.col("align_error")).alias("detected"), F.count_if("photo_present").alias("photo_ok"), F.count_if(F.col("id_digits") == 14).alias("crops_ok"))


_LIVE = cte("v_live")


@query(
    "liveness",
    _LIVE + """, g AS (SELECT user_id, count(*) AS n, arg_max(struct_pack(r := is_real, s := antispoof_score), struct_pack(a := area, p := -event_id)) AS f FROM v_live GROUP BY user_id)
SELECT user_id, n::BIGINT AS face_count, n = 1 AND f.r AND (f.s IS NULL OR f.s >= 0.5) AS passed, CASE WHEN n = 1 AND f.r AND (f.s IS NULL OR f.s >= 0.5) THEN 'ok' ELSE 'failed' END AS status, f.r AS selected_face_is_real, f.s IS NOT NULL AS score_present, f.s IS NULL OR f.s >= 0.5 AS score_ok FROM g""",
)
def liveness(spark, sf):
    faces = view(spark, sf, "v_live").withColumn("f", gates.face_summary(F.col("is_real"), F.col("antispoof_score"))).select("user_id", "area", F.col("event_id").alias("pos"), "f.*")
    return gates.liveness(faces, "user_id").select("user_id", "face_count", "passed", "status", "selected_face_is_real", "score_present", "score_ok")


@query(
    "largest_face",
    _LIVE + """, f AS (SELECT *, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 3 = 1 THEN area END, 0), area * 2, 0) * coalesce(nullif(CASE WHEN event_id % 5 = 0 THEN NULL ELSE 2.0::DOUBLE END, 0), 3, 0) AS size FROM v_live)
SELECT user_id, event_type, arg_max(event_id, struct_pack(a := size, p := -event_id)) AS face FROM f GROUP BY ALL""",
)
def largest_face(spark, sf):
    """Sides that are missing or zero fall back to width and height."""
    w = F.when(F.col("event_id") % 3 == 0, 0.0).when(F.col("event_id") % 3 == 1, F.col("area"))
    faces = view(spark, sf, "v_live").withColumns({"w": w, "width": F.col("area") * 2, "h": F.when(F.col("event_id") % 5 != 0, 2.0), "height": F.lit(3.0)})
    return rank.largest_face(faces, ["user_id", "event_type"], F.col("event_id"), F.col("event_id"))


@query("min_distance", _LIVE + " SELECT user_id, arg_min(event_id, struct_pack(d := coalesce(antispoof_score, 1), p := -event_id)) AS event FROM v_live GROUP BY user_id")
def min_distance(spark, sf):
    """Least distance, missing ones count as 1, the last wins ties."""
    return view(spark, sf, "v_live").groupBy("user_id").agg(F.min_by("event_id", F.struct(F.coalesce("antispoof_score", F.lit(1.0)), -F.col("event_id"))).alias("event"))


_EMB = cte("v_emb")
_PAIR = _EMB + ", p AS (SELECT a.vec_id, a.e AS a, b.e AS b FROM v_emb a JOIN v_emb b ON b.vec_id = a.vec_id + 1)"
_COS = "(1 - list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))))"


def _pairs(spark, sf):
    """Each vector with its successor: the two pictures of a case."""
    v = view(spark, sf, "v_emb")
    return v.select("vec_id", F.col("e").alias("a")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("b")), "vec_id")


@query("cosine_pairs", _PAIR + f" SELECT vec_id, round({_COS}, 6) AS distance FROM p")
def cosine_pairs(spark, sf):
    return _pairs(spark, sf).select("vec_id", F.round(scoring.cosine_distance(F.col("a"), F.col("b")), 6).alias("distance"))


@query(
    "metrics_all",
    _PAIR + f""" SELECT vec_id, round({_COS}, 6) AS cosine, round(list_distance(a, b), 6) AS euclidean,
  round(list_distance(list_transform(a, lambda x: x / sqrt(list_dot_product(a, a))), list_transform(b, lambda x: x / sqrt(list_dot_product(b, b)))), 6) AS euclidean_l2,
  round(acos(least(greatest(1 - {_COS}, -1), 1)) / pi(), 6) AS angular, len(a)::INT AS size, round(sqrt(list_dot_product(a, a)), 6) AS norm FROM p""",
)
def metrics_all(spark, sf):
    a, b = F.col("a"), F.col("b")
    cosine = scoring.cosine_distance(a, b)
    return _pairs(spark, sf).select(
        "vec_id", F.round(cosine, 6).alias("cosine"), F.round(scoring.euclidean(a, b), 6).alias("euclidean"), F.round(scoring.euclidean(scoring.unit(a), scoring.unit(b)), 6).alias("euclidean_l2"),
        F.round(F.acos(F.least(F.greatest(1 - cosine, F.lit(-1.0)), F.lit(1.0))) / F.pi(), 6).alias("angular"), F.size("a").alias("size"), F.round(scoring.norm(a), 6).alias("norm"),
    )


_THRESHOLDS = ((0, "Buffalo_L", 0.9), (1, "ArcFace", 0.95), (2, "Facenet512", 1.0), (3, "Facenet", 1.05))
_FACE = _PAIR + f", d AS (SELECT vec_id, {_COS} AS d FROM p), m AS (SELECT vec_id, o, model, d, t FROM d, (VALUES (0, 'Buffalo_L', 0.9::DOUBLE), (1, 'ArcFace', 0.95::DOUBLE), (2, 'Facenet512', 1.0::DOUBLE), (3, 'Facenet', 1.05::DOUBLE)) x(o, model, t))"


def _faces(spark, sf):
    models = F.broadcast(spark.createDataFrame(list(_THRESHOLDS), "o int, model string, t double"))
    pairs = _pairs(spark, sf).select("vec_id", scoring.cosine_distance(F.col("a"), F.col("b")).alias("d"))
    return pairs.crossJoin(models).withColumn("passed", F.col("d") <= F.col("t")).withColumn("margin", scoring.margin(F.col("t"), F.col("d")))


@query("face_verify", _FACE + " SELECT vec_id, model, d <= t AS passed, round(t - d, 6) AS margin FROM m")
def face_verify(spark, sf):
    return _faces(spark, sf).select("vec_id", "model", "passed", F.round("margin", 6).alias("margin"))


@query("face_vote", _FACE + ", v AS (SELECT vec_id, list(d <= t ORDER BY o) AS v FROM m GROUP BY vec_id) SELECT vec_id, len(list_filter(v, lambda x: x)) > 2 OR (v[1] AND v[2]) AS passed FROM v")
def face_vote(spark, sf):
    voted = vote.ordered_votes(_faces(spark, sf), ["vec_id"], "o", "passed")
    return voted.select("vec_id", vote.sequential_vote(F.col("votes"))["passed"].alias("passed"))


@query("face_rank", _FACE + " SELECT vec_id, model, row_number() OVER (PARTITION BY vec_id ORDER BY (d <= t) DESC, round(t - d, 9) DESC, o)::INT AS rank FROM m")
def face_rank(spark, sf):
    return rank.rank_by(_faces(spark, sf), ["vec_id"], F.col("passed").desc(), F.round(scoring.nan_safe(F.col("margin")), 9).desc(), F.col("o")).select("vec_id", "model", "rank")


# no face where a picture's first component is low; no distance from the last model where its second is high
_TRIED = _FACE + """, f AS (SELECT m.*, p.a[1] < -0.15 OR (o = 1 AND p.b[1] < -0.1) AS failed, o = 3 AND p.a[2] > 0.1 AS lost, (o + 1) * 10 + vec_id % 7 AS ms FROM m JOIN p USING (vec_id)),
r AS (SELECT *, NOT failed AND NOT lost AND d <= t AS passed FROM f)"""


def _tried(spark, sf):
    models = F.broadcast(spark.createDataFrame(list(_THRESHOLDS), "o int, model string, threshold double"))
    df = _pairs(spark, sf).crossJoin(models).withColumn("error", F.when((F.get("a", F.lit(0)) < -0.15) | ((F.col("o") == 1) & (F.get("b", F.lit(0)) < -0.1)), "no face"))
    lost = (F.col("o") == 3) & (F.get("a", F.lit(1)) > 0.1)
    df = df.withColumn("distance", F.when(~lost, scoring.cosine_distance(F.col("a"), F.col("b")))).withColumn("elapsed", (F.col("o") + 1) * 10 + F.col("vec_id") % 7)
    return faces.attempts(df.drop("a", "b"))


@query("face_report", _TRIED + " SELECT vec_id, model, CASE WHEN failed THEN 'error' ELSE 'ok' END AS status, CASE WHEN failed THEN 'no face' END AS error, passed, CASE WHEN NOT failed AND NOT lost THEN round(t - d, 6) END AS margin, ms AS elapsed FROM r")
def face_report(spark, sf):
    """Every model's attempt on every pair, with failed ones and those without a distance."""
    return _tried(spark, sf).select("vec_id", "model", "status", "error", "passed", F.round("threshold_margin", 6).alias("margin"), "elapsed")


@query(
    "face_decision",
    _TRIED + """, v AS (SELECT vec_id, list(passed ORDER BY o) AS v, count(*) FILTER (failed) AS failed, sum(ms)::BIGINT AS elapsed FROM r GROUP BY vec_id)
SELECT vec_id, len(list_filter(v, lambda x: x)) > 2 OR (v[1] AND v[2]) AS passed, failed, elapsed FROM v""",
)
def face_decision(spark, sf):
    return faces.decision(_tried(spark, sf), ["vec_id"], "o").select("vec_id", "passed", "failed", "elapsed")


_KNN = _EMB + """, d AS (SELECT q.vec_id AS q, t.vec_id AS t, list_distance(q.e, t.e) AS d FROM v_emb q JOIN v_emb t ON q.vec_id % 50 = 0 AND q.vec_id <> t.vec_id),
k AS (SELECT q, arg_min(t, struct_pack(d := d, t := t)) AS t1, min(d) AS d1, (list(d ORDER BY d, t))[2] AS d2 FROM d GROUP BY q)"""


def _two(spark, sf):
    v = view(spark, sf, "v_emb")
    queries = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("e").alias("qe"))
    return nearest.two_nearest_vectors(queries, v.select(F.col("vec_id").alias("t"), F.col("e").alias("te")))


@query("nearest_face", _KNN + " SELECT q, t1, round(d1, 6) AS d1, round(d2, 6) AS d2 FROM k")
def nearest_face(spark, sf):
    """Queries: every vector whose id is divisible by 50, against all vectors."""
    return _two(spark, sf).select("q", "t1", F.round("d1", 6).alias("d1"), F.round("d2", 6).alias("d2"))


@query("knn2_ratio", _KNN + " SELECT q, t1 FROM k WHERE d1 < 0.97::DOUBLE * d2")
def knn2_ratio(spark, sf):
    return match.ratio_test(_two(spark, sf), 0.97).select("q", "t1")


_BOX = cte("v_box") + ", b AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, tie) AS box FROM v_box)"


def _boxes(spark, sf):
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "tie")]
    return rank.rank_by(view(spark, sf, "v_box"), ["image_id"], *order, alias="box")


@query("overlap_pairs", _BOX + " SELECT a.image_id, a.box::INT AS a, b.box::INT AS b FROM b a JOIN b ON a.image_id = b.image_id AND a.box < b.box AND a.x1 - 10 < b.x2 + 10 AND b.x1 - 10 < a.x2 + 10 AND a.y1 - 10 < b.y2 + 10 AND b.y1 - 10 < a.y2 + 10")
def overlap_pairs(spark, sf):
    return boxes.overlap_pairs(_boxes(spark, sf).select("image_id", "box", "x1", "y1", "x2", "y2"), "image_id", "box", 10, 64)


# every box takes in whatever overlaps it, all boxes at once, over and over; boxes of one group end up equal
_MERGE = """, g AS (
  SELECT {page}, id, 0 AS turn, x1, y1, x2, y2 FROM start UNION ALL
  SELECT a.{page}, a.id, a.turn + 1, min(b.x1), min(b.y1), max(b.x2), max(b.y2) FROM g a JOIN g b ON a.{page} = b.{page}
    AND (a.id = b.id OR (greatest(a.x1, b.x1) - {gap} < least(a.x2, b.x2) + {gap} AND greatest(a.y1, b.y1) - {gap} < least(a.y2, b.y2) + {gap}))
  WHERE a.turn < 40 GROUP BY a.{page}, a.id, a.turn
), merged AS (SELECT {page}, x1::BIGINT AS x1, y1::BIGINT AS y1, x2::BIGINT AS x2, y2::BIGINT AS y2, count(*) AS members FROM g WHERE turn = 40 GROUP BY 1, 2, 3, 4, 5)"""


@query("merged_boxes", cte("v_box").replace("WITH", "WITH RECURSIVE", 1) + ", start AS (SELECT image_id, row_number() OVER () AS id, x1, y1, x2, y2 FROM v_box)" + _MERGE.format(page="image_id", gap=2) + " SELECT * FROM merged")
def merged_boxes(spark, sf):
    return boxes.merge_boxes(view(spark, sf, "v_box"), "image_id", 2)


@query("box_union", cte("v_box") + " SELECT image_id, min(x1) - 2 AS x1, min(y1) - 2 AS y1, max(x2) + 2 AS x2, max(y2) + 2 AS y2 FROM v_box GROUP BY image_id")
def box_union(spark, sf):
    return view(spark, sf, "v_box").groupBy("image_id").agg((F.min("x1") - 2).alias("x1"), (F.min("y1") - 2).alias("y1"), (F.max("x2") + 2).alias("x2"), (F.max("y2") + 2).alias("y2"))


@query("box_order", _BOX + " SELECT image_id, box::INT AS box, row_number() OVER (PARTITION BY image_id ORDER BY y1, x1, box)::INT AS place FROM b")
def box_order(spark, sf):
    return rank.rank_by(_boxes(spark, sf), ["image_id"], F.col("y1"), F.col("x1"), F.col("box"), alias="place").select("image_id", "box", "place")


@query("region_filter", _BOX + " SELECT image_id, box::INT AS box FROM b WHERE (x2 - x1) * (y2 - y1) / 90000.0::DOUBLE BETWEEN 0.0003 AND 0.55 AND x2 - x1 >= 0.02 * 300 AND y2 - y1 >= 0.015 * 300 AND (x2 - x1) / greatest(y2 - y1, 1)::DOUBLE BETWEEN 0.2 AND 40")
def region_filter(spark, sf):
    return _boxes(spark, sf).where(boxes.text_region(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), 300, 300)).select("image_id", "box")


_ROI_VALUES = "(VALUES " + ", ".join(f"('{s}', '{f}', {o}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE, {str(n).lower()}, {str(p).lower()})" for s, f, o, a, b, c, d, n, p in boxes.ROIS) + ") roi(side, field, ord, rx1, ry1, rx2, ry2, is_numeric, is_photo)"


@query(
    "roi_crops",
    f"""SELECT o_orderkey AS case_id, side, field, is_numeric, greatest(0, round_even(rx1 * 928, 0)::INT - 4) AS x1, greatest(0, round_even(ry1 * 584, 0)::INT - 4) AS y1,
  least(928, round_even(rx2 * 928, 0)::INT + 4) AS x2, least(584, round_even(ry2 * 584, 0)::INT + 4) AS y2 FROM orders, {_ROI_VALUES} WHERE side = CASE WHEN o_orderkey % 2 = 0 THEN 'front' ELSE 'back' END""",
)
def roi_crops(spark, sf):
    """Every image with the regions of its side, in pixels of the template."""
    images = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey AS case_id", "CASE WHEN o_orderkey % 2 = 0 THEN 'front' ELSE 'back' END AS side")
    px = geo.norm_box_px(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), 928, 584, boxes.ROI_PAD)
    return images.join(F.broadcast(boxes.roi_table(spark)), "side").withColumn("px", px).select("case_id", "side", "field", "is_numeric", "px.x1", "px.y1", "px.x2", "px.y2")


@query(
    "hit_test",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(arg_max(field, ord), '') AS field FROM lineitem LEFT JOIN {_ROI_VALUES} ON side = 'back' AND l_quantity / 50 BETWEEN rx1 AND rx2 AND l_linenumber / 8.0::DOUBLE BETWEEN ry1 AND ry2 GROUP BY ALL""",
)
def hit_test(spark, sf):
    points = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") / 50).alias("px"), (F.col("l_linenumber") / 8.0).alias("py"))
    keyed = points.withColumn("key", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return boxes.hit_test(keyed, boxes.roi_table(spark).where("side = 'back'"), "key").select("key.*", "field")


@query("drag_box", cte("v_box") + """ SELECT image_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, round(least(x1, x2) / 1000.0, 6) AS x1, round(least(y1, y2) / 1000.0, 6) AS y1, round(least(greatest(x1, x2) / 1000.0, 1), 6) AS x2, round(greatest(y1, y2) / 1000.0, 6) AS y2 FROM v_box WHERE abs(x2 - x1) >= 5 AND abs(y2 - y1) >= 5""".replace("/ 1000.0", "/ 1000.0::DOUBLE"))
def drag_box(spark, sf):
    box = boxes.drag_box(F.col("x2"), F.col("y1"), F.col("x1"), F.col("y2"), 1000.0, 1000.0)  # dragged from right to left
    return view(spark, sf, "v_box").withColumn("d", box).where("d IS NOT NULL").select("image_id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "d.*")


@query(
    "roi_names",
    """SELECT doc_id, field, count(*)::BIGINT AS n, count(*) > 1 OR length(field) = 0 AS rejected
  FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10))), concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS field FROM documents) GROUP BY doc_id, field""",
)
def roi_names(spark, sf):
    """Each line of a document as a region's name: those that it holds twice, or empty ones, are rejected."""
    named = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.explode(F.split("text", "\n")).alias("field"))
    return rank.repeated_or_empty(named, ["doc_id"], "field")


@query(
    "side_regions",
    _BOX.replace("WITH", "WITH RECURSIVE", 1) + """, start AS (SELECT image_id, box AS id, x1, y1, x2, y2 FROM b WHERE (x2 - x1) * (y2 - y1) / 90000.0::DOUBLE BETWEEN 0.0003 AND 0.55 AND x2 - x1 >= 0.02 * 300 AND y2 - y1 >= 0.015 * 300 AND (x2 - x1) / greatest(y2 - y1, 1)::DOUBLE BETWEEN 0.2 AND 40)"""
    + _MERGE.format(page="image_id", gap=10) + """ SELECT image_id, printf('region_%02d', row_number() OVER (PARTITION BY image_id ORDER BY y1, x1, y2, x2)) AS region,
  round_even(x1 / 960.0::DOUBLE, 4) AS x1, round_even(y1 / 600.0::DOUBLE, 4) AS y1, round_even(x2 / 960.0::DOUBLE, 4) AS x2, round_even(y2 / 600.0::DOUBLE, 4) AS y2 FROM merged""",
)
def side_regions(spark, sf):
    """Plausible text boxes of a side, merged, in page order, as named 0..1 regions (half-even at four places)."""
    plausible = _boxes(spark, sf).where(boxes.text_region(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), 300, 300))
    placed = rank.rank_by(boxes.merge_boxes(plausible, "image_id", 10), ["image_id"], F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2"), alias="place")
    share = lambda c, most: geo.share(F.col(c), most).alias(c)
    return placed.select("image_id", F.format_string("region_%02d", F.col("place")).alias("region"), share("x1", 960), share("y1", 600), share("x2", 960), share("y2", 600))
