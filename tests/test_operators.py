"""Truth tables and edge cases of the verification operators."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from vouchline.functions import geometry as geo
from vouchline.functions import scoring, text
from vouchline.operators import boxes, gates, ocr, records, vote
from vouchline.vision import kernels
from vouchline.vision.registry import Extractor, Registry


def one(spark, rows, schema, **columns):
    return [r.asDict() for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema).select("i", *(c.alias(n) for n, c in columns.items())).orderBy("i").collect()]


def slow_vote(v):
    t = f = 0
    for k, b in enumerate(v, 1):
        t, f = t + b, f + (not b)
        rest = len(v) - k
        if (k == 2 and t == 2) or t > f + rest:
            return True, k
        if f >= t + rest:
            return False, k
    return False, 0


def test_sequential_vote_on_all_short_vectors(spark):
    vectors = [list(v) for n in range(7) for v in itertools.product((True, False), repeat=n)]
    got = one(spark, [(v,) for v in vectors], "v array<boolean>", r=vote.sequential_vote(F.col("v")))
    assert [(g["r"]["passed"], g["r"]["used"]) for g in got] == [slow_vote(v) for v in vectors]
    assert slow_vote([True, True, False, False]) == (True, 2) and slow_vote([True, False, True, False]) == (False, 4)


def test_digits_dates_and_ids(spark):
    got = one(spark, [("a१२b34",), ("١٢٣",), ("۱۲۳",), ("",)], "t string", d=text.only_digits(F.col("t")))
    assert [g["d"] for g in got] == ["१२34", "123", "123", ""]
    dates = ["20230231", "18991231", "21001231", "21010101", "20231301", "2023123", None, "٢٠٢٣٠١٠١"]
    assert [g["v"] for g in one(spark, [(d,) for d in dates], "t string", v=text.valid_yyyymmdd(F.col("t")))] == [True, False, True, False, False, False, False, False]
    born = one(spark, [("2990101" + "1234567",), ("30506121234567",), ("19901011234567",), ("2991301",), ("299010",)], "t string", b=text.birth_from_id(F.col("t")))
    assert [g["b"] for g in born] == ["19990101", "20050612", "", "", ""]
    found = one(spark, [("2024/05/06",), ("2024 05 06",), ("x1 2024-13-40 y20231231",), ("",)], "t string", d=text.extract_yyyymmdd(F.col("t")))
    assert [g["d"] for g in found] == ["20240506", "20240506", "20231231", ""]
    same = one(spark, [("1" * 14, "١" * 14), ("1" * 13, "1" * 13), (None, "1" * 14)], "a string, b string", m=records.ids_match(F.col("a"), F.col("b")))
    assert [g["m"] for g in same] == [True, False, False]


def test_numeric_field_and_bidi(spark):
    t = F.col("t")
    rows = one(spark, [(["12", "34567"],), (["123456789"],), ([],)], "t array<string>", n=text.numeric_field(t, None), five=text.numeric_field(t, 5), eight=text.numeric_field(t, 8))
    assert [(r["n"], r["five"], r["eight"]) for r in rows] == [("1234567", "34567", "1234567"), ("123456789", "12345", "12345678"), ("", "", "")]
    wrapped = one(spark, [("abc",), ("نص",), (None,)], "t string", once=text.bidi_wrap(t), twice=text.bidi_wrap(text.bidi_wrap(t)))
    assert [r["once"] for r in wrapped] == ["abc", "⁧نص⁩", None] and all(r["once"] == r["twice"] for r in wrapped)
    nested = spark.createDataFrame([({"k": ["نص", "x"]}, 1)], "m map<string,array<string>>, n int")
    assert text.bidi_wrap_all(nested).first().m == {"k": ["⁧نص⁩", "x"]}
    assert [r["n"] for r in one(spark, [("12²３a",), (None,)], "t string", n=text.isdigit_count(t))] == [4, 0]


def test_reconcile_and_back_choice(spark):
    d = lambda n, c="1": c * n
    a, b = F.col("a"), F.col("b")
    got = one(spark, [(d(14), d(14, "2")), (d(10), d(11, "2")), (d(10), d(10, "2")), (d(13), d(14, "2"))], "a string, b string", r=records.reconcile(a, b))
    assert [g["r"][0] for g in got] == ["1", "2", "1", "2"]
    got = one(spark, [(d(13), d(12, "2")), (d(12), d(13, "2")), (d(14), d(14, "2")), (d(14), d(15, "2"))], "a string, b string", r=records.back_id_choice(a, b))
    assert [g["r"][0] for g in got] == ["1", "2", "2", "1"]


def test_scores_distances_and_liveness(spark):
    lines = spark.createDataFrame([(1, "١٢", 0.5), (2, "ab", None)], "k int, t string, c double")
    got = {r.k: r.score for r in ocr.text_scores(lines, ["k"], F.col("t"), F.col("c")).collect()}
    assert got[1] == 7.0 and math.isnan(got[2])
    v = one(spark, [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>", d=scoring.cosine_distance(F.col("a"), F.col("b")))
    assert abs(v[0]["d"]) < 1e-9 and abs(v[1]["d"] - 1) < 1e-9 and math.isnan(v[2]["d"])
    faces = spark.createDataFrame([(1, True, None, 1.0, 0), (2, True, 0.5, 1.0, 0), (3, True, 0.49, 1.0, 0), (4, True, 0.9, 1.0, 0), (4, True, 0.9, 1.0, 1), (5, None, 0.9, 1.0, 0)], "k int, is_real boolean, score double, area double, pos int")
    assert {r.k: r.passed for r in gates.liveness(faces, "k").collect()} == {1: True, 2: True, 3: False, 4: False, 5: False}


STAGES = ["has_front", "has_back", "has_selfie", "feature_error", "feature_front", "feature_back", "align_error", "photo_present", "face_error", "face_passed", "ocr_error", "id_digits", "liveness_error", "liveness_passed"]


def test_gates(spark):
    ok = dict(zip(STAGES, (True, True, True, False, True, True, False, True, False, True, False, 14, False, True), strict=True))
    cases = [{}, {"align_error": True}, {"ocr_error": True}, {"liveness_passed": False}, {"feature_back": False}, {"photo_present": False}, {"has_selfie": False}, {"id_digits": 13}, {"face_passed": False}]
    df = spark.createDataFrame([(i, *(ok | c).values()) for i, c in enumerate(cases)], "i int, " + ", ".join(f"{s} {'int' if s == 'id_digits' else 'boolean'}" for s in STAGES))
    batch = {r.i: (r.card_valid, r.face_match, r.liveness, r.overall) for r in gates.pipeline_gate(df).collect()}
    assert [batch[i] for i in range(6)] == [(True, True, True, True), (True, None, None, False), (False, True, True, False), (True, True, False, True), (False, None, None, False), (True, None, None, False)]
    web = {r.i: (r.stage, r.gate, r.overall_passed) for r in gates.web_gate(df).collect()}
    assert web[3] == ("completed", None, True) and web[6] == ("error", 0, False) and web[7][1] == 2 and web[8][1] == 3 and web[1][1] == 1
    steps = gates.gate_timeline(gates.web_gate(df)).where("i = 7").orderBy("gate_no").collect()
    assert [s.status for s in steps] == ["ok", "failed", "skipped", "skipped"]


def test_order_points_and_area(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]
    rows = [(list(p),) for p in itertools.permutations(square)]
    got = one(spark, rows, "q array<struct<x:double,y:double>>", o=geo.order_points(F.col("q")))
    assert all([(p.x, p.y) for p in g["o"]] == square for g in got)
    area = one(spark, [(square,), (square[::-1],), ([(1.0, 1.0)] * 4,)], "q array<struct<x:double,y:double>>", a=geo.polygon_area(F.col("q")))
    assert [g["a"] for g in area] == [12.0, 12.0, 0.0]


def test_boxes(spark):
    rng = np.random.default_rng(4)
    rows = []
    for page in range(6):
        for i in range(25):
            x, y = rng.integers(0, 300, 2).tolist()
            rows.append((page, i, x, y, x + int(rng.integers(1, 40)), y + int(rng.integers(1, 40))))
    df = spark.createDataFrame(rows, "page long, id int, x1 int, y1 int, x2 int, y2 int")
    hit = lambda a, b, g: a[2] - g < b[4] + g and b[2] - g < a[4] + g and a[3] - g < b[5] + g and b[3] - g < a[5] + g
    want = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and hit(a, b, 3)}
    for cell in (16, 64, 500):
        got = boxes.overlap_pairs(df, "page", "id", 3, cell).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    merged = boxes.merge_boxes(df, "page", 3).collect()
    assert sum(m.members for m in merged) == len(rows)
    flat = [(m.page, 0, m.x1, m.y1, m.x2, m.y2) for m in merged]
    assert not any(i < j and a[0] == b[0] and hit(a, b, 3) for i, a in enumerate(flat) for j, b in enumerate(flat))


def test_kernels_and_registry(spark):
    src = np.array([[0, 0], [4, 0], [4, 3], [0, 3]], float)
    m = kernels.perspective(src, src * 2 + 1)
    assert np.allclose(kernels.apply_matrix(m, src), src * 2 + 1)
    rng = np.random.default_rng(1)
    a = rng.uniform(0, 100, (40, 2))
    b = a * 1.5 + 3
    b[:8] += 50
    h, good = kernels.ransac_homography(a, b)
    assert good.sum() == 32 and not good[:8].any() and kernels.ransac_homography(a[:3], b[:3])[0] is None and h is not None
    image = np.concatenate([np.full((5, 8), 20), np.full((5, 8), 200)])
    assert 20 <= kernels.otsu(image) < 200 and abs(kernels.ncc(image, image) - 1) < 1e-9 and kernels.ncc(image, image * 0) == 0
    assert kernels.rotate(np.arange(6).reshape(2, 3), 90).shape == (3, 2)
    registry = Registry()
    registry.add(Extractor("half", "id bigint, v double", lambda: lambda f: f.assign(v=10 / f.v)))
    registry.add(Extractor("deep", "id bigint", lambda: None, available=False, reason="no weights"))

    def fragile():
        def run(f):
            if f.v.iloc[0] == 0:
                raise ValueError("zero")
            return f.assign(v=10 / f.v)

        return run

    registry.add(Extractor("fragile", "id bigint, v double", fragile))
    got = {r.id: (r.v, r.error) for r in registry.run("fragile", spark.createDataFrame([(1, 2.0), (2, 0.0)], "id long, v double")).collect()}
    assert got[1] == (5.0, None) and got[2][1] == "ValueError: zero"
    assert [r.available for r in registry.table(spark).orderBy("ord").collect()] == [True, False, True]


def test_winner_of_a_fusion_is_shrunk(spark):
    q = [(0.0, 0.0), (300.0, 0.0), (300.0, 200.0), (0.0, 200.0)]
    far = [(x + 400, y) for x, y in q]
    df = spark.createDataFrame([(q, far, 2.0, 1.0)], "a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>, sa double, sb double")
    f = geo.fused(F.col("a"), F.col("sa"), F.col("b"), F.col("sb"), F.col("a"), F.lit(1200.0), F.lit(900.0))
    got = df.select(f.alias("f")).first().f
    assert got.branch == "winner" and abs(math.dist(got.contour[0], (0, 0)) - 2) < 1e-9
