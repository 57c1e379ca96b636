"""The substring index against every pair, with copies, near and far descriptors."""

import random

from vouchline.operators import match, nearest


def brute(rows, asked):
    far = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a, b))
    out = {}
    for q in asked:
        two = sorted((far(rows[q], e), t) for t, e in rows.items() if t != q)[:2]
        out[q] = tuple(v for d, t in two for v in (t, d))
    return out


def test_index_is_exact_at_both_radii(spark, monkeypatch):
    rng = random.Random(3)
    fresh = lambda: [rng.getrandbits(64) for _ in range(4)]
    rows = {i: fresh() for i in range(60)}
    for i in range(60, 160):  # near copies of the first ten, some identical, up to 40 bits apart
        d = list(rows[i % 10])
        for _ in range(rng.choice([0, 1, 5, 14, 40])):
            d[rng.randrange(4)] ^= 1 << rng.randrange(64)
        rows[i] = d
    signed = lambda d: [v - (1 << 64) if v >> 63 else v for v in d]
    frame = spark.createDataFrame([(i, signed(d)) for i, d in rows.items()] + [(999, None)], "t long, te array<long>")
    asked = frame.where("t % 5 = 0 OR t = 999").toDF("q", "qe")
    want = brute(rows, [i for i in rows if i % 5 == 0])
    for radius, block in ((1, 1000), (0, 1000), (1, 7)):
        monkeypatch.setattr(nearest, "PROBE_BLOCK", block)
        got = nearest.two_nearest_hamming(asked, frame, 4, radius).collect()
        assert {r.q: (r.t1, r.d1, r.t2, r.d2) for r in got} == want
        assert {r.q for r in got if r.indexed} == {q for q, (*_, d2) in want.items() if d2 <= nearest.reach(4, radius)}
        assert {r.indexed for r in got} == {True, False}
    pairs = nearest.indexed_pairs(asked.where("qe IS NOT NULL"), frame.where("te IS NOT NULL"), 4)
    assert pairs.count() == pairs.select("q", "t").distinct().count()


def test_ready_models_by_preference(spark):
    wanted = spark.createDataFrame([("front", 0, "c"), ("front", 1, "gone"), ("front", 2, "a"), ("back", 0, "b")], "side string, ord int, model string")
    ready = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 2, "c"), (2, 1, "b")], "subject int, ord int, model string")
    got = {}
    for r in match.preferred_models(wanted, ready, "subject", k=2).orderBy("place").collect():
        got.setdefault((r.subject, r.side), []).append(r.model)
    assert got == {(1, "front"): ["c", "a"], (1, "back"): ["b", "a"], (2, "front"): ["b"], (2, "back"): ["b"]}
