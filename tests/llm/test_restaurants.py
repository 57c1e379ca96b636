"""Restaurants of real contexts: probabilities sum to one, contexts aren't put together, hot contexts are dealt further."""

import random
import zlib

import numpy as np
import pytest

from vouchline.llm import pitman_yor as py
from vouchline.llm import restaurants as rt

HELD = "crc32(CAST(coalesce(CAST(doc_id AS string), '') AS binary)) % 5 = 1"


def held(d):
    return zlib.crc32(str(d).encode()) % 5 == 1


@pytest.mark.parametrize("hot", [False, True])
def test_probabilities_of_every_leaf_sum_to_one(hot):
    rng = np.random.default_rng(3)
    n_words, n_v, n_rooms = 40, 3, 9
    names = np.sort(rng.integers(1, 2**62, n_words).astype(np.uint64))
    none = np.zeros(0, np.uint64)
    lay = rt.Layout(4, none, names[1:2] if hot else none, np.array([2] if hot else [], np.int64))
    count = rng.integers(0, 6, n_rooms * n_words) * (rng.random(n_rooms * n_words) < 0.5)
    state = {
        "v": (rt.COMMON + np.repeat(np.arange(n_v), n_rooms // n_v)).astype(np.uint32), "size": np.full(n_rooms, n_words, np.uint32),
        "w": (rt.COMMON + np.tile(np.arange(n_words), n_rooms)).astype(np.uint32), "count": count.astype(np.uint32), "names": names,
    }
    seats = rt.Seats(state, lay)
    above = np.zeros(len(seats.slot_w))
    for h in np.unique(seats.slot_h):
        on = seats.slot_h == h
        above[on] = rng.dirichlet(np.ones(on.sum()))
    for _ in range(3):
        seats.sweep(above, rng)
        assert (seats.t_leaf[count > 0] >= 1).all() and (seats.t_leaf <= count).all() and (seats.t_parent <= seats.customers()).all()
        assert np.allclose(np.bincount(seats.room, seats.leaf_p(above)), 1)
    again = rt.Seats(state, lay)
    again.restore(seats.tables())
    assert (again.t_leaf == seats.t_leaf).all() and (again.t_parent == seats.t_parent).all()


def test_packed_arrays_come_back():
    rng = np.random.default_rng(4)
    given = {"a": rng.integers(0, 2**63, 1000).astype(np.uint64), "b": np.zeros(0, np.uint32), "c": rng.random(7).astype(np.float32), "d": rng.random(9) < 0.5}
    got = rt._unpack(rt._pack(**given))
    assert all((got[k] == v).all() and got[k].dtype == v.dtype for k, v in given.items())


def chains():
    """The two words before fix the next one; far more pairs of words than ``py.SMALLEST`` has classes."""
    rng = random.Random(5)
    follow = lambda a, b: f"w{zlib.crc32(f'{a} {b}'.encode()) % 80}"
    rows = []
    for d in range(1500):
        out = [f"w{rng.randrange(80)}", f"w{rng.randrange(80)}"]
        for _ in range(40):
            out.append(follow(*out[-2:]) if rng.random() < 0.95 else f"w{rng.randrange(80)}")
        rows.append((d, " ".join(out)))
    return rows


def per_token(rows):
    return sum(r.score for r in rows if r.held_out) / sum(r.n_tokens for r in rows if r.held_out)


def test_two_words_before_are_told_apart_and_hot_contexts_change_little(spark, monkeypatch):
    docs = spark.createDataFrame(chains(), "doc_id long, text string")
    got = rt.score(docs, HELD).collect()
    classes = py.score(docs, HELD).collect()
    assert {(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got} == {(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in classes}
    assert np.allclose(sorted(r.base_score for r in got), sorted(r.base_score for r in classes), rtol=1e-9)
    assert per_token(got) > per_token(classes) + 0.3
    plain = rt.layout

    def all_hot(blocks, shards):
        lay = plain(blocks, shards)
        hot = np.sort(lay.common[: len(lay.common) // 2])
        return lay._replace(common=lay.common[::3], hot=hot, parts=np.full(len(hot), 3))

    monkeypatch.setattr(rt, "layout", all_hot)
    hot = rt.score(docs, HELD).collect()
    assert abs(per_token(hot) - per_token(got)) < 0.01 and sorted(r.base_score for r in hot) == sorted(r.base_score for r in got)


def test_the_query_keeps_contexts_apart_and_takes_odd_rows(spark, tmp_path):
    rows = [*chains()[:600], (None, "w1 w2"), (601, None), (602, ""), (602, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = py.op1_pitman_yor(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.score < 0 for r in got)
    by_class = py.score(spark.read.parquet(f"{tmp_path}/documents.parquet"), HELD).collect()
    assert per_token(got) > per_token(by_class) + 0.1
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert py.op1_pitman_yor(spark, f"{tmp_path}/none").count() == 0
