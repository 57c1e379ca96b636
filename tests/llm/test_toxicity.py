"""Chains against enumeration; held-out accuracy on planted words; defined results at the edges."""

import itertools
import random

import numpy as np

from vouchline.llm import toxicity as tox


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    size = np.array([1, 4, 3])
    emit, trans = rng.normal(size=(3, 4)), rng.normal(size=(2, 2))
    p, pairs, log_z = tox.forward_backward(emit, size, trans)
    want_pairs = np.zeros((2, 2))
    for c, n in enumerate(size):
        paths = list(itertools.product((0, 1), repeat=int(n)))
        w = np.array([np.exp(sum(emit[c, t] * y[t] for t in range(n)) + sum(trans[y[t], y[t + 1]] for t in range(n - 1))) for y in paths])
        assert np.isclose(np.log(w.sum()), log_z[c])
        for t in range(n):
            assert np.isclose(p[c, t], w[[y[t] == 1 for y in paths]].sum() / w.sum())
            if t + 1 < n:
                for y, x in zip(paths, w / w.sum(), strict=True):
                    want_pairs[y[t], y[t + 1]] += x
    assert np.allclose(pairs, want_pairs)


def corpus():
    rng = random.Random(2)
    plain = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "ru", "ta") for b in ("ban", "cor", "den", "fil", "gam", "hol")]
    bad = ["grobal", "grobel", "grobin", "Grobus", "snarkú"]
    rows, labels = [], []
    for i in range(400):
        w = rng.choices(plain, k=rng.randint(20, 150))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randint(2, 6)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(x + ("." if rng.random() < 0.1 else "") for x in w), toxic))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_offsets(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(1000, None, "x"), (1001, "", "x"), (None, "Grobus grobel", "x"), (0, rows[0][1], "again")], "doc_id long, text string, score string")
    marked = spark.createDataFrame([*labels, (1, 0), (9999, 1), (None, 1)], "doc_id long, toxic int")
    model = tox.train(docs, marked, "doc_id % 5 <> 0")
    got = tox.tag(docs, model).collect()
    assert len(got) == len(rows) + 4
    truth = {i: t for i, _, t in rows}
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 5 == 0]
    assert np.mean([bool(r.predicted) == truth[r.doc_id] for r in held]) > 0.97
    text = {i: t for i, t, _ in rows}
    words = {text[r.doc_id][s.start : s.end].lower()[:4] for r in held if truth[r.doc_id] for s in r.spans}
    assert "grob" in words
    by = {r.doc_id: r for r in got}
    assert by[1000].score == by[1001].score < 0.5 and by[1000].spans == [] and by[None].predicted == 1
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert tox.tag(docs, tox.train(docs, none, "true")).first().score < 1e-9
    assert tox.tag(docs.limit(0), tox.train(docs.limit(0), none, "true")).count() == 0
