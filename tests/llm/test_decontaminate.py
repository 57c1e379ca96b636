"""Containment of test items against brute force, and the search's completeness."""

import math
import random
import re

from vouchline.llm import decontaminate


def shingles(text):
    w = re.sub(r"[\W_]+", " ", (text or "").lower()).split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_containment_and_cleaning(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    items = [" ".join(rng.choices(vocab, k=rng.randint(1, 50))) for _ in range(25)] + ["", None, "one two"]
    docs = []
    for i in range(60):
        body = rng.choices(vocab, k=rng.randint(0, 400))
        if i % 3 == 0:
            w = (items[i % 25] or "").split()
            for _ in range(rng.randint(0, 1)):
                w[rng.randrange(len(w))] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = [x.upper() + "," for x in w]
        docs.append((i, " ".join(body), "e", 1))
    docs += [(100, None, "e", 1), (101, "One, TWO!", "e", 1), (101, "One, TWO!", "e", 1), (None, items[3], "e", 1), (102, "", "e", 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id string, __x int")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {}
    for d, t, *_ in docs:
        for k, item in enumerate(items):
            s = shingles(item)
            if s and len(s & shingles(t)) >= math.ceil(0.8 * len(s) - 1e-9):
                want[d, k] = len(s & shingles(t))
    got = {(r.doc_id, r.item_id): r.n_shared for r in decontaminate.containment(frame, bench).collect()}
    assert got == want and len(want) > 10
    kept = decontaminate.clean(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, *_ in docs if not any(x == d for x, _ in want))
    assert decontaminate.containment(frame, bench.limit(0)).count() == 0 and decontaminate.containment(frame.limit(0), bench).count() == 0


def test_rows_of_one_id_are_one_document(spark):
    item = " ".join(f"w{i}" for i in range(20))
    first, last = " ".join(f"w{i}" for i in range(12)), " ".join(f"w{i}" for i in range(8, 20))
    docs = spark.createDataFrame([(1, first, "a"), (1, last, "b"), (2, first, "c"), (None, first, "d"), (None, last, "e"), (3, item, "f"), (3, item, "f")], "doc_id long, text string, TEXT string")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    got = {(r.doc_id, r.n_shared) for r in decontaminate.containment(docs, bench).collect()}
    assert got == {(1, 16), (None, 16), (3, 16)}
    assert sorted(r.doc_id or 0 for r in decontaminate.clean(docs, bench).collect()) == [0, 0, 1, 1, 2]


def test_sketches_are_kept_by_size(spark):
    items = spark.createDataFrame([(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in (5, 9, 20, 100)], "item_id long, text string")
    sketch = decontaminate.sketches(decontaminate._words(items, "text").select("item_id", "__w", "__m"))
    kept = {r.item_id: r for r in sketch.groupBy("item_id", "upper").count().collect()}
    for n, r in kept.items():
        shingles_ = n - 4
        assert shingles_ <= r.upper < 2 * shingles_ or r.upper == shingles_ == 1
        assert r["count"] == min(shingles_, r.upper - math.ceil(0.8 * r.upper - 1e-9) + 1)
    assert decontaminate.bars(sketch).count() == len({r.upper for r in kept.values()})


def test_long_text(spark):
    long = " ".join(f"x{i}" for i in range(120_000))
    item = " ".join(f"x{i}" for i in range(70_000, 70_030))
    docs = spark.createDataFrame([(1, long)], "doc_id long, text string")
    assert [r.n_shared for r in decontaminate.containment(docs, spark.createDataFrame([(0, item)], "item_id long, text string")).collect()] == [26]
