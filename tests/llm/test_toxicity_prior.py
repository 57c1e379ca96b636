"""Scores keep the labels' share when the classes are drawn at different rates."""

from vouchline.llm import toxicity as tox


def test_prior_of_all_labelled_rows(spark, monkeypatch):
    monkeypatch.setattr(tox, "MAX_CLEAN", 40)
    rows = [(i, f"aa{i}q bb{i}z") for i in range(400)]  # no word tells the classes apart
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = tox.train(docs, labels, "true")
    got = [r.score for r in tox.tag(docs, model).collect()]
    assert abs(sum(got) / len(got) - 0.1) < 0.05


def test_repeated_ids_shared_texts_and_clashing_labels(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(tox, "fit", lambda texts, toxic: seen.update(zip([t.decode() for t in texts], toxic.tolist(), strict=True)) or tox.Model(None, __import__("numpy").zeros(4), __import__("numpy").zeros(4)))
    docs = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (2, "same", 0), (3, "same", 0), (4, "x" * 60, 0), (5, "y" * 60, 0)], "doc_id long, text string, TEXT int")
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 0), (4, 1), (5, 1)], "doc_id long, toxic int")
    tox.train(docs, labels, "true")
    assert seen == {"a": 0.0, "same": 1.0, "x" * 60: 1.0, "y" * 60: 1.0}
    seen.clear()
    monkeypatch.setattr(tox, "MAX_BYTES", 70)
    tox.train(docs, labels, "true")
    assert sum(len(t) for t, y in seen.items() if y) <= 70 + 4 and len(seen) >= 2


def test_words_that_sums_of_powers_take_for_one():
    import numpy as np

    word = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    raw = (word + " " + word.translate(str.maketrans("ab", "ba"))).encode()
    one, two = tox.Tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).features[0]
    assert one != two


def test_long_text(spark):
    docs = spark.createDataFrame([(1, "plain words here. " * 150_000)], "doc_id long, text string")
    model = tox.Model(tox.Crf(__import__("numpy").zeros(0, "uint64")), __import__("numpy").zeros(4), __import__("numpy").zeros(4))
    assert tox.tag(docs, model).first().score == 0.5
