"""Ledger measurements against brute force; policies and ablations."""

import re

from vouchline.llm import quality


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = {}
    for i in range(len(w) - 4):
        wins.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {i + k for at in wins.values() if len(at) > 1 for i in at for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = ["", None, " \t\n\x0b\f\r ", "a", "a b c d e " * 7, "é x y\n\n é x y", "x y z w v u x y z w v", "l1 a\nl1 a\n l1 a\n", "# $ % a", "b " * 11, "a b c d e f g h i j k l m n o"]


def test_measurements(spark):
    rows = {r.doc_id: r for r in quality.ledger(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).collect()}
    for i, t in enumerate(TEXTS):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t or ""), t


def test_policies_and_ablation(spark):
    docs = spark.createDataFrame([(i, t, 5, "z") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int, DOC_id string")
    kept = quality.apply(docs, "base@1")
    assert kept.columns == docs.columns and [r[0] for r in kept.collect()] == [10]
    entries = quality.ledger(docs)
    rows = {(r.policy, r.rule): r for r in quality.ablation(entries, "base@1").collect()}
    bits = [r.fail_bits for r in entries.collect()]
    for rule in quality.POLICIES["base@1"]:
        assert rows["base@1", rule].n_failed == sum(b & quality.BIT[rule] != 0 for b in bits)
        assert rows["base@1", rule].n_only_by_this == sum(b & 3 == quality.BIT[rule] for b in bits)
    assert quality.ledger(docs.limit(0)).count() == 0
