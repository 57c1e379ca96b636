"""Phrases against plain counting over strings."""

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import types as T

from vouchline.llm import collocations


def brute(rows, top=collocations.TOP):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= 10}
        rank = []
        for p, a in candidates.items():
            if len(p) == 2 and any(100 * b >= 50 * a for q, b in candidates.items() if len(q) == 3 and p in (q[:2], q[1:])):
                continue
            score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rank.append((-score, -a, " ".join(p).encode(), a, counts[p[:k]], counts[p[k:]], score))
        for i, (_, _, phrase, a, left, right, score) in enumerate(sorted(rank)[:top], 1):
            out.append((lang, i, phrase.decode(), a, left, right, n[lang], score))
    return sorted(out)


def run(spark, rows, top=collocations.TOP, parts=3):
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("LANG_", T.IntegerType())])
    docs = spark.createDataFrame([(*r, 1) for r in rows], kind).repartition(parts)
    found = collocations.phrases(docs, top=top)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in found.collect())


def test_phrases_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    zipf = rng.zipf(1.5, 12_000) % 60
    marks = ["", "", "", "", "", ".", ",", "\n", "\t", "!"]
    words = [f"{'Ww'[k % 2]}é{k}{marks[int(m)]}" for k, m in zip(zipf.tolist(), rng.integers(0, 10, len(zipf)), strict=True)]
    rows = [(" ".join(words[i : i + 40]), ["en", "fr", None, "und", ""][i // 40 % 5]) for i in range(0, len(words), 40)]
    want = brute(rows)
    assert len(want) > 100 and {len(r[2].split(" ")) for r in want} == {2, 3}
    assert run(spark, rows) == want
    assert run(spark, rows, top=7, parts=1) == brute(rows, top=7)


def test_covered_pairs_ties_and_cuts(spark):
    rows = [("a b c. x y! p q r s", "en")] * 12 + [("a b", "en")] * 11 + [("x y z", "en")] * 11 + [("p\tq", "en")] * 30 + [("b\fc", "en"), (None, "en"), ("", None), ("tie1 t tie2 t " * 12, "de")]
    got = run(spark, rows)
    assert got == brute(rows)
    kept = {r[2] for r in got}
    assert "a b c" in kept and "a b" not in kept and "p q" in kept  # 12 of 23 and 12 of 42 occurrences


def test_repeats_overlaps_and_long_text(spark):
    rows = [("ha ha ha " * 20_000, "en"), ("Ha ha; ha", "en"), ("ha ha ha", None)]
    assert run(spark, rows) == brute(rows)


def test_one_large_text_and_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocations.phrases(empty).count() == 0
    assert run(spark, [(None, None), ("", "en"), ("...", "en"), ("one", "en")]) == []
