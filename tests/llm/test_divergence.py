"""Divergences against a dense table of all kept terms for all groups."""

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import types as T

from vouchline.llm import divergence


def brute(rows):
    docs = [("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""), lang or "", source or "") for t, lang, source in rows]
    out = []
    for lang in {d[1] for d in docs}:
        df, total, own = Counter(), Counter(), defaultdict(Counter)
        for text, _, source in (d for d in docs if d[1] == lang):
            terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
            df.update(set(terms))
            total.update(terms)
            own[source].update(terms)
        kept = sorted((t for t in df if df[t] >= 3), key=lambda t: t.encode())

        def shares(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        q = shares(total)
        p = {s: shares(c) for s, c in own.items()}
        for s in own:
            pair = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in own if o != s]
            term = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", sorted(term, key=lambda x: (-x[0], x[1].encode()))[:200])):
                out += [(lang, s, part, item, v, i) for i, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1)]
    return sorted(out)


KIND = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "lang", "source")] + [T.StructField("SOURCE_", T.IntegerType())])


def run(spark, rows, parts=3):
    found = divergence.audit(spark.createDataFrame([(*r, 1) for r in rows], KIND).repartition(parts))
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in found.collect())


def test_audit_equals_a_dense_table(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(240):
        words = [f"{'Tt'[k % 2]}{chr(97 + k % 23)}é{'xyz'[k % 3] * (k // 23)}" for k in (rng.zipf(1.4, 30) % 120).tolist()]
        rows.append((" 1,".join(words) if i % 17 else "the " * int(rng.integers(1, 500)), ["en", "fr", None, ""][i % 4], f"s{i % 5 if i % 3 else 0}"))
    want = brute(rows)
    assert run(spark, rows) == want
    assert len({r[:2] for r in want}) == 15 and any(r[2] == "term" for r in want)


def test_more_than_200_terms_and_ties(spark):
    texts = [" ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(260))] * 3
    rows = [(t, "en", "a") for t in texts] + [("other words here", "en", "b")] * 3
    got = run(spark, rows)
    assert got == brute(rows) and sum(r[2] == "term" and r[1] == "a" for r in got) == 200


def test_nulls_groups_without_terms_and_no_kept_terms(spark):
    rows = [(None, None, None), ("", "en", "a"), ("1 2 3", "en", "b"), ("rare", "en", "c"), ("rare", "en", "c"), ("ÀÉ ñ", "es", "x"), ("ÀÉ ñ", "es", None), ("ÀÉ", "es", "x"), ("", "es", "y")]
    got = run(spark, rows)
    assert got == brute(rows)
    assert [r[4] for r in got if r[0] == "en"] == [0] * 6  # three groups, no kept term
    assert divergence.audit(spark.createDataFrame([], KIND)).count() == 0
