"""Fingerprints against the definition; components against brute force over all pairs."""

import numpy as np
import xxhash

from vouchline.llm import simhash


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def brute_components(prints):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def test_fingerprints_and_components(spark):
    texts = [None, "", " \t", "one", "one two", "Ünï  Two three", "a b c d", "A B\tc\nd", "x " * 300, "the quick brown fox " * 3 + "jumps", "the quick brown fox " * 3 + "jumps"]
    docs = spark.createDataFrame([(i + 5, t, 0) for i, t in enumerate(texts)] + [(5, None, 1)], "doc_id long, text string, fp int")
    rows = simhash.components(docs).collect()
    prints = {i + 5: slow_fingerprint(t or "") for i, t in enumerate(texts)}
    want = brute_components(prints)
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert r.fp % (1 << 64) == prints[r.doc_id] and r.component_id == want[r.doc_id]
    assert simhash.components(docs.limit(0)).count() == 0


def planted(rng, n):
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    out = list(base.tolist())
    for b in base[: n // 3].tolist():
        x = b
        for _ in range(int(rng.integers(1, 4))):  # chains: each within 0 to 4 bits of the one before
            for bit in rng.choice(64, int(rng.integers(0, 5)), replace=False):
                x ^= 1 << int(bit)
            out.append(x)
    return out


def test_links_are_complete_at_any_group_size(spark):
    rng = np.random.default_rng(7)
    values = sorted(set(planted(rng, 150)) | {1 << i for i in range(20)} | {0})
    want = brute_components(dict(enumerate(values)))
    for group in (4096, 4, 2):
        df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
        edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df, group).collect()]
        assert all((a ^ b).bit_count() <= 3 for a, b in edges)
        at = {v: i for i, v in enumerate(values)}
        parent = list(range(len(values)))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            x, y = sorted((root(at[a]), root(at[b])))
            parent[y] = x
        assert {i: root(i) for i in range(len(values))} == want
