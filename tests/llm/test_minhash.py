"""One-permutation sketches against their definition; components against brute force over all pairs."""

import re

import numpy as np

from vouchline.llm import minhash


def slow_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(" ".join(words[i : i + 3]) for i in range(len(words) - 2)) or frozenset([" ".join(words)] if words else [])


def brute(rows):
    """rows of (id, text) -> least id reachable, by row."""
    sets = [slow_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return [least.get(root(i)) for i in range(len(rows))], [len(s) for s in sets]


def check(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, TEXT_ int")
    found = sorted(((r.doc_id, r.n, r.component_id) for r in minhash.components(docs, **how).collect()), key=str)
    component, size = brute(rows)
    assert found == sorted(((i, n, c) for (i, _), n, c in zip(rows, size, component, strict=True)), key=str)
    return component


def planted(rng, n, words):
    """Chains of texts, each a few words away from the one before."""
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    while len(out) < n:
        text = [vocabulary[i] for i in rng.integers(0, 400, int(rng.integers(3, words)))]
        for _ in range(int(rng.integers(1, 7))):
            out.append(" ".join(text))
            for _ in range(int(rng.integers(0, 3))):
                text[int(rng.integers(0, len(text)))] = vocabulary[int(rng.integers(0, 400))]
    return out[:n]


def test_components_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i + 10, t) for i, t in enumerate(planted(rng, 160, 120))]
    component = check(spark, rows)
    assert len(set(component)) < len(rows)


def test_links_between_leaves_are_kept_in_blocks_of_any_size(spark):
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(70):  # one dense group at the threshold: many pairs link, many do not
        text = list(base)
        for k in rng.choice(60, int(rng.integers(0, 4)), replace=False).tolist():
            text[k] = f"x{rng.integers(0, 30)}"
        rows.append((100 - i, " ".join(text)))
    for block in (minhash.BLOCK, 400):
        check(spark, rows, block=block)


def test_leaf_links_join_what_stars_miss(spark):
    # the centre (1) is linked with nothing, the leaves 2 to 6 form two classes
    sets = {1: range(0, 30), 2: range(100, 200), 3: range(105, 205), 4: range(110, 210), 5: range(400, 500), 6: range(401, 501)}
    full = spark.createDataFrame([(v, np.array(list(s), np.uint64).tobytes()) for v, s in sets.items()], "v long, full binary")
    members = spark.createDataFrame([(9, v, len(s), 1) for v, s in sets.items()], "key long, v long, n long, centre long")
    labels = spark.createDataFrame([], "v long, lab long")
    for block in (10_000, 100):
        edges = {frozenset((r.a, r.b)) for r in minhash.leaf_links(members, labels, full, block).collect()}
        assert {frozenset((5, 6))} <= edges <= {frozenset(x) for x in ((2, 3), (3, 4), (2, 4), (5, 6))} and len(edges) >= 3
    known = spark.createDataFrame([(v, 2 if v < 5 else 5) for v in range(2, 7)], "v long, lab long")
    assert minhash.leaf_links(members.where("v < 5"), known, full) is None


def test_nulls_blanks_short_repeated_and_empty(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE\ttwo"), (8, "one two three"), (None, "one two three"), (8, "one two three"), (None, None), (None, "no one has this"), (9, "Été dÉjà vu"), (10, "été dÉjà vu")]
    check(spark, rows)
    assert minhash.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_text_and_its_near_copy(spark):
    words = [f"q{i}" for i in range(150_000)]
    near = words[:]
    near[70_000] = "other"
    rows = [(5, " ".join(words)), (4, " ".join(near)), (3, " ".join(words[:1000]))]
    assert [r.component_id for r in minhash.components(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()] == [3, 4, 4]


def test_sketches_follow_the_definition():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)) for n in (1, 2, 7, 100, 3000)]
    got = minhash.sketches(sets)
    for s, row in zip(sets, got, strict=True):
        bins = {}
        for h in s.tolist():
            k = (h >> 32) * minhash.BINS >> 32
            value = int(minhash.splitmix(np.array([h], np.uint64))[0])
            bins[k] = min(bins.get(k, value), value)
        for k in range(minhash.BINS):
            at, attempt = k, 0
            while at not in bins:
                at = int(minhash.splitmix(np.array([k + minhash.BINS * attempt], np.uint64))[0] % np.uint64(minhash.BINS))
                attempt += 1
            assert int(row[k]) == bins[at]


def test_sketch_agreement_estimates_similarity():
    rng = np.random.default_rng(2)
    agree = []
    for _ in range(300):
        s = np.unique(rng.integers(0, 1 << 63, 7, dtype=np.uint64))
        a, b = minhash.sketches([s, s[:6]])
        agree.append((a == b).mean())
    assert abs(np.mean(agree) - 6 / 7) < 0.03
