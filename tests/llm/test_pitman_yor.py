"""Counts and base score by brute force; the model's probabilities sum to one and beat the base on structured text."""

import collections
import math
import random
import re
import zlib

import numpy as np

from vouchline.llm import pitman_yor as py

HELD = "crc32(CAST(coalesce(CAST(doc_id AS string), '') AS binary)) % 5 = 1"


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def corpus():
    rng = random.Random(1)
    follow = {f"w{i}": [f"w{(i * 7 + k) % 40}" for k in range(3)] for i in range(40)}
    rows = [(0, None, 1), (1, "", 1), (2, "É x\tÉ\x0bX", 1)]
    for d in range(3, 150):
        w, out = f"w{rng.randrange(40)}", []
        for _ in range(rng.randint(1, 60)):
            w = rng.choice(follow[w]) if rng.random() < 0.95 else f"new{rng.randrange(10**6)}"
            out.append(w)
            w = w if w in follow else "w0"
        rows.append((d, " ".join(out), 1))
    return rows + [rows[5], rows[5], (None, "w1 w2", 2)]


def test_scores(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, held int")
    got = py.score(docs, HELD).collect()
    assert len(got) == len(rows)
    held = {d: zlib.crc32(str(d).encode() if d is not None else b"") % 5 == 1 for d, *_ in rows}
    train = collections.Counter(w for d, t, _ in rows if not held[d] for w in words(t))
    n, v = sum(train.values()), len(train)
    text = {d: t for d, t, _ in rows}
    model = base = 0.0
    for r in got:
        w = words(text[r.doc_id])
        assert r.held_out == held[r.doc_id] and r.n_tokens == len(w) and r.train_tokens == n
        assert r.n_known == sum(train[x] > 0 for x in w)
        assert math.isclose(r.base_score, sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
        assert r.score < 0
        if r.held_out:
            model, base = model + r.score, base + r.base_score
    assert model > 0.85 * base  # far fewer digits lost a token than by word frequencies
    assert py.score(docs.limit(0), HELD).count() == 0


def test_probabilities_sum_to_one_over_shards():
    rng = np.random.default_rng(3)
    n_words, shards, rooms_ = 60, 3, py.SMALLEST
    word = rng.integers(0, n_words, 900)
    leaf = rng.integers(0, 5, 900) * 150 % rooms_.leaves
    key, count = np.unique(word * rooms_.leaves + leaf, return_counts=True)
    count = count * rng.integers(1, 400, len(count))
    w, u = key // rooms_.leaves, key % rooms_.leaves
    known = len(np.unique(w))
    base = 1 / (known + 1)
    rooms = []
    for s in range(shards):
        on = w % shards == s
        kept, code = np.unique(w[on], return_inverse=True)
        rooms.append(py.Seating(code, u[on], count[on], len(kept)))
    customers = np.bincount(u, count, rooms_.leaves)
    for k in range(3):
        totals = sum(r.totals() for r in rooms)
        for s, r in enumerate(rooms):
            r.sweep(totals, base, np.random.default_rng([k, s]))
            assert (r.t_leaf >= 1).all() and (r.t_leaf <= r.count).all() and (r.t_root >= 1).all()
    after = sum(r.totals() for r in rooms)
    assert after[-1] >= known
    for one in np.unique(u):
        room = one // rooms_.second
        spare = (py.STRENGTH[2] + py.DISCOUNT[2] * after[one]) / (py.STRENGTH[2] + customers[one])
        below = (py.STRENGTH[1] + py.DISCOUNT[1] * after[rooms_.leaves + room]) / (py.STRENGTH[1] + after[: rooms_.leaves].reshape(rooms_).sum(1)[room])
        total = spare * below * (py.STRENGTH[0] + py.DISCOUNT[0] * after[-1]) * base / (py.STRENGTH[0] + after[rooms_.leaves : -1].sum())
        for r in rooms:
            root = r.root_p(after, base)
            parent = below * root
            mine = r.parent == room
            parent[r.parent_word[mine]] = r.parent_p(after, root)[mine]
            p = spare * parent
            here = r.leaf == one
            p[r.word[here]] += (r.count[here] - py.DISCOUNT[2] * r.t_leaf[here]) / (py.STRENGTH[2] + customers[one])
            total += p.sum()
        assert abs(total - 1) < 1e-9


def test_long_queues_open_about_as_many_tables():
    rng = np.random.default_rng(4)
    n = 200
    short, limit = py._ONE_BY_ONE, 10**9
    args = np.full(n, 5000), np.full(n, 100), np.full(n, 0.02), 0.5, 1.0
    by_time = py.reseat(*args, rng)
    py._ONE_BY_ONE = limit
    try:
        one_by_one = py.reseat(*args, rng)
    finally:
        py._ONE_BY_ONE = short
    assert abs(by_time.mean() - one_by_one.mean()) < 0.15 * one_by_one.mean()


def test_scores_are_averaged_predictive_probabilities(spark):
    """The query against loops over plain dictionaries, on the same seating."""
    rows = [(d, t) for d, t, _ in corpus()[:60] if d is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_tokens): r.score for r in py.score(docs, HELD).collect()}
    rooms, shards = py.SMALLEST, max(4, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = lambda w: int(py.END) if w is None else int(py.word_ids([w.encode()])[0])
    one = lambda h: tuple(int(c[0]) for c in py.classes(np.array([h], np.uint64), rooms))
    start = one(int(py.START))
    tokens, counts = {}, collections.Counter()
    for d, t in rows:
        seq, before, last = [], start, start
        for w in map(name, words(t)):
            seq.append((w, last[0] * rooms.second + before[1]))
            before, last = last, one(w)
        tokens[d] = seq
        if zlib.crc32(str(d).encode()) % 5 != 1:
            counts.update(seq)
    seats, at = [], {}
    for k in range(shards):
        pairs = sorted(p for p in counts if int(py._shard_of(np.array([p[0]], np.uint64), shards)[0]) == k)
        known = sorted({w for w, _ in pairs})
        seats.append(py.Seating(np.array([known.index(w) for w, _ in pairs], int), np.array([u for _, u in pairs], int), np.array([counts[p] for p in pairs], int), len(known), rooms))
        for i, p in enumerate(pairs):
            at[p] = (k, i)
        for i, w in enumerate(known):
            at[w] = (k, i)
    base, sums = 1 / (sum(isinstance(k, int) for k in at) + 1), collections.Counter()
    totals = sum(s.totals() for s in seats)
    for sweep in range(py.BURN_IN + py.SAMPLES):
        for k, s in enumerate(seats):
            s.sweep(totals, base, np.random.default_rng([py.SEED, k, sweep]))
        totals = sum(s.totals() for s in seats)
        if sweep < py.BURN_IN:
            continue
        parents, leaf_tables, root_tables, leaf_n = collections.Counter(), {}, {}, collections.Counter()
        parent_tables, root_n = {}, collections.Counter()
        for p, c in counts.items():
            k, i = at[p]
            leaf_tables[p] = int(seats[k].t_leaf[i])
            parents[p[0], p[1] // rooms.second] += leaf_tables[p]
            leaf_n[p[1]] += c
        for w, (k, i) in ((w, v) for w, v in at.items() if isinstance(w, int)):
            root_tables[w] = int(seats[k].t_root[i])
            for j in np.flatnonzero(seats[k].parent_word == i):
                parent_tables[w, int(seats[k].parent[j])] = int(seats[k].t_parent[j])
                root_n[w] += int(seats[k].t_parent[j])
        (d0, d1, d2), (s0, s1, s2) = py.DISCOUNT, py.STRENGTH
        tables_in = lambda d, key: sum(v for k, v in d.items() if k[1] == key)
        for w, u in {x for seq in tokens.values() for x in seq}:
            r = u // rooms.second
            p0 = (root_n[w] - d0 * root_tables.get(w, 0) + (s0 + d0 * sum(root_tables.values())) * base) / (s0 + sum(root_n.values()))
            p1 = (parents[w, r] - d1 * parent_tables.get((w, r), 0) + (s1 + d1 * tables_in(parent_tables, r)) * p0) / (s1 + tables_in(parents, r))
            sums[w, u] += (counts[w, u] - d2 * leaf_tables.get((w, u), 0) + (s2 + d2 * tables_in(leaf_tables, u)) * p1) / (s2 + leaf_n[u])
    for d, seq in tokens.items():
        assert math.isclose(got[d, len(seq)], sum(math.log10(sums[x] / py.SAMPLES) for x in seq), rel_tol=1e-5)


def test_a_second_copy_scores_apart(spark):
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(300)]
    text = lambda: " ".join(rng.choices(vocab, k=80))
    rows = [(i, text()) for i in range(200)]
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 1]
    kept = [i for i, _ in rows if i not in held]
    twins = held[: len(held) // 2]
    for a, b in zip(twins, kept, strict=False):
        rows[a] = (a, rows[b][1])
    got = {r.doc_id: r.score / r.n_tokens for r in py.score(spark.createDataFrame(rows, "doc_id long, text string"), HELD).collect() if r.held_out}
    assert min(got[i] for i in twins) > max(got[i] for i in held if i not in twins)


def test_rooms_grow_with_the_corpus():
    assert py.rooms_for(0) == py.SMALLEST and py.rooms_for(10**9).first == 8192 and py.rooms_for(5 * 10**10).first == 65536


def test_words_that_sums_of_powers_take_for_one_and_long_texts(spark):
    word = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    docs = spark.createDataFrame([(0, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, "w x y z " * 300_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in py.score(docs, "doc_id = 2").collect()}
    assert got[2].n_known == 1 and got[0].n_known == 2 and got[3].n_tokens == 1_200_001 and got[3].train_tokens == 1_200_003
