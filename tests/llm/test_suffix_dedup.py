"""Suffix arrays and removed bytes against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from vouchline.llm import suffix_dedup as sd


def brute(texts):
    at = {}
    for d, t in enumerate(texts):
        for p in range(len(t) - 199):
            at.setdefault(t[p : p + 200], []).append((d, p))
    gone = [np.zeros(len(t), bool) for t in texts]
    for where in at.values():
        if len(where) > 1:
            for d, p in where:
                gone[d][p : p + 200] = True
    out = []
    for t, g in zip(texts, gone, strict=True):
        edges = np.diff(np.concatenate([[0], g.astype(int), [0]]))
        kept = np.frombuffer(t, np.uint8)[~g].tobytes()
        out.append((len(t), int(g.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    prose = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [prose(rng.randint(150, 600)) for _ in range(6)]
    out = [None, "", "x" * 199, "y" * 200, "z" * 201, "ab" * 400, prose(50) * 12]
    for _ in range(40):
        out.append("".join(rng.choice([prose(rng.randint(0, 300)), rng.choice(shared)]) for _ in range(rng.randint(0, 4))))
    out += [out[20], out[20], prose(30) + out[21] + prose(30), shared[0], shared[0][:199], shared[1][1:201]]
    return out


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(2)
    for text in (rng.integers(0, 3, 400), np.zeros(50, int), np.tile([1, 2, 3], 60)):
        text = text.astype(np.uint16)
        raw = text.tolist()
        sa = sd.suffix_array(text)
        assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        got = sd.common_prefixes(text, sa, np.array([0]), np.array([len(raw)]), 20)
        for k in range(1, len(raw)):
            a, b = raw[sa[k - 1] :] + [0] * 30, raw[sa[k] :] + [0] * 30
            n = next((i for i in range(20) if a[i] != b[i]), 20)
            assert got[k] == n


@pytest.mark.parametrize("block", [8000, 3, 1])
def test_removed_bytes(spark, block):
    texts = corpus(block)
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(7, texts[7], "s"), (None, texts[30], "s")], "doc_id long, text string, seg string")
    every = [(t or "").encode() for t in [*texts, texts[7], texts[30]]]
    want = sorted(zip([*map(str, range(len(texts))), "7", "None"], brute(every), strict=True))
    got = sorted((str(r.doc_id), (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in sd.removal(docs, block=block).collect())
    assert got == want
    assert sum(w[1][1] > 0 for w in want) > 15


def test_long_texts_in_parts_and_shuffled_joins(spark, monkeypatch):
    rng = random.Random(9)
    morse = "".join("ab"[i.bit_count() % 2] for i in range(4096))
    passage = "".join(rng.choice("abcdefgh") for _ in range(900))
    noise = lambda n: "".join(rng.choice("ijklmnop ") for _ in range(n))
    texts = [morse, morse.translate(str.maketrans("ab", "ba")), noise(3000) + passage + noise(1300) + passage, "q" * 5000, noise(700) + passage[100:700], noise(2500)]
    monkeypatch.setattr(sd, "_CHUNK", 500)
    monkeypatch.setattr(sd, "BROADCAST_IDS", 0)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute([t.encode() for t in texts])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.removal(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want and want[2][1] > 1500
    found = [b for b in sd._segment_batches([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([texts[2]])], names=["rid", "text"])])]
    assert len(found) > 5 and sum(sum(b.column(2).to_pylist()) for b in found) == len(texts[2]) - 199


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sd.removal(docs).count() == 0
