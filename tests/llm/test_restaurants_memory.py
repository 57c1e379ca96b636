"""Restaurants of real contexts: what a shard's arrays take, what a worker keeps, what is shuffled."""

import ctypes
import gc
import tracemalloc
from concurrent.futures import ProcessPoolExecutor
from multiprocessing import get_context
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from vouchline.llm import restaurants as rt

N_PIECES, N_ROOMS, N_WORDS = 12, 40_000, 30_000


def pieces():
    """Pieces of one shard as ``_pieces`` makes them: sorted leaves, each with one to three words."""
    rng = np.random.default_rng(8)
    rows = []
    for block in range(N_PIECES):
        names = np.sort(rng.integers(1, 2**62, N_WORDS).astype(np.uint64))
        room = np.unique(rng.integers(0, N_WORDS**2, N_ROOMS))
        size = rng.integers(1, 4, len(room))
        w = np.concatenate([np.sort(rng.choice(N_WORDS, n, replace=False)) for n in size])
        code = lambda x: (rt.COMMON + x).astype(np.uint32)
        rows.append((0, block, rt._pack(v=code(room // N_WORDS), u=code(room % N_WORDS), w=code(w), size=size.astype(np.uint32), count=rng.integers(0, 3, len(w)).astype(np.uint32), names=names)))
    shard, block, blob = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(block, pa.int64()), pa.array(blob, pa.binary())], names=["shard", "block", "blob"])


LAYOUT = rt.Layout(4, *(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64)))


def test_a_shard_is_put_together_in_little_memory():
    batch = pieces()
    gc.collect()
    tracemalloc.start()
    try:
        (row,) = rt._states(LAYOUT)([batch])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    state = rt._unpack(row.column("blob")[0].as_py())
    assert (np.diff(state["v"].astype(np.int64)) >= 0).all() and state["size"].sum() == len(state["w"])
    pairs = sum(len(rt._unpack(x["blob"])["where"]) for x in row.column("pieces")[0].as_py())
    assert pairs > 900_000 and peak / pairs < 130


def resident():
    return next(int(x.split()[1]) for x in Path("/proc/self/status").read_text().splitlines() if x.startswith("VmRSS")) / 1024


def kept() -> float:
    """MB that a fresh process holds more after a shard than before it."""
    batch = pieces()
    list(rt._states(LAYOUT)([batch.slice(0, 1)]))  # what is loaded once
    gc.collect()
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)
    before = resident()
    assert sum(len(row) for row in rt._states(LAYOUT)([batch])) == 1
    return resident() - before


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="needs glibc")
def test_a_worker_keeps_little_of_what_a_shard_took():
    with ProcessPoolExecutor(1, get_context("spawn")) as pool:
        assert pool.submit(kept).result() < 50


def test_blocks_of_text_are_not_shuffled_to_be_scored(spark, monkeypatch):
    docs = spark.createDataFrame([(d, " ".join(f"w{(d * k) % 97}" for k in range(300))) for d in range(200)], "doc_id long, text string")

    def carried(*_):
        def rows(batches):
            for run in rt._by_key(batches, 5):
                for row in run:
                    if row[1] < 0:
                        n = sum(len(x) for x in row[3:] if x is not None)
                        columns = [[len(row[2])], [True], [n], [0], [0], [0.0], [0.0]]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        return rows

    monkeypatch.setattr(rt, "_document_scores", carried)
    got = rt.score(docs, "doc_id % 5 = 1").collect()
    assert sum(r.doc_id for r in got) == 200 and all(r.n_tokens < 200 for r in got)


def test_batches_of_short_texts_make_one_block():
    given = [pa.RecordBatch.from_arrays([pa.array([k, None]), pa.array([False, True]), pa.array([f"a b{k}", None])], names=["id", "held", "text"]) for k in range(9)]
    (block,) = rt._blocks(given)
    assert block.column("ids")[0].as_py() == [x for k in range(9) for x in (k, None)]
    assert block.column("n_tokens")[0].as_py() == 9 * 4
    held = rt._unpack(block.column("blob")[0].as_py())["held"]
    assert held.tolist() == [False, True] * 9
