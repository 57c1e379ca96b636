"""SimHash near-duplicates with pigeonring filtering.

A fingerprint's 64 bits are a ring of four 16-bit segments. If two fingerprints differ in at most three bits,
some start on the ring has all its chains within proportional budgets: the first segment equal, the first
two differ by at most one bit, three by two, four by three. The first two links of the chain make the search
key (an equal segment, and one of the next segment's halves, of which one is equal), so candidates come from
24-bit keys; the chain test then prunes them before the full Hamming check.

Equal fingerprints are collapsed before any pair is formed, and a key group gives a spanning forest of its
links, never all pairs. Groups over ``GROUP`` fingerprints take the third and fourth chain links into their
key; what is still larger is compared in pairs of blocks. No group is capped.

Defined results: null and blank texts have fingerprint zero and link with each other; repeated rows each come
back with the same component; a null id takes part and its component is the least id reachable (null if
none); an empty table gives an empty result; other columns are ignored by ``components``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchline.llm.common import materialise, pick, table, text_bytes
from vouchline.llm.components import least_reachable

SEED = 42
SHINGLE = 3
MAX_BITS = 3
GROUP = 4096
_NO_ID = (1 << 63) - 1


def fingerprint(text: bytes) -> int:
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    n = len(words) - SHINGLE + 1
    h = np.fromiter((xxh64_intdigest(line[s:e], SEED) for s, e in zip(start[:n].tolist(), end[SHINGLE - 1 :].tolist(), strict=True)), np.uint64, n)
    return _majority(h)


def _majority(h: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        bits = np.unpackbits(h[i : i + 8192].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(0, dtype=np.uint16)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def _row_key(id_col: str, text_col: str):
    return F.xxhash64(id_col, text_col)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (the 64 bits as a signed long), rid (a hash of id and text)."""
    docs = pick(docs, id_col, text_col).withColumn("__rid", _row_key(id_col, text_col))

    def rows(batches):
        for batch in batches:
            buf, off = text_bytes(batch.column(1))
            fp = np.array([fingerprint(buf[off[i] : off[i + 1]].tobytes()) for i in range(batch.num_rows)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), batch.column(2)], names=[id_col, "fp", "rid"])

    return docs.mapInArrow(rows, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp bigint, rid bigint")


def _segment(i: str) -> str:
    return f"(shiftrightunsigned(fp, 16 * (({i}) % 4)) & 65535)"


#: Key parts by level: (number of alternatives, part k of the segment that the chain reaches), all as SQL over fp and i.
_LEVELS = (
    (2, f"(shiftright({_segment('i + 1')}, 8 * CAST(k AS int)) & 255)"),
    (3, f"(CASE k WHEN 0 THEN {_segment('i + 2')} & 31 WHEN 1 THEN shiftright({_segment('i + 2')}, 5) & 31 ELSE shiftright({_segment('i + 2')}, 10) END)"),
    (4, f"(shiftright({_segment('i + 3')}, 4 * CAST(k AS int)) & 15)"),
)


def _deepen(rows: DataFrame, level: int) -> DataFrame:
    """One row per alternative, with the alternative and its bits appended to the key."""
    n, part = _LEVELS[level]
    return rows.withColumn("k", F.explode(F.array(*(F.lit(k) for k in range(n))))).withColumn("key", F.expr(f"key * 1024 + k * 256 + {part}")).drop("k")


def _linked(x: np.ndarray, i: np.ndarray | int) -> np.ndarray:
    """Whether differing bits x stay within the chain budgets from segment i on."""
    total = np.zeros(x.shape, np.uint8)
    ok = np.ones(x.shape, bool)
    for step in range(4):
        shift = np.asarray(16 * ((i + step) % 4), np.uint64)
        total = total + np.bitwise_count((x >> shift) & np.uint64(0xFFFF))
        ok &= total <= (step + 1) * MAX_BITS // 4
    return ok


def _forest(fp: np.ndarray, i: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest over the links within one key group."""
    left, a, b = np.arange(len(fp)), [], []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            u = queue.pop()
            near = _linked(fp[left] ^ fp[u], i)
            if near.any():
                reached = left[near].tolist()
                a += [u] * len(reached)
                b += reached
                queue += reached
                left = left[~near]
    return a, b


def _group_edges(batches):
    """Rows sorted by key (key, i, fp); a group may span batches."""

    def edges(key, i, fp):
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(cut, len(key)))
        two = cut[size == 2]
        good = _linked(fp[two] ^ fp[two + 1], i[two])
        a, b = [fp[two[good]]], [fp[two[good] + 1]]
        for s, n in zip(cut[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            u, v = _forest(fp[s : s + n], int(i[s]))
            a.append(fp[s : s + n][u])
            b.append(fp[s : s + n][v])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

    rest = None
    for batch in batches:
        now = [batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)]
        rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
        if not len(rest[0]):
            continue
        done = int(np.searchsorted(rest[0], rest[0][-1]))
        if done:
            yield edges(*(x[:done] for x in rest))
            rest = [x[done:] for x in rest]
    if rest is not None and len(rest[0]):
        yield edges(*rest)


def links(distinct: DataFrame, group: int = GROUP) -> DataFrame:
    """distinct (fp) -> edges a, b that connect exactly what links at ``MAX_BITS`` or fewer bits connect."""
    rows = distinct.select("fp", F.explode(F.array(*(F.lit(i) for i in range(4)))).alias("i"))
    rows = _deepen(rows.withColumn("key", F.expr(f"i * 65536 + {_segment('i')}")), 0)
    ready = []
    for level in (1, 2, 3):
        large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group)
        if not large.take(1):
            break
        large = materialise(large, "large-keys")  # at most rows / group keys
        ready.append(rows.join(large, "key", "left_anti"))
        if level < 3:
            rows = _deepen(rows.join(large.select("key"), "key"), level)
        else:  # pairs of blocks: every two members meet, each task holds two blocks
            blocks = rows.join(large, "key").withColumn("s", F.expr("CAST(ceil(2.0 * n / " + str(group) + ") AS bigint)")).withColumn("mine", F.expr("pmod(xxhash64(fp), s)"))
            rows = blocks.withColumn("other", F.explode(F.expr("sequence(0L, s - 1)"))).select("fp", "i", F.expr("xxhash64(key, least(mine, other), greatest(mine, other))").alias("key"))
    ready.append(rows)
    every = ready[0]
    for more in ready[1:]:
        every = every.unionByName(more)
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = every.select("key", "i", F.col("fp")).repartition(parts, "key").sortWithinPartitions("key", "fp")
    return placed.mapInArrow(_group_edges, "a bigint, b bigint")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_row: bool = False) -> DataFrame:
    """id, fp, component_id (and root, the component's least vertex, and rid) for every row."""
    prints = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(F.coalesce(F.min(id_col), F.lit(_NO_ID)).alias("rep"), F.count(F.lit(1)).alias("n")), "distinct")
    vertices = distinct.select(F.col("fp").alias("v"), F.struct("rep", F.col("fp").alias("v")).alias("label"))
    reached = least_reachable(vertices, links(distinct))
    classes = materialise(
        distinct.join(reached, distinct.fp == reached.v, "left").select("fp", F.expr(f"nullif(coalesce(label.rep, rep), {_NO_ID}L)").alias("component_id"), F.coalesce("label.v", "fp").alias("root"), "n"),
        "classes",
    )
    # Fingerprints that hold over a thousandth of the rows are fewer than a thousand: those go by broadcast, the rest by key.
    often = max(100, prints.count() // 1000)
    hot = F.broadcast(classes.where(F.col("n") > often).drop("n"))
    rare = classes.where(F.col("n") <= often).drop("n")
    return prints.join(hot, "fp").unionByName(prints.join(F.broadcast(classes.where(F.col("n") > often).select("fp")), "fp", "left_anti").join(rare, "fp")).select(id_col, "fp", "component_id", *["root", "rid"] * with_row)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that with the least id, with its own columns.

    Rows of the same id and text count as one; a component without any id keeps one of its rows.
    """
    found = components(docs, id_col, text_col, with_row=True)
    # combined before the shuffle, so a component of any size is one row per task
    best = found.groupBy("root").agg(F.min(F.struct(F.coalesce(id_col, F.lit(_NO_ID)).alias("i"), "rid")).alias("best")).select(F.col("best.rid").alias("__best"))
    best = materialise(best, "representatives")
    slots = [f"__d{k}" for k in range(len(docs.columns))]
    named = docs.toDF(*slots)
    keyed = named.withColumn("__rid", _row_key(slots[docs.columns.index(id_col)], slots[docs.columns.index(text_col)]))
    first = keyed.join(best, keyed["__rid"] == best["__best"], "left_semi")
    repeated = materialise(found.groupBy("rid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("rid").alias("__rid")), "repeated")
    alone = first.join(repeated, "__rid", "left_anti")
    # a row that occurs a million times over is one row per task after the first step of this aggregate
    again = first.join(repeated, "__rid", "left_semi").groupBy("__rid").agg(F.first(F.struct(*slots)).alias("__row")).select("__row.*")
    return alone.select(*slots).unionByName(again.select(*slots)).toDF(*docs.columns)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id over all documents."""
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
