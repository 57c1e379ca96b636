"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

1. A document's set of three-word shingles is hashed once; each of ``BINS`` equal ranges of hash values keeps
   its least value, and an empty bin takes the value of a filled one that universal hashing of (bin, attempt)
   finds. Equal sets are one vertex from here on.
2. ``ROWS`` bins make a band. A link at exactly 0.85 misses all ``BANDS`` bands with probability
   (1 - 0.85**5)**32 = 7e-9.
3. A bucket gives a star: its least member with each other one, so candidates are fewer than bucket rows. They
   are confirmed on full sets. A centre with many leaves meets them in slots of ``LEAVES``.
4. What a star can't show is a link between two leaves. Buckets whose leaves still belong to different classes
   are compared on full sets: each leaf outside the bucket's largest class with all others, in blocks of
   bounded size; only edges that join classes come back. So no link between texts that share a bucket is lost.

Words are named by 64-bit XXH3, shingles and sets by 64-bit mixes of those: two of n sets share a name with a
probability of about n squared / 2**65. Full sets are read from the texts a second time and only for documents
in a bucket of two or more; a filter of 2**26 bits, whatever the input, finds them.

Defined results: a null or blank text has no shingles and links with nothing; repeated rows each come back with
the same component; a null id takes part and its component is the least id reachable (null if none); texts of
any length are taken whole; an empty table gives an empty result; other columns, also such that differ from the
two in case only, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchline.llm.bits import bit_filter, fits
from vouchline.llm.common import LOWER, distinct_spans, doc_chunks, forget, join_hot, materialise, pick, splitmix, table, text_bytes, word_ids, word_spans
from vouchline.llm.components import SMALL, least_reachable

SHINGLE = 3
#: Links have 100 * intersection >= LINK * union.
LINK = 85
BANDS, ROWS = 32, 5
BINS = BANDS * ROWS
#: Leaves of one centre that are confirmed together.
LEAVES = 256
#: Shingles of a bucket that one task compares with as many others.
BLOCK = 2_000_000
_CHUNK = 4_000_000
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of documents laid end to end."""
    buf = LOWER[buf]
    start, end, counts = word_spans(buf, off)
    codes, words = distinct_spans(buf, start, end)
    name = word_ids(words)[codes] if len(words) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        one = splitmix(name)
        two = splitmix(one[:-1] + name[1:])
        three = splitmix(two[:-1] + name[2:])
    by_words = (None, one, two, three)
    first = np.cumsum(counts) - counts
    return [np.unique(by_words[min(c, SHINGLE)][f : f + max(1, c - SHINGLE + 1)]) if c else name[:0] for f, c in zip(first.tolist(), counts.tolist(), strict=True)]


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One-permutation sketches of non-empty sets, a row of ``BINS`` values each, densified."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    h = np.concatenate(sets)
    place = np.repeat(np.arange(len(sets)), size) * BINS + (((h >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
    least = np.full(len(sets) * BINS, _EMPTY)
    np.minimum.at(least, place, splitmix(h))
    least = least.reshape(-1, BINS)
    filled = least != _EMPTY
    alone = filled.sum(1) == 1
    least[alone] = least[alone].min(1)[:, None]
    row, bin_ = np.nonzero(~filled & ~alone[:, None])
    attempt = 0
    while len(row):
        donor = (splitmix(bin_.astype(np.uint64) + np.uint64(BINS * attempt)) % np.uint64(BINS)).astype(np.int64)
        found = filled[row, donor]
        least[row[found], bin_[found]] = least[row[found], donor[found]]
        row, bin_ = row[~found], bin_[~found]
        attempt += 1
    return least


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A row of ``BANDS`` keys for each sketch."""
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sketch), BANDS))
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            keys = splitmix(keys + sketch[:, r::ROWS])
    return keys


def _set_name(s: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(s.tobytes())


def _prints(batches):
    for batch in batches:
        buf, off = text_bytes(batch.column(1))
        for i, j in doc_chunks(off, _CHUNK):
            sets = shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            there = np.flatnonzero(size)
            keys = band_keys(sketches([sets[k] for k in there])).view(np.int64).ravel() if len(there) else np.zeros(0, np.int64)
            ends = np.cumsum(np.append(0, np.where(size > 0, BANDS, 0))).astype(np.int32)
            name = np.array([_set_name(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(name, mask=size == 0), pa.array(size), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))],
                names=["id", "rid", "v", "n", "bands"],
            )


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, rid (a hash of id and text), v (the set's name, null if empty), n (its size), bands."""
    read = pick(docs, id_col, text_col).withColumn("__rid", F.xxhash64(id_col, text_col))
    return read.mapInArrow(_prints, f"id {read.schema[id_col].dataType.simpleString()}, rid bigint, v bigint, n bigint, bands array<bigint>")


def full_sets(docs: DataFrame, rids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """v, full (its sorted hashes) of at least the rows named in rids (rid)."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(rids, "rid"))  # 8 MB

    def rows(batches):
        bits = shared.value
        for batch in batches:
            chosen = batch.filter(pa.array(fits(bits, batch.column(1).to_numpy(zero_copy_only=False))))
            buf, off = text_bytes(chosen.column(0))
            for i, j in doc_chunks(off, _CHUNK):
                sets = {_set_name(s): s for s in shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i]) if len(s)}
                yield pa.RecordBatch.from_arrays([pa.array(np.array(list(sets), np.uint64).view(np.int64)), pa.array([s.tobytes() for s in sets.values()], pa.binary())], names=["v", "full"])

    read = pick(docs, id_col, text_col).select(text_col, F.xxhash64(id_col, text_col).alias("__rid"))
    return read.mapInArrow(rows, "v bigint, full binary").groupBy("v").agg(F.first("full").alias("full"))


def _linked(one, other, common):
    return 100 * common >= LINK * (one + other - common)


def _confirm(batches):
    """Rows sorted by centre and slot, the centre's own set first: edges that hold."""
    at, centre = None, None
    for batch in batches:
        a, slot, b = (batch.column(k).to_pylist() for k in range(3))
        out = []
        for k in range(batch.num_rows):
            full = np.frombuffer(batch.column(3)[k].as_buffer(), np.uint64)
            if b[k] is None:
                at, centre = (a[k], slot[k]), full.copy()
                continue
            assert at == (a[k], slot[k])
            n, m = len(centre), len(full)
            if 100 * min(n, m) >= LINK * max(n, m):
                place = np.searchsorted(centre, full)
                place[place == n] = 0
                if _linked(n, m, int(np.count_nonzero(centre[place] == full))):
                    out.append((a[k], b[k]))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], names=["a", "b"])


def confirmed(edges: DataFrame, full: DataFrame) -> DataFrame:
    """edges (a, b), few of one b -> those whose full sets link."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = materialise(edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).withColumn("slots", F.expr(f"CAST(ceil(n / {LEAVES}) AS bigint)")), "slots")
    dealt = materialise(join_hot(edges, slots, "a", "n", SMALL).select("a", F.expr("pmod(xxhash64(b), slots)").alias("slot"), "b"), "dealt")
    leaves = dealt.join(full.withColumnRenamed("v", "b"), "b").select("a", "slot", "b", "full")
    centres = dealt.select("a", "slot").distinct().join(full.withColumnRenamed("v", "a"), "a").select("a", "slot", F.lit(None).cast("bigint").alias("b"), "full")
    placed = centres.unionByName(leaves).repartition(parts, "a", "slot").sortWithinPartitions("a", "slot", "b")
    return placed.mapInArrow(_confirm, "a bigint, b bigint")


def _join_classes(lab: np.ndarray, v: np.ndarray, stray: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges that join the classes of one group: each stray member against all, until nothing else links."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    cut = np.cumsum(size) - size
    mark = np.zeros(len(values), np.int32)
    lab, out = lab.copy(), []
    for x in np.flatnonzero(stray).tolist():
        if (lab == lab[x]).all():
            break
        mine = codes[cut[x] : cut[x] + size[x]]
        mark[mine] = 1
        common = np.add.reduceat(mark[codes], cut)
        mark[mine] = 0
        near = np.flatnonzero(_linked(size[x], size, common) & (lab != lab[x]))
        for y in near.tolist():
            if lab[y] != lab[x]:
                out.append((int(v[x]), int(v[y])))
                lab[lab == lab[y]] = lab[x]
    return out


def _compare(batches):
    """Rows sorted by key; a group may span batches."""
    key, held = None, []

    def edges():
        if not held:
            return []
        v, lab = (np.array([r[k] for r in held], np.int64) for k in (0, 1))
        # a block of strays against a block of all, or a whole bucket, whose strays stand in it once
        apart = np.array([r[3] for r in held])
        return _join_classes(lab, v, apart if apart.any() else np.array([r[2] for r in held]), [r[4] for r in held])

    for batch in batches:
        out = []
        columns = [batch.column(k).to_pylist() for k in range(5)]
        for k, (g, v, lab, stray, apart) in enumerate(zip(*columns, strict=True)):
            if g != key:
                out += edges()
                key, held = g, []
            held.append((v, lab, stray, apart, np.frombuffer(batch.column(5)[k].as_buffer(), np.uint64).copy()))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], names=["a", "b"])
    out = edges()
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], names=["a", "b"])


def leaf_links(members: DataFrame, labels: DataFrame, full: DataFrame, block: int = BLOCK) -> DataFrame | None:
    """members (key, v, n, centre), labels (v, lab; rows only where a link is known) -> edges between leaves that join classes.

    None if every bucket's leaves are of one class. Buckets with the same leaves are compared once.
    """
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = members.where("v <> centre").join(labels, "v", "left").select("key", "v", "n", F.coalesce("lab", "v").alias("lab"))
    leaves = materialise(leaves, "leaves")
    open_ = leaves.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("lab").alias("low"), F.max("lab").alias("high"), F.expr("bit_xor(v)").alias("x"), F.expr("bit_xor(xxhash64(v))").alias("y"))
    once = materialise(open_.where("low <> high").groupBy("m", "x", "y").agg(F.min("key").alias("key")), "open")
    if not once.take(1):
        forget(leaves)
        return None
    kept = materialise(join_hot(leaves, once.select("key", "m"), "key", "m", SMALL), "open-leaves")
    forget(leaves)
    by_class = materialise(kept.groupBy("key", "lab").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m")), "open-classes")
    plan = by_class.groupBy("key").agg(F.sum("m").alias("m"), F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("lab", F.struct("n", "lab")).alias("main"))
    # the largest class has no stray; I blocks of strays meet J blocks of all
    plan = materialise(plan.select("key", "m", "main", F.expr(f"greatest(1L, CAST(ceil((n - most) / {block}) AS bigint))").alias("I"), F.expr(f"greatest(1L, CAST(ceil(n / {block}) AS bigint))").alias("J")), "open-plan")
    rows = join_hot(kept, plan, "key", "m", SMALL).withColumn("stray", F.col("lab") != F.col("main"))
    every = rows.select("key", "v", "lab", "stray", F.lit(False).alias("apart"), F.explode(F.expr("sequence(0L, I - 1)")).alias("i"), F.expr("pmod(xxhash64(v), J)").alias("j"))
    apart = rows.where("stray AND I * J > 1").select("key", "v", "lab", "stray", F.lit(True).alias("apart"), F.expr("pmod(xxhash64(v, 1), I)").alias("i"), F.explode(F.expr("sequence(0L, J - 1)")).alias("j"))
    dealt = every.unionByName(apart).select(F.xxhash64("key", "i", "j").alias("g"), "v", "lab", "stray", "apart")
    placed = dealt.join(full, "v").select("g", "v", "lab", "stray", "apart", "full").repartition(parts, "g").sortWithinPartitions("g", "v")
    return placed.mapInArrow(_compare, "a bigint, b bigint")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """id, n, component_id for every row."""
    prints = materialise(signatures(docs, id_col, text_col), "prints")
    distinct = prints.where("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("rid").alias("rid"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    distinct = materialise(distinct, "sets")
    rows = distinct.select("v", F.explode("bands").alias("key"))
    centres = materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("centre")).where("m > 1"), "centres")
    members = materialise(join_hot(rows, centres, "key", "m", SMALL), "members")
    forget(centres)
    involved = members.select("v").distinct().join(distinct.select("v", "rid"), "v")
    full = materialise(full_sets(docs, involved.select("rid"), id_col, text_col), "full-sets")
    stars = materialise(members.where("v <> centre").select(F.col("centre").alias("a"), F.col("v").alias("b")).distinct(), "stars")
    linked = materialise(confirmed(stars, full), "links")
    vertices = distinct.select("v", F.struct(F.col("rep").isNull().alias("none"), "rep", "v").alias("label"))
    reached = least_reachable(vertices, linked)
    more = leaf_links(members.join(distinct.select("v", "n"), "v"), reached.select("v", F.col("label.v").alias("lab")), full, block)
    if more is not None:
        more = materialise(more, "leaf-links")
        if more.take(1):
            reached = least_reachable(vertices, linked.unionByName(more))
    forget(members)
    classes = distinct.join(reached, "v", "left").select("v", "copies", F.when(F.col("label").isNull(), F.col("rep")).otherwise(F.col("label.rep")).alias("component_id"))
    classes = materialise(classes, "classes")
    slim = prints.select("id", "v", "n")
    alone = slim.where("v IS NULL").select("id", "n", F.col("id").alias("component_id"))
    return join_hot(slim.where("v IS NOT NULL"), classes, "v", "copies", SMALL).select("id", "n", "component_id").unionByName(alone).withColumnRenamed("id", id_col)


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept over all documents."""
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: Every two documents that share a shingle, compared on full sets; components by closure.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words
), kinds AS (
  SELECT min(doc_id) AS rep, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY 2
), posting AS (
  SELECT rep, len(s) AS n, unnest(s) AS h FROM kinds
), pairs AS (
  SELECT a.rep AS a, b.rep AS b FROM posting a JOIN posting b ON a.h = b.h AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT rep AS a, rep AS b FROM kinds UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(l.component_id, s.doc_id) AS kept
FROM sets s LEFT JOIN kinds k ON list_sort(s.s) = k.s LEFT JOIN least l ON l.rep = k.rep
"""
