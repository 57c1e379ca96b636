"""Exact substring dedup: bytes covered by a 200-byte string that also starts elsewhere.

1. Shards. Every 200-byte window has an anchor: its least 32-byte hash. Equal windows have equal anchors, so
   windows are dealt out by anchor hash and all copies of a string meet in one shard; neighbouring windows
   with one anchor travel as one segment, and an anchor met only once needs no text at all.
2. Per-shard suffix arrays. A shard's distinct segments, each with its number of occurrences, are sorted by
   Larsson-Sadakane refinement in numpy (eight bytes first, then doubled; only unsorted groups are sorted
   again). Kasai's rule gives common prefixes, all segments of a shard
   in step; neighbours that share 200 bytes form a group, duplicated if it has two occurrences in all.
3. Cross-shard merging. An anchor with more distinct segments than ``BLOCK`` is sorted in several blocks;
   their windows' names are cut into ranges, a row for each block and range, and merged by binary search.

Segments, and windows that go from block to block, are named by their 128-bit XXH3. Long texts are cut into
parts of ``_CHUNK`` windows that overlap by 199 bytes, so no task holds more of a text than that while it hashes.

Defined results: null and empty texts have no bytes; matches never cross documents; repeated rows duplicate
each other; null ids pass through; an empty table gives an empty result; other columns, also such that differ
from the two in case only, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xxhash import xxh3_128_digest

from vouchline.llm.common import doc_chunks, materialise, pick, splitmix, table, text_bytes

WINDOW = 200
GRAM = 32
#: Distinct segments of one anchor that are sorted together.
BLOCK = 1_000
_CHUNK = 2_000_000
_SHARD_BYTES = 2_000_000
#: Below so many ids a list of documents is broadcast (8 bytes each).
BROADCAST_IDS = 200_000


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    rest = width - step
    return np.minimum(v[:-rest], v[rest:]) if rest else v


_BYTE_VALUES = splitmix(np.arange(256, dtype=np.uint64) + np.uint64(77))


def _gram_hash(buf: np.ndarray) -> np.ndarray:
    """A hash of every 32-byte string, doubled from single bytes. Different strings with one hash only share a shard."""
    h, width = _BYTE_VALUES[buf], 1
    with np.errstate(over="ignore"):
        while width < GRAM:
            h = h[:-width] * np.uint64(0xD6E8FEB86659FD93) + h[width:]
            h ^= h >> np.uint64(31)
            width *= 2
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def segments_of(buf: np.ndarray, off: np.ndarray):
    """(document, first window, windows, anchor, segment hash, weight) of documents laid end to end.

    The weight is 1, or 2 if the anchor moves within the segment, which may then repeat itself.
    """
    n = len(buf)
    fits = np.flatnonzero(np.diff(off) >= WINDOW)
    if not len(fits):
        return None
    h = _gram_hash(buf)
    # the place of a hash is kept in its twelve low bits; where a window's places pass a multiple of 4096, those
    # of the second coding don't, so the leftmost of equal hashes is found whatever the alignment
    width, at = WINDOW - GRAM + 1, np.arange(len(h), dtype=np.int64)
    v, w = (_sliding_min((h & ~np.uint64(4095)) | ((at + shift) & 4095).astype(np.uint64), width) for shift in (0, 2048))
    p = at[: len(v)]
    chosen = np.where((p & 4095) + width > 4096, (w.astype(np.int64) - 2048 - p) & 4095, (v.astype(np.int64) - p) & 4095) + p
    edge = np.zeros(len(v) + 1, np.int8)
    edge[off[fits]] = 1
    edge[off[fits + 1] - WINDOW + 1] = -1
    valid = np.cumsum(edge[:-1], dtype=np.int8) > 0
    anchor = v >> np.uint64(12)
    same = np.zeros(len(v) + 1, bool)  # window p goes with window p - 1
    same[1:-1] = (anchor[1:] == anchor[:-1]) & valid[1:] & valid[:-1]
    first, last = np.flatnonzero(valid & ~same[:-1]), np.flatnonzero(valid & ~same[1:])
    moves = np.zeros(len(v), np.int64)
    np.cumsum(chosen[1:] != chosen[:-1], out=moves[1:])
    doc = np.searchsorted(off, first, "right") - 1
    raw = memoryview(np.ascontiguousarray(buf))
    names = [xxh3_128_digest(raw[a:b]) for a, b in zip(first.tolist(), (last + WINDOW).tolist(), strict=True)]
    return doc, first - off[doc], last - first + 1, anchor[first].view(np.int64), names, 1 + (moves[last] != moves[first])


def _parts(off: np.ndarray):
    """Runs of documents of about ``_CHUNK`` bytes, and parts of longer ones: (first document, end, first byte of the part, its end)."""
    for i, j in doc_chunks(off, _CHUNK):
        start, end = int(off[i]), int(off[j])
        if end - start <= 2 * _CHUNK:
            yield i, j, start, end
        else:
            for a in range(start, max(start + 1, end - WINDOW + 1), _CHUNK):
                yield i, j, a, min(end, a + _CHUNK + WINDOW - 1)


def _segment_batches(batches):
    for batch in batches:
        buf, off = text_bytes(batch.column(1))
        rid = batch.column(0).to_numpy(zero_copy_only=False)
        for i, j, start, end in _parts(off):
            inner = np.clip(off[i : j + 1], start, end) - start
            found = segments_of(buf[start:end], inner)
            if found is not None:
                doc, at, n, anchor, seg, weight = found
                at = at + (start - off[i] if j - i == 1 else 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid[i + doc]), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor), pa.array(seg, pa.binary()), pa.array(weight.astype(np.int8))],
                    names=["rid", "at", "n", "anchor", "seg", "weight"],
                )


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by Larsson-Sadakane refinement.

    ``text`` holds small positive numbers, 0 as separator. A rank is the last place of its group; groups of
    one are done and never sorted again.
    """
    n = len(text)
    key = np.zeros(n, np.uint64)
    padded = np.concatenate([text.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)])  # 0: past the end
    for k in range(7):  # nine bits a number: seven numbers in the first key
        key = (key << np.uint64(9)) | padded[k : k + n]
    sa = np.argsort(key, kind="stable")
    sorted_key = key[sa]
    last = np.flatnonzero(np.append(sorted_key[1:] != sorted_key[:-1], True))
    rank = np.empty(n, np.int64)
    sizes = np.diff(np.append(-1, last))
    rank[sa] = np.repeat(last, sizes)
    h = 7
    places = np.flatnonzero(np.repeat(sizes > 1, sizes))
    while len(places):
        mine = sa[places]
        beyond = np.where(mine + h < n, rank[np.minimum(mine + h, n - 1)] + 1, 0)
        group = rank[mine]
        key = (group.astype(np.uint64) << np.uint64(32)) | beyond.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        mine, key = mine[order], key[order]
        sa[places] = mine
        ends = np.append(key[1:] != key[:-1], True)
        last = np.flatnonzero(ends)
        sizes = np.diff(np.append(-1, last))
        rank[mine] = np.repeat(places[last], sizes)
        places = places[np.repeat(sizes > 1, sizes)]
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, at: np.ndarray, count: np.ndarray, depth: int) -> np.ndarray:
    """For each place of the suffix array that holds one of the asked suffixes: the common prefix with the place before.

    Kasai's rule (the next suffix of a text shares at least one byte less) along each segment, all segments in
    step. at, count: where each segment's suffixes start and how many are asked for; prefixes end at ``depth``.
    """
    n = len(text)
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    out = np.zeros(n, np.int64)
    padded = np.concatenate([text, np.zeros(depth + 1, text.dtype)])
    lanes = np.argsort(-count, kind="stable")
    at, count = at[lanes], count[lanes]
    h = np.zeros(len(at), np.int64)
    for step in range(int(count[0]) if len(count) else 0):
        live = int(np.searchsorted(-count, -step, "left"))
        i = at[:live] + step
        p = place[i]
        j = sa[np.maximum(p - 1, 0)]
        k = np.maximum(h[:live] - 1, 0)
        k[p == 0] = 0
        go = np.flatnonzero((p > 0) & (k < depth))
        while len(go):
            go = go[padded[i[go] + k[go]] == padded[j[go] + k[go]]]
            k[go] += 1
            go = go[k[go] < depth]
        h[:live] = k
        out[p] = k
    return out


def window_groups(texts: list[bytes]):
    """Groups of equal windows over distinct segments: (segment, offset, group number) of every window."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.cumsum(size + 1) - size - 1
    text = np.zeros(int(size.sum()) + len(texts), np.uint16)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    text[np.arange(len(flat)) + np.repeat(np.arange(len(texts)), size)] = flat.astype(np.uint16) + 1
    windows = size - WINDOW + 1
    sa = suffix_array(text)
    shared = common_prefixes(text, sa, at, windows, WINDOW)
    owner = np.repeat(np.arange(len(texts)), size + 1)
    offset = np.arange(len(text)) - at[owner]
    asked = (offset < windows[owner])[sa]
    # a group starts where fewer than 200 bytes are shared; a suffix that is no window never stands within a group
    start = ~asked | (shared < WINDOW)
    group = np.cumsum(start)[asked]
    return owner[sa][asked], offset[sa][asked], group


def _ranges(offsets: np.ndarray) -> np.ndarray:
    """Sorted offsets as (first, last) pairs, flat."""
    cut = np.flatnonzero(np.append(True, np.diff(offsets) > 1))
    return np.stack([offsets[cut], offsets[np.append(cut[1:], len(offsets)) - 1]], 1).astype(np.int32).ravel()


_SHARD_SCHEMA = "anchor bigint, seg binary, ranges array<int>, piece int, segs binary, owners binary, prints binary, spots binary"
_NAMES = [c.split()[0] for c in _SHARD_SCHEMA.split(", ")]
_TYPES = [pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.int32(), *[pa.binary()] * 4]


def _pieces(anchor: int, blocks: int, segs: list[bytes], texts: list[bytes], offsets: list[np.ndarray]):
    """One block of an anchor as a row for each range of names: names of 16 bytes, and the segment and offset of each.

    A range holds about a block's share of the anchor's windows, however many segments the anchor has.
    """
    owner = np.repeat(np.arange(len(segs), dtype=np.int32), [len(o) for o in offsets])
    spot = np.concatenate(offsets).astype(np.int32)
    prints = np.array([xxh3_128_digest(t[o : o + WINDOW]) for t, mine in zip(texts, offsets, strict=True) for o in mine.tolist()], "S16")
    piece = (np.frombuffer(prints.tobytes(), ">u4")[::4].astype(np.int64) * blocks) >> 32
    order = np.argsort(piece, kind="stable")  # segments and offsets stay in order
    piece = piece[order]
    first = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
    for a, b in zip(first.tolist(), np.append(first[1:], len(piece)).tolist(), strict=True):
        sel = order[a:b]
        names, own = np.unique(owner[sel], return_inverse=True)
        yield anchor, None, None, int(piece[a]), b"".join(segs[i] for i in names.tolist()), own.astype(np.int32).tobytes(), prints[sel].tobytes(), spot[sel].tobytes()


def _sort_shards(batches):
    """Rows (key, anchor, seg, copies, blocks, block, text) sorted by key -> duplicated windows per segment.

    Windows of a block are settled here. Of an anchor in several blocks, the windows also go on
    as names, cut into as many ranges as there are blocks.
    """

    def work(rows):
        out = []
        owner, offset, group = window_groups([r[6] for r in rows])
        copies = np.array([r[3] for r in rows], np.int64)
        if not len(group):
            return out
        _, inverse = np.unique(group, return_inverse=True)
        total = np.bincount(inverse, copies[owner])
        twice = total[inverse] > 1
        order = np.lexsort((offset, owner))
        owner, offset, twice = owner[order], offset[order], twice[order]
        bounds = np.searchsorted(owner, np.arange(len(rows) + 1))
        split = {}
        for k, r in enumerate(rows):
            mine, hit = offset[bounds[k] : bounds[k + 1]], twice[bounds[k] : bounds[k + 1]]
            if hit.any():
                out.append((r[1], r[2], _ranges(mine[hit]), *[None] * 5))
            if r[4] > 1:
                split.setdefault((r[1], r[4], r[5]), []).append((r[2], r[6], mine))
        for (anchor, blocks, _), members in split.items():
            out.extend(_pieces(anchor, blocks, *map(list, zip(*members, strict=True))))
        return out

    pending, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if pending and size > _SHARD_BYTES and row[0] != pending[-1][0]:
                yield _shard_batch(work(pending))
                pending, size = [], 0
            pending.append(row)
            size += len(row[6])
    if pending:
        yield _shard_batch(work(pending))


def _shard_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)], names=_NAMES)


def _merge_pieces(batches):
    """Rows (anchor, piece, segs, owners, prints, spots) sorted by (anchor, piece): one range's names, a row a block.

    Each block's names are looked up in the sorted names of the range by binary search.
    """

    def work(rows):
        every = np.sort(np.concatenate([np.frombuffer(r[4], "S16") for r in rows]))
        for r in rows:
            names = np.frombuffer(r[4], "S16")
            hit = np.searchsorted(every, names, "right") - np.searchsorted(every, names, "left") > 1
            owner, spot = np.frombuffer(r[3], np.int32)[hit], np.frombuffer(r[5], np.int32)[hit]
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else owner
            for a, b in zip(first.tolist(), np.append(first[1:], len(owner)).tolist(), strict=False):
                yield r[0], r[2][16 * owner[a] : 16 * owner[a] + 16], _ranges(spot[a:b])

    def flush(rows):
        got = list(work(rows))
        return pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.binary()), pa.array([g[2] for g in got], pa.list_(pa.int32()))], names=["anchor", "seg", "ranges"])

    pending = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if pending and row[:2] != pending[-1][:2]:
                yield flush(pending)
                pending = []
            pending.append(row)
    if pending:
        yield flush(pending)


def _cut_texts(batches):
    """Rows (text, wanted) -> the text of every wanted segment."""
    for batch in batches:
        buf, off = text_bytes(batch.column(0))
        rows = []
        for i, wanted in enumerate(batch.column(1).to_pylist()):
            for w in wanted:
                s = off[i] + w["at"]
                rows.append((w["key"], w["anchor"], w["seg"], w["copies"], w["blocks"], w["block"], buf[s : s + w["n"] + WINDOW - 1].tobytes()))
        for k in range(0, len(rows), 2000):
            part = rows[k : k + 2000]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in part], t) for c, t in enumerate([pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 3, pa.binary()])], names=["key", "anchor", "seg", "copies", "blocks", "block", "text"])


def _among(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """For at most BROADCAST_IDS ids: only the texts that matter are shuffled."""
    return docs.join(F.broadcast(ids), "rid", how)


def duplicated(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs (rid, text) -> rid, windows (array of struct(at, ranges)): duplicated window starts, relative to ``at``."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = materialise(docs.mapInArrow(_segment_batches, "rid bigint, at int, n int, anchor bigint, seg binary, weight tinyint"), "segments")
    met = every.groupBy("anchor").agg(F.sum("weight").alias("met")).where("met > 1").select("anchor")
    shared = materialise(every.join(met, "anchor", "left_semi"), "shared-segments")
    distinct = shared.groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("copies"), F.max("weight").alias("weight"), F.min(F.struct("rid", "at", "n")).alias("rep"))
    distinct = materialise(distinct, "distinct-segments")
    kinds = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.max("weight").alias("self"), F.sum(F.col("rep.n") + WINDOW - 1).alias("bytes"))
    kinds = materialise(kinds, "anchors")
    # anchors with over a thousandth of the segments are fewer than a thousand: those go by broadcast, the rest by key
    often = max(100, distinct.count() // 1000)
    hot = F.broadcast(kinds.where(F.col("kinds") > often))
    known = distinct.join(hot, "anchor").unionByName(distinct.join(hot, "anchor", "left_anti").join(kinds.where(F.col("kinds") <= often), "anchor"))
    # one kind of segment that doesn't repeat itself: a suffix array of one text, whose windows all have its copies
    alone = known.where("kinds = 1 AND self = 1").select("anchor", "seg", F.expr("array(0, rep.n - 1)").alias("ranges"))
    sort = known.where("kinds > 1 OR self > 1").withColumn("blocks", F.expr(f"CAST(greatest(ceil(kinds / {block}D), ceil(bytes / {2.0 * _SHARD_BYTES}D)) AS bigint)")).withColumn("block", F.expr("pmod(xxhash64(seg), blocks)"))
    sort = sort.withColumn("key", F.expr("CASE WHEN blocks = 1 THEN anchor ELSE xxhash64(anchor, block) END"))
    wanted = sort.select(F.col("rep.rid").alias("rid"), F.struct("key", "anchor", "seg", "copies", "blocks", "block", F.col("rep.at").alias("at"), F.col("rep.n").alias("n")).alias("w"))
    wanted = materialise(wanted.groupBy("rid").agg(F.collect_list("w").alias("wanted")), "wanted-segments")
    holders = wanted.select("rid")
    n = holders.count()
    held = (_among(docs, holders, "left_semi") if n <= BROADCAST_IDS else docs).join(wanted, "rid").select("text", "wanted")
    texts = held.mapInArrow(_cut_texts, "key bigint, anchor bigint, seg binary, copies bigint, blocks bigint, block bigint, text binary")
    # several rows of one id and text would send a segment twice
    placed = texts.repartition(parts, "key").dropDuplicates(["key", "anchor", "seg"]).sortWithinPartitions("key", "anchor", "seg")
    sorted_ = materialise(placed.mapInArrow(_sort_shards, _SHARD_SCHEMA), "sorted-shards")
    settled = sorted_.where("ranges IS NOT NULL").select("anchor", "seg", "ranges")
    open_ = sorted_.where("ranges IS NULL").select("anchor", "piece", "segs", "owners", "prints", "spots")
    merged = open_.repartition(parts, "anchor", "piece").sortWithinPartitions("anchor", "piece").mapInArrow(_merge_pieces, "anchor bigint, seg binary, ranges array<int>")
    found = alone.unionByName(settled).unionByName(merged)
    return shared.join(found, ["anchor", "seg"]).groupBy("rid").agg(F.collect_set(F.struct("at", "ranges")).alias("windows"))


def _removed(length: int, windows) -> list[tuple[int, int]]:
    spans = sorted((w["at"] + a, w["at"] + b + WINDOW) for w in windows or () for a, b in zip(w["ranges"][::2], w["ranges"][1::2], strict=True))
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _digest_batches(batches):
    """Rows (id, text[, windows]) -> id, n_bytes, n_removed, n_spans, kept_sha256."""
    for batch in batches:
        buf, off = text_bytes(batch.column(1))
        windows = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
        rows = []
        for i, w in enumerate(windows):
            text = buf[off[i] : off[i + 1]]
            gone, digest, done = _removed(len(text), w), hashlib.sha256(), 0
            for s, e in gone:
                digest.update(text[done:s])
                done = e
            digest.update(text[done:])
            rows.append((len(text), sum(e - s for s, e in gone), len(gone), digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64()] * 3 + [pa.string()]))], names=[batch.schema.names[0], "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    docs = pick(docs, id_col, text_col)
    keyed = docs.select(F.xxhash64(id_col, text_col).alias("rid"), F.col(text_col).alias("text"), F.col(id_col).alias("__id"))
    hits = materialise(duplicated(keyed.select("rid", "text"), block), "duplicated")
    ids = hits.select("rid")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    if ids.count() > BROADCAST_IDS:  # one shuffle of the texts, by their own hash
        return keyed.join(hits, "rid", "left").select(F.col("__id").alias(id_col), "text", "windows").mapInArrow(_digest_batches, schema)
    clean = _among(keyed, ids, "left_anti").select(F.col("__id").alias(id_col), "text").mapInArrow(_digest_batches, schema)
    cut = _among(keyed, ids, "left_semi").join(hits, "rid").select(F.col("__id").alias(id_col), "text", "windows").mapInArrow(_digest_batches, schema)
    return clean.unionByName(cut)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 over all documents."""
    return removal(table(spark, sf_dir, "documents"))
