"""Hierarchical Pitman-Yor language model with Chinese-restaurant seating sampled by Gibbs.

Contexts. A token's leaf restaurant is the class of its previous word and a coarser class of the word before
(``Rooms``: first x second hash classes); leaves of one previous class share its parent restaurant, and those
share the root, whose base is uniform over the known words and one unknown. The classes grow with the corpus,
by the root of its bytes (``rooms_for``); a class holds many words, and the frequent ones shape it. Dishes are words.

Distribution. Words are dealt out by hash, so all restaurants' tables of one word are in one shard and only
the restaurants' totals (leaves, parents and the root: one number each) pass between shards. Within a sweep a shard
draws the table count of every (restaurant, word) from its conditional distribution: generalised Stirling
numbers times the weight of opening that many tables, normalised once over all counts. Given are the other
tables of the room and the word's probability above, both as the sweep before left them; rooms are drawn
side by side. A sweep draws from a generator seeded by shard and number, so later jobs, retries and the
scoring replay the same seating from the totals instead of storing it.

Scoring. Predictive probabilities are averaged over the sweeps after burn-in; a document's score is the sum
of their log10. A block of documents sends its distinct (word, leaf) pairs with training counts to the
shards, which are combined before the shuffle, and gets one number back for each.

Defined results: null and empty texts hold the end token only; repeated rows are counted and scored each; a
null id counts as the empty text for the split; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from vouchline.llm.common import LOWER, distinct_spans, doc_chunks, materialise, pick, splitmix, table, text_bytes, word_ids, word_spans

class Rooms(NamedTuple):
    """Classes of the previous word, and of the word before within each."""

    first: int
    second: int

    @property
    def leaves(self) -> int:
        return self.first * self.second

    @property
    def all(self) -> int:
        return self.leaves + self.first + 1


#: For small corpora; ``rooms_for`` doubles the first number until it reaches the root of the corpus' bytes over four.
SMALLEST = Rooms(256, 4)


def rooms_for(n_bytes: int) -> Rooms:
    first = SMALLEST.first
    while 16 * first * first < n_bytes:
        first *= 2
    return Rooms(first, SMALLEST.second)


#: Discounts and strengths of root, parents and leaves.
DISCOUNT, STRENGTH = (0.6, 0.7, 0.8), (1.0, 1.0, 1.0)
BURN_IN, SAMPLES = 1, 2
SEED = 20
_BLOCK_BYTES, _PART_BYTES = 8_000_000, 2_000_000
#: Text bytes whose words make one shard, at least.
SHARD_BYTES = 24_000_000
#: Queues up to this length use exact Stirling numbers; longer ones their series or saddle point.
_ONE_BY_ONE = 512
#: Weights computed at a time.
_CELLS = 1_000_000
END, START = np.uint64(0x9D1C3F5B7A2E4C61), np.uint64(0x1B873593CC9E2D51)


def _pack(**arrays: np.ndarray) -> bytes:
    """Compressed arrays, each as planes of equal bytes (the high bytes of small numbers take no room)."""
    planes = {k: (x.dtype.str, np.ascontiguousarray(np.atleast_1d(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()) for k, x in arrays.items()}
    return zlib.compress(pickle.dumps(planes, protocol=5), 1)


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    planes = pickle.loads(zlib.decompress(blob))
    return {k: np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(np.dtype(t).itemsize, -1).T).view(t).ravel() for k, (t, x) in planes.items()}


def classes(words: np.ndarray, rooms: Rooms = SMALLEST) -> tuple[np.ndarray, np.ndarray]:
    """A word's class as the previous word, and as the one before that."""
    return (splitmix(words) % np.uint64(rooms.first)).astype(np.uint32), (splitmix(words ^ START) % np.uint64(rooms.second)).astype(np.uint8)


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end token after each document, and the documents' token offsets."""
    buf = LOWER[buf]
    s, e, counts = word_spans(buf, off)
    codes, distinct = distinct_spans(buf, s, e)
    words = word_ids(distinct)[codes]
    at = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(at[-1], END, np.uint64)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    out[inside] = words
    return out, at


def contexts(one: np.ndarray, two: np.ndarray, at: np.ndarray, rooms: Rooms = SMALLEST) -> np.ndarray:
    """The leaf of each token, from the tokens' classes; before a document's first token stand two start tokens."""
    first, (start_one, start_two) = at[:-1], (c[0] for c in classes(np.array([START]), rooms))
    previous = np.concatenate([[start_one], one[:-1]]).astype(np.int64)
    previous[first] = start_one
    last = np.concatenate([[start_two], two[:-1]]).astype(np.int64)
    last[first] = start_two
    before = np.concatenate([[start_two], last[:-1]])
    before[first] = start_two
    return previous * rooms.second + before


def _blocks(shards: int, rooms: Rooms):
    """(id, held, text) -> a row per block: ids, packed words, and packed classes and shards of words, token codes and offsets, held flags."""

    def rows(batches):
        for batch in batches:
            buf, off = text_bytes(batch.column(2))
            held = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for i, j in doc_chunks(off, _BLOCK_BYTES):
                cuts = [(i + k, i + m) for k, m in doc_chunks(off[i : j + 1], _PART_BYTES)]
                parts = [tokens(buf[off[k] : off[m]], off[k : m + 1] - off[k]) for k, m in cuts]
                words = np.concatenate([w for w, _ in parts])
                at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(a) for _, a in parts]))])
                codes, unique = pd.factorize(words)
                order = np.lexsort((unique, -np.bincount(codes, minlength=len(unique))))  # frequent words get small codes
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                unique = unique[order]
                one, two = classes(unique, rooms)
                lexicon = _pack(words=unique)
                blob = _pack(codes=place[codes].astype(np.uint32), at=at.astype(np.uint32), held=held[i:j], one=one, two=two, shard=_shard_of(unique, shards).astype(np.uint32))
                # blocks of equal contents get equal numbers, and equal answers
                number = xxh64_intdigest(blob, xxh64_intdigest(lexicon)) >> 1
                ids = pa.array([batch.column(0).slice(i, j - i).to_pylist()], pa.list_(batch.schema.types[0]))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), ids, pa.array([lexicon], pa.binary()), pa.array([blob], pa.binary())], names=["block", "ids", "lexicon", "blob"])

    return rows


def _pairs(block: dict, rooms: Rooms) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (word code, leaf) of a block in order, training counts, and the pair of each token."""
    codes, at = block["codes"].astype(np.int64), block["at"].astype(np.int64)
    leaf = contexts(block["one"][codes], block["two"][codes], at, rooms)
    key, inverse = np.unique(codes * rooms.leaves + leaf, return_inverse=True)
    trained = np.repeat(~block["held"], np.diff(at))
    return key // rooms.leaves, key % rooms.leaves, np.bincount(inverse, trained, len(key)).astype(np.int64), inverse


def _shard_of(words: np.ndarray, shards: int) -> np.ndarray:
    return (splitmix(words) >> np.uint64(40)).astype(np.int64) % shards


def _pieces(shards: int, rooms: Rooms):
    def rows(batches):
        for batch in batches:
            for number, lexicon, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block, words = _unpack(blob), _unpack(lexicon)["words"]
                word, leaf, count, _ = _pairs(block, rooms)
                shard, sizes = block["shard"], np.bincount(word)
                of_pair = shard[word]
                order = np.argsort(of_pair, kind="stable")
                cuts = np.searchsorted(of_pair[order], np.arange(shards + 1))
                found = [(k, order[cuts[k] : cuts[k + 1]]) for k in range(shards) if cuts[k + 1] > cuts[k]]
                blobs = [
                    _pack(words=words[shard == k], sizes=sizes[shard == k].astype(np.uint32), leaf=leaf[p].astype(np.uint32), count=count[p].astype(np.uint32))
                    for k, p in found
                ]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([number] * len(found), pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "block", "blob"])

    return rows


def _by_key(batches, width: int):
    """Runs of rows that share the first column."""
    pending = []
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(width)), strict=True):
            if pending and pending[-1][0] != row[0]:
                yield pending
                pending = []
            pending.append(row)
    if pending:
        yield pending


def _merge(blobs: list[bytes], rooms: Rooms):
    """Distinct words, and (word code, leaf, training count) over all pieces in order; each piece's pairs among them."""
    parts = [_unpack(b) for b in blobs]
    words, codes = np.unique(np.concatenate([p["words"] for p in parts]), return_inverse=True)
    cut = np.cumsum([0] + [len(p["words"]) for p in parts])
    keys = [np.repeat(codes[cut[i] : cut[i + 1]], p["sizes"]) * rooms.leaves + p["leaf"] for i, p in enumerate(parts)]
    every = np.unique(np.concatenate(keys))
    where = [np.searchsorted(every, k) for k in keys]
    count = np.zeros(len(every), np.int64)
    for w, p in zip(where, parts, strict=True):
        count[w] += p["count"]
    return words, every // rooms.leaves, every % rooms.leaves, count, where


class Seating:
    """One shard's tables: per (word, leaf), (word, parent) and word, over pairs with training customers."""

    def __init__(self, word: np.ndarray, leaf: np.ndarray, count: np.ndarray, n_words: int, rooms: Rooms = SMALLEST):
        self.word, self.leaf, self.count, self.n_words, self.rooms = word, leaf, count, n_words, rooms
        self.parent_key, self.parent_of = np.unique(word * rooms.first + leaf // rooms.second, return_inverse=True)
        self.parent_word, self.parent = self.parent_key // rooms.first, self.parent_key % rooms.first
        self.t_leaf = np.ones(len(word), np.int64)
        self.t_parent = np.ones(len(self.parent_key), np.int64)
        self.t_root = np.bincount(self.parent_word, minlength=n_words).clip(max=1).astype(np.int64)

    def parent_customers(self) -> np.ndarray:
        return np.bincount(self.parent_of, self.t_leaf, len(self.parent_key)).astype(np.int64)

    def root_customers(self) -> np.ndarray:
        return np.bincount(self.parent_word, self.t_parent, self.n_words).astype(np.int64)

    def totals(self) -> np.ndarray:
        """Tables of every leaf, parent and the root."""
        return np.concatenate(
            [np.bincount(self.leaf, self.t_leaf, self.rooms.leaves), np.bincount(self.parent, self.t_parent, self.rooms.first), [self.t_root.sum()]]
        ).astype(np.int64)

    def root_p(self, totals: np.ndarray, base: float) -> np.ndarray:
        customers = totals[self.rooms.leaves : -1].sum()
        return (self.root_customers() - DISCOUNT[0] * self.t_root + (STRENGTH[0] + DISCOUNT[0] * totals[-1]) * base) / (STRENGTH[0] + customers)

    def parent_p(self, totals: np.ndarray, root: np.ndarray) -> np.ndarray:
        customers = totals[: self.rooms.leaves].reshape(self.rooms).sum(1)
        spare = STRENGTH[1] + DISCOUNT[1] * totals[self.rooms.leaves : -1]
        k = self.parent
        return (self.parent_customers() - DISCOUNT[1] * self.t_parent + spare[k] * root[self.parent_word]) / (STRENGTH[1] + customers[k])

    def sweep(self, totals: np.ndarray, base: float, rng: np.random.Generator) -> None:
        root = self.root_p(totals, base)
        parent = self.parent_p(totals, root)
        self.t_leaf = reseat(self.count, totals[self.leaf] - self.t_leaf, parent[self.parent_of], DISCOUNT[2], STRENGTH[2], rng)
        self.t_parent = reseat(self.parent_customers(), totals[self.rooms.leaves + self.parent] - self.t_parent, root[self.parent_word], DISCOUNT[1], STRENGTH[1], rng)
        queue = self.root_customers()
        some = queue > 0
        self.t_root[some] = reseat(queue[some], totals[-1] - self.t_root[some], np.full(int(some.sum()), base), DISCOUNT[0], STRENGTH[0], rng)


def gammaln(x: np.ndarray | float) -> np.ndarray:
    """log of the gamma function at x > 0, by Stirling's series from x + 8 on."""
    x = np.asarray(x, float)
    y = x + 8
    head = x.copy()
    for k in range(1, 8):
        head = head * (x + k)
    r = 1 / y**2
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y - np.log(head)


@lru_cache(maxsize=8)
def _stirling(discount: float, upto: int) -> list[np.ndarray]:
    """log S(c, t) for t = 1..c, for c = 1..upto at place c - 1: S(c + 1, t) = S(c, t - 1) + (c - discount * t) S(c, t)."""
    rows = [np.zeros(1)]
    for c in range(1, upto):
        stay = rows[-1] + np.log(c - discount * np.arange(1, c + 1))
        rows.append(np.logaddexp(np.append(stay, -np.inf), np.append(-np.inf, rows[-1])))
    return rows


def _log_sum(c: np.ndarray, t: np.ndarray, v: np.ndarray, d: float) -> np.ndarray:
    """log of P(t table sizes drawn by (1 - (1 - z)**d) add up to c) = S(c, t) t! d**t / c!, for c over 512; v: a start for the saddle point.

    Few tables: the binomial series in (1 - z)**d. Many: the saddle point at z = 1 - v, with the next term.
    """
    x = np.log(v)
    for _ in range(8):  # Newton steps for mean size m(v) = c / t
        v = np.exp(x)
        h, z = -np.expm1(d * x), -np.expm1(x)
        slope = -v / z + d - 1 + d * v**d / h
        x = np.clip(x - (np.log(z * d / h) + (d - 1) * x - np.log(c / t)) / np.minimum(slope, -1e-9), x - 3, np.minimum(x + 3, x / 4))
    v = np.exp(x)
    h, z = -np.expm1(d * x), -np.expm1(x)
    a1, a2, a3, a4 = (z * d * v ** (d - 1) / h, z**2 * d * (1 - d) * v ** (d - 2) / h, z**3 * d * (1 - d) * (2 - d) * v ** (d - 3) / h, z**4 * d * (1 - d) * (2 - d) * (3 - d) * v ** (d - 4) / h)
    # factorial moments -> moments -> cumulants of a size
    m1, m2, m3, m4 = a1, a1 + a2, a1 + 3 * a2 + a3, a1 + 7 * a2 + 6 * a3 + a4
    k2 = np.maximum(m2 - m1**2, 1e-300)
    k3 = m3 - 3 * m1 * m2 + 2 * m1**3
    k4 = m4 - 4 * m1 * m3 - 3 * m2**2 + 12 * m1**2 * m2 - 6 * m1**4
    more = (k4 / k2**2 / 8 - 5 * k3**2 / k2**3 / 24) / t
    out = t * np.log(h) - c * np.log(z) - 0.5 * np.log(2 * np.pi * t * k2) + np.log1p(np.clip(more, -0.5, 0.5))
    out = np.where(t >= c, c * np.log(d), out)
    few = t < 2 * c**d
    if few.any():
        cc, tt = c[few], t[few]
        total, ways = np.zeros(len(cc)), np.ones(len(cc))
        kinds, kind = np.unique(cc, return_inverse=True)
        lead = last = gammaln(kinds - d)
        for j in range(1, 91):
            now = gammaln(kinds - j * d)
            ways *= (tt - (j - 1)) * (np.exp(now - last) / j)[kind]
            total += ways * float((-1) ** (j + 1) * np.exp(gammaln(1 + j * d)) * np.sin(np.pi * j * d) / np.pi)
            last = now
        out[few] = (lead - gammaln(kinds + 1))[kind] + np.log(np.maximum(total, 1e-300))
    return out


def _long(c: np.ndarray, room: np.ndarray, up: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of long queues from the same conditional, on a grid around its mode; room: strength / d + other tables."""
    size = lambda x: (-np.expm1(d * x)) / (-np.expm1(x)) / d * np.exp((1 - d) * x) * c  # noqa: E731  tables whose saddle is at log v = x
    tilt = lambda x: np.log(-np.expm1(d * x)) + np.log((room / size(x) + 1) * up)  # noqa: E731  slope of the log weight
    low, high = np.full(len(c), -200.0), np.full(len(c), -1e-9)
    for _ in range(60):
        mid = (low + high) / 2
        rising = tilt(mid) > 0
        low, high = np.where(rising, mid, low), np.where(rising, high, mid)
    x = np.minimum(low, -1e-6)
    mode, eps = size(x), 1e-4
    bend = (tilt(x - eps) - tilt(x + eps)) / np.maximum(size(x + eps) - size(x - eps), 1e-300)
    reach = np.minimum(12 / np.sqrt(np.maximum(bend, 1e-18)) + 20, c)
    first, last = np.maximum(1, np.floor(mode - reach)), np.minimum(c, np.ceil(mode + reach))
    step = np.maximum(1, np.ceil((last - first) / 160))
    t = np.minimum(first[:, None] + step[:, None] * np.arange(162), last[:, None])
    fresh = np.concatenate([np.ones((len(c), 1), bool), np.diff(t, axis=1) > 0], 1)
    wide = np.broadcast_to(c[:, None], t.shape).ravel()
    start = np.exp(np.clip(x[:, None] + np.log(t / mode[:, None]) / (1 - d), -200, -1e-6))
    weight = _log_sum(wide, t.ravel(), start.ravel(), d).reshape(t.shape) - gammaln(t + 1) + gammaln(room[:, None] + t) - gammaln(room[:, None]) + t * np.log(up)[:, None]
    weight = np.where(fresh, weight, -np.inf)
    total = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
    at = (total < (rng.random(len(c)) * total[:, -1])[:, None]).sum(1)
    # between the grid's points the weight is interpolated
    apart = np.floor(rng.random(len(c)) * step) - np.floor(rng.random(len(c)) * step)
    return np.clip(t[np.arange(len(c)), at] + apart, 1, c).astype(np.int64)


def reseat(customers: np.ndarray, other_tables: np.ndarray, above: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish, drawn from their conditional distribution with the rest of the room as it is.

    t tables of c customers weigh S(c, t) * product over i < t of (strength + discount * (other_tables + i)) * above.
    customers >= 1; above: the dish's probability in the room's parent.
    """
    order = np.argsort(customers, kind="stable")
    c, other, up = customers[order], other_tables[order], above[order]
    t = np.ones(len(c), np.int64)
    short = int(np.searchsorted(c, _ONE_BY_ONE, "right"))
    rows = _stirling(discount, min(_ONE_BY_ONE, max(512, int(c[short - 1])))) if short and c[short - 1] > 1 else []
    sizes, starts = np.unique(c[:short], return_index=True)
    for n, i, end in zip(sizes.tolist(), starts.tolist(), np.append(starts, short)[1:].tolist(), strict=True):
        for a in range(i, end if n > 1 else i, max(1, _CELLS // n)):
            b = min(end, a + max(1, _CELLS // n))
            new = (strength + discount * (other[a:b, None] + np.arange(n))) * up[a:b, None]
            weight = rows[n - 1] + np.cumsum(np.log(new), 1)
            total = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
            t[a:b] = 1 + (total < (rng.random(b - a) * total[:, -1])[:, None]).sum(1)
    for a in range(short, len(c), 1000):
        b = min(len(c), a + 1000)
        t[a:b] = _long(c[a:b].astype(float), strength / discount + other[a:b], up[a:b], discount, rng)
    out = np.empty(len(c), np.int64)
    out[order] = t
    return out


def _replay(seating: Seating, shard: int, history: list[np.ndarray], base: float):
    """Yields the seating after each sweep whose totals before it are known."""
    for k, totals in enumerate(history):
        seating.sweep(totals, base, np.random.default_rng([SEED, shard, k]))
        yield seating


def _states(rooms: Rooms):
    """Pieces sorted by shard -> shard, packed trained pairs, words, tokens."""

    def rows(batches):
        for run in _by_key(batches, 3):
            words, word, leaf, count, _ = _merge([r[2] for r in run], rooms)
            on = count > 0
            kept, code = np.unique(word[on], return_inverse=True)
            blob = _pack(word=code.astype(np.uint32), leaf=leaf[on].astype(np.uint32), count=count[on].astype(np.uint32))
            yield pa.RecordBatch.from_arrays(
                [pa.array([run[0][0]], pa.int32()), pa.array([len(kept)], pa.int64()), pa.array([int(count.sum())], pa.int64()), pa.array([blob], pa.binary())],
                names=["shard", "n_words", "n_tokens", "blob"],
            )

    return rows


#: Rooms that travel together as one row.
_TOGETHER = 1024


def _rooms(values: np.ndarray):
    """Rows (group, its rooms' values): groups without a value are left out."""
    padded = np.concatenate([values, np.zeros(-len(values) % _TOGETHER, np.int64)]).reshape(-1, _TOGETHER)
    some = np.flatnonzero(padded.any(1))
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(list(padded[some]), pa.list_(pa.int64()))], names=["group", "n"])


def _summed(batches):
    """Rows sorted by group -> one row a group, packed."""
    for run in _by_key(batches, 2):
        total = np.sum([np.array(r[1], np.int64) for r in run], 0)
        yield pa.RecordBatch.from_arrays([pa.array([run[0][0]], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["group", "n"])


def _leaf_customers(rooms: Rooms):
    """Training tokens of every leaf: one row a group of leaves and task, however many shards the task holds."""

    def rows(batches):
        found = np.zeros(rooms.leaves, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                s = _unpack(blob)
                found += np.bincount(s["leaf"], s["count"], rooms.leaves).astype(np.int64)
        yield _rooms(found)

    return rows


def _totals(history: list[np.ndarray], base: float, rooms: Rooms):
    """Tables of every room after the known sweeps: one row a group of rooms and task."""

    def rows(batches):
        found = np.zeros(rooms.all, np.int64)
        for batch in batches:
            for shard, n_words, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = _unpack(blob)
                seating = Seating(s["word"].astype(np.int64), s["leaf"].astype(np.int64), s["count"].astype(np.int64), n_words, rooms)
                for _ in _replay(seating, shard, history, base):
                    pass
                found += seating.totals()
        yield _rooms(found)

    return rows


def _collected(rows: DataFrame, n: int) -> np.ndarray:
    """Sums by room on the driver, added up in tasks first: eight bytes a room, and rooms grow by the root of the corpus."""
    out = np.zeros(n + -n % _TOGETHER, np.int64)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for group, packed in rows.repartition(parts, "group").sortWithinPartitions("group").mapInArrow(_summed, "group int, n binary").toLocalIterator():
        out[group * _TOGETHER : (group + 1) * _TOGETHER] = np.frombuffer(packed, np.int64)
    return out[:n]


def _predict(history: list[np.ndarray], totals: list[np.ndarray], leaf_customers: np.ndarray, base: float, rooms: Rooms):
    """Pieces sorted by shard -> per piece: training count of each word, log10 of the averaged probability of each pair.

    history: the totals before each sweep; totals: those after it.
    """

    def rows(batches):
        for rows_ in _by_key(batches, 3):
            shard = rows_[0][0]
            words, word, leaf, count, where = _merge([r[2] for r in rows_], rooms)
            on = count > 0
            kept, code = np.unique(word[on], return_inverse=True)
            seating = Seating(code, leaf[on], count[on], len(kept), rooms)
            dense = np.full(len(words), -1, np.int64)
            dense[kept] = np.arange(len(kept))
            w = dense[word]
            room = leaf // rooms.second
            key = np.where(w >= 0, w * rooms.first + room, -1)
            at = np.searchsorted(seating.parent_key, key).clip(max=max(0, len(seating.parent_key) - 1))
            found = seating.parent_key[at] == key if len(seating.parent_key) else np.zeros(len(key), bool)
            total_p = np.zeros(len(word))
            for k, state in enumerate(_replay(seating, shard, history, base)):
                if k < BURN_IN:
                    continue
                after = totals[k]
                unknown = (STRENGTH[0] + DISCOUNT[0] * after[-1]) * base / (STRENGTH[0] + after[rooms.leaves : -1].sum())
                root = np.append(state.root_p(after, base), unknown)[w]
                spare = STRENGTH[1] + DISCOUNT[1] * after[rooms.leaves + room]
                parent = spare * root / (STRENGTH[1] + after[: rooms.leaves].reshape(rooms).sum(1)[room])
                if found.any():
                    parent[found] = state.parent_p(after, state.root_p(after, base))[at[found]]
                tables = np.zeros(len(word))
                tables[on] = state.t_leaf
                total_p += (count - DISCOUNT[2] * tables + (STRENGTH[2] + DISCOUNT[2] * after[leaf]) * parent) / (STRENGTH[2] + leaf_customers[leaf])
            log_p = np.log10(total_p / SAMPLES)
            per_word = np.bincount(word, count, len(words)).astype(np.int64)
            for r, pairs in zip(rows_, where, strict=True):
                part = _unpack(r[2])
                own = per_word[np.searchsorted(words, part["words"])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[1]], pa.int64()), pa.array([shard], pa.int32()), pa.array([_pack(count=own, log_p=log_p[pairs].astype(np.float32))], pa.binary())],
                    names=["block", "shard", "blob"],
                )

    return rows


def _document_scores(n_tokens: int, n_words: int, id_type: pa.DataType, id_col: str, rooms: Rooms):
    """Rows (block, shard, ids, blob) sorted by block and shard; a block's own row has shard -1."""

    def rows(batches):
        for run in _by_key(batches, 4):
            answers = {shard: blob for _, shard, _, blob in run if shard >= 0}
            for _, shard, ids, blob in run:
                if shard < 0:
                    yield one(ids, _unpack(blob), answers)

    def one(ids, block, answers):
        word, _, _, inverse = _pairs(block, rooms)
        of_word = block["shard"]
        of_pair = of_word[word]
        count, log_p = np.zeros(len(of_word), np.int64), np.zeros(len(of_pair))
        for shard, blob in answers.items():
            part = _unpack(blob)
            count[of_word == shard] = part["count"]
            log_p[of_pair == shard] = part["log_p"]
        at = block["at"].astype(np.int64)
        c = count[block["codes"]]
        sums = lambda x: np.add.reduceat(x, at[:-1])  # noqa: E731  every document holds its end token
        base = np.log10((c + 0.5) / (n_tokens + 0.5 * (n_words + 1)))
        columns = [block["held"], np.diff(at), sums((c > 0).astype(np.int64)), np.full(len(at) - 1, n_tokens, np.int64), sums(base), sums(log_p[inverse])]
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *map(pa.array, columns)], names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows


def score(docs: DataFrame, held: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fits on the rows where ``held`` (SQL over the columns) isn't true and scores all rows.

    id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = pick(docs, id_col, text_col)
    kind = given.schema[id_col].dataType
    n_bytes = int(given.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0])
    rooms = rooms_for(n_bytes)
    shards = max(4, 2 * parts, n_bytes // SHARD_BYTES)
    given = given.select(id_col, F.coalesce(F.expr(held), F.lit(False)).alias("held"), text_col)
    blocks = materialise(given.mapInArrow(_blocks(shards, rooms), f"block bigint, ids array<{kind.simpleString()}>, lexicon binary, blob binary"), "blocks")
    pieces = blocks.select("block", "lexicon", "blob").mapInArrow(_pieces(shards, rooms), "shard int, block bigint, blob binary")
    placed = pieces.repartition(shards, "shard").sortWithinPartitions("shard", "block")
    state = materialise(placed.mapInArrow(_states(rooms), "shard int, n_words bigint, n_tokens bigint, blob binary"), "states")
    size = state.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    n_words, n_tokens = int(size[0]), int(size[1])
    customers = _collected(state.select("blob").mapInArrow(_leaf_customers(rooms), "group int, n array<bigint>"), rooms.leaves)
    base = 1.0 / (n_words + 1)
    seats = state.select("shard", "n_words", "blob")
    history: list[np.ndarray] = []
    for _ in range(BURN_IN + SAMPLES + 1):
        history.append(_collected(seats.mapInArrow(_totals(history, base, rooms), "group int, n array<bigint>"), rooms.all))
    answers = placed.mapInArrow(_predict(history[:-1], history[1:], customers, base, rooms), "block bigint, shard int, blob binary")
    own = blocks.select("block", F.lit(-1).alias("shard"), "ids", "blob")
    both = own.unionByName(answers.select("block", "shard", F.lit(None).cast(f"array<{kind.simpleString()}>").alias("ids"), "blob"))
    id_type = pa.int64() if kind.simpleString() == "bigint" else None
    schema = f"`{id_col}` {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return both.repartition(parts, "block").sortWithinPartitions("block", "shard").mapInArrow(_document_scores(n_tokens, n_words, id_type, id_col, rooms), schema)


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score over all documents; a restaurant a context."""
    from vouchline.llm import restaurants  # it seats with this module's functions

    return restaurants.score(table(spark, sf_dir, "documents"), "crc32(CAST(coalesce(CAST(doc_id AS string), '') AS binary)) % 5 = 1")
