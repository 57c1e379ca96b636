"""Hierarchical Pitman-Yor language model whose restaurants are the contexts themselves.

Contexts. A token's leaf restaurant is its two previous words, the parent restaurant its previous word, the root has
none; the root's base is uniform over the known words and one unknown. Words are named by 64 bits, none are put
together. Before a document's first token stand two start tokens.

Distribution. Leaves and parents are dealt to shards by the previous word, so a parent and its leaves are together
and only the root's dishes pass between shards: a shard sends, for each word, the tables that its parents opened, to
the word's own shard, which seats them at the root and sends back customers and tables. A previous word that alone
would fill a shard (``Layout.hot``) is dealt further by the word before it; the dishes of such a parent are seated
where their word is, from the tables of all its leaves, and only its two totals are collected (and those of the
root). States lie in the shared folder by shard and are read there, so a sweep moves nothing but these numbers; blocks
of documents lie there in files of their own, and scoring moves the files' names.

Memory. Two tasks share an executor's limit with Spark's own process, and workers stay between tasks: arrays of a
shard are dropped as soon as they are used, places are 32-bit numbers, and what a shard or block took is given back.

Seating is drawn as in ``pitman_yor``: a sweep draws the table count of each (restaurant, word) from its exact
conditional, given the other tables and the probability above as the sweep before left them. Counts of one have one
table. Probabilities are averaged over the sweeps after burn-in.

Defined results: as ``pitman_yor``.
"""

from __future__ import annotations

import pickle
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from vouchline.llm.common import doc_chunks, give_back, materialise, pick, shared_path, splitmix, text_bytes
from vouchline.llm.pitman_yor import _BLOCK_BYTES, _PART_BYTES, BURN_IN, DISCOUNT, SAMPLES, SEED, START, STRENGTH, reseat, tokens
from vouchline.llm.warc import open_fs

#: Text bytes whose contexts make one shard, at least.
SHARD_BYTES = 10_000_000
#: Frequent words that travel by rank; all others by name. Changes sizes only.
COMMON = 1_000_000
#: Words of a block that may be common.
_OFTEN = 65_536
_ZSTD = pa.Codec("zstd", compression_level=1)


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays as planes of equal bytes, each compressed by itself where that helps; planes of zeros are left out."""
    out = {}
    for k, x in arrays.items():
        planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T)
        kept = []
        for p in planes:
            raw = p.tobytes() if p.any() else b""
            small = _ZSTD.compress(raw, asbytes=True) if raw else b""
            kept.append((True, small) if len(small) < len(raw) else (False, raw))
        out[k] = x.dtype.str, len(x), kept
    return pickle.dumps(out, protocol=5)


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    out = {}
    for k, (t, n, kept) in pickle.loads(blob).items():
        planes = np.zeros((n, np.dtype(t).itemsize), np.uint8)
        for i, (small, raw) in enumerate(kept):
            if raw:
                planes[:, i] = np.frombuffer(_ZSTD.decompress(raw, n, asbytes=True) if small else raw, np.uint8)
        out[k] = planes.view(t).ravel()
    return out


def _one_by_one(make, units):
    """``make`` of each unit; what it took is given back before the next."""
    for unit in units:
        out = make(unit)
        del unit
        give_back()
        yield out
        del out


def _rows_of(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and the place of each among them, in half the memory of ``np.unique``."""
    order = np.argsort(x)
    x = x[order]
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    x = x[new]
    place = np.cumsum(new, dtype=np.int32)
    place -= 1
    out = np.empty(len(order), np.int32)
    out[order] = place
    return x, out


def _by_key(batches, width: int):
    """Runs of rows that share the first column."""
    pending = []
    for batch in batches:
        for i in range(0, len(batch), 32):
            part = batch.slice(i, 32)
            for row in zip(*(part.column(k).to_pylist() for k in range(width)), strict=True):
                if pending and pending[-1][0] != row[0]:
                    yield pending
                    pending = []
                pending.append(row)
    if pending:
        yield pending


class Layout(NamedTuple):
    """Number of shards, names of the common words, names of the hot previous words and their number of parts."""

    shards: int
    common: np.ndarray
    hot: np.ndarray
    parts: np.ndarray

    def deal(self, previous: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Shard of each leaf, by names."""
        base, hot, part = self.hints(np.concatenate([previous, before]))
        n = len(previous)
        return self.by_hints(base[:n], hot[:n], part[n:])

    def hints(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What decides a leaf's shard: a word's own shard and place among the hot words, and what parts it as the word before."""
        return _mixed(words) % self.shards, _find(self.hot, words)[0], _mixed(words ^ START) % 65_536

    def by_hints(self, base: np.ndarray, hot: np.ndarray, part: np.ndarray) -> np.ndarray:
        return (base + part % np.append(self.parts, 1)[hot]) % self.shards

    @property
    def of_words(self) -> int:
        """Words have fewer shards, so that each pair of shards exchanges rows of some thousand slots."""
        return max(4, self.shards // 4)

    def of_word(self, words: np.ndarray) -> np.ndarray:
        return _mixed(words) % self.of_words


def _mixed(words: np.ndarray) -> np.ndarray:
    return (splitmix(words) >> np.uint64(24)).astype(np.int64)


def _find(names: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted names (their number where absent), and which are there."""
    at = np.searchsorted(names, x)
    hit = np.append(names, np.uint64(0))[at] == x
    hit &= at < len(names)
    return np.where(hit, at, len(names)), hit


def _gathered(batches):
    """Columns of as many batches as make a block: batches of short texts hold few bytes, and each block becomes a file."""
    pending = []
    for batch in batches:
        pending.append(batch)
        if sum(b.nbytes for b in pending) >= _BLOCK_BYTES:
            yield pa.Table.from_batches(pending).columns
            pending = []
    if pending:
        yield pa.Table.from_batches(pending).columns


def _blocks(batches):
    """(id, held, text) -> a row per block: ids, packed words (frequent first) and counts of the most frequent, packed token codes, offsets, held flags."""

    def chunks():
        for ids, held, texts in _gathered(batches):
            buf, off = text_bytes(texts)
            held = held.to_numpy().astype(bool)
            for i, j in doc_chunks(off, _BLOCK_BYTES):
                yield ids.slice(i, j - i), held[i:j], buf[off[i] : off[j]], off[i : j + 1] - off[i]

    yield from _one_by_one(_block, chunks())


def _block(chunk) -> pa.RecordBatch:
    ids, held, buf, off = chunk
    parts = [tokens(buf[off[k] : off[m]], off[k : m + 1] - off[k]) for k, m in doc_chunks(off, _PART_BYTES)]
    at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(a) for _, a in parts]))])
    words = np.concatenate([w for w, _ in parts])
    del parts
    codes, unique = pd.factorize(words)
    n_tokens = len(words)
    del words
    n = np.bincount(codes, minlength=len(unique))
    order = np.lexsort((unique, -n))
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order))
    lexicon = _pack(words=unique[order], n=n[order][:_OFTEN].astype(np.uint32), docs=np.array([len(held)], np.uint32))
    blob = _pack(codes=place[codes], at=at.astype(np.uint32), held=held)
    # blocks of equal contents get equal numbers, and equal answers
    number = xxh64_intdigest(blob, xxh64_intdigest(lexicon)) >> 1
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([n_tokens], pa.int64()), pa.array([lexicon], pa.binary()), pa.array([blob], pa.binary())],
        names=["block", "ids", "n_tokens", "lexicon", "blob"],
    )


def _often(batches):
    """Blocks' most frequent words as (name, occurrences as a context)."""
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            x = _unpack(blob)
            n = x["n"][x["n"] > 1]
            names = np.append(x["words"][: len(n)], START).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.append(n, x["docs"]).astype(np.int64))], names=["word", "n"])


def layout(blocks: DataFrame, shards: int) -> Layout:
    every = int(blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0])
    counts = blocks.select("lexicon").mapInArrow(_often, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    # at most a million names, eight bytes each; hot words are among them, as they are frequent in some block
    top = counts.orderBy(F.desc("n"), "word").limit(COMMON).toArrow()
    names, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    hot = 2 * shards * n > every
    order = np.argsort(names[hot])
    return Layout(shards, names, names[hot][order], -(-2 * shards * n[hot][order] // max(1, every)))


def _ranks(common: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Rank of each common word, else -1."""
    order = np.argsort(common)
    at, hit = _find(common[order], words)
    return np.where(hit, np.append(order, -1)[at], -1)


def trigrams(block: dict, n_words: int):
    """Distinct (previous, before, word) codes of a block in order, a start token being n_words; training counts, and the place of each token among them."""
    w, at = block["codes"].astype(np.int64), block["at"].astype(np.int64)
    v = np.concatenate([[n_words], w[:-1]])
    v[at[:-1]] = n_words
    u = np.concatenate([[n_words], v[:-1]])
    u[at[:-1]] = n_words
    room, rooms = v * (n_words + 1) + u, None
    if (n_words + 1) ** 3 >= 2**63:
        rooms, room = _distinct(room)
        room = room.astype(np.int64)
    del v, u
    room *= n_words
    room += w
    key, inverse = _distinct(room)
    room, w = key // n_words, key % n_words
    room = room if rooms is None else rooms[room]
    trained = np.repeat(~block["held"], np.diff(at))
    return room // (n_words + 1), room % (n_words + 1), w, np.bincount(inverse, trained, len(key)).astype(np.int64), inverse


def _first_of_runs(*columns: np.ndarray) -> np.ndarray:
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _by_shard(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _pieces(lay: Layout):
    """Blocks -> (shard, block, its distinct trigrams of that shard)."""

    def rows(batches):
        yield from _one_by_one(one, _rows_of(batches))

    def one(row):
        number, lexicon, blob = row
        words = np.append(_unpack(lexicon)["words"], START)
        rank = _ranks(lay.common, words)
        v, u, w, count, _ = trigrams(_unpack(blob), len(words) - 1)
        first = _first_of_runs(v, u)
        size = np.diff(np.append(first, len(v)))
        v, u = v[first], u[first]
        base, hot, part = lay.hints(words)
        shard = lay.by_hints(base[v], hot[v], part[u])
        by_room, cut_room = _by_shard(shard, lay.shards)
        by_pair, cut_pair = _by_shard(np.repeat(shard, size), lay.shards)
        out = []
        for k in np.unique(shard).tolist():
            r, p = by_room[cut_room[k] : cut_room[k + 1]], by_pair[cut_pair[k] : cut_pair[k + 1]]
            codes = np.concatenate([v[r], u[r], w[p]])
            far = rank[codes] < 0
            rare = np.unique(codes[far])
            named = rank[codes]
            named[far] = COMMON + np.searchsorted(rare, codes[far])
            named = named.astype(np.uint32)
            n = len(r)
            out.append((k, _pack(v=named[:n], u=named[n : 2 * n], w=named[2 * n :], size=size[r].astype(np.uint32), count=count[p].astype(np.uint32), names=words[rare])))
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in out], pa.int32()), pa.array([number] * len(out), pa.int64()), pa.array([b for _, b in out], pa.binary())], names=["shard", "block", "blob"]
        )

    return rows


def _joined(parts: list[dict]):
    """Names that aren't common over all parts in order, and a function that takes a field out of all parts, in codes that are common to them."""
    cut = np.cumsum([0] + [len(p["names"]) for p in parts])
    names, inverse = _distinct(np.concatenate([p.pop("names") for p in parts]))

    def take(field: str) -> np.ndarray:
        out, a = np.empty(sum(len(p[field]) for p in parts), np.int64), 0
        for p, i in zip(parts, cut[:-1], strict=True):
            c = p.pop(field)
            out[a : a + len(c)] = c
            far = a + np.flatnonzero(c >= COMMON)
            out[far] = COMMON + inverse[i + out[far] - COMMON]
            a += len(c)
        return out

    return names, take


def _packed_slots(lay: Layout, seats: Seats) -> list[tuple[int, bytes]]:
    """What the words' shards are to know of this one, in the order in which numbers are sent later."""
    out = []
    train, tables = seats.slot_train(), seats.slot_tables()
    for g, s in seats.sent:
        code = seats.slot_w[s]
        far = code >= COMMON
        rare, place = np.unique(code[far], return_inverse=True)
        code[far] = COMMON + place
        out.append((g, _pack(h=seats.slot_h[s].astype(np.uint32), w=code.astype(np.uint32), names=seats.names[rare - COMMON], train=train[s].astype(np.uint64), tables=tables[s].astype(np.uint64))))
    return out


def _states(lay: Layout):
    """Pieces sorted by shard -> a row a shard: its pairs, where each piece's pairs are among them, its slots."""

    def rows(batches):
        yield from _one_by_one(one, _by_key(batches, 3))

    def one(run):
        shard, blocks = run[0][0], [r[1] for r in run]
        parts = [_unpack(r[2]) for r in run]
        run.clear()
        names, take = _joined(parts)
        width = COMMON + len(names)
        key = take("v")
        key *= width
        key += take("u")
        rooms, room = _distinct(key)
        key = np.repeat(room, np.concatenate([p.pop("size") for p in parts])).astype(np.int64)
        del room
        key *= width
        cut = np.cumsum([0] + [len(p["w"]) for p in parts])
        key += take("w")
        key, where = _distinct(key)
        count = np.bincount(where, np.concatenate([p.pop("count") for p in parts]), len(key)).astype(np.uint32)
        state = {
            "v": (rooms // width).astype(np.uint32), "size": np.bincount(key // width, minlength=len(rooms)).astype(np.uint32),
            "w": (key % width).astype(np.uint32), "count": count, "names": names,
        }
        del key, rooms, count
        pieces = [{"block": k, "blob": _pack(where=where[a:b].astype(np.uint32))} for k, a, b in zip(blocks, cut[:-1], cut[1:], strict=True)]
        del where
        slots = [{"g": g, "blob": b} for g, b in _packed_slots(lay, Seats(state, lay))]
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([_pack(**state)], pa.binary()), pa.array([pieces], _PIECES), pa.array([slots], _SLOTS)], names=["shard", "blob", "pieces", "slots"]
        )

    return rows


_PIECES = pa.list_(pa.struct([("block", pa.int64()), ("blob", pa.binary())]))
_SLOTS = pa.list_(pa.struct([("g", pa.int32()), ("blob", pa.binary())]))
_LINKS = pa.list_(pa.struct([("s", pa.int32()), ("blob", pa.binary())]))


def _stored(folder: str, shard: int, *columns: str) -> list:
    """Columns of the one row that the shared folder holds for a shard."""
    fs, root = open_fs(folder)
    (path,) = (f.path for f in fs.get_file_info(pafs.FileSelector(f"{root}/shard={shard}")) if f.path.endswith(".parquet"))
    with fs.open_input_file(path) as file:
        found = pq.ParquetFile(file).read(columns=list(columns))
    return [found.column(c)[0].as_py() for c in columns]


class Seats:
    """A shard's leaves and parents: pairs (leaf, word), bigrams (previous word, word), slots (hot previous word or none, word).

    A slot stands for what another shard seats: the root's dish, or a hot parent's.
    """

    def __init__(self, state: dict, lay: Layout):
        self.names, self.count, size = state["names"], state["count"], state["size"].astype(np.int64)
        width = COMMON + len(self.names)
        self.room = np.repeat(np.arange(len(size), dtype=np.int32), size)
        vs, of_room = _distinct(state["v"])
        name = lambda c: np.concatenate([lay.common, np.zeros(COMMON - len(lay.common), np.uint64), self.names])[c]
        place, hit = _find(lay.hot, name(vs))
        bigrams = np.repeat(of_room, size).astype(np.int64)
        bigrams *= width
        bigrams += state["w"]
        bigrams, self.bi = _distinct(bigrams)
        self.v, w = (bigrams // width).astype(np.int32), bigrams % width
        h = np.where(hit, place + 1, 0)[self.v]
        self.hot = h > 0
        slots, self.slot = _distinct(h * width + w)
        self.slot_h, self.slot_w = slots // width, slots % width
        order, cut = _by_shard(lay.of_word(name(self.slot_w)), lay.of_words)
        self.sent = [(g, order[cut[g] : cut[g + 1]]) for g in range(lay.of_words) if cut[g + 1] > cut[g]]
        self.n_rooms, self.n_v = len(size), len(vs)
        self.t_leaf = self.count.clip(max=1)
        self.t_parent = np.where(self.hot, 0, self.customers().clip(max=1))

    def customers(self) -> np.ndarray:
        return np.bincount(self.bi, self.t_leaf, len(self.v)).astype(np.int64)

    def slot_train(self) -> np.ndarray:
        return np.bincount(self.slot[self.bi], self.count, len(self.slot_w))

    def slot_tables(self) -> np.ndarray:
        return np.bincount(self.slot, np.where(self.hot, self.customers(), self.t_parent), len(self.slot_w))

    def tables(self) -> bytes:
        return _pack(leaf=self.t_leaf[self.count > 1].astype(np.uint32), parent=self.t_parent[self.customers() > 1].astype(np.uint32))

    def restore(self, blob: bytes) -> None:
        """Tables as ``tables`` gave them; customers of a parent are known from its leaves."""
        x = _unpack(blob)
        self.t_leaf[self.count > 1] = x["leaf"]
        c = self.customers()
        self.t_parent = np.where(self.hot, 0, c.clip(max=1))
        self.t_parent[c > 1] = x["parent"]

    def above(self, answers: dict[int, dict], totals: Totals) -> np.ndarray:
        """Probability of each slot, from the customers and tables that the words' shards sent."""
        c, t, hot_c, hot_t = (np.zeros(len(self.slot_w)) for _ in range(4))
        for g, s in self.sent:
            x = answers[g]
            c[s], t[s] = x["c"], x["t"]
            on = s[self.slot_h[s] > 0]
            hot_c[on], hot_t[on] = x["hot_c"], x["hot_t"]
        root = totals.root_p(c, t)
        return np.where(self.slot_h > 0, totals.hot_p(self.slot_h - 1, hot_c, hot_t, root), root)

    def parent_p(self, above: np.ndarray) -> np.ndarray:
        c, p = self.customers(), above[self.slot]
        all_c, all_t = np.bincount(self.v, c, self.n_v), np.bincount(self.v, self.t_parent, self.n_v)
        own = (c - DISCOUNT[1] * self.t_parent + (STRENGTH[1] + DISCOUNT[1] * all_t)[self.v] * p) / (STRENGTH[1] + all_c)[self.v]
        return np.where(self.hot, p, own)

    def leaf_p(self, above: np.ndarray) -> np.ndarray:
        """Predictive probability of each pair."""
        out = self.parent_p(above)[self.bi]
        out *= (STRENGTH[2] + DISCOUNT[2] * np.bincount(self.room, self.t_leaf, self.n_rooms))[self.room]
        out += self.count - DISCOUNT[2] * self.t_leaf
        out /= (STRENGTH[2] + np.bincount(self.room, self.count, self.n_rooms))[self.room]
        return out

    def sweep(self, above: np.ndarray, rng: np.random.Generator) -> None:
        parent = self.parent_p(above)
        some = np.flatnonzero(self.count > 1)
        room = self.room[some]
        in_room = np.bincount(self.room, self.t_leaf, self.n_rooms).astype(np.int64)
        in_parent = np.bincount(self.v, self.t_parent, self.n_v).astype(np.int64)
        self.t_leaf[some] = reseat(self.count[some].astype(np.int64), in_room[room] - self.t_leaf[some], parent[self.bi[some]], DISCOUNT[2], STRENGTH[2], rng)
        c = self.customers()
        some = np.flatnonzero((c > 1) & ~self.hot)
        others = in_parent[self.v[some]] - self.t_parent[some]
        self.t_parent = np.where(self.hot, 0, c.clip(max=1))
        self.t_parent[some] = reseat(c[some], others, above[self.slot[some]], DISCOUNT[1], STRENGTH[1], rng)


class Totals(NamedTuple):
    """Known words, training tokens, the root's customers and tables, and those of each hot parent."""

    n_words: int
    n_tokens: int
    customers: int
    tables: int
    hot_customers: np.ndarray
    hot_tables: np.ndarray

    @property
    def base(self) -> float:
        return 1.0 / (self.n_words + 1)

    def root_p(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        return (c - DISCOUNT[0] * t + (STRENGTH[0] + DISCOUNT[0] * self.tables) * self.base) / (STRENGTH[0] + self.customers)

    def hot_p(self, h: np.ndarray, c: np.ndarray, t: np.ndarray, root: np.ndarray) -> np.ndarray:
        all_c, all_t = np.append(self.hot_customers, 0)[h], np.append(self.hot_tables, 0)[h]
        return (c - DISCOUNT[1] * t + (STRENGTH[1] + DISCOUNT[1] * all_t) * root) / (STRENGTH[1] + all_c)


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=0).astype(np.int32)


def _words(batches):
    """Slots sorted by the words' shard -> a row a shard: its dishes, and where the slots of each sender are among them."""
    yield from _one_by_one(_word_row, _by_key(batches, 3))


def _word_row(run) -> pa.RecordBatch:
    g, senders = run[0][0], [r[1] for r in run]
    parts = [_unpack(r[2]) for r in run]
    run.clear()
    _, take = _joined(parts)
    cut = np.cumsum([0] + [len(p["w"]) for p in parts])
    dishes, to = _distinct(take("w"))
    train = np.bincount(to, np.concatenate([p.pop("train") for p in parts]), len(dishes)).astype(np.uint64)
    h = np.concatenate([p.pop("h") for p in parts]).astype(np.int64)
    on = h > 0
    hots, hot = _distinct((h[on] - 1) * len(dishes) + to[on])
    to[on] = len(dishes) + hot
    links = [{"s": s, "blob": _pack(to=_steps(to[a:b]))} for s, a, b in zip(senders, cut[:-1], cut[1:], strict=True)]
    opened = np.bincount(to, np.concatenate([p.pop("tables") for p in parts]), len(dishes) + len(hots)).astype(np.uint64)
    blob = _pack(train=train, opened=opened, hot_h=(hots // len(dishes)).astype(np.uint32), hot_w=(hots % len(dishes)).astype(np.uint32))
    return pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([blob], pa.binary()), pa.array([links], _LINKS)], names=["shard", "blob", "links"])


def _links(links: list[dict]) -> dict[int, np.ndarray]:
    return {x["s"]: np.cumsum(_unpack(x["blob"])["to"], dtype=np.int64) for x in links}


def _seated(g: int, x: dict, opened: np.ndarray, n_hot: int, before: dict | None = None, totals: Totals | None = None, sweep: int = 0) -> pa.RecordBatch:
    """A words' shard with so many customers: its tables, and its share of the totals. Without tables before, a dish has one."""
    hot_h, hot_w, n = x["hot_h"].astype(np.int64), x["hot_w"].astype(np.int64), len(x["train"])
    hot_c = opened[n:]
    hot_t = hot_c.clip(max=1)
    rng = np.random.default_rng([SEED, 1, g, sweep])
    if before is not None and (some := np.flatnonzero(hot_c > 1)).size:
        up = totals.root_p(before["c"], before["t"])
        hot_t[some] = reseat(hot_c[some], totals.hot_tables[hot_h[some]] - before["hot_t"][some], up[hot_w[some]], DISCOUNT[1], STRENGTH[1], rng)
    c = opened[:n] + np.bincount(hot_w, hot_t, n).astype(np.int64)
    t = c.clip(max=1)
    if before is not None and (some := np.flatnonzero(c > 1)).size:
        t[some] = reseat(c[some], totals.tables - before["t"][some], np.full(len(some), totals.base), DISCOUNT[0], STRENGTH[0], rng)
    share = np.concatenate([[(x["train"] > 0).sum(), x["train"].sum(), c.sum(), t.sum()], np.bincount(hot_h, hot_c, n_hot), np.bincount(hot_h, hot_t, n_hot)]).astype(np.int64)
    packed = _pack(c=c.astype(np.uint64), t=t.astype(np.uint64), hot_c=hot_c.astype(np.uint64), hot_t=hot_t.astype(np.uint64))
    return pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([packed], pa.binary()), pa.array([share], pa.list_(pa.int64()))], names=["shard", "blob", "share"])


def _first_root(n_hot: int):
    def rows(batches):
        yield from _one_by_one(one, _rows_of(batches))

    def one(row):
        x = _unpack(row[1])
        return _seated(row[0], x, x["opened"].astype(np.int64), n_hot)

    return rows


def _root(folder: str, n_hot: int, totals: Totals, sweep: int):
    """Rows (words' shard, sender or -1, blob): tables that the senders opened, and the shard's own tables before -> its tables, and its share of the totals."""

    def rows(batches):
        yield from _one_by_one(one, _by_key(batches, 3))

    def one(run):
        g = run[0][0]
        blob, links = _stored(folder, g, "blob", "links")
        x, links = _unpack(blob), _links(links)
        opened, before = np.zeros(len(x["opened"]), np.int64), {}
        for _, s, sent in run:
            if s < 0:
                before = {k: a.astype(np.int64) for k, a in _unpack(sent).items()}
            else:
                opened[links[s]] += _unpack(sent)["tables"].astype(np.int64)  # a sender's slots are different dishes
        return _seated(g, x, opened, n_hot, before, totals, sweep)

    return rows


def _answers(folder: str, sweep: int, train: bool):
    """The words' shards' tables -> rows (shard, sweep, words' shard, customers and tables of its slots)."""

    def rows(batches):
        yield from _one_by_one(one, _rows_of(batches))

    def one(row):
        g, blob = row
        fixed, links = _stored(folder, g, "blob", "links")
        fixed, x = _unpack(fixed), _unpack(blob)
        n, out = len(x["c"]), []
        for s, to in _links(links).items():
            hot = to[to >= n] - n
            w = to.copy()
            w[to >= n] = fixed["hot_w"][hot]
            more = {"train": fixed["train"][w]} if train else {}
            out.append((s, _pack(c=x["c"][w].astype(np.uint64), t=x["t"][w], hot_c=x["hot_c"][hot], hot_t=x["hot_t"][hot], **more)))
        return pa.RecordBatch.from_arrays(
            [pa.array([s for s, _ in out], pa.int32()), pa.array([sweep] * len(out), pa.int32()), pa.array([g] * len(out), pa.int32()), pa.array([b for _, b in out], pa.binary())],
            names=["shard", "sweep", "g", "blob"],
        )

    return rows


def _sweep(folder: str, lay: Layout, totals: Totals, sweep: int):
    """Answers, and the shard's tables (g = -1) -> rows (g, shard, blob): tables that the shard opened, and its own (g = -1)."""

    def rows(batches):
        yield from _one_by_one(one, _by_key(batches, 4))

    def one(run):
        s = run[0][0]
        seats = Seats(_unpack(_stored(folder, s, "blob")[0]), lay)
        got = {g: b for _, _, g, b in run}
        if -1 in got:
            seats.restore(got.pop(-1))
        seats.sweep(seats.above({g: _unpack(b) for g, b in got.items()}, totals), np.random.default_rng([SEED, 0, s, sweep]))
        opened = seats.slot_tables()
        out = [(-1, seats.tables())] + [(g, _pack(tables=opened[at].astype(np.uint64))) for g, at in seats.sent]
        return pa.RecordBatch.from_arrays([pa.array([g for g, _ in out], pa.int32()), pa.array([s] * len(out), pa.int32()), pa.array([b for _, b in out], pa.binary())], names=["g", "s", "blob"])

    return rows


def _predict(folder: str, lay: Layout, totals: dict[int, Totals]):
    """Answers and tables of the sweeps after burn-in -> (block, shard, training counts and log10 of the averaged probabilities of the block's pairs)."""

    def rows(batches):
        yield from _one_by_one(one, _by_key(batches, 4))

    def one(run):
        s = run[0][0]
        state, pieces = _stored(folder, s, "blob", "pieces")
        state = _unpack(state)
        seats, p = Seats(state, lay), 0.0
        for k, after in totals.items():
            got = {g: b for _, sweep, g, b in run if sweep == k}
            seats.restore(got.pop(-1))
            got = {g: _unpack(b) for g, b in got.items()}
            p += seats.leaf_p(seats.above(got, after))
        train = np.zeros(len(seats.slot_w), np.int64)
        for g, at in seats.sent:
            train[at] = got[g]["train"]
        w, train = state["w"], train[seats.slot][seats.bi]
        del state, seats, got
        log_p = np.log10(p / len(totals)).astype(np.float32)
        del p
        blobs = []
        for piece in pieces:
            where = _unpack(piece["blob"])["where"].astype(np.int64)
            known = where[~pd.Series(w[where]).duplicated().to_numpy()]
            blobs.append(_pack(count=train[known].astype(np.uint64), log_p=log_p[where]))
        return pa.RecordBatch.from_arrays(
            [pa.array([x["block"] for x in pieces], pa.int64()), pa.array([s] * len(pieces), pa.int32()), pa.array(blobs, pa.binary())], names=["block", "shard", "blob"]
        )

    return rows


def _document_scores(folder: str, lay: Layout, n_tokens: int, n_words: int, id_type: pa.DataType | None, id_col: str):
    """Rows (block, shard, ids, file, blob) sorted by block and shard; a block's own rows have shard -1 and name its file in the folder."""

    def rows(batches):
        for run in _by_key(batches, 5):
            answers = {shard: blob for _, shard, _, _, blob in run if shard >= 0}
            own = [(ids, file) for _, shard, ids, file, _ in run if shard < 0]
            run.clear()
            yield from _one_by_one(lambda x: one(*x, answers), own)  # noqa: B023

    def one(ids, file, answers):
        fs, root = open_fs(folder)
        with fs.open_input_file(f"{root}/{file}") as f:
            found = pq.ParquetFile(f).read(columns=["lexicon", "blob"])
        words, block = np.append(_unpack(found.column(0)[0].as_py())["words"], START), _unpack(found.column(1)[0].as_py())
        del found
        n = len(words) - 1
        base, hot, part = lay.hints(words)
        v, u, w, _, inverse = trigrams(block, n)
        order, cut = _by_shard(lay.by_hints(base[v], hot[v], part[u]), lay.shards)
        del v, u
        count, log_p = np.zeros(n, np.int64), np.zeros(len(w))
        for shard, blob in answers.items():
            got, mine = _unpack(blob), order[cut[shard] : cut[shard + 1]]
            log_p[mine] = got["log_p"]
            count[pd.unique(w[mine])] = got["count"]
        del order, w
        at = block["at"].astype(np.int64)
        c = count[block["codes"]]
        sums = lambda x: np.add.reduceat(x, at[:-1])  # noqa: E731  every document holds its end token
        base = np.log10((c + 0.5) / (n_tokens + 0.5 * (n_words + 1)))
        columns = [block["held"], np.diff(at), sums((c > 0).astype(np.int64)), np.full(len(at) - 1, n_tokens, np.int64), sums(base), sums(log_p[inverse])]
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *map(pa.array, columns)], names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows


def _in_folder(df: DataFrame, name: str) -> str:
    """Writes one row a shard into a folder of the shard."""
    path = shared_path(df.sparkSession, name)
    df.write.partitionBy("shard").parquet(path)
    return path


def _total(tables: DataFrame, n_hot: int) -> Totals:
    found = np.zeros(4 + 2 * n_hot, np.int64)
    for place, n in tables.select(F.posexplode("share").alias("place", "n")).groupBy("place").agg(F.sum("n")).collect():
        found[place] = n
    return Totals(*found[:4].tolist(), found[4 : 4 + n_hot], found[4 + n_hot :])


def score(docs: DataFrame, held: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fits on the rows where ``held`` (SQL over the columns) isn't true and scores all rows.

    id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = pick(docs, id_col, text_col)
    kind = given.schema[id_col].dataType.simpleString()
    n_bytes = int(given.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0])
    shards = max(4, n_bytes // SHARD_BYTES)
    given = given.select(id_col, F.coalesce(F.expr(held), F.lit(False)).alias("held"), text_col)
    kept, block_schema = shared_path(spark, "blocks"), f"block bigint, ids array<{kind}>, n_tokens bigint, lexicon binary, blob binary"
    given.mapInArrow(_blocks, block_schema).write.option("maxRecordsPerFile", 1).parquet(kept)
    blocks = spark.read.schema(block_schema).parquet(kept)
    lay = layout(blocks, shards)
    n_hot = len(lay.hot)
    placed = blocks.select("block", "lexicon", "blob").mapInArrow(_pieces(lay), "shard int, block bigint, blob binary").repartitionById(shards, "shard").sortWithinPartitions("shard", "block")
    found = placed.mapInArrow(_states(lay), "shard int, blob binary, pieces array<struct<block: bigint, blob: binary>>, slots array<struct<g: int, blob: binary>>")
    leaves = _in_folder(found, "leaves")
    slots = spark.read.schema("slots array<struct<g: int, blob: binary>>, shard int").parquet(leaves).select("shard", F.explode("slots").alias("x")).select("x.g", F.col("shard").alias("s"), "x.blob")
    at_words = lambda rows: rows.repartitionById(lay.of_words, "g").sortWithinPartitions("g", "s")
    at_leaves = lambda rows: rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "sweep", "g")
    words = _in_folder(at_words(slots).mapInArrow(_words, "shard int, blob binary, links array<struct<s: int, blob: binary>>"), "words")
    root_schema, answer_schema = "shard int, blob binary, share array<bigint>", "shard int, sweep int, g int, blob binary"
    seats = spark.read.schema("blob binary, shard int").parquet(words).select("shard", "blob")
    root = {0: materialise(seats.mapInArrow(_first_root(n_hot), root_schema), "root")}
    totals, seated = {0: _total(root[0], n_hot)}, {}
    own = lambda k: seated[k].where("g = -1").select(F.col("s").alias("shard"), F.lit(k).alias("sweep"), "g", "blob")
    answers = lambda k, train: root[k].select("shard", "blob").mapInArrow(_answers(words, k, train), answer_schema)
    last = BURN_IN + SAMPLES
    for k in range(last):
        rows = answers(k, False) if k == 0 else answers(k, False).unionByName(own(k))
        seated[k + 1] = materialise(at_leaves(rows).mapInArrow(_sweep(leaves, lay, totals[k], k), "g int, s int, blob binary"), "seated")
        before = root[k].select(F.col("shard").alias("g"), F.lit(-1).alias("s"), "blob")
        opened = at_words(seated[k + 1].where("g >= 0").unionByName(before))
        root[k + 1] = materialise(opened.mapInArrow(_root(words, n_hot, totals[k], k + 1), root_schema), "root")
        totals[k + 1] = _total(root[k + 1], n_hot)
    averaged = range(BURN_IN + 1, last + 1)
    rows = None
    for k in averaged:
        more = answers(k, k == last).unionByName(own(k))
        rows = more if rows is None else rows.unionByName(more)
    found = at_leaves(rows).mapInArrow(_predict(leaves, lay, {k: totals[k] for k in averaged}), "block bigint, shard int, blob binary")
    mine = blocks.select("block", F.lit(-1).alias("shard"), "ids", F.col("_metadata.file_name").alias("file"), F.lit(None).cast("binary").alias("blob"))
    both = mine.unionByName(found.select("block", "shard", F.lit(None).cast(f"array<{kind}>").alias("ids"), F.lit(None).cast("string").alias("file"), "blob"))
    id_type = pa.int64() if kind == "bigint" else None
    schema = f"`{id_col}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    scores = _document_scores(kept, lay, totals[0].n_tokens, totals[0].n_words, id_type, id_col)
    return both.repartition(parts, "block").sortWithinPartitions("block", "shard").mapInArrow(scores, schema)
