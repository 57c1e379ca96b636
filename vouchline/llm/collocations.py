"""Phrase collocation mining with count tries of depth three.

1. Each task counts the words of some 8 MB of text into a trie: words below the root, a word's followers within
   pieces below it. Nodes are serialised in the order of their words' 64-bit names, one run for each prefix
   range, and the runs of a range are merged in one task (numpy's stable sort of presorted runs). First words
   make the ranges, and a first word's followers are dealt to ``SPREAD`` of them, so a word that holds a third
   of the text doesn't land in one.
2. The third level grows only below pairs that reached ``LEAST``, as no phrase is more frequent than its parts.
   The text is read again for it; a bit array of fixed size names those pairs, and what it names besides is
   merged and falls below ``LEAST`` itself. So few of the text's triples are ever shuffled.
3. Walking a phrase's path up gives its left parts, a suffix link (its node without the first word) its right
   parts: nodes and the paths that lead to them are sorted together and read in that order.

Words are named by XXH3 seeded with their language: two of n words share a name with a probability of about
n squared / 2**65.

Defined results: a null text is empty, a null language is ``und``; repeated rows count again; ids aren't read;
texts of any length are taken whole, in one piece of work each; ties are broken by score, count and phrase, so
the order is total; an empty table gives an empty result; other columns, also such that differ from the two in
case only, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from vouchline.llm.bits import bit_filter, fits
from vouchline.llm.common import LOWER, distinct_spans, doc_chunks, materialise, pick, splitmix, table, text_bytes
from vouchline.llm.tokens import byte_set, runs

LEAST = 10
#: A phrase goes if a longer candidate around it has this share of its occurrences, in per cent.
COVERED = 50
TOP = 2000
#: Prefix ranges over which the followers of one first word are dealt.
SPREAD = 64
_CHUNK = 8_000_000
_PIECE = byte_set((0x0A, 0x0D), *((ord(c),) * 2 for c in ".,;:!?"))
_BREAK = _PIECE | byte_set((0x20, 0x20), (0x09, 0x09))
_U64 = np.uint64


class _Words:
    """The tokens of some documents: local numbers in the order of their names, and which go on to the next."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, lang: np.ndarray):
        part = LOWER[buf]
        start, end, counts = runs(~_BREAK[part], off)
        code, words = distinct_spans(part, start, end)
        langs, l_of = np.unique(lang, return_inverse=True)
        kinds, token = np.unique(np.repeat(l_of, counts) * len(words) + code, return_inverse=True)
        l_kind, w_kind = np.divmod(kinds, max(1, len(words)))
        seeds = langs.view(_U64).tolist()
        name = np.fromiter((xxh3_64_intdigest(words[w], seeds[k]) for k, w in zip(l_kind.tolist(), w_kind.tolist(), strict=True)), _U64, len(kinds))
        order = np.argsort(name)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.token, self.name, self.lang = place[token], name[order], langs[l_kind[order]]
        self._words, self._kind = words, w_kind[order]
        breaks = np.cumsum(_PIECE[part], dtype=np.int32)
        doc = np.repeat(np.arange(len(counts)), counts)
        self.goes_on = (doc[1:] == doc[:-1]) & (breaks[start[1:]] == breaks[end[:-1] - 1]) if len(start) else np.zeros(0, bool)

    def spell(self, local: np.ndarray) -> list[bytes]:
        return [self._words[k] for k in self._kind[local].tolist()]


def _texts(batches):
    for batch in batches:
        buf, off = text_bytes(batch.column(1))
        lang = batch.column(0).to_numpy(zero_copy_only=False)
        for i, j in doc_chunks(off, _CHUNK):
            yield _Words(buf[off[i] : off[j]], off[i : j + 1] - off[i], lang[i:j])


def _range(name: np.ndarray, parts: int) -> np.ndarray:
    return (((name >> _U64(32)) * _U64(parts)) >> _U64(32)).astype(np.int64)


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return splitmix(splitmix(first) + second)


def _cut(part: np.ndarray):
    """Stable order by prefix range, and the (range, first, end) of each."""
    order = np.argsort(part.astype(np.uint16 if part.max(initial=0) < 1 << 16 else np.int64), kind="stable")
    if not len(part):
        return order, []
    sorted_ = part[order]
    cut = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    return order, list(zip(sorted_[cut].tolist(), cut.tolist(), np.append(cut[1:], len(part)).tolist(), strict=True))


def _run(parents: list[np.ndarray], child: np.ndarray, n: np.ndarray) -> tuple[list[bytes], bytes, bytes, bytes]:
    """A sorted run: each parent once, its number of children, their names and counts."""
    new = np.zeros(len(child), bool)
    new[:1] = True
    for p in parents:
        new[1:] |= p[1:] != p[:-1]
    at = np.flatnonzero(new)
    return [p[at].tobytes() for p in parents], np.diff(np.append(at, len(child))).astype(np.uint32).tobytes(), child.tobytes(), n.astype(np.uint32).tobytes()


_RUN = "part int, l bigint, first binary, second binary, kids binary, child binary, words array<binary>, n binary"


def _batch(rows: list[dict]) -> pa.RecordBatch:
    b = pa.binary()
    kinds = {"part": pa.int32(), "l": pa.int64(), "first": b, "second": b, "kids": b, "child": b, "words": pa.list_(b), "n": b}
    return pa.RecordBatch.from_pylist(rows, pa.schema(kinds.items()))


def _two_levels(parts: int):
    def tries(batches):
        for w in _texts(batches):
            rows, name = [], w.name
            n = np.bincount(w.token, minlength=len(name))
            for l in np.unique(w.lang).tolist():
                mine = np.flatnonzero(w.lang == l)
                order, cuts = _cut(_range(name[mine], parts))
                for part, i, j in cuts:
                    k = mine[order[i:j]]
                    rows.append({"part": part, "l": l, "child": name[k].tobytes(), "words": w.spell(k), "n": n[k].astype(np.uint32).tobytes()})
            yield _batch(rows)
            at = np.flatnonzero(w.goes_on)
            pair, n = np.unique(w.token[at] * len(name) + w.token[at + 1], return_counts=True)
            first, second = (name[k] for k in np.divmod(pair, max(1, len(name))))
            order, cuts = _cut((_range(first, parts) + _range(second, SPREAD)) % parts)
            rows = []
            for part, i, j in cuts:
                k = order[i:j]
                (a,), kids, child, count = _run([first[k]], second[k], n[k])
                rows.append({"part": part, "first": a, "kids": kids, "child": child, "n": count})
            yield _batch(rows)

    return tries


def _third_level(parts: int, shared):
    def tries(batches):
        bits = shared.value
        for w in _texts(batches):
            name, token = w.name, w.token
            if len(token) < 3:
                continue
            often = w.goes_on & fits(bits, _pair_hash(name[token[:-1]], name[token[1:]]))
            at = np.flatnonzero(often[:-1] & often[1:])
            pair, p = np.unique(token[at] * len(name) + token[at + 1], return_inverse=True)
            key, n = np.unique(p * len(name) + token[at + 2], return_counts=True)
            p, third = np.divmod(key, len(name))
            first, second = (name[k] for k in np.divmod(pair[p], len(name)))
            third = name[third]
            order, cuts = _cut((_range(first, parts) + _range(second, SPREAD) + _range(third, SPREAD)) % parts)
            rows = []
            for part, i, j in cuts:
                k = order[i:j]
                (a, b), kids, child, count = _run([first[k], second[k]], third[k], n[k])
                rows.append({"part": part, "first": a, "second": b, "kids": kids, "child": child, "n": count})
            yield _batch(rows)

    return tries


def _numbers(column, kind):
    return [np.frombuffer(x, kind) for x in column.to_pylist() if x is not None]


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges presorted runs of keys that were laid end to end."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[at], np.add.reduceat(n[order], at) if len(at) else n


def _joined(arrays: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, kind)


def _merged_paths(runs_: pa.Table, parents: tuple[str, ...]):
    """Merged paths (a name for each level) and counts; the order of numbers is that of names, so runs stay sorted."""
    kids = _joined(_numbers(runs_.column("kids"), np.uint32), np.uint32)
    n = _joined(_numbers(runs_.column("n"), np.uint32), np.uint32).astype(np.int64)
    levels = [np.unique(_joined(_numbers(runs_.column(c), _U64), _U64), return_inverse=True) for c in (*parents, "child")]
    key, steps = np.zeros(len(kids), np.int64), []
    for names, number in levels[:-1]:
        key = key * max(1, len(names)) + number
    paths, place = np.unique(key, return_inverse=True)  # one number a parent path, so three levels fit 64 bits
    names, number = levels[-1]
    key, n = _summed(np.repeat(place, kids) * max(1, len(names)) + number, n)
    keep = n >= LEAST
    key, n = key[keep], n[keep]
    at, last = np.divmod(key, max(1, len(names)))
    path, steps = paths[at], [names[last]]
    for level, _ in reversed(levels[:-1]):
        path, k = np.divmod(path, max(1, len(level)))
        steps.append(level[k])
    return steps[::-1], n


def _merge_two(batches):
    """Rows (kind, l, w1, w2, h, word, n): kind 0 all words of a language, 1 a word, 2 a pair."""
    found = list(batches)
    if not found:
        return
    runs_ = pa.Table.from_batches(found)

    def batch(kind, m, l=None, w1=None, w2=None, h=None, word=None, n=None):
        signed = lambda x: pa.nulls(m, pa.int64()) if x is None else pa.array(np.ascontiguousarray(x).view(np.int64))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(m, kind, np.int32)), signed(l), signed(w1), signed(w2), signed(h), pa.nulls(m, pa.string()) if word is None else word, signed(n)],
            names=["kind", "l", "w1", "w2", "h", "word", "n"],
        )

    single = runs_.filter(pa.compute.is_valid(runs_.column("l")))
    for l in sorted(set(single.column("l").to_pylist())):
        mine = single.filter(pa.compute.equal(single.column("l"), l))
        name, n = _joined(_numbers(mine.column("child"), _U64), _U64), _joined(_numbers(mine.column("n"), np.uint32), np.uint32).astype(np.int64)
        words = pa.compute.list_flatten(mine.column("words").combine_chunks())
        kinds, at = np.unique(name, return_index=True)
        _, total = _summed(name, n)
        yield batch(0, 1, l=np.array([l]), n=np.array([total.sum()]))
        keep = total >= LEAST
        yield batch(1, int(keep.sum()), l=np.full(int(keep.sum()), l), w1=kinds[keep], word=words.take(pa.array(at[keep])).cast(pa.string()), n=total[keep])
    (first, second), n = _merged_paths(runs_.filter(pa.compute.is_valid(runs_.column("kids"))), ("first",))
    yield batch(2, len(n), w1=first, w2=second, h=_pair_hash(first, second), n=n)


def _merge_three(batches):
    found = list(batches)
    if found:
        steps, n = _merged_paths(pa.Table.from_batches(found), ("first", "second"))
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (*steps, n)], names=["w1", "w2", "w3", "n"])


def _filled(keys: int, payload: int):
    """Rows sorted by key, a key's node (its last columns null) first: each other row with its node's payload."""

    def walk(batches):
        last = None
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            is_node = columns[-1].is_valid().to_numpy(zero_copy_only=False)
            names = [c.to_numpy(zero_copy_only=False) for c in columns[:keys]]
            values = [np.asarray(c.fill_null(0).to_numpy(zero_copy_only=False)) for c in columns[-payload:]]
            if last is not None:  # the node of a key that goes on from the batch before stands in front
                names = [np.append(x[:1], n) for x, n in zip(last[0], names, strict=True)]
                values = [np.append(x[:1], v) for x, v in zip(last[1], values, strict=True)]
                is_node = np.append(True, is_node)
            at = np.maximum.accumulate(np.where(is_node, np.arange(len(is_node)), 0))
            known = ~is_node & is_node[at]
            for n in names:
                known &= n == n[at]
            last = ([n[at[-1:]] for n in names], [v[at[-1:]] for v in values]) if len(at) else last
            known, at = known[len(known) - batch.num_rows :], at[len(at) - batch.num_rows :]
            keep = pa.array(known)
            kept = [c.filter(keep) for c in columns[:-payload]] + [pa.array(v[at[known]]) for v in values]
            yield pa.RecordBatch.from_arrays(kept, names=batch.schema.names)

    return walk


def _walk(paths: DataFrame, nodes: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """paths with the payload (bigint) of the node that their key names: up the trie, or along a suffix link.

    Nodes and paths are sorted together, each node ahead of its paths. A key with over a thousandth of the paths is
    dealt in ``SPREAD`` slots, each with its node; there are fewer than a thousand such keys.
    """
    parts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in paths.columns if c not in keys]
    counted = paths.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    often = max(1000, paths.count() // 1000)
    hot = [tuple(r)[:-1] for r in counted.where(F.col("__n") > often).collect()]
    name = F.concat_ws(":", *keys)
    is_hot = name.isin([":".join(map(str, k)) for k in hot]) if hot else F.lit(False)
    slots = F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0))))
    slot = F.when(is_hot, F.pmod(F.xxhash64(*rest), F.lit(SPREAD)).cast("int")).otherwise(0)
    kinds = {f.name: f.dataType.simpleString() for f in paths.schema}
    above = nodes.select(*keys, slots.alias("__slot"), *(F.lit(None).cast(kinds[c]).alias(c) for c in rest), *payload)
    below = paths.select(*keys, slot.alias("__slot"), *rest, *(F.lit(None).cast("bigint").alias(c) for c in payload))
    placed = above.unionByName(below).repartition(parts, *keys, "__slot").sortWithinPartitions(*keys, "__slot", F.col(payload[0]).desc_nulls_last())
    schema = ", ".join(f"{c} {kinds.get(c, 'bigint' if c != '__slot' else 'int')}" for c in placed.columns)
    return materialise(placed.mapInArrow(_filled(len(keys), len(payload)), schema).drop("__slot"), "walk")


def _score(a: str, left: str, right: str):
    wide = lambda x: f"CAST({x} AS decimal(19,0))"
    return F.expr(f"{wide(a)} * {wide(a)} * CAST(1000000 AS decimal(7,0)) div ({wide(left)} * {wide(right)})")


def levels(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(words and pairs, triples) of all languages with at least ``LEAST`` occurrences."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * docs.rdd.getNumPartitions())
    read = pick(docs, text, lang).select(F.xxhash64(F.coalesce(lang, F.lit("und"))).alias("l"), F.col(text).alias("text"))
    dealt = lambda runs_: runs_.repartitionById(parts, "part")
    two = dealt(read.mapInArrow(_two_levels(parts), _RUN)).mapInArrow(_merge_two, "kind int, l bigint, w1 bigint, w2 bigint, h bigint, word string, n bigint")
    two = materialise(two, "two-levels")
    shared = spark.sparkContext.broadcast(bit_filter(two.where("kind = 2"), "h"))
    three = dealt(read.mapInArrow(_third_level(parts, shared), _RUN)).mapInArrow(_merge_three, "w1 bigint, w2 bigint, w3 bigint, n bigint")
    return two, materialise(three, "third-level")


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two and three words."""
    two, three = levels(docs, text, lang)
    words = two.where("kind = 1")
    pairs = two.where("kind = 2").select("w1", "w2", "n")
    word = lambda key, *names: words.select(F.col("w1").alias(key), *(F.col(c).alias(n) for c, n in zip(("n", "l"), names)))  # noqa: B905, E731
    pair = lambda x, y, name: pairs.select(F.col("w1").alias(x), F.col("w2").alias(y), F.col("n").alias(name))

    # a pair and the triples that begin or end with it, in one aggregate
    longer = three.select(F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"), "n").select("p.*", F.lit(None).cast("bigint").alias("a"), F.col("n").alias("longer"))
    short = pairs.select("w1", "w2", F.col("n").alias("a"), F.lit(None).cast("bigint").alias("longer")).unionByName(longer).groupBy("w1", "w2").agg(F.max("a").alias("a"), F.max("longer").alias("longer"))
    short = materialise(short.where(f"a IS NOT NULL AND (longer IS NULL OR 100 * longer < {COVERED} * a)").select("w1", "w2", "a"), "pairs")
    short = _walk(_walk(short, word("w1", "f1", "lang_"), ["w1"], ["f1", "lang_"]), word("w2", "f2"), ["w2"], ["f2"])
    short = short.select("lang_", "w1", "w2", F.lit(None).cast("bigint").alias("w3"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _score("a", "f1", "f2").alias("score"))

    long = three.withColumnRenamed("n", "a")
    for nodes, keys, payload in ((word("w1", "f1", "lang_"), ["w1"], ["f1", "lang_"]), (word("w3", "f3"), ["w3"], ["f3"]), (pair("w1", "w2", "f12"), ["w1", "w2"], ["f12"]), (pair("w2", "w3", "f23"), ["w2", "w3"], ["f23"])):
        long = _walk(long, nodes, keys, payload)
    long = long.withColumn("s1", _score("a", "f1", "f23")).withColumn("s2", _score("a", "f12", "f3"))
    long = long.select("lang_", "w1", "w2", "w3", "a", F.expr("IF(s1 <= s2, f1, f12)").alias("l"), F.expr("IF(s1 <= s2, f23, f3)").alias("r"), F.least("s1", "s2").alias("score"))

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.desc("a")]
    # a language's candidates are cut down in parts first, ties kept, so no task sorts all of them; only the rest is spelt
    part = Window.partitionBy("lang_", F.expr(f"pmod(xxhash64(w1, w2, w3), {parts})")).orderBy(*order)
    best = short.unionByName(long).withColumn("rank", F.rank().over(part)).where(F.col("rank") <= top)
    best = materialise(best.withColumn("rank", F.rank().over(Window.partitionBy("lang_").orderBy(*order))).where(F.col("rank") <= top), "best")
    for i in (1, 2, 3):
        best = best.join(words.select(F.col("w1").alias(f"w{i}"), F.col("word").alias(f"t{i}")), f"w{i}", "left")
    best = best.withColumn("phrase", F.concat_ws(" ", "t1", "t2", "t3"))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang_").orderBy(*order, "phrase"))).where(F.col("rank") <= top)
    totals = two.where("kind = 0").groupBy(F.col("l").alias("lang_")).agg(F.sum("n").alias("n"))
    langs = pick(docs, lang).select(F.coalesce(lang, F.lit("und")).alias("lang")).distinct().withColumn("lang_", F.xxhash64("lang"))
    return best.join(totals, "lang_").join(langs, "lang_").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score over all documents."""
    return phrases(table(spark, sf_dir, "documents"))


#: Every phrase of one to three words counted as a string.
ORACLE = r"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (SELECT lang, unnest(regexp_extract_all(text, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM docs),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM words, range(1, 4) t(k)
), f AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY 1, 2, 3 HAVING count(*) >= 10),
totals AS (SELECT lang, CAST(count(*) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY 1),
cuts AS (
  SELECT lang, phrase, k, n AS a, unnest(range(1, k)) AS c, str_split(phrase, ' ') AS w FROM f WHERE k > 1
), sides AS (
  SELECT c.*, x.n AS l, y.n AS r, (CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.n AS HUGEINT) * y.n) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:c], ' ') AND x.k = c.c
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[c + 1:c.k], ' ') AND y.k = c.k - c.c
), chosen AS (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner_ AS (
  SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM chosen WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM chosen WHERE k = 3
), longer AS (SELECT lang, phrase, max(a) AS most FROM inner_ GROUP BY 1, 2),
left_ AS (SELECT c.* FROM chosen c LEFT JOIN longer o ON c.lang = o.lang AND c.phrase = o.phrase AND c.k = 2 WHERE o.most IS NULL OR 100 * o.most < 50 * c.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, t.n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals t USING (lang) WHERE rank <= 2000
"""
