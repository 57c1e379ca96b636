"""Source divergence audit: how far the sources of a language differ in their terms, in whole numbers.

A language keeps the terms that ``MIN_DOCS`` of its documents hold. Each (language, source) group, and each
language, gives every kept term a smoothed share of ``SCALE``, which depends on the term's count there only. A
pair of sources is priced by inclusion and exclusion over the terms that occur in either:

- a histogram of each group's counts prices the terms as if the other source had none of them;
- terms of both sources are found in posting lists, two by two, counted by (pair, count, count) and priced
  once for each such combination: the joint price less the two one-sided ones;
- terms of neither have one price, times how many there are.

So no table of all terms for all sources is made. Counts are summed in tasks before they are shuffled, by term
and group, so a frequent term or a large group is one row a task; posting lists are as long as a language has
sources.

Defined results: null text, language or source count as ''; words in other scripts are terms, as every byte
over 127 is a letter; repeated rows are documents of their own; ids aren't read; texts of any length are taken
whole; a group without terms has every count 0; a language without kept terms gives pairs of value 0; an empty
table gives an empty result; other columns, also such that differ from the three in case only, are ignored.
Groups are named by XXH64 of language and source while they are counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vouchline.llm.common import LOWER, distinct_spans, doc_chunks, materialise, pick, table, text_bytes
from vouchline.llm.tokens import byte_set, runs

MIN_DOCS = 3
SCALE = 1_000_000_000
TOP = 200
_CHUNK = 8_000_000
#: Distinct terms after which a task gives out what it has counted.
_TERMS = 400_000
_ROWS = 100_000
#: Up to so many groups, their table is broadcast (under 100 bytes each).
SMALL = 50_000
_LETTER = byte_set((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def _add(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys and the sums of their values."""
    kinds, at = np.unique(key, return_inverse=True)
    out = []
    for v in values:
        total = np.zeros(len(kinds), np.int64)
        np.add.at(total, at, v)
        out.append(total)
    return kinds, *out


def _flush(index: dict[bytes, int], held: list):
    if not held:
        return
    group, term, n, df = (np.concatenate(x) for x in zip(*held, strict=True))
    groups, g = np.unique(group, return_inverse=True)
    key, n, df = _add(g * len(index) + term, n, df)
    words = pa.array(list(index), pa.binary())
    for i in range(0, len(key), _ROWS):
        k = key[i : i + _ROWS]
        yield pa.RecordBatch.from_arrays(
            [pa.array(groups[k // len(index)]), words.take(pa.array(k % len(index))).cast(pa.string()), pa.array(n[i : i + _ROWS]), pa.array(df[i : i + _ROWS])],
            names=["g", "term", "n", "df"],
        )


def _count(batches):
    index, held = {}, []
    for batch in batches:
        buf, off = text_bytes(batch.column(1))
        group = batch.column(0).to_numpy(zero_copy_only=False)
        for i, j in doc_chunks(off, _CHUNK):
            part = LOWER[buf[off[i] : off[j]]]
            start, end, counts = runs(_LETTER[part], off[i : j + 1] - off[i])
            if not len(start):
                continue
            code, words = distinct_spans(part, start, end)
            ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
            per_doc, n = np.unique(np.repeat(np.arange(j - i), counts) * len(words) + code, return_counts=True)
            groups, g = np.unique(group[i:j], return_inverse=True)
            key, n, df = _add(g[per_doc // len(words)] * len(words) + per_doc % len(words), n, np.ones(len(n), np.int64))
            held.append((groups[key // len(words)], ids[key % len(words)], n, df))
            if len(index) > _TERMS:
                yield from _flush(index, held)
                index, held = {}, []
    yield from _flush(index, held)


def _share(n, total, kinds):
    """1 + floor(SCALE * (n + 1) / (total + kinds)), exact."""
    return F.expr(f"CAST(1 + (CAST({n} AS decimal(20,0)) + 1) * {SCALE} div (CAST({total} AS decimal(20,0)) + {kinds}) AS bigint)")


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def _times(k: str, price: str) -> str:
    return f"CAST({k} AS decimal(18,0)) * CAST({price} AS decimal(20,0))"


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(groups: g, lang, source), (kept terms: lang, term, c, list of (g, n) by g)."""
    read = pick(docs, text, lang, source).select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source"), F.col(text).alias("text"))
    groups = materialise(read.select("lang", "source").distinct().withColumn("g", F.xxhash64("lang", "source")), "groups")
    found = read.select(F.xxhash64("lang", "source").alias("g"), "text").mapInArrow(_count, "g bigint, term string, n bigint, df bigint")
    summed = found.groupBy("g", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).join(_small(groups.select("g", "lang")), "g")
    terms = summed.groupBy("lang", "term").agg(F.sum("n").alias("c"), F.sum("df").alias("df"), F.sort_array(F.collect_list(F.struct("g", "n"))).alias("list"))
    return groups, materialise(terms.where(F.col("df") >= MIN_DOCS).drop("df"), "postings")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: every pair of sources, and each group's ``TOP`` terms over its language."""
    groups, terms = counts(docs, text, lang, source)
    by_lang = materialise(terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"), F.sum("c").alias("total")), "languages")
    histogram = materialise(terms.select(F.explode("list").alias("x")).groupBy("x.g", "x.n").agg(F.count(F.lit(1)).alias("k")), "histograms")
    totals = histogram.groupBy("g").agg(F.sum(F.col("n") * F.col("k")).alias("own"), F.sum("k").alias("support"))
    sizes = groups.join(F.broadcast(by_lang), "lang", "left").join(totals, "g", "left").fillna(0, ["kinds", "total", "own", "support"])
    sizes = materialise(sizes.withColumn("zero", F.when(F.col("kinds") > 0, _share("0L", "own", "kinds"))), "sizes")
    known = _small(sizes.select("g", "lang", "own", "kinds", "zero"))
    partner = _small(sizes.select("lang", F.col("g").alias("h"), F.col("zero").alias("h0")))

    # one-sided: a count of g against none in h, in both directions
    priced = histogram.join(known, "g").select("lang", "g", "zero", "k", _share("n", "own", "kinds").alias("p"))
    sided = priced.join(partner, "lang").where("g <> h")
    there = sided.groupBy("g", "h").agg(F.sum(F.expr(_times("k", _f("p", "h0")))).alias("out"), F.sum(F.expr(_times("k", _f("h0", "p")))).alias("back"))

    # both: every two entries of a posting list, counted by their counts
    two = terms.select("list", F.posexplode("list").alias("i", "x")).select("x", F.explode(F.expr("slice(list, i + 2, size(list))")).alias("y"))
    both = two.groupBy(F.col("x.g").alias("g"), F.col("y.g").alias("h"), F.col("x.n").alias("m"), F.col("y.n").alias("n")).agg(F.count(F.lit(1)).alias("k"))
    other = known.select(F.col("g").alias("h"), F.col("own").alias("h_own"), F.col("zero").alias("h0"))
    both = both.join(known, "g").join(_small(other) if sizes.count() <= SMALL else other, "h").select("g", "h", "k", "zero", "h0", _share("m", "own", "kinds").alias("p"), _share("n", "h_own", "kinds").alias("q"))
    over = both.groupBy("g", "h").agg(
        F.sum("k").alias("shared"),
        F.sum(F.expr(_times("k", f"{_f('p', 'q')} - {_f('p', 'h0')} - {_f('zero', 'q')}"))).alias("out"),
        F.sum(F.expr(_times("k", f"{_f('q', 'p')} - {_f('q', 'zero')} - {_f('h0', 'p')}"))).alias("back"),
    )
    amounts = (
        there.select("g", "h", F.col("out").alias("v"), F.lit(0).cast("bigint").alias("shared"))
        .unionByName(there.select(F.col("h").alias("g"), F.col("g").alias("h"), F.col("back").alias("v"), F.lit(0).cast("bigint").alias("shared")))
        .unionByName(over.select("g", "h", F.col("out").alias("v"), "shared"))
        .unionByName(over.select(F.col("h").alias("g"), F.col("g").alias("h"), F.col("back").alias("v"), "shared"))
        .groupBy("g", "h")
        .agg(F.sum("v").alias("v"), F.sum("shared").alias("shared"))
    )
    one = sizes.select("lang", "source", "g", "kinds", F.col("support").alias("s"), F.col("zero").alias("p0"))
    another = sizes.select("lang", F.col("source").alias("item"), F.col("g").alias("h"), F.col("support").alias("t"), F.col("zero").alias("q0"))
    pairs = one.join(_small(another), "lang").where("g <> h").join(amounts, ["g", "h"], "left").fillna(0, ["shared"])
    value = F.coalesce(F.expr(f"coalesce(v, CAST(0 AS decimal(38,0))) + {_times('kinds - s - t + shared', _f('p0', 'q0'))}"), F.lit(0)).cast("bigint")
    by_value = Window.partitionBy("g").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"), "g").withColumn("rank", F.row_number().over(by_value))

    # terms of a group that stand above the language's share
    entries = terms.select("lang", F.col("term").alias("item"), "c", F.explode("list").alias("x")).select("lang", "item", "c", "x.g", "x.n")
    shares = entries.join(_small(sizes.select("g", "source", "own")), "g").join(F.broadcast(by_lang), "lang")
    shares = shares.select("lang", "source", "item", "g", _share("n", "own", "kinds").alias("p"), _share("c", "total", "kinds").alias("q")).where("p > q")
    best = shares.select("lang", "source", F.lit("term").alias("part"), "item", F.expr(_f("p", "q")).alias("value"), "g")
    best = best.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= TOP)
    return pairs.unionByName(best).drop("g")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value, rank over all documents."""
    return audit(table(spark, sf_dir, "documents"))


#: Every kept term for every group, priced pair by pair.
ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), groups AS (SELECT DISTINCT lang, source FROM docs),
words AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS c FROM words GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
langs AS (SELECT lang, count(*) AS kinds, sum(c) AS total FROM kept GROUP BY 1),
counted AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY 1, 2, 3),
dense AS (
  SELECT g.lang, g.source, k.term, k.c, coalesce(n, 0) AS n, kinds, total,
    sum(coalesce(n, 0)) OVER (PARTITION BY g.lang, g.source) AS own
  FROM groups g JOIN kept k USING (lang) JOIN langs USING (lang) LEFT JOIN counted USING (lang, source, term)
), shares AS (
  SELECT *, 1 + (CAST(1000000000 AS HUGEINT) * (n + 1)) // CAST(own + kinds AS HUGEINT) AS p, 1 + (CAST(1000000000 AS HUGEINT) * (c + 1)) // CAST(total + kinds AS HUGEINT) AS q FROM dense
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM shares WHERE n > 0 AND p > q
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
