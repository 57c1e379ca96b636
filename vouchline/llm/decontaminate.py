"""Benchmark decontamination by size-partitioned MinHash containment (DataFrame and SQL functions only).

A document is contaminated by a test item if it holds at least ``THRESHOLD`` of the item's distinct five-word
shingles, wherever they stand in it and however long it is. Jaccard similarity says nothing about a short
item in a long document, so the search is one of containment, and both sides have sketches that depend on the
item's size: items are partitioned by size (powers of two); a partition with at most u shingles keeps each
item's K(u) = u - ceil(THRESHOLD * u) + 1 least hash values as its signature, and its bar is the largest value
kept in it. A document's sketch holds its hash values up to the highest bar, and only those are joined. A
document that misses at most n - ceil(THRESHOLD * n) of an item's n shingles holds one of the values kept, and
that value is under the bar, so the search loses nothing; candidates are then verified by exact containment of
shingle strings.

Words are runs of letters and digits of the lower-cased text, so case and punctuation don't hide a passage.
A text of fewer than five words has its whole sequence as its one shingle; one without words matches nothing.
Null texts count as empty; rows of one id are one document, whose shingles are those of all its rows (null ids
too are one); ``clean`` judges each row on its own; texts of any length are searched whole; empty tables give an
empty result; other columns, also such that differ in case only, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchline.llm.common import materialise, pick, table

WIDTH = 5
THRESHOLD = 0.8
#: Broadcast only below these row counts; beyond them, shuffled joins.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64_000_000


def _words(df: DataFrame, text: str) -> DataFrame:
    """Adds __w, the words, and __m, the number of shingles."""
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    out = df.withColumn("__t", clean).withColumn("__w", F.split("__t", " ", -1)).where("__t <> ''")
    return out.withColumn("__m", F.greatest(F.lit(1), F.size("__w") - F.lit(WIDTH - 1))).drop("__t")


_WINDOW = ", ".join(f"get(__w, i + {k})" for k in range(WIDTH))
#: hash of each shingle; absent words of a short text are null and leave the hash as it is
_HASHES = f"transform(sequence(0, __m - 1), i -> xxhash64({_WINDOW}))"
_STRINGS = f"transform(sequence(0, __m - 1), i -> array_join(slice(__w, i + 1, {WIDTH}), ' '))"


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """items (item_id, __w, __m) -> h, item_id: each item's least hash values, as many as its size partition keeps."""
    hashed = items.withColumn("__h", F.array_sort(F.array_distinct(F.expr(_HASHES))))
    upper = hashed.withColumn("__u", F.expr("shiftleft(1L, CAST(ceil(log2(size(__h))) AS int))"))
    # size(__h) <= __u < 2 * size(__h): the partition's bound
    kept = upper.withColumn("__k", (F.col("__u") - F.ceil(F.col("__u") * F.lit(threshold) - F.lit(1e-9)) + 1).cast("int"))
    return kept.select("item_id", F.col("__u").alias("upper"), F.explode(F.slice("__h", 1, F.col("__k"))).alias("h"))


def bars(sketch: DataFrame) -> DataFrame:
    """upper, bar: the largest hash value that each size partition keeps (one row a power of two)."""
    return sketch.groupBy("upper").agg(F.max("h").alias("bar"))


def _contained(docs: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame:
    """docs (__unit, __x) -> __unit, item_id, n_shared, n_item; a unit's shingles are those of all its rows."""
    items = materialise(_words(pick(benchmark, "item_id", "text"), "text").select("item_id", "__w", "__m"), "items")
    sketch = materialise(sketches(items, threshold), "sketches")
    bar = bars(sketch).agg(F.max("bar")).first()[0]
    own = F.filter(F.expr(_HASHES), lambda h: h <= F.lit(0 if bar is None else bar))
    sketched = _words(docs, "__x").select("__unit", F.explode(own).alias("h"))
    found = sketched.join(_small(sketch.select("h", "item_id"), sketch.count()), "h").groupBy("__unit", "item_id").agg(F.lit(1).alias("hit"))
    candidates = materialise(found.select("__unit", "item_id"), "candidates")
    # exact containment: the candidates' own shingle strings against those of the items
    units = candidates.select("__unit").distinct()
    near = _words(docs.join(_small(units, units.count()), "__unit", "left_semi"), "__x")
    exact = near.select("__unit", F.explode(F.array_distinct(F.expr(_STRINGS))).alias("s"))
    parts = materialise(items.select("item_id", F.explode(F.array_distinct(F.expr(_STRINGS))).alias("s")).distinct(), "item-shingles")
    n_parts, n_bytes = parts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("s")), F.lit(0))).first()
    sizes = parts.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item"))
    # repeated rows of a unit give each shared shingle once
    met = exact.join(F.broadcast(parts) if n_parts <= BROADCAST_ROWS and n_bytes <= BROADCAST_BYTES else parts, "s")
    shared = met.select("__unit", "item_id", "s").distinct().groupBy("__unit", "item_id").agg(F.count(F.lit(1)).alias("n_shared"))
    full = shared.join(candidates, ["__unit", "item_id"], "left_semi").join(_small(sizes, items.count()), "item_id")
    return full.where(F.col("n_shared") >= F.ceil(F.col("n_item") * F.lit(threshold) - F.lit(1e-9)))


def containment(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, item_id, n_shared, n_item, containment for every pair at or over the threshold."""
    # a null id has a value of its own while units are joined
    docs = pick(docs, id_col, text_col).select(F.array(F.col(id_col)).alias("__unit"), F.col(text_col).alias("__x"))
    kept = _contained(docs, benchmark, threshold)
    return kept.select(F.get("__unit", F.lit(0)).alias(id_col), "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows without a test item, with their own columns."""
    slots = [f"__d{i}" for i in range(len(docs.columns))]
    named = docs.toDF(*slots)
    i, t = slots[docs.columns.index(id_col)], slots[docs.columns.index(text_col)]
    keyed = named.withColumn("__unit", F.expr(f"xxhash64({i}, {t})"))
    hits = materialise(_contained(keyed.select("__unit", F.col(t).alias("__x")), benchmark, THRESHOLD).select(F.col("__unit").alias("__hit")).distinct(), "contaminated")
    return keyed.join(_small(hits, hits.count()), keyed["__unit"] == hits["__hit"], "left_anti").select(*slots).toDF(*docs.columns)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of every contaminated document."""
    found = containment(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_item", "containment")


ORACLE = r"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), ' ') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), ' ') FROM benchmark),
s AS (SELECT DISTINCT side, id, array_to_string(w[i:i+4], ' ') AS s
  FROM (SELECT side, id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE w <> ['']) t),
n AS (SELECT id AS item_id, count(*)::BIGINT AS n_item FROM s WHERE side = 'b' GROUP BY id)
SELECT d.id AS doc_id, item_id, count(*)::BIGINT AS n_shared, n_item, count(*)::DOUBLE / n_item AS containment
FROM s d JOIN s b ON d.side = 'd' AND b.side = 'b' AND d.s = b.s JOIN n ON n.item_id = b.id
GROUP BY d.id, item_id, n_item HAVING count(*) >= ceil(n_item * 0.8 - 1e-9)
"""
