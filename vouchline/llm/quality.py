"""Quality rules as a bitmask ledger (DataFrame and SQL functions only).

Every rule is evaluated once per document; the ledger keeps the failure bits and the measurements. A
policy is a named, versioned mask over those bits, so changing the policy, or asking what one rule alone
rejects, never reads a text again.

Defined results: a null or blank text has no words and fails ``too_few_words``; repeated rows are judged
each on its own; null ids pass through; an empty table gives an empty ledger; extra columns are ignored by
``ledger`` and kept by ``apply``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchline.llm.common import WS_CLASS, pick, table

#: (name, condition over the measurements that means failure); a rule's bit is its place here and is never reused.
RULES = (
    ("too_few_words", lambda m: m["n_words"] < 10),
    ("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    ("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    ("duplicate_lines", lambda m: (10 * m["n_dup_lines"] > 4 * m["n_lines"]) & (m["n_lines"] >= 5)),
    ("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])),
    ("stutter", lambda m: 100 * m["n_stutter"] > 30 * m["n_words"]),
    ("very_long_words", lambda m: m["word_chars"] > 40 * m["n_words"]),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: name and version of a policy -> the rules that reject.
POLICIES = {
    "base@1": ("too_few_words", "repeated_windows"),
    "web@1": ("too_few_words", "repeated_windows", "symbols"),
    "web@2": ("too_few_words", "repeated_windows", "symbols", "duplicate_lines", "word_length", "stutter"),
}
BASE, CURRENT = "base@1", "web@2"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutter")


def mask(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    A chain of aliased columns under a filter makes the optimizer's constraint propagation grow with every
    alias to the power of two; one expression with bound variables doesn't.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(w: Column) -> Column:
    """Words in five-word windows that stand twice or more; windows are compared by their 64-bit hash."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(w), F.lit(5)) - 5)
    hashes = F.when(F.size(w) >= 5, F.transform(starts, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(5))))).otherwise(F.array().cast("array<bigint>"))

    def sorted_pairs(h: Column) -> Column:
        # only texts with a repeated window are sorted: (hash, place), so that equal windows are neighbours
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))

    def places(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-5).alias("last"))
        return F.aggregate(p, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(5), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    return _let(hashes, lambda h: _let(sorted_pairs(h), lambda s: covered(places(s))))


def measures(text: Column) -> Column:
    """struct of all measurements of a text and its ``fail_bits``."""

    def of(t: Column, w: Column, lines: Column) -> Column:
        values = {
            "n_words": F.size(w).cast("bigint"),
            "word_chars": F.length(F.array_join(w, "")).cast("bigint"),
            "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("bigint"),
            "n_lines": F.size(lines).cast("bigint"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
            "n_repeat_words": _repeated(w),
            "n_stutter": F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))).cast("bigint"),
        }
        return F.struct(*(values[m].alias(m) for m in MEASURES))

    def words(t: Column) -> Column:
        return _let(F.btrim(t, F.lit(" \t\n\x0b\x0c\r")), lambda b: F.when(b == "", F.array().cast("array<string>")).otherwise(F.split(b, f"[{WS_CLASS}]+")))

    def lines(t: Column) -> Column:
        return F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{WS_CLASS}]"))

    known = _let(F.coalesce(text, F.lit("")), lambda t: _let(words(t), lambda w: _let(lines(t), lambda n: of(t, w, n))))
    return _let(known, lambda m: F.struct(*(m[k].alias(k) for k in MEASURES), fail_bits(m).alias("fail_bits")))


def fail_bits(m: Column) -> Column:
    total = F.lit(0).cast("bigint")
    for i, (_, fails) in enumerate(RULES):
        total = total.bitwiseOR(F.when(fails(m), F.lit(1 << i)).otherwise(0).cast("bigint"))
    return total


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, measurements, ``fail_bits``. Reads each text once, without a shuffle."""
    return pick(docs, id_col, text_col).select(id_col, measures(F.col(text_col)).alias("m")).select(id_col, "m.*")


def passes(policy: str, column: Column | None = None) -> Column:
    return (F.col("fail_bits") if column is None else column).bitwiseAND(F.lit(mask(policy)).cast("bigint")) == 0


def ablation(entries: DataFrame, *policies: str) -> DataFrame:
    """Per policy and rule: how many documents fail it, and how many the rule alone rejects.

    Documents are first counted by their bits, so at most 2**len(RULES) rows are left whatever the corpus.
    """
    spark = entries.sparkSession
    counted = entries.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    rules = spark.createDataFrame([(p, r, BIT[r], mask(p)) for p in policies or POLICIES for r in POLICIES[p]], "policy string, rule string, bit bigint, mask bigint")
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return (
        counted.join(F.broadcast(rules), F.col("fail_bits").bitwiseAND(F.col("bit")) != 0)
        .groupBy("policy", "rule")
        .agg(F.sum("n").alias("n_failed"), F.coalesce(F.sum(F.when(hit == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only_by_this"))
    )


def apply(docs: DataFrame, policy: str = CURRENT, text_col: str = "text") -> DataFrame:
    """The rows that pass, with their own columns."""
    slots = [f"__d{i}" for i in range(len(docs.columns))]
    named = docs.toDF(*slots)
    text = slots[docs.columns.index(text_col)]
    return named.where(passes(policy, measures(F.col(text))["fail_bits"])).toDF(*docs.columns)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, fail_bits."""
    found = ledger(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~passes(BASE)).alias("base_failed"),
        (passes(BASE) & passes(CURRENT)).alias("kept"),
        "fail_bits",
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
wins AS (SELECT rid, i, w[i:i+4] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
dups AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM wins) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM dups, (SELECT unnest(range(0, 5)) AS k) GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_stutter
      FROM w LEFT JOIN cov USING (rid)),
f AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
        + CASE WHEN 10 * n_dup_lines > 4 * n_lines AND n_lines >= 5 THEN 8 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END
        + CASE WHEN 100 * n_stutter > 30 * n_words THEN 32 ELSE 0 END
        + CASE WHEN word_chars > 40 * n_words THEN 64 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
  (fail_bits & 63) = 0 AS kept, fail_bits FROM f
"""
