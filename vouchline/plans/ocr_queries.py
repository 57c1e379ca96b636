"""OCR line queries over document lines and synthetic Arabic lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from vouchline.functions import scoring, text
from vouchline.operators import ocr, rank
from vouchline.plans.adapters import cte, view

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


_LINES = cte("v_lines")
# a position on the page for each line: two columns, rows 9 px apart
_CX, _CY = "CAST(pos % 2 * 100 + length(line) AS DOUBLE)", "CAST((pos - pos % 3) * 9 AS DOUBLE)"


@query("reading_order", _LINES + f" SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY round_even({_CY} / 18.0, 0), {_CX} DESC, pos)::INT AS reading FROM v_lines")
def reading_order(spark, sf):
    return ocr.reading_rank(view(spark, sf, "v_lines"), ["doc_id"], F.expr(_CX), F.expr(_CY), F.col("pos")).select("doc_id", "pos", "reading")


@query(
    "merge_lines",
    _LINES + f" SELECT doc_id, md5(trim(regexp_replace(string_agg(line, ' ' ORDER BY round_even({_CY} / 18.0, 0), {_CX} DESC, pos), '[\\s\\p{{Z}}\\x1c-\\x1f\\x0b\\x85]+', ' ', 'g'))) AS merged_md5 FROM v_lines GROUP BY doc_id",
)
def merge_lines(spark, sf):
    merged = ocr.merge_lines(view(spark, sf, "v_lines"), ["doc_id"], [F.rint(F.expr(_CY) / 18.0), -F.expr(_CX), F.col("pos")], F.col("line"))
    return merged.select("doc_id", F.md5("merged").alias("merged_md5"))


_AR_LINE = "translate(line, 'aeiouth', 'اثيو٣طه')"
_CONF = "CASE WHEN pos % 3 < 2 THEN CAST(length(line) % 11 AS DOUBLE) / 16 END"
_VARIANT = "pos % 4"


@query(
    "text_score",
    _LINES + f""", c AS (SELECT doc_id, CAST({_VARIANT} AS INT) AS variant, {_AR_LINE} AS l, {_CONF} AS c FROM v_lines)
SELECT doc_id, variant, round(sum(length(l) - length(regexp_replace(l, '[\\x{{0600}}-\\x{{06FF}}]', '', 'g'))) + 10 * avg(c), 6) AS score FROM c GROUP BY doc_id, variant HAVING avg(c) IS NOT NULL""",
)
def text_score(spark, sf):
    return _scores(spark, sf).where("NOT isnan(score)").select("doc_id", "variant", F.round("score", 6).alias("score"))


def _scores(spark, sf):
    lines = view(spark, sf, "v_lines").withColumn("variant", F.expr(f"CAST({_VARIANT} AS INT)"))
    return ocr.text_scores(lines, ["doc_id", "variant"], F.expr(_AR_LINE), F.expr(_CONF))


@query(
    "best_variant",
    _LINES + f""", c AS (SELECT doc_id, CAST({_VARIANT} AS INT) AS variant, {_AR_LINE} AS l, {_CONF} AS c FROM v_lines),
s AS (SELECT doc_id, variant, coalesce(sum(length(l) - length(regexp_replace(l, '[\\x{{0600}}-\\x{{06FF}}]', '', 'g'))) + 10 * avg(c), -1e18) AS score FROM c GROUP BY doc_id, variant)
SELECT doc_id, CASE WHEN max(score) <= -1e18 THEN -1 ELSE arg_max(variant, struct_pack(s := score, n := -variant)) END AS variant FROM s GROUP BY doc_id""",
)
def best_variant(spark, sf):
    best = rank.best(_scores(spark, sf), ["doc_id"], F.col("score"), F.col("variant"), F.struct("variant", scoring.nan_safe(F.col("score")).alias("s")))
    return best.select("doc_id", F.when(F.col("best.s") <= -1e18, -1).otherwise(F.col("best.variant")).alias("variant"))


_E = cte("v_id14") + """, l AS (SELECT case_id, id14, day, unnest([0, 1, 2, 3]) AS pos FROM v_id14),
e AS (SELECT case_id, pos, CASE pos WHEN 0 THEN CASE WHEN case_id % 3 = 0 THEN 'البطاقة سارية' ELSE 'البطاقة' END WHEN 1 THEN CASE WHEN case_id % 2 = 0 THEN 'حتى' ELSE 'xx' END
   WHEN 2 THEN day ELSE 'حتى' END AS line, (pos * CASE WHEN case_id % 6 = 0 THEN 1 ELSE 20 + case_id % 4 * 3 END)::DOUBLE AS cy, (case_id % 6 * 9)::DOUBLE AS h FROM l)"""
_LABEL_SCORE = "((contains({0}, 'البطاقه'))::INT + (contains({0}, 'ساريه'))::INT + (contains({0}, 'حتي'))::INT)"
_UNIFY = "translate({0}, 'أإآةىؤئ', 'اااهيوي')"


def _expiry_lines(spark, sf):
    v = view(spark, sf, "v_id14").select("case_id", "day", F.explode(F.array(*map(F.lit, range(4)))).alias("pos"))
    line = F.expr("""CASE pos WHEN 0 THEN CASE WHEN case_id % 3 = 0 THEN 'البطاقة سارية' ELSE 'البطاقة' END WHEN 1 THEN CASE WHEN case_id % 2 = 0 THEN 'حتى' ELSE 'xx' END WHEN 2 THEN day ELSE 'حتى' END""")
    return v.select("case_id", "pos", line.alias("line"), F.expr("CAST(pos * CASE WHEN case_id % 6 = 0 THEN 1 ELSE 20 + case_id % 4 * 3 END AS DOUBLE)").alias("cy"), F.expr("CAST(case_id % 6 * 9 AS DOUBLE)").alias("h"))


_ANCHOR = _E + f""", n AS (SELECT *, lead(cy, 1) OVER w AS c1, lead(cy, 2) OVER w AS c2, lead(line, 1) OVER w AS l1, lead(line, 2) OVER w AS l2, {_LABEL_SCORE.format(_UNIFY.format('line'))} AS label FROM e WINDOW w AS (PARTITION BY case_id ORDER BY pos)),
a AS (SELECT case_id, pos, concat_ws(' ', line, CASE WHEN abs(c1 - cy) <= greatest(h, 1) * 1.3::DOUBLE THEN l1 END, CASE WHEN abs(c1 - cy) <= greatest(h, 1) * 1.3::DOUBLE AND abs(c2 - cy) <= greatest(h, 1) * 1.3::DOUBLE THEN l2 END) AS merged FROM n WHERE label > 0),
b AS (SELECT case_id, pos, merged, {_LABEL_SCORE.format(_UNIFY.format('merged'))} AS label_score, replace(regexp_extract(merged, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}', 0), '-', '') AS date FROM a)"""


@query("expiry_lines", _ANCHOR + " SELECT case_id, pos, merged, label_score, date, label_score >= 2 AND date <> '' AS matched FROM b")
def expiry_lines(spark, sf):
    return ocr.expiry_anchors(_expiry_lines(spark, sf), ["case_id"], "pos", "line", F.col("cy"), F.col("h"))


@query(
    "best_expiry",
    _ANCHOR + """, m AS (SELECT *, label_score >= 2 AND date <> '' AS matched FROM b), x AS (SELECT case_id, arg_max(struct_pack(m := matched, l := label_score, d := date), struct_pack(m := matched, l := label_score, n := length(date), p := -pos)) AS s FROM m GROUP BY case_id)
SELECT case_id, s.m AS matched, s.d AS date, 100.0 * s.m::INT + 10 * s.l + length(s.d) + 5 * 0.5 AS score FROM x""",
)
def best_expiry(spark, sf):
    best = ocr.best_expiry(ocr.expiry_anchors(_expiry_lines(spark, sf), ["case_id"], "pos", "line", F.col("cy"), F.col("h")), ["case_id"], "pos")
    b = F.col("best")
    return best.select("case_id", b["matched"].alias("matched"), b["date"].alias("date"), scoring.expiry_score(b["matched"], b["label_score"], b["date"], F.lit(0.5)).cast("double").alias("score"))


@query(
    "expiry_variant",
    _ANCHOR.replace("SELECT case_id, pos, merged, label_score", "SELECT case_id, pos, merged, label_score", 1) + """, v AS (SELECT case_id, pos AS variant, 100.0::DOUBLE * (label_score >= 2 AND date <> '')::INT + 10 * label_score + length(date) + 5 * (pos / 4.0) AS s FROM b)
SELECT case_id, arg_max(variant, struct_pack(s := s, n := -variant)) AS variant FROM v GROUP BY case_id""",
)
def expiry_variant(spark, sf):
    a = ocr.expiry_anchors(_expiry_lines(spark, sf), ["case_id"], "pos", "line", F.col("cy"), F.col("h"))
    s = scoring.expiry_score(F.col("matched"), F.col("label_score"), F.col("date"), F.col("pos") / 4.0)
    return rank.best(a, ["case_id"], s, F.col("pos"), F.col("pos"), "variant").select("case_id", "variant")


@query(
    "ocr_zip",
    _LINES + """, r AS (SELECT doc_id, list(line ORDER BY pos) AS t FROM v_lines GROUP BY doc_id), z AS (SELECT doc_id, t, unnest(range(0, len(t))) AS i FROM r)
SELECT doc_id, i::INT AS pos, md5(trim(t[i + 1])) AS text_md5, CASE WHEN i < len(t) - 1 THEN i / 4.0::DOUBLE END AS score, CASE WHEN doc_id % 2 = 0 AND i < 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS x0 FROM z WHERE trim(t[i + 1]) <> ''""",
)
def ocr_zip(spark, sf):
    """Ragged parallel arrays: one score less than texts, polygons for the first two lines of every other document."""
    packed = view(spark, sf, "v_lines").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]).alias("rec_texts"))
    box = F.array_repeat(F.array(F.lit(1.0), F.lit(2.0)), 4)
    raw = packed.select(
        "doc_id", "rec_texts", F.transform(F.slice("rec_texts", 1, F.greatest(F.size("rec_texts") - 1, F.lit(0))), lambda _, i: i / 4.0).alias("rec_scores"),
        F.array().cast("array<array<array<double>>>").alias("rec_polys"), F.when(F.col("doc_id") % 2 == 0, F.array_repeat(box, 2)).otherwise(F.array().cast("array<array<array<double>>>")).alias("dt_polys"),
    )
    z = ocr.zip_lines(raw, "doc_id")
    return z.select("doc_id", "pos", F.md5("text").alias("text_md5"), "score", F.get(F.get("box", F.lit(0)), F.lit(0)).alias("x0"))


@query("line_metrics", _LINES + f" SELECT doc_id, pos, length(line) % 30 + 2.5 AS height, {_CY} + (length(line) % 30 + 2.5) / 2 AS cy FROM v_lines")
def line_metrics(spark, sf):
    h = F.length("line") % 30 + 2.5
    y = F.expr(_CY)
    corner = lambda dy: F.array(F.lit(0.0), (y + dy).cast("double"))
    box = F.array(corner(F.lit(0.0)), corner(F.lit(0.0)), corner(h), corner(h))
    return view(spark, sf, "v_lines").select("doc_id", "pos", ocr.line_height(box).alias("height"), ocr.center(box, 1).alias("cy"))


@query("best_numeric", cte("v_id14") + """ SELECT case_id, CASE WHEN case_id % 2 = 0 THEN id14 ELSE substr(id14, 1, 8) END AS number, (case_id % 2)::INT AS variant FROM v_id14""")
def best_numeric(spark, sf):
    """The variant of the best text score, then its number; a variant without scores never wins."""
    v = view(spark, sf, "v_id14").select("case_id", "id14", F.explode(F.array(*map(F.lit, range(3)))).alias("variant"))
    line = F.expr("CASE variant WHEN 0 THEN id14 WHEN 1 THEN substr(id14, 1, 8) ELSE concat(id14, 'اااااااااااا') END")
    lines = v.withColumn("line", F.translate(line, "0123456789", text.ARABIC_INDIC)).withColumn("c", F.expr("CASE variant WHEN 0 THEN 0.5D WHEN 1 THEN IF(case_id % 2 = 1, 1.5D, 0.1D) END"))
    scores = ocr.text_scores(lines, ["case_id", "variant"], F.col("line"), F.col("c"))
    top = rank.best(scores, ["case_id"], F.col("score"), F.col("variant"), F.col("variant"), "variant")
    chosen = lines.join(top, ["case_id", "variant"])
    return chosen.groupBy("case_id", "variant").agg(F.collect_list("line").alias("t")).select("case_id", text.numeric_field(F.col("t"), 14).alias("number"), "variant")


@query(
    "single_image_ocr",
    _LINES + f""", c AS (SELECT doc_id, pos, line, CAST({_VARIANT} AS INT) AS variant, {_AR_LINE} AS l, {_CONF} AS c FROM v_lines),
s AS (SELECT doc_id, variant, coalesce(sum(length(l) - length(regexp_replace(l, '[\\x{{0600}}-\\x{{06FF}}]', '', 'g'))) + 10 * avg(c), -1e18) AS score FROM c GROUP BY doc_id, variant),
b AS (SELECT doc_id, arg_max(variant, struct_pack(s := score, n := -variant)) AS variant, max(score) AS best FROM s GROUP BY doc_id)
SELECT b.doc_id, CASE WHEN b.doc_id % 7 = 0 THEN 'unsupported extension' WHEN b.doc_id % 11 = 0 THEN 'missing file' END AS error,
  CASE WHEN b.doc_id % 7 <> 0 AND b.doc_id % 11 <> 0 AND best > -1e18 THEN md5(trim(regexp_replace(string_agg(line, ' ' ORDER BY pos), '[\\s\\p{{Z}}\\x1c-\\x1f\\x0b\\x85]+', ' ', 'g'))) END AS text_md5
FROM b JOIN c ON c.doc_id = b.doc_id AND c.variant = b.variant GROUP BY b.doc_id, best""",
)
def single_image_ocr(spark, sf):
    """The best variant's lines as one text; a missing or unsupported file gives its error instead."""
    top = rank.best(_scores(spark, sf), ["doc_id"], F.col("score"), F.col("variant"), F.struct("variant", scoring.nan_safe(F.col("score")).alias("s")))
    lines = view(spark, sf, "v_lines").withColumn("variant", F.expr(f"CAST({_VARIANT} AS INT)"))
    chosen = lines.join(top.select("doc_id", "best.variant", F.col("best.s").alias("s")), ["doc_id", "variant"])
    merged = ocr.merge_lines(chosen, ["doc_id", "s"], [F.col("pos")], F.col("line"))
    error = F.when(F.col("doc_id") % 7 == 0, "unsupported extension").when(F.col("doc_id") % 11 == 0, "missing file")
    return merged.select("doc_id", error.alias("error"), F.when(error.isNull() & (F.col("s") > -1e18), F.md5("merged")).alias("text_md5"))
