"""OCR lines: ragged parsing, reading order, variant choice, expiry lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vouchline.functions import scoring, text

BAND = 18.0


def zip_lines(df: DataFrame, *keys: str) -> DataFrame:
    """rec_texts, rec_scores and polygons side by side; empty recognised polygons count as missing, a missing one is four zero points.

    Texts are stripped and empty ones left out with their scores and boxes.
    """
    polys = F.when(F.size(F.coalesce("rec_polys", F.array())) > 0, F.col("rec_polys")).otherwise(F.col("dt_polys"))
    zero = F.array_repeat(F.array(F.lit(0.0), F.lit(0.0)), 4)
    rows = df.select(*keys, F.posexplode(F.arrays_zip(F.col("rec_texts").alias("t"), F.col("rec_scores").alias("s"), polys.alias("p"))).alias("pos", "z"))
    kept = rows.select(*keys, "pos", F.trim("z.t").alias("text"), F.col("z.s").alias("score"), F.coalesce("z.p", zero).alias("box"))
    return kept.where("text IS NOT NULL AND text <> ''")


def center(box: Column, axis: int) -> Column:
    values = F.transform(box, lambda p: F.get(p, F.lit(axis)))
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def line_height(box: Column) -> Column:
    ys = F.transform(box, lambda p: F.get(p, F.lit(1)))
    return F.array_max(ys) - F.array_min(ys)


def reading_rank(df: DataFrame, keys: list[str], cx: Column, cy: Column, pos: Column) -> DataFrame:
    """Bands of eighteen pixels from the top (half-even), right to left within a band, stable."""
    return df.withColumn("reading", F.row_number().over(Window.partitionBy(*keys).orderBy(F.rint(cy / BAND), cx.desc(), pos)))


def merge_lines(df: DataFrame, keys: list[str], order: list[Column], line: Column, alias: str = "merged") -> DataFrame:
    """Lines in order, joined by blanks and normalised; a key's lines are one document's."""
    packed = F.array_sort(F.collect_list(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), line.alias("line"))))
    return df.groupBy(*keys).agg(text.normalize_arabic(F.array_join(F.transform(packed, lambda s: s["line"]), " ")).alias(alias))


def text_scores(df: DataFrame, keys: list[str], line: Column, confidence: Column) -> DataFrame:
    """Arabic characters plus ten times the mean confidence; NaN if no line has one."""
    out = df.groupBy(*keys).agg(F.sum(text.arabic_chars(line)).alias("arabic"), F.coalesce(F.avg(confidence), F.lit(float("nan"))).alias("mean_confidence"))
    return out.withColumn("score", scoring.text_score(F.col("arabic"), F.col("mean_confidence")))


def expiry_anchors(df: DataFrame, keys: list[str], pos: str, line: str, cy: Column, h: Column) -> DataFrame:
    """Lines with a label word, merged with up to two following lines, each within 1.3 heights of the label's own line
    (at least 1.3 pixels); a gap ends the run.
    """
    w = Window.partitionBy(*keys).orderBy(pos)
    near = lambda c: F.coalesce(F.abs(F.col(c) - F.col("__cy")) <= 1.3 * F.greatest(F.col("__h"), F.lit(1.0)), F.lit(False))
    marked = df.withColumns({"__cy": cy, "__h": h, "label": text.expiry_label_score(F.col(line))})
    marked = marked.withColumns({"__c1": F.lead("__cy", 1).over(w), "__c2": F.lead("__cy", 2).over(w), "__l1": F.lead(line, 1).over(w), "__l2": F.lead(line, 2).over(w)})
    one = near("__c1")
    two = one & near("__c2")
    merged = text.normalize_arabic(F.concat_ws(" ", F.col(line), F.when(one, F.col("__l1")), F.when(two, F.col("__l2"))))
    found = marked.where("label > 0").withColumn("merged", merged).withColumn("label_score", text.expiry_label_score(F.col("merged"))).withColumn("date", text.extract_yyyymmdd(F.col("merged")))
    return found.withColumn("matched", (F.col("label_score") >= 2) & (F.col("date") != "")).select(*keys, pos, "merged", "label_score", "date", "matched")


def best_expiry(anchors: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The lexicographic best of matched, label score and length, first on ties."""
    order = F.struct(F.col("matched").alias("m"), F.col("label_score").alias("l"), F.length("date").alias("n"), (-F.col(pos)).alias("p"))
    return anchors.groupBy(*keys).agg(F.max_by(F.struct("matched", "label_score", "date", "merged"), order).alias("best"))
