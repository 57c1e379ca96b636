"""Gated verification: stage columns to verdicts, with not-run states kept as null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Web stages and the gate at which each stops, gates in order, batch stages that a toggle controls.
STAGE_GATE = (("alignment_failed", 1), ("invalid_card", 2), ("face_match_failed", 3), ("liveness_failed", 4), ("completed", None), ("error", None))
GATES = ((1, "alignment"), (2, "ocr"), (3, "face_match"), (4, "liveness"))
TOGGLES = ("feature_front", "feature_back", "alignment", "ocr", "liveness", "face_match")


def pipeline_gate(df: DataFrame) -> DataFrame:
    """Batch verdict: card_valid, face_match, liveness, overall, stopped_at.

    Failed features stop everything; a failed alignment or a missing photo stops later stages but leaves the
    card valid; a failed reading makes the card invalid; neither ids nor liveness count in the overall verdict.
    """
    features = ~F.col("feature_error") & F.col("feature_front") & F.col("feature_back")
    aligned = features & ~F.col("align_error")
    runs = aligned & F.col("photo_present")
    face = F.when(runs & ~F.col("face_error"), F.col("face_passed"))
    live = F.when(runs & ~F.col("liveness_error"), F.col("liveness_passed"))
    card = features & ~(runs & F.col("ocr_error"))
    stop = F.when(~features, "features").when(~aligned, "alignment").when(~runs, "photo")
    return df.withColumns({"card_valid": card, "face_match": face, "liveness": live, "stopped_at": stop, "overall": card & F.coalesce(face, F.lit(False))})


def web_gate(df: DataFrame) -> DataFrame:
    """stage, gate, overall_passed of a request; the first failing gate stops, liveness never blocks."""
    missing = ~(F.col("has_front") & F.col("has_back") & F.col("has_selfie"))
    stage = (
        F.when(missing, "error").when(F.col("align_error"), "alignment_failed").when(F.col("ocr_error") | (F.col("id_digits") != 14), "invalid_card")
        .when(F.col("face_error") | ~F.col("face_passed"), "face_match_failed").otherwise("completed")
    )
    gate = F.when(missing, 0)
    for name, number in STAGE_GATE:
        gate = gate.when(F.col("stage") == name, F.lit(number).cast("int"))
    return df.withColumn("stage", stage).withColumn("gate", gate).withColumn("overall_passed", F.col("stage") == "completed")


def gate_timeline(df: DataFrame) -> DataFrame:
    """One row per gate: skipped after the failing one, failed at it, ok before; all ok without a failing gate."""
    spark = df.sparkSession
    fails = F.lit(None).cast("int")
    for name, number in STAGE_GATE:
        fails = F.when(F.col("stage") == name, F.lit(number).cast("int")).otherwise(fails)
    gates = F.broadcast(spark.createDataFrame(list(GATES), "gate_no int, gate_name string"))
    status = F.when(F.col("gate_no") > fails, "skipped").when(F.col("gate_no") == fails, "failed").otherwise("ok")
    return df.crossJoin(gates).withColumn("status", status)


def stage_toggles(df: DataFrame, toggles: dict[str, bool]) -> DataFrame:
    """What every stage of a run gives under the toggles: passed, failed, error, skipped or null (not run)."""
    on = {t: F.lit(toggles.get(t, True)) for t in TOGGLES}
    verdict = lambda ok, err: F.when(err, "error").when(ok, "passed").otherwise("failed")
    art_front = on["alignment"] & F.col("has_front") & ~F.col("align_error")
    art_back = on["alignment"] & F.col("has_back") & ~F.col("align_error")
    return df.withColumns(
        {
            "front_features": F.when(on["feature_front"] & F.col("has_front"), verdict(F.col("feature_front"), F.col("feature_error"))),
            "back_features": F.when(on["feature_back"] & F.col("has_back"), verdict(F.col("feature_back"), F.col("feature_error"))),
            "alignment": F.when(on["alignment"] & F.col("has_front"), F.when(F.col("align_error"), "error").otherwise("passed")),
            "ocr": F.when(on["ocr"], F.when(~(art_front | art_back), "skipped").when(F.col("ocr_error"), "error").otherwise("passed")),
            "face": F.when(on["face_match"] & F.col("has_selfie") & art_front, F.when(~F.col("photo_present"), "skipped").otherwise(verdict(F.col("face_passed"), F.col("face_error")))),
            "live": F.when(on["liveness"] & F.col("has_selfie"), verdict(F.col("liveness_passed"), F.col("liveness_error"))),
        }
    )


def face_summary(is_real: Column, score: Column) -> Column:
    """Missing realness is false; a missing or non-numeric score stays null."""
    return F.struct(F.coalesce(is_real, F.lit(False)).alias("is_real"), score.try_cast("double").alias("score"))


def liveness(faces: DataFrame, key: str, area: str = "area", pos: str = "pos") -> DataFrame:
    """status, passed and the checks of an image's faces; the largest face counts, the first on ties."""
    top = F.max_by(F.struct("is_real", "score"), F.struct(F.col(area).alias("a"), (-F.col(pos)).alias("p")))
    out = faces.groupBy(key).agg(F.count(F.lit(1)).alias("face_count"), top.alias("f"))
    score = F.col("f.score")
    checks = {"single_face": F.col("face_count") == 1, "selected_face_is_real": F.coalesce("f.is_real", F.lit(False)), "score_present": score.isNotNull(), "score_ok": score.isNull() | (score >= 0.5)}
    out = out.withColumns(checks).withColumn("passed", F.col("single_face") & F.col("selected_face_is_real") & F.col("score_ok"))
    return out.withColumn("status", F.when(F.col("passed"), "ok").otherwise("failed")).drop("f")
