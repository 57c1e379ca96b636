"""Front and back record reconciliation and the assembled field record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchline.functions import text

ID_LENGTH = 14
#: fields that a record has before anything was read
FIELDS = ("name", "address", "id_number", "front_id_number", "back_id_number", "birth_date", "expiry_date", "issue_date", "profession", "gender", "religion", "marital_status", "front_full_text", "back_full_text")


def ids_match(a: Column, b: Column) -> Column:
    """Both fourteen digits and equal."""
    x, y = text.only_digits(a), text.only_digits(b)
    return F.coalesce((F.length(x) == ID_LENGTH) & (F.length(y) == ID_LENGTH) & (x == y), F.lit(False))


def back_id_choice(full: Column, edge: Column) -> Column:
    """The edge reading if it has fourteen digits, else a full reading of fourteen, else the strictly longer edge."""
    return F.when(F.length(edge) == ID_LENGTH, edge).when(F.length(full) == ID_LENGTH, full).when(F.length(edge) > F.length(full), edge).otherwise(full)


def reconcile(front: Column, back: Column) -> Column:
    """The id of the side that alone has fourteen digits; front if both; else back only if strictly longer."""
    nf, nb = F.length(front), F.length(back)
    return F.when((nb == ID_LENGTH) & (nf != ID_LENGTH), back).when(nf == ID_LENGTH, front).when(nb > nf, back).otherwise(front)


def birth_fallback(birth: Column, id_number: Column) -> Column:
    """A missing or invalid birth date gives way to that of the id, if the id has one."""
    known = F.coalesce(birth, F.lit(""))
    return F.when(text.valid_yyyymmdd(known), known).otherwise(F.coalesce(F.nullif(text.birth_from_id(F.coalesce(id_number, F.lit(""))), F.lit("")), known))


def full_text(*parts: Column) -> Column:
    return text.normalize_arabic(F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), " "))


def default_record(df, *fields: str):
    """Missing text fields become empty, a missing match flag false."""
    return df.withColumns({f: F.coalesce(F.col(f), F.lit("")) for f in fields or FIELDS if f in df.columns} | ({"id_numbers_match": F.coalesce("id_numbers_match", F.lit(False))} if "id_numbers_match" in df.columns else {}))


def complete(record: Column) -> Column:
    """Whether all values of an array are there and not empty."""
    return F.forall(record, lambda x: F.coalesce(x != "", F.lit(False)))


def sides_union(front: DataFrame, back: DataFrame) -> DataFrame:
    """Rows of both sides under ``side``."""
    return front.withColumn("side", F.lit("front")).unionByName(back.withColumn("side", F.lit("back")), allowMissingColumns=True)


def join_sides(front: DataFrame, back: DataFrame, key: str) -> DataFrame:
    """front (key, front_id_number), back (key, back_id_number): one row a case with the reconciled id and the match flag.

    A case may have one side only; the other counts as an empty reading.
    """
    both = front.join(back, key, "full_outer").withColumns({c: F.coalesce(c, F.lit("")) for c in ("front_id_number", "back_id_number")})
    f, b = F.col("front_id_number"), F.col("back_id_number")
    return both.withColumn("id_number", reconcile(f, b)).withColumn("id_numbers_match", ids_match(f, b))


def expiry_override(expiry: Column, back_full_text: Column) -> Column:
    """A date in the back's full text wins over the one read from its own crop; in Arabic digits."""
    found = text.extract_yyyymmdd(text.normalize_arabic(F.coalesce(back_full_text, F.lit(""))))
    return F.when(found != "", text.arabic_digits(found)).otherwise(F.coalesce(expiry, F.lit("")))


def missing_input(*parts: Column) -> Column:
    """struct(stage, gate): an error at gate 0 if any part is missing, else nulls."""
    missing = F.lit(False)
    for p in parts:
        missing = missing | p.isNull()
    return F.struct(F.when(missing, "error").alias("stage"), F.when(missing, 0).alias("gate"))


def card_fields(reads: DataFrame, year: int, *keys: str) -> DataFrame:
    """The whole record of a card from what was read of each crop.

    reads: the best lines (array<string>) of ``name, address, issue_date, profession, gender, religion, marital_status,
    back_text``, the digits of ``id_number, birth_date, back_id_full, back_id_edge``, and ``expiry_date``. Missing
    crops are null. The id's century is mended before the sides are reconciled, the birth date falls back to the
    reconciled id, and a date in the back's text wins over the expiry crop.
    """
    lines = lambda c: F.coalesce(text.joined_lines(F.col(c)), F.lit(""))
    known = lambda c: F.coalesce(F.col(c), F.lit(""))
    r = reads.withColumns({c: lines(c) for c in ("name", "address", "profession", "gender", "religion", "marital_status", "issue_date", "back_text")})
    r = r.withColumns({"gender": text.repair_gender(F.col("gender")), "issue_date": text.issue_date(F.col("issue_date")), "front_id_number": text.only_digits(text.century_fix(known("id_number"), year))})
    r = r.withColumn("back_id_number", text.only_digits(back_id_choice(text.only_digits(known("back_id_full")), text.only_digits(known("back_id_edge")))))
    r = r.withColumn("id_number", reconcile(F.col("front_id_number"), F.col("back_id_number")))
    r = r.withColumns({"birth_date": birth_fallback(F.col("birth_date"), F.col("id_number")), "expiry_date": expiry_override(F.col("expiry_date"), F.col("back_text")), "back_full_text": F.col("back_text")})
    r = r.withColumn("front_full_text", full_text(F.col("name"), F.col("address"), F.col("id_number"), F.col("birth_date")))
    return r.select(*keys, *FIELDS)
