"""Digit, text, date and record queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vouchline.functions import text
from vouchline.operators import records
from vouchline.plans.adapters import cte, view

QUERIES, ORACLES = {}, {}
YEAR = 2026


def query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


_AR = "translate({}, '0123456789', '٠١٢٣٤٥٦٧٨٩')"
_FOLD = "translate({}, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789')"
_ID = cte("v_id14")


def _id(spark, sf):
    return view(spark, sf, "v_id14").select("case_id", "id14", "day", "status", "cust")


_MIXED = f"concat('a', {_AR.format('substr(id14, 1, 5)')}, '-x', translate(substr(id14, 6), '0123456789', '۰۱۲۳۴۵۶۷۸۹'), '²')"


@query("digits_fold", _ID + f" SELECT case_id, {_FOLD.format(_MIXED)} AS folded, translate({_FOLD.format(_MIXED)}, '0123456789', '٠١٢٣٤٥٦٧٨٩') AS arabic, regexp_replace({_FOLD.format(_MIXED)}, '[^\\p{{Nd}}]+', '', 'g') AS digits FROM v_id14")
def digits_fold(spark, sf):
    mixed = F.concat(F.lit("a"), F.translate(F.substring("id14", 1, 5), "0123456789", text.ARABIC_INDIC), F.lit("-x"), F.translate(F.substring("id14", 6, 99), "0123456789", text.EXTENDED_INDIC), F.lit("²"))
    return _id(spark, sf).select("case_id", text.fold_digits(mixed).alias("folded"), text.arabic_digits(mixed).alias("arabic"), text.only_digits(mixed).alias("digits"))


_LABEL = "concat('‏الـبطاقة‎  سارية ', status, '\n حتى ', " + _AR.format("id14") + ", ' أإآةىؤئ! ')"
_NORM = "trim(regexp_replace(translate(replace({}, 'ـ', ''), '‏‎\n', '   '), '[\\s\\p{{Z}}]+', ' ', 'g'))"
_MATCH = "trim(regexp_replace(regexp_replace(translate(" + _FOLD + ", 'أإآةىؤئ', 'اااهيوي'), '[^؀-ۿ0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"


def _label():
    return F.concat(F.lit("‏الـبطاقة‎  سارية "), F.col("status"), F.lit("\n حتى "), F.translate("id14", "0123456789", text.ARABIC_INDIC), F.lit(" أإآةىؤئ! "))


@query("arabic_match_norm", _ID + f", t AS (SELECT case_id, {_NORM.format(_LABEL)} AS normal FROM v_id14) SELECT case_id, normal, {_MATCH.format('normal')} AS matched FROM t")
def arabic_match_norm(spark, sf):
    return _id(spark, sf).select("case_id", text.normalize_arabic(_label()).alias("normal"), text.match_form(_label()).alias("matched"))


@query("bidi_wrap", _ID + f" SELECT case_id, CASE WHEN case_id % 2 = 0 THEN concat('⁧', {_AR.format('id14')}, '⁩') ELSE id14 END AS wrapped, CASE WHEN case_id % 2 = 0 THEN concat('⁧', {_AR.format('id14')}, '⁩') ELSE id14 END AS twice FROM v_id14")
def bidi_wrap(spark, sf):
    mixed = F.when(F.col("case_id") % 2 == 0, F.translate("id14", "0123456789", text.ARABIC_INDIC)).otherwise(F.col("id14"))
    return text.bidi_wrap_all(_id(spark, sf).select("case_id", text.bidi_wrap(mixed).alias("wrapped"), text.bidi_wrap(text.bidi_wrap(mixed)).alias("twice")))


@query(
    "numeric_field",
    _ID + """, t AS (SELECT case_id, concat_ws(' ', 'no. ' || substr(id14, 1, case_id % 5 + 3), substr(id14, 4, case_id % 7) || '/' || day, status) AS j FROM v_id14),
c AS (SELECT case_id, list_filter(list_concat(regexp_extract_all(translate(j, '/-._', '    '), '[0-9]+'), [regexp_replace(j, '[^0-9]', '', 'g')]), lambda x: x <> '') AS c FROM t),
d AS (SELECT case_id, list_filter(c, lambda x, i: list_position(c, x) = i) AS c FROM c),
s AS (SELECT case_id, list_transform(list_sort(list_transform(c, lambda x, i: {'n': -length(x), 'i': i, 'x': x})), lambda s: s.x) AS s FROM d)
SELECT case_id, coalesce(s[1], '') AS longest, coalesce(list_filter(s, lambda x: length(x) = 8)[1], left(list_filter(s, lambda x: length(x) >= 8)[1], 8), s[1], '') AS eight,
  coalesce(list_filter(s, lambda x: length(x) = 14)[1], left(list_filter(s, lambda x: length(x) >= 14)[1], 14), s[1], '') AS fourteen FROM s""",
)
def numeric_field(spark, sf):
    lines = F.array(F.expr("concat('no. ', substr(id14, 1, CAST(case_id % 5 + 3 AS int)))"), F.expr("concat(substr(id14, 4, CAST(case_id % 7 AS int)), '/', day)"), F.col("status"))
    return _id(spark, sf).select("case_id", text.numeric_field(lines, None).alias("longest"), text.numeric_field(lines, 8).alias("eight"), text.numeric_field(lines, 14).alias("fourteen"))


_VALID = "coalesce(regexp_full_match({0}, '[0-9]{{8}}') AND try_cast(substr({0}, 1, 4) AS INT) BETWEEN 1900 AND 2100 AND try_cast(substr({0}, 5, 2) AS INT) BETWEEN 1 AND 12 AND try_cast(substr({0}, 7, 2) AS INT) BETWEEN 1 AND 31, false)"


@query("date_valid", _ID + f" SELECT case_id, {_VALID.format('substr(id14, 2, 8)')} AS inner_ok, {_VALID.format("replace(day, '-', '')")} AS day_ok FROM v_id14")
def date_valid(spark, sf):
    return _id(spark, sf).select("case_id", text.valid_yyyymmdd(F.substring("id14", 2, 8)).alias("inner_ok"), text.valid_yyyymmdd(F.replace("day", F.lit("-"), F.lit(""))).alias("day_ok"))


# separated, padded and unpadded dates, a separated one that is none before a plain one, runs of digits, and no date
_RAW = """CASE case_id % 8 WHEN 0 THEN 'x ' || replace(day, '-', '/') WHEN 1 THEN 'n 99-99 ' || day WHEN 2 THEN substr(id14, 1, 3) || ' ' || replace(day, '-', ' ') WHEN 3 THEN id14 || status
  WHEN 4 THEN substr(day, 1, 4) || '/' || regexp_replace(substr(day, 6, 2), '^0', '') || '/' || regexp_replace(substr(day, 9, 2), '^0', '') WHEN 5 THEN '1234/56/78 . ' || replace(day, '-', '') WHEN 6 THEN substr(day, 1, 7) || '-' || regexp_replace(substr(day, 9, 2), '^0', '') || ' '
  ELSE 'none ' || substr(id14, 9) END"""
_SEP = r"'([0-9]{4})\s*[/\\\-.]\s*([0-9]{2})\s*[/\\\-.]\s*([0-9]{2})'"


@query(
    "date_extract",
    _ID + f""", t AS (SELECT case_id, {_RAW} AS t FROM v_id14),
p AS (SELECT case_id, t, CASE WHEN regexp_matches(t, {_SEP}) THEN regexp_extract(t, {_SEP}, 1) || regexp_extract(t, {_SEP}, 2) || regexp_extract(t, {_SEP}, 3) END AS p1,
  regexp_replace(regexp_extract(t, '[0-9]{{4}}\\s*[0-9]{{2}}\\s*[0-9]{{2}}', 0), '[^0-9]', '', 'g') AS p2, regexp_replace(t, '[^0-9]', '', 'g') AS d FROM t)
SELECT case_id, coalesce(CASE WHEN {_VALID.format('p1')} THEN p1 END, CASE WHEN {_VALID.format('p2')} THEN p2 END,
  list_filter(list_transform(range(1, greatest(length(d) - 6, 2)), lambda i: substr(d, i, 8)), lambda x: {_VALID.format('x')})[1], '') AS found FROM p""",
)
def date_extract(spark, sf):
    return _id(spark, sf).select("case_id", text.extract_yyyymmdd(F.expr(_RAW)).alias("found"))


_BORN = """CASE WHEN length({0}) >= 7 AND substr({0}, 1, 1) IN ('2', '3') AND try_cast(substr({0}, 4, 2) AS INT) BETWEEN 1 AND 12 AND try_cast(substr({0}, 6, 2) AS INT) BETWEEN 1 AND 31
  THEN CASE substr({0}, 1, 1) WHEN '2' THEN '19' ELSE '20' END || substr({0}, 2, 6) ELSE '' END"""
_OK = f"coalesce({YEAR} - try_cast(substr({{0}}, 1, 4) AS INT) BETWEEN 0 AND 100, false)"


@query("birth_from_id", _ID + f", b AS (SELECT case_id, {_BORN.format('id14')} AS born, {_BORN.format("'1' || substr(id14, 2)")} AS other FROM v_id14) SELECT case_id, born, other, {_OK.format('born')} AS plausible FROM b")
def birth_from_id(spark, sf):
    born = text.birth_from_id(F.col("id14"))
    return _id(spark, sf).select("case_id", born.alias("born"), text.birth_from_id(F.concat(F.lit("1"), F.substring("id14", 2, 99))).alias("other"), text.plausible_birth(born, YEAR).alias("plausible"))


_FIX = "CASE WHEN {b} <> '' AND NOT {ok} THEN CASE WHEN {ok3} THEN '3' || substr(id14, 2) WHEN {ok2} THEN '2' || substr(id14, 2) ELSE id14 END ELSE id14 END".format(
    b=_BORN.format("id14"), ok=_OK.format(f"({_BORN.format('id14')})"), ok3=_OK.format(f"({_BORN.format("('3' || substr(id14, 2))")})"), ok2=_OK.format(f"({_BORN.format("('2' || substr(id14, 2))")})")
)


@query("century_fix", _ID + f" SELECT case_id, id14, {_FIX} AS fixed FROM v_id14")
def century_fix(spark, sf):
    return _id(spark, sf).select("case_id", "id14", text.century_fix(F.col("id14"), YEAR).alias("fixed"))


_ISSUED = "CASE case_id % 4 WHEN 0 THEN substr(day, 1, 4) || ' / ' || substr(day, 6, 2) WHEN 1 THEN 'no ' || substr(day, 1, 4) || 'l' || substr(day, 6, 2) WHEN 2 THEN substr(day, 1, 4) || '-19' ELSE status END"


@query(
    "issue_date",
    _ID + f""", t AS (SELECT case_id, {_ISSUED} AS t FROM v_id14), p AS (SELECT case_id, regexp_extract(t, '((?:19|20)[0-9]{{2}})\\s*[/\\\\\\-.]\\s*([0-9]{{1,2}})', 1) AS y1, regexp_extract(t, '((?:19|20)[0-9]{{2}})\\s*[/\\\\\\-.]\\s*([0-9]{{1,2}})', 2) AS m1,
  regexp_extract(t, '((?:19|20)[0-9]{{2}})[1l]([0-9]{{2}})', 1) AS y2, regexp_extract(t, '((?:19|20)[0-9]{{2}})[1l]([0-9]{{2}})', 2) AS m2 FROM t)
SELECT case_id, translate(CASE WHEN try_cast(m1 AS INT) BETWEEN 1 AND 12 THEN y1 || '/' || lpad(m1, 2, '0') WHEN try_cast(m2 AS INT) BETWEEN 1 AND 12 THEN y2 || '/' || lpad(m2, 2, '0') ELSE '' END, '0123456789', '٠١٢٣٤٥٦٧٨٩') AS issued FROM p""",
)
def issue_date(spark, sf):
    return _id(spark, sf).select("case_id", text.issue_date(F.expr(_ISSUED)).alias("issued"))


@query("fmt_date8", _ID + " SELECT case_id, CASE WHEN case_id % 3 = 0 THEN id14 ELSE replace(day, '-', '/') END AS shown FROM v_id14")
def fmt_date8(spark, sf):
    arabic_day = F.translate(F.replace("day", F.lit("-"), F.lit(".")), "0123456789", text.ARABIC_INDIC)
    return _id(spark, sf).select("case_id", text.fmt_date8(F.when(F.col("case_id") % 3 == 0, F.col("id14")).otherwise(arabic_day)).alias("shown"))


@query("gender_repair", _ID + " SELECT case_id, CASE status WHEN 'F' THEN 'ذكر x' WHEN 'O' THEN 'ذكر x' ELSE 'انثى x' END AS gender FROM v_id14")
def gender_repair(spark, sf):
    raw = F.when(F.col("status") == "F", "دكر x").when(F.col("status") == "O", "نكر x").otherwise("انثى x")
    return _id(spark, sf).select("case_id", text.repair_gender(raw).alias("gender"))


@query("web_id_digits", _ID + " SELECT case_id, CASE WHEN case_id % 2 = 0 THEN 14 ELSE 13 END AS digits, case_id % 2 = 0 AS accepted FROM v_id14")
def web_id_digits(spark, sf):
    shown = F.when(F.col("case_id") % 2 == 0, F.concat(F.translate(F.substring("id14", 1, 13), "0123456789", text.ARABIC_INDIC), F.lit(" ²"))).otherwise(F.concat(F.substring("id14", 1, 13), F.lit("-x")))
    n = text.isdigit_count(shown)
    return _id(spark, sf).select("case_id", n.alias("digits"), (n == 14).alias("accepted"))


@query(
    "label_format",
    _ID + """ SELECT case_id, printf('%.3f', cust / 8.0::DOUBLE) AS score3, printf('%.1f%%', cust / 5.0::DOUBLE) AS percent, rpad('case_' || case_id::VARCHAR, 45, ' ') || lpad(status, 8, ' ') AS report_row,
  left(repeat(day, 30), 200) AS traced, 'x.tar' AS stem, '.jpg' AS ext FROM v_id14""",
)
def label_format(spark, sf):
    path = F.concat(F.lit("/in/"), F.col("day"), F.lit("/x.tar.JPG"))
    return _id(spark, sf).select(
        "case_id", text.score_label(F.col("cust") / 8.0).alias("score3"), text.percent_label(F.col("cust") / 5.0).alias("percent"),
        text.report_row(F.concat(F.lit("case_"), F.col("case_id").cast("string")), F.col("status")).alias("report_row"), text.traced(F.repeat("day", 30)).alias("traced"),
        text.stem(path).alias("stem"), text.extension(path).alias("ext"),
    )


_BACK = "substr(id14, 1, CAST(14 - case_id % 3 AS INT))"
_EDGE = "substr(id14, 1, CAST(12 + case_id % 4 AS INT))"


@query("ids_match", _ID + " SELECT case_id, case_id % 3 = 0 AS same FROM v_id14")
def ids_match(spark, sf):
    return _id(spark, sf).select("case_id", records.ids_match(F.col("id14"), F.translate(F.expr(_BACK), "0123456789", text.ARABIC_INDIC)).alias("same"))


@query("back_id_choice", _ID + f" SELECT case_id, CASE WHEN length({_EDGE}) = 14 THEN {_EDGE} WHEN length({_BACK}) = 14 THEN {_BACK} WHEN length({_EDGE}) > length({_BACK}) THEN {_EDGE} ELSE {_BACK} END AS back_id FROM v_id14")
def back_id_choice(spark, sf):
    return _id(spark, sf).select("case_id", records.back_id_choice(F.expr(_BACK), F.expr(_EDGE)).alias("back_id"))


_FRONT = "substr(id14, 1, CAST(14 - case_id % 5 AS INT))"
_OTHER = "reverse(" + _EDGE + ")"


@query("id_reconcile", _ID + f""", t AS (SELECT case_id, {_FRONT} AS f, {_OTHER} AS b FROM v_id14) SELECT case_id, f AS front_id_number, CASE WHEN length(b) = 14 AND length(f) <> 14 THEN b WHEN length(f) = 14 THEN f WHEN length(b) > length(f) THEN b ELSE f END AS id_number FROM t""")
def id_reconcile(spark, sf):
    """Front and back tables of the same cases, joined one to one."""
    v = _id(spark, sf)
    front, back = v.select("case_id", F.expr(_FRONT).alias("f")), v.select("case_id", F.expr(_OTHER).alias("b"))
    return front.join(back, "case_id").select("case_id", F.col("f").alias("front_id_number"), records.reconcile(F.col("f"), F.col("b")).alias("id_number"))


_BIRTH = "CASE case_id % 4 WHEN 0 THEN replace(day, '-', '') WHEN 1 THEN '20239999' WHEN 2 THEN '' END"


@query("birth_fallback", _ID + f", t AS (SELECT case_id, id14, coalesce({_BIRTH}, '') AS b FROM v_id14) SELECT case_id, CASE WHEN {_VALID.format('b')} THEN b ELSE coalesce(nullif({_BORN.format('id14')}, ''), b) END AS birth_date FROM t")
def birth_fallback(spark, sf):
    return _id(spark, sf).select("case_id", records.birth_fallback(F.expr(_BIRTH), F.col("id14")).alias("birth_date"))


@query(
    "card_record",
    _ID + f""", t AS (SELECT case_id, {_FRONT} AS f, {_OTHER} AS b, day, status FROM v_id14),
r AS (SELECT *, CASE WHEN length(b) = 14 AND length(f) <> 14 THEN b WHEN length(f) = 14 THEN f WHEN length(b) > length(f) THEN b ELSE f END AS id_number FROM t)
SELECT case_id, id_number, f AS front_id_number, b AS back_id_number, coalesce(nullif({_BORN.format('id_number')}, ''), '') AS birth_date, replace(day, '-', '') AS expiry_date,
  length(f) = 14 AND length(b) = 14 AND f = b AS id_numbers_match, trim(CASE WHEN status = 'P' THEN '' ELSE status || ' ' END || id_number) AS front_full_text, '' AS religion, status <> 'P' AS complete FROM r""",
)
def card_record(spark, sf):
    """The assembled record: reconciled id, birth from the id, expiry from the back text, joined texts, defaults."""
    v = _id(spark, sf).select("case_id", F.expr(_FRONT).alias("front_id_number"), F.expr(_OTHER).alias("back_id_number"), "day", "status")
    name = F.when(F.col("status") == "P", "").otherwise(F.col("status"))
    r = v.withColumn("id_number", records.reconcile(F.col("front_id_number"), F.col("back_id_number"))).withColumn("religion", F.lit(None).cast("string")).withColumn("name", name)
    r = r.withColumn("expiry_date", text.extract_yyyymmdd(F.col("day"))).withColumn("birth_date", records.birth_fallback(F.lit(""), F.col("id_number")))
    r = r.withColumn("id_numbers_match", records.ids_match(F.col("front_id_number"), F.col("back_id_number"))).withColumn("front_full_text", records.full_text(F.col("name"), F.lit(""), F.col("id_number"), F.lit(None).cast("string")))
    r = r.withColumn("complete", records.complete(F.array("name", "id_number")))
    return records.default_record(r).select("case_id", "id_number", "front_id_number", "back_id_number", "birth_date", "expiry_date", "id_numbers_match", "front_full_text", "religion", "complete")
