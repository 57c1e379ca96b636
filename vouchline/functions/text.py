"""Text, digit and date rules for noisy Arabic and Latin card text, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouchline.functions.geometry import let

# Digit sets, letter variants, marks and label words of the card format.
ARABIC_INDIC = "٠١٢٣٤٥٦٧٨٩"
EXTENDED_INDIC = "۰۱۲۳۴۵۶۷۸۹"
ASCII_DIGITS = "0123456789"
LETTER_FROM, LETTER_TO = "أإآةىؤئ", "اااهيوي"
TATWEEL, RLM, LRM = "ـ", "‏", "‎"
RLI, PDI = "⁧", "⁩"
EXPIRY_WORDS = ("البطاقه", "ساريه", "حتي")
ARABIC = r"[\x{0600}-\x{06FF}]"


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def fold_digits(c: Column) -> Column:
    """Both Arabic digit sets to ASCII."""
    return F.translate(c, ARABIC_INDIC + EXTENDED_INDIC, ASCII_DIGITS * 2)


def arabic_digits(c: Column) -> Column:
    return F.translate(fold_digits(c), ASCII_DIGITS, ARABIC_INDIC)


def only_digits(c: Column) -> Column:
    """Folded, then everything but Unicode decimal digits removed."""
    return F.regexp_replace(fold_digits(c), r"(?U)\D+", "")


def normalize_arabic(c: Column) -> Column:
    return _squeeze(F.translate(F.translate(c, TATWEEL, ""), RLM + LRM + "\n", "   "))


def match_form(c: Column) -> Column:
    """Normalised, folded, letter variants united, anything else than Arabic, digits and blanks to a blank."""
    united = F.translate(fold_digits(normalize_arabic(c)), LETTER_FROM, LETTER_TO)
    return _squeeze(F.regexp_replace(united, r"[^\x{0600}-\x{06FF}0-9 ]+", " "))


def bidi_wrap(c: Column) -> Column:
    """Right-to-left isolate around text with Arabic letters, once."""
    wrapped = c.startswith(RLI) & c.endswith(PDI)
    return F.when(c.rlike(ARABIC) & ~wrapped, F.concat(F.lit(RLI), c, F.lit(PDI))).otherwise(c)


def bidi_wrap_all(df: DataFrame) -> DataFrame:
    """``bidi_wrap`` on every string value of a frame, nested ones too; keys and other types stay."""

    def walk(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return bidi_wrap(c)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: walk(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda _, v: walk(v, kind.valueType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*(walk(c[f.name], f.dataType).alias(f.name) for f in kind.fields)))
        return c

    return df.select(*(walk(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))


def numeric_field(texts: Column, prefer: int | None) -> Column:
    """The best digit run of a line array: exact length, else the first ``prefer`` digits of the longest, else the longest."""
    joined = F.translate(fold_digits(F.array_join(texts, " ")), "/-._", "    ")

    def runs(t: Column) -> Column:
        every = F.concat(F.regexp_extract_all(t, F.lit(r"((?U)\d+)"), 1), F.array(only_digits(t)))
        return F.array_distinct(F.filter(every, lambda x: x != ""))

    def chosen(found: Column) -> Column:
        longest_first = F.array_sort(F.transform(found, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x"))))
        longest = lambda r: F.coalesce(F.get(r, F.lit(0))["x"], F.lit(""))
        if prefer is None:
            return let(longest_first, longest)
        exact = F.get(F.filter(found, lambda x: F.length(x) == prefer), F.lit(0))
        # the longest run is long enough if any is
        return let(longest_first, lambda r: F.coalesce(exact, F.substring(longest(r), 1, prefer)))

    return let(joined, lambda t: let(runs(t), chosen))


def _digit_like() -> str:
    """Characters with a digit value that are no decimals (superscripts, circled digits), as a class body, by Unicode's rule."""
    return "".join(rf"\x{{{c:X}}}" for c in range(0x110000) if chr(c).isdigit() and not chr(c).isdecimal())


def isdigit_count(c: Column) -> Column:
    """How many characters count as digits for the web gate: decimals and other characters with a digit value."""
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), rf"[^\p{{Nd}}{_digit_like()}]", "")).cast("int")


def digit_count(c: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\D", "")).cast("int")


def _part(c: Column, at: int, n: int) -> Column:
    return F.substring(c, at, n).try_cast("int")


def valid_yyyymmdd(c: Column) -> Column:
    """Eight digits, year 1900 to 2100, month and day in range; no calendar."""
    ok = c.rlike(r"^[0-9]{8}$") & _part(c, 1, 4).between(1900, 2100) & _part(c, 5, 2).between(1, 12) & _part(c, 7, 2).between(1, 31)
    return F.coalesce(ok, F.lit(False))


def birth_from_id(c: Column) -> Column:
    """YYYYMMDD from the century digit and the next six digits; empty if they don't make one."""
    d = only_digits(c)
    century = F.when(F.substring(d, 1, 1) == "2", "19").when(F.substring(d, 1, 1) == "3", "20")
    ok = (F.length(d) >= 7) & century.isNotNull() & _part(d, 4, 2).between(1, 12) & _part(d, 6, 2).between(1, 31)
    return F.when(ok, F.concat(century, F.substring(d, 2, 6))).otherwise("")


def plausible_birth(c: Column, year: int) -> Column:
    return F.coalesce((F.lit(year) - _part(c, 1, 4)).between(0, 100), F.lit(False))


def century_fix(id14: Column, year: int) -> Column:
    """An id whose birth year is implausible gets the first of '3', '2', '1' that makes it plausible."""

    def of(d: Column) -> Column:
        """d: the digits. Whether they hold a month and a day doesn't depend on the century's digit."""
        tail, two = F.substring(d, 2, 6), _part(d, 2, 2)
        dated = (F.length(d) >= 7) & _part(d, 4, 2).between(1, 12) & _part(d, 6, 2).between(1, 31) & tail.isNotNull()
        plausible = lambda base: F.coalesce((F.lit(year - base) - two).between(0, 100), F.lit(False))
        now = F.when(F.substring(d, 1, 1) == "2", plausible(1900)).when(F.substring(d, 1, 1) == "3", plausible(2000))
        other = F.when(plausible(2000), "3").when(plausible(1900), "2")
        return F.when(F.coalesce(dated & ~now, F.lit(False)) & other.isNotNull(), F.concat(other, F.substring(d, 2, 1 << 20))).otherwise(id14)

    return let(only_digits(id14), of)


def extract_yyyymmdd(c: Column) -> Column:
    """First separated date (two digits for month and day) if valid, else first run of eight, else the first valid window over all digits."""
    t = fold_digits(c)
    pattern = r"([0-9]{4})\s*[/\\\-.]\s*([0-9]{2})\s*[/\\\-.]\s*([0-9]{2})"
    first = F.concat(*(F.regexp_extract(t, pattern, k) for k in (1, 2, 3)))
    plain = F.regexp_replace(F.regexp_extract(t, r"[0-9]{4}\s*[0-9]{2}\s*[0-9]{2}", 0), r"[^0-9]", "")
    digits = F.regexp_replace(t, r"[^0-9]", "")
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.length(digits) - 7, F.lit(1))), lambda i: digits.substr(i, F.lit(8)))
    valid = F.get(F.filter(windows, valid_yyyymmdd), F.lit(0))
    return F.coalesce(F.when(valid_yyyymmdd(first), first), F.when(valid_yyyymmdd(plain), plain), valid, F.lit(""))


def issue_date(c: Column) -> Column:
    """YYYY/MM in Arabic digits, also where the slash was read as 1 or l."""
    t = fold_digits(c)
    found = None
    for pattern in (r"((?:19|20)[0-9]{2})\s*[/\\\-.]\s*([0-9]{1,2})", r"((?:19|20)[0-9]{2})[1l]([0-9]{2})"):
        y, m = F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 2)
        one = F.when(m.try_cast("int").between(1, 12), F.concat(y, F.lit("/"), F.lpad(m, 2, "0")))
        found = one if found is None else F.coalesce(found, one)
    return arabic_digits(F.coalesce(found, F.lit("")))


def fmt_date8(c: Column) -> Column:
    """YYYY/MM/DD where eight ASCII digits are left, else the text as it is."""
    d = F.regexp_replace(F.translate(c, ARABIC_INDIC, ASCII_DIGITS), r"[^0-9]", "")
    return F.when(F.length(d) == 8, F.concat_ws("/", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))).otherwise(c)


def repair_gender(c: Column) -> Column:
    return F.regexp_replace(c, "[دنر]كر", "ذكر")


def expiry_label_score(c: Column) -> Column:
    """How many of the three label words stand in the text, as substrings."""
    m = match_form(c)
    return sum((m.contains(w).cast("int") for w in EXPIRY_WORDS), F.lit(0))


def arabic_chars(c: Column) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, ARABIC, ""))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)$", 1))


def score_label(c: Column) -> Column:
    return F.format_string("%.3f", c)


def percent_label(c: Column) -> Column:
    return F.format_string("%.1f%%", c)


def report_row(name: Column, *values: Column) -> Column:
    """A name in 45 columns, each value right-aligned in eight."""
    return F.concat(F.rpad(name, 45, " "), *(F.lpad(v, 8, " ") for v in values))


def traced(c: Column, most: int = 200) -> Column:
    """The head of a value as a trace shows it."""
    return F.substring(c, 1, most)


def trace_header(c: Column) -> Column:
    """Length and names of a map as a trace shows them."""
    return F.concat(F.lit("len="), F.size(c).cast("string"), F.lit(" keys="), F.array_join(F.array_sort(F.map_keys(c)), ","))


def joined_lines(lines: Column) -> Column:
    """Lines joined by blanks, without empty ones, normalised."""
    return normalize_arabic(F.array_join(F.filter(lines, lambda x: x.isNotNull() & (x != "")), " "))


def attempt(value: Column, message: Column | str) -> Column:
    """struct(value, error): a null value carries the message and the run goes on."""
    note = F.lit(message) if isinstance(message, str) else message
    return F.struct(value.alias("value"), F.when(value.isNull(), note).alias("error"))


def clock_ms(c: Column) -> Column:
    """Milliseconds of a HH:MM:SS.mmm time of day."""
    part = lambda at, n: F.substring(c, at, n).cast("bigint")
    return ((part(1, 2) * 60 + part(4, 2)) * 60 + part(7, 2)) * 1000 + part(10, 3)
