"""Secret scan: Aho-Corasick keyword prefilter, anchored expressions near hits, checksum validation.

One automaton pass over the ASCII-lower-cased bytes finds keyword hits; the expression of a hit's kind is
tried only at that hit. Kinds that carry a checksum count only if it holds: ``github`` and ``npm`` tokens (the last
six characters are the base-62 CRC-32 of the thirty before), ``card`` numbers (Luhn's rule) and ``iban`` bank
accounts (97 by ISO 7064, and the length of their country). Long hexadecimal runs have no keyword and are found
by their run length.

Defined results: null and empty texts have no spans (empty string, digest of the empty string); offsets are
code points, end exclusive; repeated rows are scanned each on its own; null ids pass through; an empty table
gives an empty result; other columns, also such that differ from the two in case only, are ignored by ``find``
and kept by ``redact``; a text of any length is scanned whole, at some bytes of memory a byte.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vouchline.llm.common import pick, table, text_bytes

#: In the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "github", "npm", "card", "iban")
BASE_KINDS = 3
#: keyword (lower case) -> kind
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm",
    "card": "card", "iban": "iban",
}
EXPRESSIONS = {
    "assign": re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "github": re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "card": re.compile(rb"card(?:\x20?(?:number|no\.?))?[\x20:=#]*((?:[0-9][\x20-]?){12,18}[0-9])(?![0-9])", re.IGNORECASE),
    "iban": re.compile(rb"iban[\x20:=#]*([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})", re.IGNORECASE),
}
# Length of an account number by country.
IBAN_LENGTH = {
    b"AT": 20, b"BE": 16, b"BG": 22, b"CH": 21, b"CY": 28, b"CZ": 24, b"DE": 22, b"DK": 18, b"EE": 20, b"ES": 24, b"FI": 18, b"FR": 27, b"GB": 22, b"GR": 27, b"HR": 21, b"HU": 28, b"IE": 22,
    b"IT": 27, b"LT": 20, b"LU": 20, b"LV": 21, b"MT": 31, b"NL": 18, b"NO": 15, b"PL": 28, b"PT": 25, b"RO": 24, b"SA": 24, b"SE": 24, b"SI": 19, b"SK": 24, b"TR": 26,
}
HEX_RUN = re.compile(rb"[0-9a-f]{24,}")
#: Digits, then capitals, then small letters: the usual base-62 order of these checksums.
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_automaton = None


def base62_crc(payload: bytes) -> bytes:
    """Six base-62 digits of a payload's CRC-32."""
    crc, out = zlib.crc32(payload), b""
    for _ in range(6):
        crc, digit = divmod(crc, 62)
        out = BASE62[digit : digit + 1] + out
    return out


def _keywords():
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            _automaton.add_word(word, (len(word), kind))
        _automaton.make_automaton()
    return _automaton


def luhn(digits: bytes) -> bool:
    """Every second digit from the right doubled, digits summed: a multiple of ten."""
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(c - 48 for c in reversed(digits))) % 10 == 0


def iban_end(match: re.Match) -> int | None:
    """Where the account number of its country's length ends, if its remainder by 97 is 1."""
    body = match.group(1)
    want = IBAN_LENGTH.get(body[:2].upper())
    places = [i for i, c in enumerate(body) if c != 0x20]
    if want is None or len(places) < want:
        return None
    code = bytes(body[i] for i in places[:want]).upper()
    value = int("".join(str(int(chr(c), 36)) for c in code[4:] + code[:4]))
    return match.start(1) + places[want - 1] + 1 if value % 97 == 1 else None


def _valid_end(kind: str, match: re.Match) -> int | None:
    """Where the span of a match ends, None if it fails its length or checksum."""
    if kind == "iban":
        return iban_end(match)
    body = match.group()[4:]
    holds = {
        "assign": lambda: match.end(1) - match.start(1) >= 6,
        "access": lambda: match.end() - match.start() >= 20,
        "card": lambda: luhn(re.sub(rb"[^0-9]", b"", match.group(1))),
    }.get(kind, lambda: base62_crc(body[:30]) == body[30:])
    return match.end() if holds() else None


def scan(text: bytes) -> list[tuple[int, int, str]]:
    """(start, kind's rank, end) of every span, in bytes, sorted."""
    found = [(m.start(), 2, m.end()) for m in HEX_RUN.finditer(text)]
    last = dict.fromkeys(KINDS, 0)
    hits = [(end - size + 1, kind) for end, (size, kind) in _keywords().iter(text.lower().decode("latin-1"))]
    for start, kind in sorted(hits):
        # left to right without overlap, also over matches that fail the length or the checksum
        if start >= last[kind] and (m := EXPRESSIONS[kind].match(text, start)):
            last[kind] = m.end()
            if (end := _valid_end(kind, m)) is not None:
                found.append((start, KINDS.index(kind), end))
    return sorted(found)


def in_code_points(text: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, int]]:
    if not spans or text.isascii():
        return spans
    before = np.zeros(len(text) + 1, np.int64)
    np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80, out=before[1:])
    return [(int(before[s]), k, int(before[e])) for s, k, e in spans]


def _scan_batches(batches):
    for batch in batches:
        buf, off = text_bytes(batch.column(1))
        counts, base, spans = np.zeros((BASE_KINDS, batch.num_rows), np.int64), [], []
        for i in range(batch.num_rows):
            text = buf[off[i] : off[i + 1]].tobytes()
            found = in_code_points(text, scan(text))
            for _, k, _ in found:
                if k < BASE_KINDS:
                    counts[k, i] += 1
            base.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found if k < BASE_KINDS).encode()).hexdigest())
            spans.append(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *map(pa.array, counts), pa.array(base, pa.string()), pa.array(spans, pa.string())],
            names=[batch.schema.names[0], "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, counts of the base kinds, digest of the base spans, and all spans as ``kind:start:end``."""
    docs = pick(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.mapInArrow(_scan_batches, f"`{id_col}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """The same rows and columns with every span of a secret replaced by ``mark``; overlapping spans merge."""
    at = docs.columns.index(text_col)

    def rows(batches):
        for batch in batches:
            buf, off = text_bytes(batch.column(at))
            out = []
            for i in range(batch.num_rows):
                text = buf[off[i] : off[i + 1]].tobytes()
                done, pieces = 0, []
                for s, _, e in scan(text):
                    if s >= done:
                        pieces += [text[done:s], mark.encode()]
                    done = max(done, e)
                out.append(b"".join([*pieces, text[done:]]).decode())
            text_array = pa.array(out, pa.string())
            nulls = batch.column(at).is_null()
            text_array = pa.compute.if_else(nulls, pa.scalar(None, pa.string()), text_array)
            columns = [text_array if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    slots = [f"c{i}" for i in range(len(docs.columns))]
    named = docs.toDF(*slots)
    return named.mapInArrow(rows, named.schema).toDF(*docs.columns)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans over all documents."""
    return find(table(spark, sf_dir, "documents"))
