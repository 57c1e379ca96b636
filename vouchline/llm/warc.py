"""WARC archives: one gzip member per record, revisit records for repeated payloads, and a splittable reader.

Reading: archives are cut into byte ranges. A task looks for the gzip magic from the start of its range, takes
a candidate as a member only if it decodes to a WARC header with a length, and owns the records that start
inside its range; a record is read to its end wherever that is. So any cut gives every record exactly once.

Writing: each task writes one archive under a name of its own and returns a manifest row; only the manifest
rows of tasks that succeeded are kept, so a retried task leaves at most an unlisted file.

Nothing is lost in silence: a member whose WARC header decodes but whose rest is damaged or cut short is an
error, and ``complete`` holds the number of records read against the manifest.

Defined results: a null payload is empty; of equal payloads that with the least id is the response (rows that
repeat that very id are responses too), all others revisit it; rows without an id never are what others
refer to; a null url has no target line; an empty table gives no archive and no record; payloads of any length
are held whole by the task that writes or reads them, one at a time; other columns, also such that differ from
the three in case only, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchline.llm.common import materialise, pick, shared_path, table

SPLIT_BYTES = 4 << 20
#: Below so many repeated payloads their table is broadcast (under 100 bytes a row).
BROADCAST_ROWS = 200_000
_MAGIC = b"\x1f\x8b\x08"
_READ = 1 << 18
_URN = "urn:vouchline:page:"
_DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"\w[\w+.-]*:/", path) else (pafs.LocalFileSystem(), path)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One compressed member; a revisit keeps the HTTP head, and with it the payload's length, without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: <{_URN}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes all rows as records; returns the manifest (path, bytes, records)."""
    rows = pick(pages, id_col, url_col, html_col).toDF("page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    firsts = rows.where(F.octet_length("html") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = materialise(firsts, "repeated-payloads")
    n = firsts.count()
    if n <= BROADCAST_ROWS:
        known = rows.join(F.broadcast(firsts.select("sha1", "first")), "sha1", "left")
    else:
        # payloads that hold over a thousandth of the repeats are fewer than a thousand: broadcast; the rest meet by digest
        total = firsts.agg(F.sum("n")).first()[0]
        hot = firsts.where(F.col("n") > total // 1000).select("sha1", F.col("first").alias("hot"))
        rare = firsts.where(F.col("n") <= total // 1000).select(F.col("sha1").alias("key"), "first")
        spread = rows.join(F.broadcast(hot), "sha1", "left").withColumn("k", F.when(F.col("hot").isNull(), F.col("sha1")).otherwise(F.sha1(F.col("page_id").cast("string"))))
        known = spread.join(rare, F.col("k") == F.col("key"), "left").withColumn("first", F.coalesce("hot", "first"))

    def write(batches):
        fs, root = open_fs(folder)
        path = f"{root}/pages-{uuid.uuid4().hex}.warc.gz"
        out, size, count = None, 0, 0
        for batch in batches:
            for page_id, url, html, sha1, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                member = record(page_id, url, html.encode(), digest, first, first is not None and first != page_id)
                out.write(member)
                size, count = size + len(member), count + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{path.rsplit('/', 1)[1]}", "bytes": size, "records": count}])

    manifest = known.select("page_id", "url", "html", "sha1", "first").mapInArrow(write, "path string, bytes bigint, records bigint")
    return materialise(manifest, "manifest")


class _Window:
    """Bytes of a file from an offset on, read as they are asked for."""

    def __init__(self, file, at: int):
        self.file, self.base, self.data = file, at, bytearray()
        file.seek(at)

    def more(self) -> bool:
        got = self.file.read(_READ)
        self.data += got
        return bool(got)

    def find(self, at: int, end: int) -> int:
        """Offset of the next magic in [at, end), -1 if none; nothing that can't belong to it is read."""
        while at < end:
            k = self.data.find(_MAGIC, at - self.base, end + len(_MAGIC) - 1 - self.base)
            if k >= 0:
                return self.base + k
            at = max(at, self.base + len(self.data) - len(_MAGIC) + 1)
            if at < end and not self.more():
                return -1
        return -1

    def drop(self, at: int) -> None:
        del self.data[: at - self.base]
        self.base = at

    def member(self, at: int) -> tuple[bytes, int] | None:
        """The decoded member at ``at`` and its end; None if it isn't a WARC record, an error if it is a broken one."""
        unpack, out, k = zlib.decompressobj(31), bytearray(), at - self.base
        try:
            while not unpack.eof:
                if k >= len(self.data) and not self.more():
                    if _is_record(out):
                        raise ValueError(f"record at {at} is cut short")
                    return None
                chunk = self.data[k : k + _READ]
                k += len(chunk)
                out += unpack.decompress(chunk)
                if len(out) >= len(_START) and not _is_record(out):
                    return None
        except zlib.error as e:
            if _is_record(out):
                raise ValueError(f"record at {at} is damaged: {e}") from e
            return None
        return bytes(out), self.base + k - len(unpack.unused_data)


_START = b"WARC/1."


def _is_record(data: bytes | bytearray) -> bool:
    return data.startswith(_START)


def parse(data: bytes) -> tuple[dict[str, str], bytes] | None:
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/1."):
        return None
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:]))
    length = fields.get("content-length", "")
    return (fields, rest[: int(length)]) if length.isdigit() and len(rest) >= int(length) else None


def records_in(path: str, start: int, end: int):
    """(offset, header fields, block) of the records that start in [start, end)."""
    fs, local = open_fs(path)
    with fs.open_input_file(local) as file:
        window, at = _Window(file, start), start
        while (at := window.find(at, end)) >= 0:
            got = window.member(at)
            if got is None:
                at += 1
                continue
            if (parsed := parse(got[0])) is None:
                raise ValueError(f"record of {path} at {at} has no header, no length, or fewer bytes than its length")
            yield at, *parsed
            at = got[1]
            window.drop(at)


def read_archives(archives: DataFrame, split: int = SPLIT_BYTES, payload: bool = False) -> DataFrame:
    """archives (path, bytes) -> a row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload].

    A response's digest and length are those of the payload as read, and must agree with its header.
    """
    spark = archives.sparkSession
    ranges = archives.where("bytes > 0").select("path", F.explode(F.expr(f"sequence(0L, bytes - 1, {split}L)")).alias("start"))
    ranges = ranges.withColumn("end", F.col("start") + split).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "start")
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payload
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def number(field: str | None) -> int | None:
        text = (field or "").strip("<>").removeprefix(_URN)
        return int(text) if text.lstrip("-").isdigit() else None

    def read(batches):
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                for at, fields, block in records_in(path, start, end):
                    http, _, body = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    kind = fields["warc-type"]
                    if kind == "response" and (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()) != (size, digest):
                        raise ValueError(f"payload of {path} at {at} doesn't match its header")
                    rows.append((number(fields["warc-record-id"]), fields.get("warc-target-uri"), size, digest, kind, number(fields.get("warc-refers-to")), body)[: len(names)])
                    if len(rows) == 500:
                        yield _batch(rows, names, kinds)
                        rows = []
                if rows:
                    yield _batch(rows, names, kinds)

    return ranges.mapInArrow(read, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payload)


def _batch(rows, names, kinds):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds)], names=names)  # noqa: B905


def complete(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """The records as a written table, if they are as many as the manifest says; an error if not."""
    found = materialise(found, "records")
    got, told = found.count(), manifest.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    if got != told:
        raise ValueError(f"{got} records read, {told} written")
    return found


#: Equal payloads by their text; base32 of a SHA-1 takes five bits at a time from its hexadecimal digits.
ORACLE = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least_id FROM pages)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(sha1(html), 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM least_id AND least_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM least_id THEN least_id END AS refers_to,
  replace(replace(url, chr(13), '%0D'), chr(10), '%0A') AS url FROM p
"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as read back from the archives, url."""
    manifest = write_archives(table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    found = complete(read_archives(manifest), manifest)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
