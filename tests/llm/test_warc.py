"""Round trips through archives at any cut, and what a range owns."""

import base64
import gzip
import hashlib

import pytest

from vouchline.llm import warc


def test_round_trip_at_any_cut(spark, tmp_path):
    inner = warc.record(99, "u", b"inner", "X", None, False)
    rows = [(3, "http://a/\nx", "same", 1), (1, None, "same", 2), (2, "u", None, 3), (7, "u", "", 4), (8, "u", "é" * 70000, 5), (9, "u", "other", 6), (None, "u", "same", 7)]
    rows += [(1, None, "same", 8), (20, "u", inner.decode("latin-1"), 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, URL2 int")
    manifest = warc.write_archives(pages, str(tmp_path / "w"))
    want = sorted(
        (str(i), len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), kind, ref)
        for i, p, kind, ref in [
            (3, b"same", "revisit", 1), (1, b"same", "response", None), (1, b"same", "response", None), (None, b"same", "revisit", 1), (2, b"", "response", None),
            (7, b"", "revisit", 2), (8, "é".encode() * 70000, "response", None), (9, b"other", "response", None), (20, inner.decode("latin-1").encode(), "response", None),
        ]
    )
    for split in (1 << 22, 64, 7):
        got = warc.read_archives(manifest, split).collect()
        assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    body = {r.page_id: bytes(r.payload) for r in warc.read_archives(manifest, payload=True).collect() if r.record_type == "response"}
    assert body[8] == "é".encode() * 70000
    assert warc.read_archives(warc.write_archives(pages.limit(0), str(tmp_path / "e"))).count() == 0


def test_loss_is_an_error(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>" * 400, "x") for i in range(30)], "page_id long, url string, html string, HTML string")
    manifest = warc.write_archives(pages.coalesce(1), str(tmp_path / "w"))
    assert warc.complete(warc.read_archives(manifest, 300), manifest).count() == 30
    path = manifest.first().path
    whole = open(path, "rb").read()
    for harmed in (whole[:-40], whole[: len(whole) // 2] + b"\0" * 40 + whole[len(whole) // 2 + 40 :]):
        with open(path, "wb") as f:
            f.write(harmed)
        with pytest.raises(Exception, match="cut short|damaged|records read"):
            warc.complete(warc.read_archives(manifest, 300), manifest)


def test_a_range_reads_little_beyond_its_end(tmp_path):
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"\0" * 3_000_000)
    with open(path, "rb") as f:
        window = warc._Window(f, 10)
        assert window.find(10, 20) == -1 and f.tell() <= 10 + warc._READ


def test_false_magic_is_passed_over(tmp_path):
    junk = b"\x1f\x8b\x08 not gzip" + gzip.compress(b"plain text, no record")
    path = tmp_path / "x.warc.gz"
    real = warc.record(5, "u", b"abc", "D", None, False)
    path.write_bytes(junk + real + real)
    found = [(at, f["warc-record-id"]) for at, f, _ in warc.records_in(str(path), 0, 10**6)]
    assert [a for a, _ in found] == [len(junk), len(junk) + len(real)]
    assert [a for a, *_ in warc.records_in(str(path), len(junk) + 1, len(junk) + len(real))] == []
