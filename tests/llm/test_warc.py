"""WARC round trips: exact, at any range size, and past damaged places."""

from __future__ import annotations

import gzip
import hashlib
import os
import random
import string
import zlib

import pytest

from tillroll.llm import warc


@pytest.fixture(scope="module")
def pages(spark):
    big = "long " * 40_000
    rows = [(1, "http://a.example/x", "short"), (2, None, "short"), (3, "u", None), (4, "u", ""), (9, "u\r\nEvil: 1", big),
            (7, "u", big), (8, "u", big), (5, "u", "é" * 50), (6, "u", "é" * 50), (10, "u", "é" * 49), (11, "u", "é" * 49),
            (12, "u", "WARC/1.1\r\n\r\n" * 20), (None, "u", big), (20, "u", "twice" * 30), (20, "u", "twice" * 30), (21, "u", "twice" * 30)]
    return spark.createDataFrame([(*r, "extra", "x") for r in rows], "page_id long, url string, html string, payload string, offset string")


def expected(pages):
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    out = []
    for i, payload in rows:
        same = [j for j, p in rows if p == payload and j is not None]
        first = min(same) if len(payload) >= 100 and i is not None else i
        out.append((i, len(payload), hashlib.sha256(payload).hexdigest(), "response" if first == i else "revisit", None if first == i else first))
    return sorted(out, key=str)


def page(urn):
    return int(urn.rpartition(":")[2]) if urn and urn.startswith("urn:page:") else None


@pytest.mark.parametrize("range_bytes", [64, 1000, 1 << 23])
def test_round_trip_at_any_range(spark, pages, tmp_path, range_bytes):
    manifest = warc.write_warc(pages.repartition(3), str(tmp_path / "w"))
    rows = warc.read_warc(spark, manifest, range_bytes).collect()
    got = sorted(((page(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], page(r["refers_to"])) for r in rows), key=str)
    assert got == expected(pages)
    texts = {(r["page_id"]): (r["html"] or "").encode() for r in pages.collect()}
    assert all(r["payload"] == texts[page(r["record_id"])] for r in rows if r["record_type"] == "response")
    assert all(r["payload"] is None for r in rows if r["record_type"] == "revisit")


def test_files_are_standard_gzip_members(pages, tmp_path):
    manifest = warc.write_warc(pages, str(tmp_path / "w")).collect()
    assert sum(r["records"] for r in manifest) == 16
    for r in manifest:
        data = open(r["path"], "rb").read()
        assert len(data) == r["bytes"] == os.path.getsize(r["path"])
        assert gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type: ") == r["records"]
        first = zlib.decompressobj(31)
        assert first.decompress(data).startswith(b"WARC/1.1\r\n") and first.eof


def test_false_magic_and_damage(spark, tmp_path):
    """Bytes that look like a member are not taken, a broken one is passed over."""
    def member(i, payload):
        digest = hashlib.sha256(payload).hexdigest()
        return gzip.compress(warc.record(f"urn:page:{i}", "u", payload, digest, None))
    good = [member(i, b"p%d" % i * 10) for i in range(4)]
    broken = bytearray(member(9, os.urandom(400)))
    broken[-20] ^= 0xFF
    noise = b"\x1f\x8b\x08\x00junk\x1f\x8b\x08" + gzip.compress(b"not a record") + b"\x1f\x8b\x08"
    data = good[0] + noise + good[1] + bytes(broken) + good[2] + b"\x1f\x8b" + good[3] + b"\x1f"
    path = str(tmp_path / "x.warc.gz")
    open(path, "wb").write(data)
    manifest = spark.createDataFrame([(path, len(data))], "path string, bytes long")
    for size in (7, 100, 1 << 20):
        got = warc.read_warc(spark, manifest, size).collect()
        assert sorted(page(r["record_id"]) for r in got) == [0, 1, 2, 3]


@pytest.mark.parametrize("range_bytes", [5000, 1 << 23])
def test_long_urls(spark, tmp_path, range_bytes):
    """A header may be of any length, easy to compress or not."""
    rng = random.Random(1)
    any_kind = lambda n: "data:," + "".join(rng.choices(string.ascii_letters + string.digits + "é-_%", k=n))
    urls = ["u", "x" * 66_000, any_kind(70_000), any_kind(200_000), "y" * 3_000_000, "é" * 40_000, "v"]
    body = "same payload " * 20
    pages = spark.createDataFrame([(i, u, body if i in (3, 5, 6) else f"page {i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    manifest = warc.write_warc(pages.repartition(2), str(tmp_path / "w"))
    rows = warc.read_warc(spark, manifest, range_bytes).collect()
    assert len(rows) == sum(r["records"] for r in manifest.collect()) == len(urls)
    assert {page(r["record_id"]): r["target_uri"] for r in rows} == dict(enumerate(urls))
    assert {page(r["record_id"]): page(r["refers_to"]) for r in rows if r["record_type"] == "revisit"} == {5: 3, 6: 3}


def test_records_that_are_not_found_are_an_error(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_BYTES", 300)
    manifest = warc.write_warc(pages.repartition(2), str(tmp_path / "w"))
    for r in manifest.collect():
        assert sum(r["begin"]) == r["records"] and len(r["begin"]) == -(-r["bytes"] // 300)
    assert warc.read_warc(spark, manifest, 900).count() == warc.read_warc(spark, manifest, 300).count() == 16
    path = manifest.first()["path"]
    data = bytearray(open(path, "rb").read())
    data[-20] ^= 0xFF
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="records begin in bytes"):
        warc.read_warc(spark, manifest, 300).count()


def test_empty(spark, pages, tmp_path):
    manifest = warc.write_warc(pages.where("false"), str(tmp_path / "w"))
    assert manifest.count() == 0 and warc.read_warc(spark, manifest).count() == 0
