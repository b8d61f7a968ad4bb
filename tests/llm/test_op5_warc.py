import base64
import hashlib
import struct

import pytest
import zstandard

from ledgerline.llm import op5_warc as op


@pytest.fixture
def pages(spark):
    return lambda rows: spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, _digest string, records int").repartition(3)


def brute(rows, least=0):
    payload = lambda html: (html or "").encode()
    first = {}
    for page, _, html in rows:
        if page is not None and len(payload(html)) >= least:
            first[payload(html)] = min(page, first.get(payload(html), page))
    out = []
    for page, _, html in rows:
        p = payload(html)
        to = first.get(p)
        to = None if to is None or page is None or page == to else to
        out.append((page, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


CASE = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, None), (4, "http://c", ""), (5, "http://a b\r\nX: y", "é\r\n\r\nü"), (6, "u", "<p>x</p>"), (7, "", "z" * 2_000_000), (7, "", "z" * 2_000_000), (None, "n", "<p>x</p>"), (9, "w", "WARC/1.1\r\nContent-Length: 3\r\n\r\n")]


@pytest.mark.parametrize("least", [0, 5, 10**9])
def test_round_trip_of_odd_pages(pages, least):
    assert rows(op.round_trip(pages(CASE), least)) == brute(CASE, least)


def test_round_trip_of_the_table(spark, small):
    table = spark.read.parquet(f"{small}/pages.parquet").collect()
    assert rows(op.query(spark, small)) == brute([(r.page_id, r.url, r.html) for r in table])


def test_long_pages_have_a_dictionary_too(pages, tmp_path):
    """Every page is over 64 KiB: the dictionary comes from their heads."""
    long = [(k, f"http://h/{k}", "".join(f"<div class='row{(i * 7 + k) % 97}'>item {i} of {k}</div>" for i in range(3000))) for k in range(8)]
    assert all(len(h) > 65536 for _, _, h in long)
    (m, *_) = op.archived(pages(long), f"file://{tmp_path}/warc").collect()
    with open(m.archive.removeprefix("file://"), "rb") as f:
        magic, size = struct.unpack("<II", f.read(8))
    assert magic == 0x184D2A5D and size > 1000
    assert rows(op.round_trip(pages(long))) == brute(long)


def test_archive_layout(spark, small, tmp_path):
    """A dictionary in a leading skippable frame; each record is a frame of its own, readable alone with that dictionary."""
    source = spark.read.parquet(f"{small}/pages.parquet")
    html = {r.page_id: r.html or "" for r in source.collect()}
    manifest = op.archived(source, f"file://{tmp_path}/warc", archive_bytes=20_000).collect()
    assert len(manifest) > 1 and sum(m.records for m in manifest) == len(html)
    for m in manifest:
        with open(m.archive.removeprefix("file://"), "rb") as f:
            data = f.read()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D and len(data) == m.bytes
        dictionary, at, seen = zstandard.ZstdCompressionDict(data[8 : 8 + size]), 8 + size, 0
        while at < len(data):
            frame = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
            record = frame.decompress(data[at:])
            assert frame.eof and record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            at, seen = len(data) - len(frame.unused_data), seen + 1
        assert seen == m.records + 1
        for fields, block in op.read_archive(m.archive):
            if fields["WARC-Type"] == "response":
                assert block.partition(b"\r\n\r\n")[2].decode() == html[int(fields["X-Page-Id"])]


def test_damage_is_an_error(spark, pages, tmp_path):
    (m,) = op.archived(pages([(1, "u", "text " * 100)]).coalesce(1), f"file://{tmp_path}/warc").collect()
    path = m.archive.removeprefix("file://")
    with open(path, "r+b") as f:
        f.truncate(m.bytes - 5)
    with pytest.raises(ValueError):
        list(op.read_archive(m.archive))


def test_no_pages(pages):
    assert op.round_trip(pages([])).collect() == []


def test_payload_of_a_third_of_all_pages(pages):
    case = [(k, f"http://h/{k}", "shared page" if k % 3 == 0 else f"page {k % 40}") for k in range(300)] + [(None, "n", "shared page")] * 5
    assert rows(op.round_trip(pages(case))) == brute(case)
