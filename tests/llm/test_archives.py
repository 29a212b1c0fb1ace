"""Archives as other makers write them: a gzip member per record, plain files, images, no page ids."""

from __future__ import annotations

import gzip
import hashlib

import pytest

from tidings.llm import warc
from tidings.llm.common import prepare

GIF = b"GIF89a" + bytes(range(256)) * 5
PAGE = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n<html>" + b"text " * 300 + "é".encode("latin-1")
PAGE_PAYLOAD = PAGE.split(b"\r\n\r\n", 1)[1]
IMAGE = b"HTTP/1.0 200 OK\r\nContent-Type: image/gif\r\n\r\n" + GIF
RECORDS = [
    ("http://a.example/", PAGE), ("dns:a.example", b"20040101000000\na.example. 10 IN A 10.0.0.1\n"), ("http://a.example/i.gif", IMAGE),
    ("http://b.example/copy", PAGE), ("http://b.example/none", b"HTTP/1.0 404 Not Found\r\n\r\n"), ("http://b.example/é", IMAGE),
]


def archive(version, members):
    parts = [warc.version_block(version, "20040101000000") + b"\n"]
    parts += [warc.arc_record(version, url, f"2004010100000{n}", content, 0) + b"\n" for n, (url, content) in enumerate(RECORDS)]
    return b"".join(gzip.compress(p) for p in parts) if members == "each" else gzip.compress(b"".join(parts)) if members == "one" else b"".join(parts)


@pytest.mark.parametrize("members, name", [("each", "IA-1.arc.gz"), ("one", "part-1.arc.gz"), (None, "crawl.arc")])
@pytest.mark.parametrize("version", [1, 2])
def test_archives_of_other_makers(spark, tmp_path, version, members, name):
    prepare(spark)
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / name).write_bytes(archive(version, members))
    warc.convert(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    files = [f for f in (tmp_path / "out").iterdir() if f.name.startswith("part-")]
    records = [r for f in files for r in warc.parse_warc(gzip.decompress(f.read_bytes()))]
    by_url = {r[0].get("WARC-Target-URI"): r for r in records}
    assert len(records) == len(RECORDS) + 1 and by_url[None][0]["WARC-Type"] == "warcinfo"
    kinds = [by_url[url][0]["WARC-Type"] for url, _ in RECORDS]
    # Of equal payloads without page ids the last one of the last file stays.
    assert kinds == ["revisit", "resource", "revisit", "response", "response", "response"]
    for url, content in RECORDS:
        fields, block = by_url[url]
        if fields["WARC-Type"] == "revisit":
            assert content.startswith(block) and block.endswith(b"\r\n\r\n")
            assert fields["WARC-Refers-To"] in {r[0]["WARC-Record-ID"] for r in records}
        else:
            assert block == content
    assert by_url["dns:a.example"][0]["Content-Type"] == "text/html"
    assert len({r[0]["WARC-Record-ID"] for r in records}) == len(records)
    back = warc.read_warc(spark, str(tmp_path / "out")).collect()
    assert sorted((r["target_uri"], r["payload_bytes"]) for r in back)[:1] == [("dns:a.example", len(RECORDS[1][1]))]
    assert {r["payload_digest"] for r in back if r["record_type"] == "revisit"} == {hashlib.sha1(x).hexdigest() for x in (PAGE_PAYLOAD, GIF)}
    assert all(r["page_id"] is None and r["refers_to"] is None for r in back)


def test_null_and_repeated_page_ids(spark):
    html = "x" * 1200
    df = spark.createDataFrame(
        [(None, "u", html), (5, "u", html), (7, "v", html), (7, "v", html), (None, None, None), (None, "u", html)], "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.pages_through_archives(df).collect()), key=repr)
    assert got == sorted([(None, "revisit", 7, 1200)] * 2 + [(5, "revisit", 7, 1200)] + [(7, "response", None, 1200)] * 2 + [(None, "response", None, 0)], key=repr)
    ids = [r["record_id"] for r in warc.pages_through_archives(df).collect()]
    assert len(set(ids)) == 6


def test_torn_archives_stop(spark):
    with pytest.raises(ValueError, match="too early"):
        warc.unzipped(archive(1, "one")[:-20])
    assert warc.unzipped(b"") == b""
