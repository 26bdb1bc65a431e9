"""Archives: round trip, revisits and frames."""

import base64
import hashlib
import random
import re
from datetime import UTC, datetime

import pytest
import zstandard

from paylens.llm import warc as W
from paylens.llm.common import read
from paylens.session import scratch_path

SF_DIR = "/root/testdata/sf0.001"


def round_trip(spark, pages):
    path = scratch_path(spark, "warc")
    W.write_archives(pages, path)
    return path, W.read_archives(spark, path).collect()


def expected(rows):
    """By plain loops: (page_id, bytes, digest, type, refers_to) for (page_id, html)."""
    out = []
    for k, html in rows:
        data = (html or "").encode()
        same = [j for j, other in rows if (other or "").encode() == data and j is not None]
        first = max(same, default=None)
        revisit = len(data) >= 1000 and first is not None and first != k
        out.append((k, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response",
                    first if revisit else None))
    return out


def by_order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_pages(spark):
    pages = read(spark, SF_DIR, "pages")
    pages = pages.union(pages.selectExpr("page_id + 1000", "url", "html"))
    path, got = round_trip(spark, pages)
    html = {r.page_id: r for r in pages.collect()}
    columns = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
    assert by_order(columns) == by_order(expected([(r.page_id, r.html) for r in html.values()]))
    assert sum(r.record_type == "revisit" for r in got) > 10
    for r in got:
        assert r.intact and r.url == html[r.page_id].url
        assert r.payload is None if r.record_type == "revisit" else r.payload.decode() == html[r.page_id].html


def test_odd_pages(spark):
    long = "é" * 500
    rows = [(1, "u", None), (2, None, ""), (3, "a%0Db\r\nWARC-Type: x%", "<p>" + "x" * 996), (9, "v", long), (4, "v", long),
            (9, "v", long), (None, "w", long), (5, "s", "short"), (6, "s", "short"), (None, None, "n" * 2000),
            (None, None, "n" * 2000), (7, "big", "word " * 200_000)]
    pages = spark.createDataFrame([(*r, 0, "z") for r in rows], "page_id long, url string, html string, payload int, first string")
    _, got = round_trip(spark, pages)
    assert by_order([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]) == by_order(
        expected([(r[0], r[2]) for r in rows])
    )
    assert sorted(str(r.url) for r in got) == sorted(str(r[1]) for r in rows)
    assert all(r.intact for r in got)


def test_empty(spark):
    _, got = round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string"))
    assert got == []


def plain_records(data):
    """Records of an archive by a reader of its own: frames by the Zstandard library, fields by splitting lines."""
    size = int.from_bytes(data[4:8], "little")
    learned = zstandard.ZstdCompressionDict(bytes(data[8 : 8 + size]))
    with zstandard.ZstdDecompressor(dict_data=learned).stream_reader(bytes(data), read_across_frames=True) as stream:
        rest = stream.read()
    while rest:
        head, _, rest = rest.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        assert version == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in lines)
        assert len(fields) == len(lines)
        block, rest = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
        assert rest.startswith(b"\r\n\r\n")
        yield fields, block
        rest = rest[4:]


def test_archives_by_another_reader(spark):
    """Every record has the fields that the standard asks for, and its block is what they say."""
    pages = read(spark, SF_DIR, "pages")
    pages = pages.union(pages.selectExpr("page_id + 1000", "url", "html")).repartition(3)
    path = scratch_path(spark, "warc")
    W.write_archives(pages, path, datetime(2024, 5, 6, 7, 8, 9, tzinfo=UTC))
    html = {r.page_id: r for r in pages.collect()}
    files = spark.read.format("binaryFile").load(path).select("path", "content").collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in files) == [f"pages-0000{k}.warc.zst" for k in range(3)]
    seen, refers = {}, []
    for r in files:
        assert int.from_bytes(r.content[:4], "little") == W.DICTIONARY_FRAME
        first, *records = plain_records(r.content)
        assert first[0]["WARC-Type"] == "warcinfo" and first[0]["Content-Type"] == "application/warc-fields"
        for fields, block in [first, *records]:
            assert re.fullmatch("<urn:uuid:[0-9a-f-]{36}>", fields["WARC-Record-ID"])
            assert fields["WARC-Date"] == "2024-05-06T07:08:09Z" and fields["WARC-Record-ID"] not in seen
            seen[fields["WARC-Record-ID"]] = fields
        for fields, block in records:
            page = html[int(fields["Page-ID"])]
            data = page.html.encode()
            assert fields["WARC-Target-URI"] == page.url
            assert fields["Content-Type"] == "application/http; msgtype=response"
            assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
            http, _, payload = block.partition(b"\r\n\r\n")
            assert http.startswith(b"HTTP/1.1 200 OK\r\n") and f"Content-Length: {len(data)}".encode() in http
            if fields["WARC-Type"] == "revisit":
                refers.append(fields)
                assert payload == b"" and "identical-payload-digest" in fields["WARC-Profile"]
            else:
                assert payload == data and fields["WARC-Type"] == "response"
    assert len(seen) == len(html) + 3 and len(refers) > 10
    for fields in refers:
        other = seen[fields["WARC-Refers-To"]]
        assert other["WARC-Type"] == "response" and other["Page-ID"] == fields["Refers-To-Page"]
        assert other["WARC-Payload-Digest"] == fields["WARC-Payload-Digest"]


def test_the_sample_is_spread(spark, monkeypatch):
    """Records of a late part of the table are learned from as well."""
    monkeypatch.setattr(W, "LEARN_PAGES", 40)
    late = "quite another kind of page, with words of its own kind " * 3
    rows = [(i, f"u{i}", f"<p>{i} plain</p>" if i < 500 else f"<div>{i} {late}</div>") for i in range(1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    learned = W.sampled_dictionary(pages, "2024-01-01T00:00:00Z")
    assert b"another kind of page" in learned and learned == W.sampled_dictionary(pages.repartition(4), "2024-01-01T00:00:00Z")


def test_frames():
    rng = random.Random(1)
    records = [bytes(rng.choice(b"abc P*M\x18\0") for _ in range(rng.randrange(400))) for _ in range(300)]
    for some in ([], records[:1], [b""], [b"same"] * 40, records):
        data = W.SEPARATOR.encode().join(W.archive_frames(iter(some), W.learn_dictionary(some)))
        assert list(W.archive_records(data)) == some
    with pytest.raises(ValueError):
        list(W.archive_records(data[:-5]))
