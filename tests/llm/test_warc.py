import base64
import gzip
import hashlib

import pytest

from codemap.llm import warc
from codemap.llm.common import Scratch

PAGES = [(4, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (9, "http://b/", None), (7, "http://b/x", ""), (5, None, "é" * 50),
         (6, "http://c/\r\nX: y", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n"), (6, "http://c/", "twice"), (6, "http://c/", "twice"),
         (None, "http://n/", "<p>same</p>"), (None, "http://n/", "only null"), (None, "http://n/", "only null"), (8, "http://d", "x" * 300_000)]


def brute(pages, least=0):
    out, first = [], {}
    order = sorted(range(len(pages)), key=lambda i: (pages[i][0] is None, pages[i][0] or 0, i))
    for i in order:
        pid, _, html = pages[i]
        data = (html or "").encode()
        d = base64.b32encode(hashlib.sha1(data).digest()).decode()
        if len(data) >= least and d in first:
            out.append((pid, len(data), d, "revisit", first[d]))
        else:
            first.setdefault(d, pid)
            out.append((pid, len(data), d, "response", None))
    return sorted(out, key=str)


def frame(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'q' as payload", "1 as rid").repartition(3)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip(spark, compression):
    path = Scratch(spark, "test-warc").path("archive")
    warc.archive(frame(spark), path, compression)
    records = warc.read(spark, path)
    assert sorted((tuple(r) for r in warc.catalogue(records).collect()), key=str) == brute(PAGES)
    got = {r.record_id: r for r in records.filter("warc_type = 'response'").collect()}
    assert bytes(got["urn:page:8"].payload) == b"x" * 300_000 and got["urn:page:8"].http_length == 300_000
    assert got["urn:page:5"].target_uri is None
    # predicates: what the reader gives is what Spark would filter, with and without payloads
    every = [r.asDict() for r in warc.read(spark, path, payload=False).collect()]
    assert all(r["payload"] is None for r in every)
    for sql, keep in [("warc_type = 'revisit'", lambda r: r["warc_type"] == "revisit"),
                      ("target_uri like 'http://b%'", lambda r: (r["target_uri"] or "").startswith("http://b")),
                      ("record_id in ('urn:page:5', 'urn:page:9')", lambda r: r["record_id"] in ("urn:page:5", "urn:page:9")),
                      ("content_length > 1000 and refers_to is null", lambda r: r["content_length"] > 1000 and r["refers_to"] is None),
                      ("not (warc_type = 'revisit')", lambda r: r["warc_type"] != "revisit"),
                      ("target_uri is null", lambda r: r["target_uri"] is None)]:
        for payload in (True, False):
            found = warc.read(spark, path, payload=payload).filter(sql).collect()
            assert sorted((r.file, r.offset) for r in found) == sorted((r["file"], r["offset"]) for r in every if keep(r)), sql


def test_filters_reach_the_reader():
    from pyspark.sql.datasource import EqualTo, GreaterThan, Not
    reader = warc.WarcReader({"path": "x"})
    left = list(reader.pushFilters([EqualTo(("warc_type",), "response"), Not(EqualTo(("target_uri",), "u")), GreaterThan(("offset",), 3)]))
    assert len(left) == 1 and len(reader.tests) == 2
    row = {"warc_type": "response", "target_uri": None}
    assert warc._holds(reader.tests[0], row) is True and warc._holds(reader.tests[1], row) is None


def test_least_bytes_and_empty(spark):
    path = Scratch(spark, "test-warc").path("archive")
    warc.archive(frame(spark), path, least_bytes=5)
    assert sorted((tuple(r) for r in warc.catalogue(warc.read(spark, path)).collect()), key=str) == brute(PAGES, 5)
    none = Scratch(spark, "test-warc").path("archive")
    warc.archive(frame(spark).limit(0), none)
    assert warc.read(spark, none).count() == 0


def test_archives_of_others(spark, tmp_path):
    """Members without the length field, plain records in one folder, folded headers; a cut file is an error."""
    record = lambda i, block: (f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:{i}>\r\nwarc-target-uri: http://h/\r\n {i}\r\n"  # noqa: E731
                               f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"
    blocks = [b"one", b"", b"z" * 200_000, b"\r\n\r\nfour"]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(record(i, b)) for i, b in enumerate(blocks)))
    (tmp_path / "b.warc").write_bytes(b"".join(record(i, b) for i, b in enumerate(blocks)))
    got = warc.read(spark, f"file://{tmp_path}")
    assert sorted((r.record_id, bytes(r.payload)) for r in got.collect()) == sorted((f"urn:x:{i}", b) for i, b in enumerate(blocks) for _ in range(2))
    assert {r.target_uri for r in got.filter("record_id = 'urn:x:3'").collect()} == {"http://h/ 3"}
    (tmp_path / "b.warc").write_bytes(record(0, b"whole") + record(1, b"cut")[:-8])
    with pytest.raises(Exception, match="truncated"):
        warc.read(spark, f"file://{tmp_path}/b.warc").collect()
