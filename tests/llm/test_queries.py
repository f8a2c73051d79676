"""The registered queries over whole small tables, against brute force (no SQL form) or DuckDB (tools/check_oracle.py)."""
import hashlib
import html
import re
import zlib

import numpy as np
import pytest

import test_packing
import test_secrets
import test_simhash
import test_suffix_dedup
import test_warc
from codemap.llm import oracle
from codemap.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def pages(spark):
    return [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]


def test_one_query_for_each_operator():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES] == list(range(1, 1 + len(QUERIES)))
    assert set(oracle.SQL) <= set(QUERIES)


def test_op1(spark, documents):
    got = QUERIES["op1_simhash"](spark, SF).select("doc_id", "fingerprint", "component_id").collect()
    assert len(got) == len(documents) and {tuple(r) for r in got} == test_simhash.brute_components(documents)


def test_op4(spark, pages):
    got = QUERIES["op4_html"](spark, SF).collect()
    source = {p: (u, h) for p, u, h in pages}
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*?)</article>", source[r.page_id][1], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<br>|</?p>|</?h1>", " ", inner))).split())
        assert (r.url, r.text, r.n_chars) == (source[r.page_id][0], want, len(want))


def test_op5(spark, documents):
    texts = dict(documents)
    got = QUERIES["op5_secrets"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        base = test_secrets.brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(base.count(k) for k in ("assign:", "access:", "hex:"))
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_op6(spark, documents):
    want = {d: (n, gone, spans, hashlib.sha256(kept).hexdigest()) for (d, _), (kept, n, gone, spans) in zip(documents, test_suffix_dedup.brute([t for _, t in documents], 200))}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op6_substrings"](spark, SF).collect()}
    assert got == want and any(w[1] for w in want.values())


def test_op7(spark, documents):
    got = QUERIES["op7_packing"](spark, SF).collect()
    want = set()
    for d, t in documents:
        ids = test_packing.direct_ids(t)
        want |= {(d, k, at, len(ids[at:at + 4096]), zlib.crc32(np.array(ids[at:at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096))}
    assert len(got) == len(want) and {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want
    assert test_packing.check(got, 4096) <= -(-sum(r.length for r in got) // 4096) + 1


def test_op8(spark, pages):
    got = [tuple(r) for r in QUERIES["op8_warc"](spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == test_warc.brute(pages)
