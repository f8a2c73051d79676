"""Periodic runs against a brute-force version that compares all words at all distances."""
import hashlib
import random
import zlib

import pytest

from codemap.llm import periodic_runs
from codemap.llm.queries import QUERIES


def brute(words: list[str], least: int = 24) -> list[tuple[int, int, int]]:
    """(start, period, length) of every run."""
    found: dict[tuple[int, int], int] = {}
    n = len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 3 * q):
                found.setdefault((i, j + q), q)  # ascending periods: the smallest stays
            i = j + 1
    return sorted((a, q, b - a) for (a, b), q in found.items())


def collapsed(words, runs):
    gone = {i for s, q, n in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in periodic_runs.collapse(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        words = (t or "").split()
        runs = brute(words)
        assert [(r.start, r.period, r.length) for r in got[i].runs] == runs, i
        want = collapsed(words, runs)
        assert got[i].collapsed == (want if runs else None) or (not runs and got[i].collapsed is None)
        assert got[i].collapsed_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[i].n_words == len(words)


def periodic(rng, head, period, times, tail, alphabet):
    word = [f"w{rng.randrange(alphabet)}" for _ in range(period)]
    body = (word * (times + 1))[: int(period * times)]
    return " ".join([f"h{rng.randrange(alphabet)}" for _ in range(head)] + body + [f"t{rng.randrange(alphabet)}" for _ in range(tail)])


def test_random_texts(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(300))) for _ in range(60)]
    texts += [periodic(rng, rng.randrange(70), rng.randrange(1, 70), rng.choice([2, 3, 4, 5, 9]), rng.randrange(70), rng.choice([2, 3, 50])) for _ in range(150)]
    texts += [" ".join(periodic(rng, 5, rng.randrange(1, 40), rng.randrange(2, 8), 5, 4) for _ in range(4)) for _ in range(40)]
    check(spark, texts)


@pytest.mark.parametrize("period", [1, 7, 8, 9, 15, 16, 17, 31, 32, 33, 63, 64, 65, 128])
def test_edges_of_octaves(period):
    """Every place of a run relative to the anchors, and lengths about the least one."""
    for shift in range(0, 2 * period + 9, max(1, period // 5)):
        for extra in (-1, 0, 1):
            size = max(24, 3 * period) + extra
            words = [f"x{i}" for i in range(shift)] + [f"p{i % period}" for i in range(size)] + [f"y{i}" for i in range(9)]
            merged = set()
            for step, start, anchors, ids in periodic_runs.tiles_of(periodic_runs.word_ids([w.encode() for w in words])):
                merged |= set(periodic_runs.fragments(step, start, anchors.tolist(), ids.tolist()))
            at = [f for f in merged if f[0] == period]
            assert (min((f[1] for f in at), default=None), max((f[2] for f in at), default=None)) == (shift, shift + size) or extra < 0


def test_nested_and_long_runs(spark):
    inner = ["a"] * 30 + ["b", "c"]
    texts = [" ".join(inner * 5), " ".join((["a", "b", "a", "c"] * 8 + ["d"]) * 4), " ".join(["z"] * 5000), " ".join(f"q{i % 700}" for i in range(4000)),
             " ".join(["k"] * 23), " ".join(["k"] * 24), " ".join(f"u{i}" for i in range(3000))]
    check(spark, texts)


def test_words_and_edge_cases(spark):
    df = spark.createDataFrame([(1, "a\tb " * 40, 9, 8), (1, "a\tb " * 40, 9, 8), (None, "\xa0 x" * 30, 9, 8), (3, None, None, None), (4, "", 1, 1), (5, "é\x1fé " * 60, 1, 1)],
                               "doc_id long, text string, k long, tiles long").withColumnRenamed("k", "meta.k")
    got = periodic_runs.collapse(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.collapsed) for r in got) == sorted(
        [(False, 1, "a b"), (False, 1, "a b"), (True, 0, "\xa0 x\xa0 x"), (False, 3, None), (False, 4, None), (False, 5, "é\x1fé")], key=lambda r: (r[0], r[1]))
    assert periodic_runs.collapse(df.limit(0)).collect() == []


def rewritten(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    words = [w.decode() for w in words]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        words = rewritten(d.doc_id, d.text)
        runs, r = brute(words), got[d.doc_id]
        lines = "".join(f"{s},{n},{q}\n" for s, q, n in runs)
        best = min(runs, key=lambda x: (-x[2] / x[1], x[0], x[1]), default=None)
        want = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
        assert (r.n_runs, (r.start, r.length, r.period, r.exponent_milli)) == (len(runs), want)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
        some += bool(runs)
    assert some > 10
