import random

import numpy as np
import pytest

from codemap.llm import suffix_dedup
from codemap.llm.suffix_dedup import repeated_windows, stretches, suffix_array


def brute(texts, length):
    """(kept, n_bytes, n_removed, n_spans) of each text, from a dictionary of all windows."""
    data = [(t or "").encode() for t in texts]
    count = {}
    for d in data:
        for i in range(len(d) - length + 1):
            w = d[i:i + length]
            count[w] = count.get(w, 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((bytes(b for b, g in zip(d, gone) if not g), len(d), sum(gone), spans))
    return out


def corpus(seed, n=60):
    rnd = random.Random(seed)
    say = lambda k: " ".join(rnd.choice(["the", "of", "é"]) + str(rnd.randrange(300)) for _ in range(k))
    shared = [say(30), say(12), say(90), "ab" * 90, "x" * 500]
    texts = [None, "", "short", "same text " * 3, "x" * 300, " " * 41, "a" * 40, "a" * 39]
    for _ in range(n):
        parts = [say(rnd.randint(0, 40))]
        for _ in range(rnd.randint(0, 2)):
            p = rnd.choice(shared)
            a = rnd.randrange(len(p))
            parts += [p[a:] if rnd.random() < 0.4 else p[:a] if rnd.random() < 0.4 else p, say(rnd.randint(0, 9))]
        t = rnd.choice(["", " ", "\n"]).join(parts)
        texts.append(t)
        if rnd.random() < 0.2:
            texts.append(t.replace("1", "2", 1))
        if rnd.random() < 0.1:
            texts.append(t)
    return texts


def test_suffix_array_equals_sorting():
    rnd = random.Random(1)
    for _ in range(200):
        strings = [bytes(rnd.choice([97, 98, 0, 255][:rnd.randint(1, 4)]) for _ in range(rnd.randint(1, 40))) for _ in range(rnd.randint(1, 6))]
        ends, at, want = np.cumsum([len(s) for s in strings]), 0, []
        for j, s in enumerate(strings):
            want += [(s[i:], j, at + i) for i in range(len(s))]
            at += len(s)
        assert suffix_array(b"".join(strings), ends).tolist() == [w[2] for w in sorted(want)]
        length = rnd.randint(1, 12)
        if min(map(len, strings)) >= length:
            windows = [s[i:i + length] for s in strings for i in range(len(s) - length + 1)]
            assert np.concatenate(repeated_windows(strings, length)).tolist() == [windows.count(w) > 1 for w in windows]


def test_stretches_cover_every_window_once(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    texts = [(t or "").encode() for t in corpus(3)] + [b"z" * 2500, bytes(random.Random(2).randrange(256) for _ in range(5000))]
    anchor_of = {}
    seen = set()
    for number, start, windows, anchor, _ in zip(*[c.tolist() for c in stretches(texts, 40)]):
        for i in range(start, start + windows):
            assert (number, i) not in seen
            seen.add((number, i))
            assert anchor_of.setdefault(texts[number][i:i + 40], anchor) == anchor
    assert seen == {(n, i) for n, t in enumerate(texts) for i in range(len(t) - 40 + 1)}


@pytest.mark.parametrize("bucket", [2000, 3, 1])
def test_equals_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", 5000)
    monkeypatch.setattr(suffix_dedup, "SALT_ROWS", 4096 if bucket > 3 else 2)
    texts = corpus(5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'q' as k", "2 as c").repartition(3)
    got = {r.doc_id: (bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.dedup(df, length=40).collect()}
    assert got == dict(enumerate(brute(texts, 40)))


def test_a_bucket_of_very_many_near_copies(spark):
    """10,000 texts that differ in two bytes: their stretches meet in buckets of thousands, which are dealt on and sorted."""
    rnd = random.Random(9)
    base = [rnd.choice("abcdefgh ") for _ in range(150)]
    texts = set()
    while len(texts) < 10000:
        t = list(base)
        for _ in range(2):
            t[rnd.randrange(150)] = chr(rnd.randrange(33, 127))
        texts.add("".join(t))
    texts = sorted(texts)
    got = {r.doc_id: (bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=64).collect()}
    assert got == dict(enumerate(brute(texts, 64)))


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(1, text), (1, text), (None, "a" * 60), (None, "b" + "a" * 50), (None, None), (2, text[:45] + "!")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.dedup(df, length=40).collect()), key=str)
    want = brute([t for _, t in rows], 40)
    assert got == sorted(((d, *w) for (d, _), w in zip(rows, want)), key=str)
    assert suffix_dedup.dedup(df.limit(0), length=40).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.dedup(df, length=10)
