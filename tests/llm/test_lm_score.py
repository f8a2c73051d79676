import math
import random

import numpy as np
import pytest

from codemap.llm import lm_score


def brute(texts, order, alpha=0.4):
    docs = [(t or "").split() for t in texts]

    def count(words):
        out = {}
        for n in range(1, order + 1):
            for i in range(len(words) - n + 1):
                g = tuple(words[i:i + n])
                out[g] = out.get(g, 0) + 1
        return out

    every = {}
    for c in map(count, docs):
        for g, k in c.items():
            every[g] = every.get(g, 0) + k
    out = []
    for words in docs:
        own, rest, total = count(words), sum(map(len, docs)) - len(words), 0.0
        c = lambda g: every[g] - own[g]
        for i in range(len(words)):
            start = min(order, i + 1)
            for n in range(start, 0, -1):
                g = tuple(words[i - n + 1:i + 1])
                if c(g) > 0:
                    total += (start - n) * math.log(alpha) + math.log(c(g) / (c(g[:-1]) if n > 1 else rest))
                    break
            else:
                total += start * math.log(alpha) - math.log(max(rest, 1))
        out.append((len(words), total))
    return out


def corpus():
    rnd = random.Random(7)
    say = lambda k: " ".join(f"w{int(rnd.paretovariate(0.6))}" for _ in range(k))
    texts = [say(rnd.randint(0, 60)) for _ in range(80)] + [None, "", " \n", "unique words only here", "the " * 3000]
    return texts + texts[:5] + [texts[3]] * 4


@pytest.mark.parametrize("order,small", [(1, False), (2, True), (3, True), (3, False)])
def test_equals_brute_force(spark, monkeypatch, order, small):
    if small:  # many blocks and partitions
        monkeypatch.setattr(lm_score, "BLOCK_BYTES", 700)
        monkeypatch.setattr(lm_score, "PARTITION_ENTRIES", 500)
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as n", "'x' as block")
    got = {r.doc_id: r for r in lm_score.score(df, order=order).collect()}
    assert len(got) == len(texts)
    for i, (n, total) in enumerate(brute(texts, order)):
        assert got[i].n_words == n and math.isclose(got[i].log_score, total, rel_tol=1e-9, abs_tol=1e-9), i
        assert (got[i].mean_log_score is None) == (n == 0)


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "c")], "doc_id long, text string")
    got = lm_score.score(df).collect()
    assert sorted((r.doc_id is None, round(r.log_score, 6)) for r in got) == sorted([(True, round(math.log(1 / 3), 6))] * 2 + [(False, round(math.log(0.4) - math.log(4), 6))])
    assert lm_score.score(df.limit(0)).count() == 0


def test_packing_of_keys():
    rnd = np.random.default_rng(1)
    for keys in (rnd.integers(0, 2**64, 1000, np.uint64), np.array([5], np.uint64), np.array([1, 2**63, 2**64 - 1], np.uint64), np.arange(9, dtype=np.uint64)):
        keys = np.unique(keys)
        assert (lm_score.unpacked(lm_score.packed(keys)) == keys).all()
        assert (lm_score._wide(lm_score._small(keys % np.uint64(70_000))) == (keys % np.uint64(70_000)).astype(np.int64)).all()
