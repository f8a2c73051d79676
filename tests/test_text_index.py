"""The stored inverted index: equal scores, equal best files, and what is read for them."""
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codemap import session
from codemap.operators import lexical as LX
from codemap.operators import text_index as TI


def corpus(spark, seed, repos=3, files=60):
    """Files whose words are Zipf-like, so some terms are in most files and get the floored idf."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = [(f"r{r}", f"d/f{i}.py", " ".join(rnd.choices(words, weights, k=rnd.randrange(0, 150)))) for r in range(repos) for i in range(files)]
    rows += [("small", "a", "w0 w0 w1"), ("small", "b", None), ("one", "x", "w0 w3")]
    kws = [(f"r{r}", i, " ".join(rnd.sample(words, rnd.randrange(1, 4))).upper()) for r in range(repos) for i in range(rnd.randrange(1, 4))]
    kws += [("small", 0, "w0 w0"), ("one", 0, "w3 nothing"), ("absent", 0, "w1")]
    return (spark.createDataFrame(rows, "repo_id string, path string, content string").repartition(5),
            spark.createDataFrame(kws, "repo_id string, kw_ord int, keyword string"))


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(TI, "BLOCK", 4)


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_and_best_files_equal_full_scoring(spark, small, tmp_path, seed):
    cands, kws = corpus(spark, seed)
    index = TI.build(cands, f"{tmp_path}/index")
    full = {(r.repo_id, r.path): (r.bm25_raw, r.bm25) for r in LX.bm25_scores(cands, kws).collect()}
    got = {(r.repo_id, r.path): (r.bm25_raw, r.bm25) for r in index.scores(kws).collect()}
    assert got.keys() == full.keys() and all(math.isclose(a, b, abs_tol=1e-9) for k in got for a, b in zip(got[k], full[k]))
    terms = {(r.repo_id, r.term) for r in LX.query_terms(kws).collect()}
    named = {(r.repo_id, r.path) for r in LX.doc_terms(cands).collect() if (r.repo_id, r.term) in terms}
    for k in (1, 3, 10, 50):
        want = set()
        for repo in {r for r, _ in named}:
            best = sorted((-round(full[key][0], 9), key[1]) for key in named if key[0] == repo)[:k]
            want |= {(repo, i + 1, path, -s) for i, (s, path) in enumerate(best)}
        assert {(r.repo_id, r.rank, r.path, round(r.bm25_raw, 9)) for r in index.top(kws, k).collect()} == {(a, b, c, round(d, 9)) for a, b, c, d in want}


def test_blocks_that_cannot_reach_the_best_are_not_read(spark, small, tmp_path):
    rows = [("r", f"f{i}", "rare " * (20 if i < 5 else 0) + "common " * (1 + (i % 3 == 0)) + f"pad{i} " * (i % 17)) for i in range(300)]
    rows += [("r", f"g{i}", f"other{i} words") for i in range(400)]
    cands = spark.createDataFrame(rows, "repo_id string, path string, content string")
    kws = spark.createDataFrame([("r", 0, "rare common")], "repo_id string, kw_ord int, keyword string")
    index = TI.build(cands, f"{tmp_path}/index")
    read = {(r.term, r.essential): r["sum(n)"] for r in index.reachable(kws, 3).groupBy("term", "essential").agg({"n": "sum"}).collect()}
    assert read[("rare", True)] == 5 and ("common", True) not in read
    one = spark.createDataFrame([("r", 0, "common")], "repo_id string, kw_ord int, keyword string")
    assert sum(r.n for r in index.reachable(one, 3).collect()) < 100
    assert [r.path for r in index.top(kws, 3).orderBy("rank").collect()] == [
        r.path for r in LX.bm25_scores(cands, kws).orderBy("bm25_raw", ascending=False).limit(3).collect()]


def test_a_query_opens_only_its_terms_folders(spark, tmp_path):
    cands, _ = corpus(spark, 3)
    index = TI.build(cands, f"{tmp_path}/index")
    kws = spark.createDataFrame([("r1", 0, "w7"), ("r2", 0, "w9")], "repo_id string, kw_ord int, keyword string")
    want = [tuple(r) for r in index.top(kws, 3).orderBy("repo_id", "rank").collect()]
    wanted = {f"bucket={r.bucket}" for r in LX.query_terms(kws).select(TI._bucket()).collect()}
    broken = 0
    for file in tmp_path.glob("index/*/bucket=*/*.parquet"):
        if file.parent.name not in wanted:
            file.write_bytes(b"not parquet")
            broken += 1
    spark.catalog.clearCache()
    assert broken > 20 and want
    assert [tuple(r) for r in index.top(kws, 3).orderBy("repo_id", "rank").collect()] == want
    scored = {(r.repo_id, r.path) for r in index.scores(kws).where("bm25_raw <> 0").collect()}
    assert scored and {r for r, _ in scored} == {"r1", "r2"}


def test_terms_are_counted_without_a_shuffle(spark):
    cands, _ = corpus(spark, 4)
    plan = LX.doc_terms(spark.createDataFrame(cands.collect(), cands.schema))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    got = {(r.repo_id, r.path, r.term): (r.tf, r.dl) for r in LX.doc_terms(cands).collect()}
    for repo, path, content in cands.collect():
        words = f"{path} {content or ''}".lower().split()
        for w in set(words):
            assert got.pop((repo, path, w)) == (words.count(w), len(words))
    assert not got


def test_blocks_are_cut_alike_whatever_the_batches(spark):
    rows = [("r", f"t{i // 7 % 5}", i // 40 % 2, f"p{i}", (i * 37 % 11) / 7) for i in range(400)]
    rows = sorted(rows, key=lambda r: r[:3]) + [("s", "t4", 1, "p", 1.0)]
    whole = pa.RecordBatch.from_pydict({"bucket": pa.array([3] * len(rows), pa.int32()), "repo_id": [r[0] for r in rows], "term": [r[1] for r in rows], "level": pa.array([r[2] for r in rows], pa.int32()),
                                        "path": [r[3] for r in rows], "impact": [r[4] for r in rows]})
    want = {}
    for repo, term, level, path, impact in rows:
        want.setdefault((repo, term, level), []).append({"path": path, "impact": impact})
    for size in (1, 3, 8, 64, len(rows)):
        got = {}
        for batch in TI._cut((whole.slice(i, size) for i in range(0, len(rows), size)), 8):
            for r in batch.to_pylist():
                own = got.setdefault((r["repo_id"], r["term"], r["level"]), [])
                scores = [p["impact"] for p in r["posts"]]
                assert r["part"] * 8 == len(own) and r["n"] == len(scores) <= 8 and (r["best"], r["worst"], r["bucket"]) == (max(scores), min(scores) if len(scores) > 1 else None, 3)
                own += r["posts"]
        assert got == want
    assert list(TI._cut(iter([]), 8)) == [] and list(TI._cut(iter([whole.slice(0, 0)]), 8)) == []


def test_no_block_holds_more_than_its_bound_and_terms_add_up(spark, small, tmp_path):
    cands, _ = corpus(spark, 5)
    index = TI.build(cands, f"{tmp_path}/index")
    assert max(len(r.posts) for r in index._read("postings").collect()) == 4
    want = {}
    for r in LX.doc_terms(cands).collect():
        want[r.repo_id, r.term] = want.get((r.repo_id, r.term), 0) + 1
    assert {(r.repo_id, r.term): r.df for r in index._read("terms").collect()} == want


def test_counted_terms_are_not_dealt_to_meet_the_query(spark, monkeypatch):
    """The query's terms are picked where the counted terms lie, and the average idf is that of every term."""
    cands, kws = corpus(spark, 6)
    plans, stage = {}, session.stage

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stage(df, name)

    monkeypatch.setattr(session, "stage", seen)
    LX.bm25_scores(cands, kws).collect()
    assert "BroadcastHashJoin" in plans["query_hits"] and "hashpartitioning" not in plans["query_hits"]
    st = LX.corpus_stats(cands)
    n = {r.repo_id: r.n_docs for r in st["repo"].collect()}
    raw = {}
    for r in st["tf"].groupBy("repo_id", "term").count().collect():
        raw.setdefault(r.repo_id, []).append(math.log(n[r.repo_id] - r["count"] + 0.5) - math.log(r["count"] + 0.5))
    for r in st["repo"].collect():
        assert r.n_terms == len(raw[r.repo_id]) and math.isclose(r.average_idf, sum(raw[r.repo_id]) / r.n_terms, abs_tol=1e-9)


@pytest.mark.parametrize("in_task", [0, 1000, 10 ** 9])
def test_equal_frequencies_of_small_and_large_repositories(spark, monkeypatch, in_task):
    monkeypatch.setattr(LX, "COUNTED_CHARS", 50)
    cands, _ = corpus(spark, 4)
    cands = cands.unionByName(spark.createDataFrame([("odd", None, "no path"), ("odd", "", ""), ("odd", "p", "A a\x1cb B​c"), (None, "x", "w0"), ("odd", "p", "twice")], cands.schema))
    want = {}
    for r in cands.where("path IS NOT NULL").collect():
        for word in set(f"{r.path} {r.content or ''}".lower().split()):
            want[r.repo_id, word] = want.get((r.repo_id, word), 0) + 1
    equal = {}
    for (repo, _), df in want.items():
        if repo is not None:
            equal[repo, df] = equal.get((repo, df), 0) + 1
    sizes = cands.groupBy("repo_id").agg(F.sum(F.length(LX.searched_text())).alias("chars"))
    got = LX.equal_frequencies(cands, sizes, in_task)
    assert {(r.repo_id, r.df): r.n for r in got.collect() if r.repo_id is not None} == equal


def test_query_counts_are_the_terms_asked_for(spark):
    cands, kws = corpus(spark, 5)
    q = LX.query_terms(kws)
    asked = {(r.repo_id, r.term) for r in q.collect()}
    terms = LX.doc_terms(cands).collect()
    got = LX.query_counts(cands, q).collect()
    assert {(r.repo_id, r.path, r.dl, r.term, r.tf) for r in got if r.term} == {(r.repo_id, r.path, r.dl, r.term, r.tf) for r in terms if (r.repo_id, r.term) in asked}
    assert sorted((r.repo_id, r.path, r.dl) for r in got if r.first) == sorted((r.repo_id, r.path, r.dl) for r in terms if r.first)
