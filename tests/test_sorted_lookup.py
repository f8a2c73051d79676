"""Prefix lookups in a sorted order, against plain loops; few keys and many partitions put them on partition edges."""
import random

import pytest

from codemap.operators import evidence as EV
from codemap.operators import sorted_lookup as SL
from pyspark.sql import functions as F


@pytest.fixture(params=[1, 16])
def parts(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def word(rnd, letters, most):
    return "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, most)))


def test_endings(spark, parts):
    rnd = random.Random(1)
    texts = {(rnd.choice("rs"), word(rnd, "ab/é", 9)) for _ in range(200)}
    wanted = {(rnd.choice("rst"), word(rnd, "ab/é", 6)) for _ in range(80)} | {("r", "zz")}
    got = SL.endings(spark.createDataFrame(sorted(texts), "repo_id string, text string"), spark.createDataFrame(sorted(wanted), "repo_id string, suffix string"))
    got = {(r.repo_id, r.suffix): (r.n, r["first"]) for r in got.collect()}
    assert got.keys() == wanted
    for repo, suffix in wanted:
        ends = [t for r, t in texts if r == repo and t.endswith(suffix)]
        assert got[(repo, suffix)] == (len(ends), ends[0] if len(ends) == 1 else None)


def test_longest_prefixes(spark, parts):
    rnd = random.Random(2)
    keys = {(rnd.choice("rs"), word(rnd, "abc", 5)) for _ in range(40)}
    texts = [(rnd.choice("rst"), i, word(rnd, "abcd", 9)) for i in range(300)]
    frame = spark.createDataFrame(sorted(keys), "repo_id string, key string").withColumn("value", F.array(F.struct(F.length("key").alias("n"))))
    got = SL.longest_prefixes(frame, spark.createDataFrame(texts, "repo_id string, id bigint, text string")).collect()
    assert len(got) == len(texts)
    for r in got:
        before = max((k for repo, k in keys if repo == r.repo_id and k <= r.text), default=None)
        assert r.key == before and (r.value is None if before is None else r.value[0].n == len(before))


def test_node_labels_against_containment(spark, parts):
    rnd = random.Random(3)
    names = [word(rnd, "abx", 6) + rnd.choice(["", ".py", ".PY", ".tar.gz", "."]) for _ in range(60)] + [".env", "aa.py", "a.py"]
    em = [(rnd.choice("rs"), i, rnd.choice(["", f"n{i % 7}"]), f"d/{n}") for i, n in enumerate(names)]
    nodes = [(rnd.choice("rst"), f"n{i}", rnd.choice(["", None, word(rnd, "abx. ", 20), word(rnd, "ABX.py", 30)])) for i in range(60)]
    frame = spark.createDataFrame(em, "repo_id string, ord int, node_id string, file string")
    stems = {r.ord: r.s for r in frame.select("ord", EV._stem("file").alias("s")).collect()}
    got = {(r.repo_id, r.node_id): (r.rule, r.ord) for r in EV.match_nodes(spark.createDataFrame(nodes, "repo_id string, node_id string, label string"), frame).collect()}
    for repo, node, label in nodes:
        own, low = [e for e in em if e[0] == repo], (label or "").lower()
        rules = [(0, e[1]) for e in own if node and e[2] == node]
        if low:
            rules += [(1, e[1]) for e in own if stems[e[1]] in low] + [(2, e[1]) for e in own if e[3].rsplit("/", 1)[-1].lower() in low]
        assert got[(repo, node)] == min(rules, default=(None, None)), (repo, node, label)


def test_a_long_label_makes_a_row_for_each_character(spark, monkeypatch):
    seen, lookup = [], EV.longest_prefixes
    monkeypatch.setattr(EV, "longest_prefixes", lambda keys, texts: (seen.append(texts.count()), lookup(keys, texts))[1])
    label = "".join(random.Random(4).choice("abcdefghij") for _ in range(10_000)) + "handler"
    em = spark.createDataFrame([("r", i, "", f"src/{'k' * (i + 1)}{i}.py") for i in range(50)] + [("r", 99, "", "src/handler.py")], "repo_id string, ord int, node_id string, file string")
    nodes = spark.createDataFrame([("r", "x", label)], "repo_id string, node_id string, label string")
    r = EV.match_nodes(nodes, em).first()
    assert (r.rule, r.ord) == (1, 99) and seen[0] <= len(label)
