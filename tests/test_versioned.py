"""Versioned tables: what a version replaces, what a killed job leaves, and what is computed again."""
import os

import pytest

from codemap.plans import report as RP
from codemap.plans import versioned as V

from conftest import files_df


def table(spark, path, n=40):
    t = V.VersionedTable(spark, str(path), buckets=8)
    rows = spark.createDataFrame([(f"r{i}", j, f"v{i}.{j}") for i in range(n) for j in range(i % 4)], "repo_id string, ord int, value string")
    keys = spark.createDataFrame([(f"r{i}", "a") for i in range(n)], "repo_id string, fingerprint string")
    return t, rows, keys


def content(df):
    return sorted(map(tuple, df.collect()))


def test_replacing_a_repository_leaves_the_others(spark, tmp_path):
    t, rows, keys = table(spark, tmp_path / "t")
    assert t.version() == 0 and t.keys().count() == 0
    with pytest.raises(ValueError):
        t.read()
    assert t.replace(rows, keys) == 1 and content(t.read()) == content(rows)
    folders, files = t.manifest()["folders"], {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "data").rglob("*.parquet")}
    new = spark.createDataFrame([("r7", 0, "new")], "repo_id string, ord int, value string")
    assert t.replace(new, spark.createDataFrame([("r7", "b")], "repo_id string, fingerprint string")) == 2
    want = [r for r in content(rows) if r[0] != "r7"] + [("r7", 0, "new")]
    assert content(t.read()) == sorted(want) and content(t.read(1)) == content(rows)
    changed = {b for b, f in t.manifest()["folders"].items() if folders[b] != f}
    assert len(changed) == 1 and all(p.stat().st_mtime_ns == m for p, m in files.items())
    assert dict(map(tuple, t.keys().collect()))["r7"] == "b" and t.keys().count() == 40
    t.replace(new.limit(0), keys.limit(0), gone=spark.createDataFrame([("r7",), ("r6",)], "repo_id string"))
    assert content(t.read()) == [r for r in content(rows) if r[0] not in ("r6", "r7")] and t.keys().count() == 38


def test_a_killed_job_leaves_the_old_version(spark, tmp_path, monkeypatch):
    t, rows, keys = table(spark, tmp_path / "t")
    t.replace(rows, keys)
    with monkeypatch.context() as m:
        m.setattr(V.VersionedTable, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            t.replace(rows.limit(0), keys)
    assert t.version() == 1 and content(t.read()) == content(rows)
    assert t.replace(rows.limit(0), keys) == 2 and t.read().count() == 0
    with pytest.raises(RuntimeError):  # two writers of one version: the second fails
        t._commit(2, {})
    assert t.version() == 2 and not [f for f in os.listdir(tmp_path / "t" / "manifests") if f.startswith(".2-") and not f.endswith(".crc")]


def test_only_what_changed_is_computed(spark, tmp_path):
    t, rows, keys = table(spark, tmp_path / "t")
    asked = []

    def compute(ids):
        asked.append(sorted(r.repo_id for r in ids.collect()))
        return rows.join(ids, "repo_id", "left_semi")

    assert content(t.refresh(keys, compute)) == content(rows) and len(asked[0]) == 40
    assert content(t.refresh(keys, compute)) == content(rows) and len(asked) == 1 and t.version() == 1
    other = keys.selectExpr("repo_id", "if(repo_id = 'r5', 'b', fingerprint) AS fingerprint").where("repo_id <> 'r9'")
    assert content(t.refresh(other, compute)) == [r for r in content(rows) if r[0] != "r9"] and asked[1:] == [["r5"]]


def test_fingerprints(spark):
    schema = "repo_id string, a string, b int"
    rows = [("r", "x", 1), ("r", "x", 1), ("r", None, 2), ("s", "", 3)]
    fp = lambda rows, **k: dict(map(tuple, V.fingerprint(spark.createDataFrame(rows, schema).repartition(3), **k).collect()))
    base = fp(rows)
    assert base == fp(rows[::-1]) and base["r"] != fp(rows[1:])["r"] and base["s"] != fp([("s", None, 3)])["s"]
    assert base["s"] == fp(rows[2:])["s"] and base["r"] != fp(rows, rules="2")["r"]


FILES = [("o/a", "main.py", "import lib\n"), ("o/a", "lib.py", "x = 1\n"), ("o/a", "README.md", "# a"), ("o/b", "main.py", "import util\n@app.get('/x')\ndef f(): pass\n"),
         ("o/b", "util.py", "y = 2\n"), ("o/c", "app.js", "import a from './b'\n"), ("o/c", "b.js", "1\n")]


def test_a_changed_file_recomputes_one_repository(spark, tmp_path, monkeypatch):
    repos = spark.createDataFrame([(r, f"https://github.com/{r}", None) for r in ("o/a", "o/b", "o/c", "o/empty")], "repo_id string, repo_url string, default_branch string")
    replies = spark.createDataFrame([("o/a", 1, '{"summary": "shop", "keywords": ["lib"]}')], "repo_id string, response_id bigint, raw string")
    analysed, graphs, analyse, ranked = [], [], RP.analyse, RP.PR.pagerank

    def counted(files, *args, **kwargs):
        analysed.append(sorted({r.repo_id for r in files.select("repo_id").collect()}))
        return analyse(files, *args, **kwargs)

    def counted_ranks(nodes, edges, **kwargs):
        graphs.append(sorted({r.repo_id for r in nodes.select("repo_id").collect()}))
        return ranked(nodes, edges, **kwargs)

    monkeypatch.setattr(RP, "analyse", counted)
    monkeypatch.setattr(RP.PR, "pagerank", counted_ranks)
    path = str(tmp_path / "reports")
    run = lambda files, replies=replies: sorted(map(str, RP.refresh_reports(path, files, replies, replies, repos).collect()))
    full = lambda files, replies=replies: sorted(map(str, RP.report(analyse(files, replies, replies, repos)).collect()))
    files = files_df(spark, FILES)
    assert run(files) == full(files) and analysed == [["o/a", "o/b", "o/c"]]
    del analysed[:], graphs[:]
    changed = files_df(spark, [(r, p, "import util\nimport main\n" if (r, p) == ("o/b", "main.py") else c) for r, p, c in FILES])
    assert run(changed) == full(changed) and analysed == [["o/b"]] and graphs[0] == ["o/b"]
    del analysed[:], graphs[:]
    assert run(changed) == full(changed) and analysed == []
    other = spark.createDataFrame([("o/a", 2, '{"summary": "store"}')], "repo_id string, response_id bigint, raw string")
    del graphs[:]
    assert run(changed, other) == full(changed, other) and analysed == [["o/a"]]
