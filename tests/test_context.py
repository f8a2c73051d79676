import json

from pyspark.sql import functions as F

from codemap.operators import context as CX
from codemap.operators import ingest as I
from codemap.operators import llm_output as LO
from codemap.plans.report import latest_reply

from conftest import files_df


def test_clean_and_parse_context(spark):
    raw = [("r", 1, '```json\n{"summary": "s", "tech_stack": ["a", "a"], "keywords": "x"}\n```'),
           ("r", 2, '{"summary": 7, "main_modules": null, "domain": "web"}'),
           ("r", 3, "Sure! not json"),
           ("r", 4, "[1, 2]")]
    df = spark.createDataFrame(raw, "repo_id string, response_id bigint, raw string")
    got = {r.response_id: r for r in CX.parse_context(df).collect()}
    assert got[1].parse_ok and got[1].summary == "s" and got[1].tech_stack == ["a", "a"] and got[1].keywords == []
    assert got[2].parse_ok and got[2].summary == "" and got[2].domain == "web" and got[2].main_modules == []
    assert not got[3].parse_ok and not got[4].parse_ok
    assert CX.pick_context(CX.parse_context(df)).collect()[0].response_id == 1


def test_clean_modules(spark):
    df = spark.createDataFrame([(["routing", "src/app.py", "api.py", " routing ", "", "cli", "x.rs"] + [f"m{i}" for i in range(10)],)],
                               "m array<string>")
    assert df.select(CX.clean_modules(F.col("m"))).collect()[0][0] == ["routing", "cli", "m0", "m1", "m2", "m3", "m4", "m5"]


def test_entry_point_repair_cascade(spark):
    tree = I.ingest(files_df(spark, [
        ("r", "src/pkg/cli.py", "x"), ("r", "src/main.py", "x"), ("r", "tools/run.py", "x"),
        ("r", "a/x_server.py", "x"), ("r", "b/server.py", "x"), ("r", "lib/index.js", "x")]))
    raw = spark.createDataFrame([("r", 0, "./main.py"), ("r", 1, "pkg/cli.py"), ("r", 2, "run.py"),
                                 ("r", 3, "server.py"), ("r", 4, "index.js"), ("r", 5, " "), ("r", 6, "ver.py")],
                                "repo_id string, ep_ord int, raw string")
    got = {r.ep_ord: r.path for r in CX.normalise_entry_points(raw, tree).collect()}
    assert got[0] == "src/main.py"          # src/ layout
    assert got[1] == "src/pkg/cli.py"       # unique suffix
    assert got[2] == "tools/run.py"         # unique suffix
    assert got[3] == "b/server.py"          # two paths end with 'server.py'; the file name is unique
    assert got[4] == "lib/index.js"
    assert got[5] is None
    assert got[6] is None                   # suffix 'ver.py' matches two paths, no file named ver.py


def test_scores(spark):
    df = spark.createDataFrame([("src/app/main.py", 'if __name__ == "__main__":\n  argparse'), ("pkg/__init__.py", ""),
                                ("tests/main.py", ""), ("README.md", "")], "path string, content string")
    rows = df.select(CX.context_score("path").alias("c"), CX.entry_score("path", "content").alias("e"),
                     CX.entry_valid("path", "content").alias("v")).collect()
    assert [r.c for r in rows] == [2 + 2 + 4, 0 + 1, -100, 0]
    assert [r.e for r in rows] == [8 + 3 + 6 + 6, -3, -100, -100]
    assert [r.v for r in rows] == [True, False, False, False]


def test_architecture_reply_parsing(spark):
    raw = [("r", 1, 'Here:\n```json\n{"narrative_summary": "n", "flow_mermaid": " graph TD ", "evidence_map": [{"node_id": "a", "file": "f.py", "start_line": 1, "end_line": 2}]}\n```\nthanks'),
           ("r", 2, '{"architecture_mermaid": "graph LR", "flow_mermaid": ["a", "b"]}'),
           ("r", 3, "no json"), ("r", 4, '{"flow_mermaid": {"k": 1}}'), ("r", 5, '"just a string"')]
    df = spark.createDataFrame(raw, "repo_id string, response_id bigint, raw string")
    got = {r.response_id: r for r in LO.parse_architecture(df).collect()}
    assert got[1].parse_ok and got[1].narrative_summary == "n" and got[1].flow_mermaid == ["graph TD"]
    assert json.loads(got[1].evidence_map[0]) == {"node_id": "a", "file": "f.py", "start_line": 1, "end_line": 2} and got[1].architecture_mermaid == ""
    assert got[2].flow_mermaid == ["a", "b"] and got[2].narrative_summary == ""
    assert not got[3].parse_ok and got[3].architecture_mermaid.startswith("graph TD")
    assert got[4].flow_mermaid == [] and not got[5].parse_ok


def test_replies_with_equal_keys_and_mixed_lists(spark):
    raw = [("r", 1, '{"summary": "a", "summary": "b", "main_modules": [1, "routing", true, {"k": 1}, null, "cli"], "entry_points": ["main.py", 3]}')]
    got = CX.parse_context(spark.createDataFrame(raw, "repo_id string, response_id bigint, raw string")).collect()[0]
    assert got.parse_ok and got.summary == "b" and got.main_modules == ["routing", "cli"] and got.entry_points == ["main.py"]


def test_evidence_entries_pass_through(spark):
    raw = [("r", 1, '{"evidence_map": [{"file": "f.py", "start_line": 12.5, "end_line": "12-20", "note": "x"}, "loose", null, 7], "narrative_summary": "x", "narrative_summary": "y"}')]
    got = LO.parse_architecture(spark.createDataFrame(raw, "repo_id string, response_id bigint, raw string")).collect()[0]
    assert [json.loads(e) for e in got.evidence_map] == [{"file": "f.py", "start_line": 12.5, "end_line": "12-20", "note": "x"}, "loose", None, 7]
    assert got.narrative_summary == "y"


def test_latest_reply_that_parses(spark):
    raw = [("r", 1, '{"narrative_summary": "one"}'), ("r", 2, '{"narrative_summary": "two"}'), ("r", 3, "Sure!"), ("s", 1, "Sure!"), ("s", 2, "No.")]
    parsed = LO.parse_architecture(spark.createDataFrame(raw, "repo_id string, response_id bigint, raw string"))
    assert {(r.repo_id, r.response_id) for r in latest_reply(parsed).collect()} == {("r", 2), ("s", 2)}


def test_fallback_files_are_scored_once(spark):
    """What is read of them afterwards are their scores, not their texts."""
    tree = I.ingest(files_df(spark, [("r", "main.py", "app = FastAPI()"), ("r", "lib/run.py", "x"), ("s", "lib/run_cli.py", "import argparse\nclick.command"), ("s", "a.py", "y")]))
    files = CX.context_files(tree, tree.select("repo_id", "path").where("path = 'main.py' OR path = 'a.py'"))
    got = CX.fallback_entry_points(files, tree)
    assert "content" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.repo_id, r.path, r.score, r.tier) for r in got.collect()} == {("r", "main.py", 17, 1), ("r", "lib/run.py", 11, 1), ("s", "lib/run_cli.py", 15, 2)}
