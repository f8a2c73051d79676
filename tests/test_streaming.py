import json
import os
import tempfile

from codemap.sources import fixtures as X
from codemap.streaming.requests import start_request_stream


def test_request_stream(spark):
    d = tempfile.mkdtemp(prefix="codemap-stream-", dir="/tmp")
    os.makedirs(f"{d}/in")
    with open(f"{d}/in/a.json", "w") as fh:
        for i, (url, budget, branch) in enumerate([("https://github.com/org/repo3.git", 8000, None), ("org/repo5", 500, "dev"), ("http://example.com/x/y", 10, None),
                                                   ("org/repo5", 100_000, ""), ("org/repo5", 500, None)]):
            fh.write(json.dumps({"request_id": f"q{i}", "repo_url": url, "token_budget": budget, "default_branch": branch}) + "\n")
    sf = "/root/testdata/sf0.001"
    files = X.files(spark, sf)
    replies = X.responses(spark, sf)
    q = start_request_stream(spark, f"{d}/in", f"{d}/out", f"{d}/ckpt", files, replies, replies)
    q.awaitTermination(600)
    rep = {r.request_id: r for r in spark.read.parquet(f"{d}/out/reports").collect()}
    assert {k: (r.repo_id, r.token_budget) for k, r in rep.items()} == {
        "q0": ("org/repo3", 8000), "q1": ("org/repo5", 500), "q3": ("org/repo5", 100_000), "q4": ("org/repo5", 500)}
    assert rep["q1"].default_branch == "dev" and rep["q3"].default_branch == "main"
    assert rep["q1"].selected_files == rep["q4"].selected_files == rep["q3"].selected_files[: len(rep["q1"].selected_files)]
    rej = spark.read.parquet(f"{d}/out/rejected").collect()
    assert [(r.request_id, r.error) for r in rej] == [("q2", "not a github url")]
