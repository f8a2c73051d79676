import base64
import json
import os
import tempfile

from codemap.operators import evidence as EV
from codemap.plans import report as RP
from codemap.sources import listing as SL

CODE = """@app.route("/a")
@router.get('/items/{id}')
async def handler(x):
def h2(y):
  def inner(z):
class Svc:
  session.add(x); mydb.query(); User.objects.filter(); Model.query
"""


def test_evidence_patterns(spark):
    df = spark.createDataFrame([("r", "a.py", CODE, 1)], "repo_id string, path string, content string, file_rank int")
    ev = EV.extract_evidence(df).collect()
    by = {}
    for r in ev:
        by.setdefault(r.kind, []).append((r.pattern_ord, r.match_ord, r.method, r.value))
    assert sorted(by["route"]) == [(0, 1, None, "/a"), (1, 1, "GET", "/items/{id}")]
    assert sorted(by["handler"]) == [(0, 1, None, "handler"), (0, 2, None, "h2"), (1, 1, None, "Svc")]
    assert [v for *_, v in sorted(by["db_call"])] == ["session.add", "db.query", ".objects.filter", "Model.query"]


def test_evidence_cap_per_repository(spark):
    code = "\n".join(f"def f{i}(x):" for i in range(15))
    df = spark.createDataFrame([("r", "a.py", code, 2), ("r", "b.py", code, 1)], "repo_id string, path string, content string, file_rank int")
    capped = EV.cap_evidence(EV.extract_evidence(df)).orderBy("ev_rank").collect()
    assert len(capped) == 20 and capped[0].file == "b.py" and capped[15].file == "a.py"


def test_node_links(spark):
    em = spark.createDataFrame([("r", 1, "n1", "src/auth.py", 10, 20), ("r", 2, "", "src/db.py", 0, None),
                                ("r", 3, "n3", "src/.env", 5, None)],
                               "repo_id string, ord int, node_id string, file string, start_line int, end_line int")
    nodes = spark.createDataFrame([("r", "n1", "Auth"), ("r", "x", "DB layer"), ("r", "y", "nothing here")],
                                  "repo_id string, node_id string, label string")
    repos = spark.createDataFrame([("r", "https://github.com/o/r", None)], "repo_id string, repo_url string, default_branch string")
    got = {r.node_id: (r.rule, r.url) for r in EV.evidence_links(nodes, em, repos).collect()}
    assert got["n1"] == (0, "https://github.com/o/r/blob/main/src/auth.py#L10-L20")
    assert got["x"] == (1, "https://github.com/o/r/blob/main/src/db.py")
    # '.env' has an empty stem, contained in every label
    assert got["y"] == (1, "https://github.com/o/r/blob/main/src/.env#L5")


def test_repo_id_normalise(spark):
    urls = [" https://github.com/Org/Repo.git/ ", "https://www.github.com/o/r/tree/main", "http://gitlab.com/o/r",
            "https://github.com/o", "o/r", "o/r/x", "", "https://github.com/o/r?tab=1"]
    df = spark.createDataFrame([(u,) for u in urls], "repo_url string")
    got = [(r.owner, r.repo, r.error is None) for r in SL.normalise_repo_ids(df).collect()]
    assert got == [("Org", "Repo", True), ("o", "r", True), (None, None, False), (None, None, False),
                   ("o", "r", True), (None, None, False), (None, None, False), ("o", "r", True)]


def test_decode_and_listing_and_checkouts(spark):
    bad = base64.b64encode(b"ok\xff\xfeyes").decode()
    df = spark.createDataFrame([("base64", bad), ("utf-8", "aGk="), ("base64", "!!!")], "encoding string, content_b64 string")
    assert [r.content for r in SL.decode_content(df).collect()] == ["okyes", "", ""]
    d = tempfile.mkdtemp(prefix="codemap-src-", dir="/tmp")
    with open(os.path.join(d, "l.json"), "w") as fh:
        fh.write(json.dumps({"repo_id": "o/r", "tree": [{"path": "a.py", "type": "blob", "size": 3},
                                                        {"path": "src", "type": "tree"}, {"path": "b.md", "type": "blob"}]}) + "\n")
        fh.write(json.dumps({"repo_id": "o/empty"}) + "\n")
    items = SL.scan_listing(SL.read_tree_listings(spark, d)).orderBy("tree_ord").collect()
    assert [(r.repo_id, r.path, r.size_bytes) for r in items] == [("o/r", "a.py", 3), ("o/r", "b.md", 0)]
    root = tempfile.mkdtemp(prefix="codemap-co-", dir="/tmp")
    os.makedirs(os.path.join(root, "o", "r", "src"))
    with open(os.path.join(root, "o", "r", "src", "app.py"), "wb") as fh:
        fh.write(b"import os\n")
    with open(os.path.join(root, "o", "r", "big.bin"), "wb") as fh:
        fh.write(b"x" * 400)
    with open(os.path.join(root, "o", "r", "notes.md"), "wb") as fh:
        fh.write(b"not read")
    os.makedirs(os.path.join(root, "o", "r", "node_modules"))
    with open(os.path.join(root, "o", "r", "node_modules", "x.js"), "wb") as fh:
        fh.write(b"skipped")
    with open(os.path.join(root, "o", "r", "src", "bad.py"), "wb") as fh:
        fh.write(b"ok\xff\xfe\xef\xbf\xbdyes")
    os.makedirs(os.path.join(root, "p", "q"))
    with open(os.path.join(root, "p", "q", "main.py"), "wb") as fh:
        fh.write(b"pass")
    open(os.path.join(root, "p", "q", "empty.py"), "wb").close()  # Spark's listing leaves out files without bytes
    co = SL.read_checkouts(spark, root).collect()
    assert co[0].asDict().keys() == {"repo_id", "path", "tree_ord", "size_bytes", "content"}
    assert {(r.repo_id, r.path, r.content) for r in co} == {
        ("o/r", "src/app.py", "import os\n"), ("o/r", "src/bad.py", "ok\ufffdyes"), ("o/r", "big.bin", None), ("o/r", "notes.md", None), ("p/q", "main.py", "pass")}
    order = [(r.repo_id, r.path) for r in sorted(co, key=lambda r: r.tree_ord)]
    assert order == sorted(order)
    assert "big.bin" not in {r.path for r in SL.read_checkouts(spark, "file://" + root, max_file_size=100).collect()}


def test_listing_and_contents_make_files(spark):
    listing = spark.createDataFrame([("o/r", "a.py", 0, "blob", 3), ("o/r", "src", 1, "tree", None), ("o/r", "b.py", 2, "blob", None)],
                                    "repo_id string, path string, tree_ord bigint, type string, size bigint")
    contents = spark.createDataFrame([("o/r", "a.py", "base64", base64.b64encode(b"import b").decode())], "repo_id string, path string, encoding string, content_b64 string")
    got = {tuple(r) for r in SL.files_of_listing(listing, contents).collect()}
    assert got == {("o/r", "a.py", 0, 3, "import b"), ("o/r", "b.py", 2, 0, None)}


def test_analyse_a_checkout_and_write_reports(spark):
    root, out = tempfile.mkdtemp(prefix="codemap-co-", dir="/tmp"), tempfile.mkdtemp(prefix="codemap-rep-", dir="/tmp")
    texts = {"README.md": "# Shop", "main.py": "from .orders import place\nimport stock.core\n", "orders.py": "def place():\n    return 1\n", "stock/core.py": "x = 1\r\nimport main\r\n"}
    for path, text in texts.items():
        os.makedirs(os.path.dirname(os.path.join(root, "own", "shop", path)), exist_ok=True)
        with open(os.path.join(root, "own", "shop", path), "w", newline="") as fh:
            fh.write(text)
    repos = spark.createDataFrame([("own/shop", "https://github.com/own/shop", "trunk")], "repo_id string, repo_url string, default_branch string")
    none = spark.createDataFrame([], "repo_id string, response_id bigint, raw string")
    a = RP.analyse(SL.read_checkouts(spark, root), none, none, repos)
    RP.write_reports(RP.report(a), out + "/reports")
    got = spark.read.json(out + "/reports").collect()
    assert len(got) == 1 and not any(f.startswith("repo_id=") for f in os.listdir(out + "/reports"))
    assert got[0].total_files == 4 and got[0].signal_files == ["README.md"] and got[0].default_branch == "trunk"
    assert {(e.src, e.dst) for e in a.graph.edges.collect()} == {("main.py", "stock/core.py"), ("stock/core.py", "main.py")}
    assert RP.report(a, list_limit=0).first().signal_files == []
    assert {(r.list, r.value) for r in RP.report_lists(a).collect()} == {("signal_files", "README.md")}


def test_node_labels(spark):
    em = spark.createDataFrame([("r", 1, "", "src/.env"), ("r", 2, "n2", "src/orders.py")], "repo_id string, ord int, node_id string, file string")
    nodes = spark.createDataFrame([("r", "a", ""), ("r", "b", None), ("r", "c", "The ORDERS box"), ("r", "n2", "anything"), ("r", "d", "x" * 3000 + "orders.py")],
                                  "repo_id string, node_id string, label string")
    got = {r.node_id: (r.rule, r.ord) for r in EV.match_nodes(nodes, em).collect()}
    assert got["a"] == got["b"] == (None, None) and got["n2"] == (0, 2)
    assert got["c"][1] in (1, 2) and got["d"][0] == 1
