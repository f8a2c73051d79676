"""The checkout store: what is opened, and what the tables hold."""
import os

from codemap.operators import graph as G
from codemap.plans.ingestion import RepoGraph, ingestion_report
from codemap.sources.store import CheckoutStore


def put(root, path, text, stamp=None):
    file = os.path.join(root, path)
    os.makedirs(os.path.dirname(file), exist_ok=True)
    with open(file, "w") as fh:
        fh.write(text)
    if stamp:
        os.utime(file, (stamp, stamp))


def checkout(root):
    put(root, "o/r/main.py", "import lib\nfrom .util import x\n", 1_700_000_000)
    put(root, "o/r/lib.py", "x = 1\n", 1_700_000_000)
    put(root, "o/r/util.py", "x = 1\n", 1_700_000_000)
    put(root, "o/r/README.md", "# r\n", 1_700_000_000)
    put(root, "o/r/logo.bin", "not text", 1_700_000_000)
    put(root, "p/q/main.py", "import lib\nfrom .util import x\n", 1_700_000_000)


def rows(df):
    return sorted((r.repo_id, r.path, r.size_bytes, r.content) for r in df.collect())


def test_paths_open_no_file(spark, tmp_path):
    checkout(tmp_path / "src")
    store = CheckoutStore(spark, str(tmp_path / "src"), str(tmp_path / "store"))
    listed = store.paths()
    assert {(r.repo_id, r.path, r.content) for r in listed.collect()} == {
        ("o/r", "main.py", None), ("o/r", "lib.py", None), ("o/r", "util.py", None), ("o/r", "README.md", None), ("o/r", "logo.bin", None), ("p/q", "main.py", None)}
    assert RepoGraph(listed).tree.select("path").count() == 6
    assert store.opened.value == 0 and not (tmp_path / "store").exists()


def test_a_full_analysis_opens_every_file_once(spark, tmp_path):
    checkout(tmp_path / "src")
    store = CheckoutStore(spark, str(tmp_path / "src"), str(tmp_path / "store"))
    g = RepoGraph(store.files())
    report = {r.repo_id: r for r in ingestion_report(g).collect()}
    assert (report["o/r"].total_files, report["o/r"].graph_edges, report["o/r"].signal_files) == (5, 1, ["README.md"])
    assert G.degree_stats(g.tree, g.edges).count() and g.central(3).count()
    assert store.opened.value == 5  # not the binary
    assert store.objects.count() == 3 and store.versions.count() == 5  # two pairs of files are equal


def test_a_second_run_opens_what_has_changed(spark, tmp_path):
    root = tmp_path / "src"
    checkout(root)
    store = CheckoutStore(spark, str(root), str(tmp_path / "store"))
    before = rows(store.files())
    again = CheckoutStore(spark, str(root), str(tmp_path / "store"))
    assert rows(again.files()) == before and again.opened.value == 0
    put(root, "o/r/lib.py", "y = 2\n", 1_700_000_100)  # the same length, another time
    put(root, "o/r/new.py", "x = 1\n")
    os.remove(root / "o/r/util.py")
    got = rows(again.files())
    assert again.opened.value == 2
    assert {(p, c) for r, p, _, c in got if r == "o/r"} == {
        ("main.py", "import lib\nfrom .util import x\n"), ("lib.py", "y = 2\n"), ("new.py", "x = 1\n"), ("README.md", "# r\n"), ("logo.bin", None)}
    assert again.objects.count() == 4
    order = [(r.repo_id, r.path) for r in again.files().orderBy("tree_ord").collect()]
    assert order == sorted(order)


def test_a_job_that_died_between_its_tables_is_completed(spark, tmp_path):
    checkout(tmp_path / "src")
    store = CheckoutStore(spark, str(tmp_path / "src"), str(tmp_path / "store"))
    want = rows(store.files())
    for f in (tmp_path / "store" / "versions").glob("*.parquet"):  # objects were written, versions not
        f.unlink()
    assert rows(CheckoutStore(spark, str(tmp_path / "src"), str(tmp_path / "store")).files()) == want
    assert store.objects.count() == 3
