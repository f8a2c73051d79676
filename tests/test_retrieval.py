import math
from collections import Counter

from pyspark.sql import functions as F

from codemap import constants as K
from codemap.operators import ingest as I
from codemap.operators import lexical as LX
from codemap.operators import rank as RK

from conftest import files_df


def bm25_py(corpus, query, k1=1.5, b=0.75, eps=0.25):
    n = len(corpus)
    avgdl = sum(len(d) for d in corpus) / n
    df = Counter()
    for d in corpus:
        df.update(set(d))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    avg = sum(idf.values()) / len(idf)
    idf = {t: (eps * avg if v < 0 else v) for t, v in idf.items()}
    out = []
    for d in corpus:
        tf = Counter(d)
        s = 0.0
        for q in query:
            f = tf.get(q, 0)
            s += idf.get(q, 0) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(d) / avgdl))
        out.append(s)
    return out


def test_token_estimate_and_truncation(spark):
    df = spark.createDataFrame([("a" * 400,), ("b" * 7000,), (None,)], "c string")
    rows = df.select(RK.token_estimate(F.col("c")).alias("t"), F.length(RK.truncated("c")).alias("n")).collect()
    assert rows[0].t == 100
    assert rows[1].n == K.MAX_CHARS_PER_FILE + len(K.TRUNCATION_MARKER)
    assert rows[2].n == 0


def test_bm25_matches_plain_python(spark):
    docs = [("src/auth/login.py", "def login(user): return auth(user) login"),
            ("src/payments/checkout.py", "x"),
            ("README.md", "Login and payments; the auth module. " * 20),
            ("src/app.py", "import auth\nimport payments\napp = App()")]
    cands = spark.createDataFrame([("r", p, c) for p, c in docs], "repo_id string, path string, content string")
    kws = spark.createDataFrame([("r", 0, "auth"), ("r", 1, "Login"), ("r", 2, "auth import")],
                                "repo_id string, kw_ord int, keyword string")
    got = {r.path: r.bm25_raw for r in LX.bm25_scores(cands, kws).collect()}
    assert len(got) == 4  # one score per file
    corpus = [(p + " " + c).lower().split() for p, c in docs]
    want = bm25_py(corpus, "auth login auth import".split())
    for (p, _), w in zip(docs, want):
        assert abs(got[p] - w) < 1e-9


def test_budget_pick_stops_at_first_overflow(spark):
    """The eighth file does not fit; the ninth would, but comes after it."""
    chars = [4000, 4000, 100, 100, 100, 100, 100, 40000, 40, 40, 40]
    rows = [("r", f"f{i}.py", i, n, float(100 - i)) for i, n in enumerate(chars)]
    ranked = spark.createDataFrame(rows, "repo_id string, path string, tree_ord bigint, chars int, score double")
    picked = RK.budget_select(ranked, 2500).orderBy("rank").collect()
    assert [r.path for r in picked] == ["f0.py", "f1.py", "f2.py", "f3.py", "f4.py", "f5.py", "f6.py"]
    assert [r.tokens for r in picked] == [1000, 1000, 25, 25, 25, 25, 25] and picked[-1].cum_tokens == 2125
    every = RK.budget_select(ranked, 10 ** 9).orderBy("rank").collect()
    assert [r.path for r in every] == [f"f{i}.py" for i in range(10)]
    assert every[7].tokens == 1506  # 6,000 characters and the marker


def test_picked_files_get_their_texts(spark):
    tree = files_df(spark, [("r", "a.py", "x" * 7000), ("r", "b.py", "short")])
    picked = spark.createDataFrame([("r", "a.py", 1), ("r", "b.py", 2)], "repo_id string, path string, rank int")
    got = {r.path: r for r in RK.with_texts(picked, tree).collect()}
    assert len(got["a.py"].full_content) == 7000 and len(got["a.py"].content) == 6000 + len(K.TRUNCATION_MARKER)
    assert got["b.py"].content == got["b.py"].full_content == "short"


def test_fetch_quota_takes_pinned_names_first(spark):
    tree = I.filter_tree(files_df(spark, [
        ("r", "deep/er/main.py", "x", 9), ("r", "z.py", "x", 5), ("r", "a.py", "x", 5), ("r", "app.js", "x", 7), ("r", "src/b.ts", "x", 1),
        ("r", "README.md", "x", 1), ("r", "setup.py", "x", 1), ("r", "small.py", "x", 2), ("r", "logo.png", "x", 1), ("r", "dist/c.py", "x", 1)]))
    got = [r.path for r in I.quota_ranks(tree, 5).orderBy("quota_rank").collect()]
    assert got == ["app.js", "deep/er/main.py", "small.py", "z.py", "a.py"]


def test_scores_cover_every_file(spark):
    cands = spark.createDataFrame([("r", "lib/session.py", "x"), ("r", "lib/orders.py", "y")], "repo_id string, path string, content string")
    kws = spark.createDataFrame([("r", 0, "orders"), ("r", 1, "session")], "repo_id string, kw_ord int, keyword string")
    assert {r.path for r in LX.bm25_scores(cands, kws).collect()} == {"lib/session.py", "lib/orders.py"}


def test_prompt_parts_concatenate_to_the_prompt(spark):
    from codemap.operators import context as CX
    from codemap.operators import graph as G
    from codemap.plans import prompts as PM
    rows = [("o/a", f"pkg{i}/README.md", "é" * (i % 1500)) for i in range(1500)] + [("o/a", "main.py", "import x"), ("o/b", "main.py", "y = 1"), ("o/b", "lib.py", None)]
    tree = I.ingest(files_df(spark, rows))
    central = G.nodes_of(tree).select("repo_id", F.col("id").alias("path")).where("path LIKE '%.py'")
    files = CX.context_files(tree, central)
    repos = spark.createDataFrame([("o/a",), ("o/b",), ("o/none",)], "repo_id string")
    whole = {r.repo_id: r.prompt for r in PM.context_prompt(tree, files, repos).collect()}
    parts = PM.context_prompt_parts(tree, files, repos, part_files=100)
    got = {}
    for r in parts.orderBy("repo_id", "section", "part").collect():
        got[r.repo_id] = got.get(r.repo_id, "") + r.text
        assert len(r.text) <= 100 * (K.SIGNAL_EXCERPT_CHARS + 40) + 20_000
    assert got == whole
    assert {(r.repo_id, r.n_parts, r.chars) for r in PM.prompt_manifest(parts).collect()} == {
        ("o/a", 17, len(whole["o/a"])), ("o/b", 2, len(whole["o/b"])), ("o/none", 2, len(whole["o/none"]))}
