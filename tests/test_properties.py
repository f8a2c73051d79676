"""Properties of the fetch quota and of the budgeted pick, on generated inputs."""
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from codemap import constants as K
from codemap.operators import ingest as I
from codemap.operators import rank as RK

from conftest import files_df

NAMES = ["main.py", "App.py", "util.py", "x.ts", "index.js", "a.jsx", "README.md", "setup.py", "b.go"]
SLOW = dict(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


@settings(**SLOW)
@given(st.lists(st.tuples(st.lists(st.sampled_from(["src", "pkg", "lib"]), max_size=3), st.sampled_from(NAMES),
                          st.integers(0, 4)), min_size=1, max_size=25),
       st.integers(1, 8))
def test_quota_takes_the_smallest_keys(spark, items, cap):
    paths = {"/".join([*dirs, f"{i}{name}" if i % 3 else name]): size for i, (dirs, name, size) in enumerate(items)}
    tree = I.filter_tree(files_df(spark, [("r", p, "x", s) for p, s in paths.items()]))
    every = I.quota_ranks(tree, None).collect()
    got = I.quota_ranks(tree, cap).collect()
    key = lambda r: (not r.pinned, r.depth, r.size_bytes, r.tree_ord)
    assert len(got) == min(cap, len(every))
    assert sorted(r.quota_rank for r in got) == list(range(1, len(got) + 1))
    picked = {r.path for r in got}
    left = [key(r) for r in every if r.path not in picked]
    assert not left or max(key(r) for r in got) < min(left)  # no file that is left sorts before a picked one
    assert all(r.path.endswith(tuple(K.SOURCE_EXTENSIONS)) and r.path.split("/")[-1] not in K.SIGNAL_FILENAMES for r in every)


@settings(**SLOW)
@given(st.lists(st.integers(0, 9000), min_size=1, max_size=14), st.integers(0, 20000))
def test_pick_is_a_prefix_that_fits(spark, sizes, budget):
    rows = [("r", f"f{i}.py", i, s, float(100 - i)) for i, s in enumerate(sizes)]
    ranked = spark.createDataFrame(rows, "repo_id string, path string, tree_ord bigint, chars int, score double")
    got = sorted(RK.budget_select(ranked, budget).collect(), key=lambda r: r.rank)
    assert [r.path for r in got] == [f"f{i}.py" for i in range(len(got))]  # best first, none skipped
    assert min(K.MIN_FILES, len(sizes)) <= len(got) <= min(K.MAX_FILES, len(sizes))
    assert all(r.tokens <= (K.MAX_CHARS_PER_FILE + len(K.TRUNCATION_MARKER)) // K.CHARS_PER_TOKEN for r in got)
    assert all(r.cum_tokens == sum(x.tokens for x in got[: i + 1]) for i, r in enumerate(got))
    assert all(r.cum_tokens <= budget for r in got[K.MIN_FILES:])
    if len(got) < min(K.MAX_FILES, len(sizes)):  # the next one would overflow
        more = RK.budget_select(ranked, 10 ** 9).where(f"rank = {len(got) + 1}").first()
        assert got[-1].cum_tokens + more.tokens > budget
