import random

import pytest

from codemap.operators import pagerank as PR


def pagerank_py(nodes, edges, alpha=0.85, max_iter=100, tol=1e-6):
    """Plain power iteration (uniform start/teleport, dangling mass spread uniformly)."""
    n = len(nodes)
    out = {v: [] for v in nodes}
    for s, d in sorted(set(edges)):
        out[s].append(d)
    x = {v: 1.0 / n for v in nodes}
    for it in range(1, max_iter + 1):
        last = x
        dm = sum(last[v] for v in nodes if not out[v])
        x = {v: (1 - alpha) / n + alpha * dm / n for v in nodes}
        for s in nodes:
            for d in out[s]:
                x[d] += alpha * last[s] / len(out[s])
        if sum(abs(x[v] - last[v]) for v in nodes) < n * tol:
            return x, it
    return x, None


def _graph(seed, n, m):
    rnd = random.Random(seed)
    nodes = [f"f{i}.py" for i in range(n)]
    edges = {(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(m)}
    return nodes, [(a, b) for a, b in edges if a != b]


@pytest.mark.parametrize("in_task", [PR.IN_TASK, 25, 0])
def test_matches_plain_python_per_repository(spark, in_task):
    graphs = {"r1": _graph(1, 12, 20), "r2": _graph(2, 7, 3), "r3": (["a.py", "b.py"], []), "r4": _graph(4, 30, 90)}
    nodes = spark.createDataFrame([(r, v) for r, (ns, _) in graphs.items() for v in ns], "repo_id string, id string")
    edges = spark.createDataFrame([(r, a, b) for r, (_, es) in graphs.items() for a, b in es],
                                  "repo_id string, src string, dst string")
    got = {(r.repo_id, r.id): (r.pagerank, r.iterations, r.converged) for r in PR.pagerank(nodes, edges, in_task=in_task).collect()}
    for repo, (ns, es) in graphs.items():
        want, it = pagerank_py(ns, es)
        assert abs(sum(got[(repo, v)][0] for v in ns) - 1.0) < 1e-9
        for v in ns:
            assert abs(got[(repo, v)][0] - want[v]) < 1e-12
            assert got[(repo, v)][1] == it and got[(repo, v)][2]


def test_fixed_steps_mode(spark):
    ns, es = _graph(7, 10, 25)
    nodes = spark.createDataFrame([("r", v) for v in ns], "repo_id string, id string")
    edges = spark.createDataFrame([("r", a, b) for a, b in es], "repo_id string, src string, dst string")
    got = {r.id: r.pagerank for r in PR.pagerank_fixed(nodes, edges, 3).collect()}
    want, _ = pagerank_py(ns, es, max_iter=3, tol=-1)
    assert all(abs(got[v] - want[v]) < 1e-12 for v in ns)


def _frames(spark, graphs):
    nodes = spark.createDataFrame([(r, v) for r, (ns, _) in graphs.items() for v in ns], "repo_id string, id string")
    edges = spark.createDataFrame([(r, a, b) for r, (_, es) in graphs.items() for a, b in es], "repo_id string, src string, dst string")
    return nodes, edges


def test_converged_repositories_leave_the_state(spark, monkeypatch):
    graphs = {"slow": _graph(3, 25, 40), "quick": (["a", "b"], []), "other": ([f"n{i}" for i in range(9)], [])}
    sizes, keep = [], PR._Tables.keep

    def counted(self, df, name):
        kept = keep(self, df, name)
        if name.startswith("state"):
            sizes.append(kept.count())
        return kept

    monkeypatch.setattr(PR._Tables, "keep", counted)
    got = PR.pagerank(*_frames(spark, graphs), in_task=0, check_every=2).collect()
    assert sizes[:3] == [36, 36, 36] and sizes[3] == 25 == sizes[-1]
    assert sorted((r.repo_id, r.id) for r in got) == sorted((k, v) for k, (ns, _) in graphs.items() for v in ns)
    assert spark.sql("SHOW TABLES").count() == 0


def test_a_failing_step_leaves_no_table(spark, monkeypatch):
    step = PR._step

    def broken(state, weighted, alpha, tol, k):
        if k == 3:
            raise RuntimeError("lost")
        return step(state, weighted, alpha, tol, k)

    monkeypatch.setattr(PR, "_step", broken)
    with pytest.raises(RuntimeError):
        PR.pagerank(*_frames(spark, {"r": _graph(3, 25, 40)}), in_task=0)
    assert spark.sql("SHOW TABLES").count() == 0


def test_steps_move_neither_state_nor_edges(spark):
    """The only exchanges of a step are those of the summed contributions and of the stats."""
    nodes, edges = _frames(spark, {"r": _graph(3, 25, 40)})
    tables = PR._Tables(spark, 4)
    try:
        weighted = tables.keep(edges.selectExpr("repo_id", "src AS id", "dst", "1.0D AS w").repartition(4, "repo_id", "id"), "edges")
        state = tables.keep(nodes.selectExpr("*", "25D AS n", "false AS dangling", "0.04D AS x", "0D AS xp", "false AS done", "1 AS it").repartition(4, "repo_id", "id"), "state0")
        for key, value in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
            spark.conf.set(key, value)
        plan = PR._step(state, weighted, 0.85, 1e-6, 2)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        tables.drop()
    dealt = [line for line in plan.splitlines() if "Exchange" in line]
    assert len([line for line in dealt if "hashpartitioning(repo_id" in line and ", id" in line or "dst" in line]) == 1, plan


def test_buckets_go_by_the_edges(spark, monkeypatch):
    """A step has as many tasks as there are buckets: a small graph has one, whatever the number of shuffle partitions."""
    seen, made = [], PR._Tables.__init__

    def init(self, spark, buckets):
        seen.append(buckets)
        made(self, spark, buckets)

    monkeypatch.setattr(PR._Tables, "__init__", init)
    PR.pagerank(*_frames(spark, {"r": _graph(3, 25, 40)}), in_task=0).collect()
    assert seen == [1]
    assert PR.bucket_count(0, 600) == 1 and PR.bucket_count(2_600_000, 600) == 52
    assert PR.bucket_count(10**9, 600) == 600 and PR.bucket_count(10**10, 600) == 5000
