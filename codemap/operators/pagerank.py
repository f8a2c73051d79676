"""PageRank over every repository at once.

Semantics follow the usual power iteration with uniform start and teleport,
dangling mass spread uniformly, damping ``alpha`` and a per-graph stopping rule:
after step k, a repository whose L1 change is below ``N * tol`` keeps x_k and is
frozen. Freezing is per repository, so a score never depends on other graphs in the
corpus. Repositories that do not converge in ``max_iter`` steps keep their last
vector and ``converged = false``.

There are two ways, chosen for each repository by the counted size of its graph:

* A graph of at most ``in_task`` nodes and edges (so of bounded memory) is iterated where it lies: nodes and edges meet once, by
  repository, and a task runs all of its steps on arrays. Millions of ordinary repositories cost one shuffle, not one a step.
* A larger graph is spread over the cluster and iterated by joins over an *active set*. One step is
    contributions = state ⋈ edges, summed per (repo, dst) with map-side partial aggregation
    repo stats    = dangling mass and last L1 change per repository (partial aggregation, one row per repository)
    next state    = state ⟕ contributions ⋈ repo stats
  State and weighted edges are tables in the same buckets of (repo_id, id): the joins read both in place, and a step only moves the summed
  contributions. Every step writes its state, so plans stay small and a lost executor re-reads the last state. Repositories that have
  converged go to a result table every ``check_every`` steps and leave the state, so later steps read only what is still moving.
  As each of them has more than ``in_task`` nodes and edges, there are few, and their stats are a small table that Spark broadcasts
  after measuring it.

All tables lie in the folder of spark.checkpoint.dir; the catalog entries of the bucketed ones are dropped however the loop ends.
"""
from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..session import delete_on_exit, ensure_checkpoint_dir

#: Edges of a bucket: at most so many, and at least so many unless there is one bucket. A step's tasks are as many as its buckets, however small these are.
EDGES_PER_PARTITION, LEAST_EDGES = 2_000_000, 50_000
#: Nodes and edges of a graph that one task iterates: about 100 MB of a worker's memory.
IN_TASK = 200_000
RESULT = "repo_id string, id string, pagerank double, converged boolean, iterations int"


def iterate(n: int, src: np.ndarray, dst: np.ndarray, degree: np.ndarray, alpha: float, max_iter: int, tol: float) -> tuple[np.ndarray, bool, int]:
    """(vector, converged, steps) of a graph of n nodes; ``degree``: out-degree of each edge's source."""
    x, dangling = np.full(n, 1.0 / n), np.ones(n, bool)
    dangling[src] = False
    inside = dst >= 0
    src, dst, weight = src[inside], dst[inside], 1.0 / degree[inside]
    for step in range(1, max_iter + 1):
        moved = np.bincount(dst, weights=x[src] * weight, minlength=n)
        new = alpha * (moved + x[dangling].sum() / n) + (1.0 - alpha) / n
        x, change = new, np.abs(new - x).sum()
        if change < n * tol:
            return x, True, step
    return x, False, max_iter


def _in_tasks(nodes: DataFrame, edges: DataFrame, alpha: float, max_iter: int, tol: float) -> DataFrame:
    """The graphs whose size is bounded: both sides are dealt by repository, and each group is iterated on its own."""
    def solve(own: pa.Table, links: pa.Table) -> pa.Table:
        ids = own.column("id").combine_chunks()
        if not len(ids):
            return pa.Table.from_pylist([], schema)
        place = lambda name: np.asarray(pc.index_in(links.column(name).combine_chunks(), value_set=ids).fill_null(-1))
        src, dst = place("src"), place("dst")
        known = src >= 0
        src, dst = src[known], dst[known]
        degree = np.bincount(src, minlength=len(ids))[src]
        x, converged, steps = iterate(len(ids), src, dst, degree, alpha, max_iter, tol)
        return pa.Table.from_arrays([own.column("repo_id").combine_chunks(), ids, pa.array(x), pa.array([converged] * len(ids)), pa.array([steps] * len(ids), pa.int32())], schema=schema)

    kinds = (("repo_id", pa.string()), ("id", pa.string()), ("pagerank", pa.float64()), ("converged", pa.bool_()), ("iterations", pa.int32()))
    schema = pa.schema(kinds)
    return nodes.groupBy("repo_id").cogroup(edges.groupBy("repo_id")).applyInArrow(solve, RESULT)


class _Tables:
    """Bucketed tables of one run, on (repo_id, id), in the checkpoint folder; ``drop`` removes their catalog entries."""

    def __init__(self, spark, buckets: int):
        self.spark, self.run = spark, f"pagerank_{uuid.uuid4().hex}"
        self.buckets = min(buckets, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))
        self.base, self.names = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{self.run}", []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        table = f"{self.run}_{name}"
        if table not in self.names:
            self.names.append(table)
        (df.write.mode("overwrite").bucketBy(self.buckets, "repo_id", "id").sortBy("repo_id", "id")
         .option("path", f"{self.base}/{name}").saveAsTable(table))
        delete_on_exit(self.spark, self.base)
        return self.spark.table(table)

    def append(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("append").parquet(f"{self.base}/{name}")
        delete_on_exit(self.spark, self.base)
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def drop(self) -> None:
        for table in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")


def bucket_count(edges: int, default: int) -> int:
    """Buckets for so many edges: by their number, not by the cluster's number of shuffle partitions, which bounds them only below EDGES_PER_PARTITION."""
    return max(1, min(default, -(-edges // LEAST_EDGES)), -(-edges // EDGES_PER_PARTITION))


def _in_steps(nodes: DataFrame, edges: DataFrame, alpha: float, max_iter: int, tol: float, buckets: int | None, check_every: int) -> DataFrame:
    """The graphs that are spread over the cluster: see the module's text."""
    spark = nodes.sparkSession
    tables = _Tables(spark, buckets or bucket_count(edges.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    try:
        outdeg = edges.groupBy("repo_id", "src").agg(F.count(F.lit(1)).alias("deg"))
        weighted = (edges.join(outdeg, ["repo_id", "src"])
                    .select("repo_id", F.col("src").alias("id"), "dst", (F.lit(1.0) / F.col("deg")).alias("w")))
        weighted = tables.keep(weighted.repartition(tables.buckets, "repo_id", "id"), "edges")
        n = nodes.groupBy("repo_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
        start = (nodes.join(n, "repo_id")
                 .join(outdeg.select("repo_id", F.col("src").alias("id"), F.lit(False).alias("has_out")), ["repo_id", "id"], "left")
                 .select("repo_id", "id", "n", F.col("has_out").isNull().alias("dangling"), (F.lit(1.0) / F.col("n")).alias("x"),
                         F.lit(None).cast("double").alias("xp"), F.lit(False).alias("done"), F.lit(0).alias("it")))
        state = tables.keep(start.repartition(tables.buckets, "repo_id", "id"), "state0")
        finished = None
        for step in range(1, max_iter + 1):
            nxt = _step(state, weighted, alpha, tol, step)
            state = tables.keep(nxt, f"state{step % 2}")
            if step % check_every == 0:
                finished = tables.append(_result(state.where("done"), F.lit(True)), "finished")
                state = state.where(~F.col("done"))  # the next step's table holds only these
                if state.limit(1).count() == 0:
                    return finished
        last = state.join(_stats(state).select("repo_id", "err"), "repo_id")
        below = F.col("err").isNotNull() & (F.col("err") < F.col("n") * F.lit(tol))
        return tables.append(_result(last, F.col("done") | below), "finished")
    finally:
        tables.drop()


def _stats(state: DataFrame) -> DataFrame:
    return state.groupBy("repo_id").agg(
        F.sum(F.when(F.col("dangling"), F.col("x")).otherwise(F.lit(0.0))).alias("dmass"),
        F.sum(F.abs(F.col("x") - F.col("xp"))).alias("err"))


def _step(state: DataFrame, weighted: DataFrame, alpha: float, tol: float, step: int) -> DataFrame:
    contrib = (state.where(~F.col("done")).select("repo_id", "id", "x").join(weighted, ["repo_id", "id"])
               .groupBy("repo_id", F.col("dst").alias("id")).agg(F.sum(F.col("x") * F.col("w")).alias("c")))
    newly_done = F.lit(step > 1) & F.col("err").isNotNull() & (F.col("err") < F.col("n") * F.lit(tol))
    done = F.col("done") | newly_done
    x_new = (F.lit(alpha) * (F.coalesce(F.col("c"), F.lit(0.0)) + F.col("dmass") / F.col("n")) + F.lit(1.0 - alpha) / F.col("n"))
    return (state.join(contrib, ["repo_id", "id"], "left").join(_stats(state), "repo_id")
            .select("repo_id", "id", "n", "dangling",
                    F.when(done, F.col("x")).otherwise(x_new).alias("x"),
                    F.when(done, F.col("xp")).otherwise(F.col("x")).alias("xp"),
                    done.alias("done"), F.when(done, F.col("it")).otherwise(F.lit(step)).alias("it")))


def _result(state: DataFrame, converged) -> DataFrame:
    return state.select("repo_id", "id", F.col("x").alias("pagerank"), converged.alias("converged"), F.col("it").cast("int").alias("iterations"))


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = K.PAGERANK_ALPHA,
             max_iter: int = K.PAGERANK_MAX_ITER, tol: float = K.PAGERANK_TOL,
             num_partitions: int | None = None, check_every: int = 6, in_task: int = IN_TASK) -> DataFrame:
    """nodes(repo_id, id) + edges(repo_id, src, dst) -> (repo_id, id, pagerank, converged, iterations).

    ``in_task``: most nodes and edges of a graph that one task iterates; 0 spreads every graph over the cluster.
    """
    nodes = nodes.select("repo_id", "id").distinct()
    edges = edges.select("repo_id", "src", "dst").distinct()
    if in_task <= 0:
        return _in_steps(nodes, edges, alpha, max_iter, tol, num_partitions, check_every)
    sizes = reduce(DataFrame.unionByName, [df.groupBy("repo_id").agg(F.count(F.lit(1)).alias("size")) for df in (nodes, edges)])
    large = sizes.groupBy("repo_id").agg(F.sum("size").alias("size")).where(F.col("size") > in_task).select("repo_id")
    if large.isEmpty():
        return _in_tasks(nodes, edges, alpha, max_iter, tol)
    # at most (nodes + edges) / in_task repositories are large
    rest = [df.join(large, "repo_id", "left_anti") for df in (nodes, edges)]
    spread = [df.join(large, "repo_id", "left_semi") for df in (nodes, edges)]
    return _in_tasks(*rest, alpha, max_iter, tol).unionByName(_in_steps(*spread, alpha, max_iter, tol, num_partitions, check_every))


def pagerank_fixed(nodes: DataFrame, edges: DataFrame, iterations: int, alpha: float = K.PAGERANK_ALPHA) -> DataFrame:
    """Exactly ``iterations`` steps, no stopping rule (for fixed-step comparisons)."""
    return pagerank(nodes, edges, alpha=alpha, max_iter=iterations, tol=-1.0)
