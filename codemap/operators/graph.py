"""Graph-level results: central files, repository statistics, degrees and the graph-page payload."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import paths as P

# Scores are ranked on a rounded value so last-bit summation differences between
# engines cannot flip a tie; exact ties fall back to file-tree order.
RANK_DIGITS = 12


def nodes_of(tree: DataFrame) -> DataFrame:
    return tree.select("repo_id", F.col("path").alias("id"))


def central_files(pr: DataFrame, tree: DataFrame, top_n: int = K.REPORT_CENTRAL_TOP_N) -> DataFrame:
    """Top-n non-noise files by PageRank (desc), ties in tree order: (repo_id, rank, path, pagerank).

    A repository without edges has a uniform PageRank, so this is its first n
    non-noise files in tree order, as required. The filter runs before the limit.
    """
    scored = (pr.select("repo_id", F.col("id").alias("path"), "pagerank")
              .join(tree.select("repo_id", "path", "tree_ord"), ["repo_id", "path"])
              .where(~P.is_noise("path")))
    w = Window.partitionBy("repo_id").orderBy(F.round("pagerank", RANK_DIGITS).desc(), F.col("tree_ord"))
    return (scored.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= F.lit(top_n))
            .select("repo_id", F.col("rank").cast("int").alias("rank"), "path", "pagerank", "tree_ord"))


def repo_stats(tree: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, total_files, signal_files, graph_nodes, graph_edges) — one row per repository."""
    t = tree.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("is_signal")).alias("signal_files"))
    e = edges.groupBy("repo_id").agg(F.count(F.lit(1)).alias("graph_edges"))
    return (t.join(e, "repo_id", "left")
            .select("repo_id", "total_files", "signal_files",
                    F.col("total_files").alias("graph_nodes"),
                    F.coalesce(F.col("graph_edges"), F.lit(0)).cast("bigint").alias("graph_edges")))


def degree_stats(tree: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, path, imports, imported_by) for every node."""
    out_d = edges.groupBy("repo_id", F.col("src").alias("path")).agg(F.count(F.lit(1)).alias("imports"))
    in_d = edges.groupBy("repo_id", F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("imported_by"))
    return (tree.select("repo_id", "path")
            .join(out_d, ["repo_id", "path"], "left")
            .join(in_d, ["repo_id", "path"], "left")
            .select("repo_id", "path",
                    F.coalesce("imports", F.lit(0)).cast("bigint").alias("imports"),
                    F.coalesce("imported_by", F.lit(0)).cast("bigint").alias("imported_by")))


def graph_payload(central: DataFrame, edges: DataFrame) -> DataFrame:
    """Graph page nodes: central files ∪ edge endpoints, flagged, with out-link counts.

    (repo_id, id, central, links_out); the links themselves are the ``edges`` table.
    """
    ends = (edges.select("repo_id", F.col("src").alias("id"))
            .unionByName(edges.select("repo_id", F.col("dst").alias("id"))))
    c = central.select("repo_id", F.col("path").alias("id"), F.lit(True).alias("central"))
    nodes = ends.unionByName(c.select("repo_id", "id")).distinct()
    outs = edges.groupBy("repo_id", F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("links_out"))
    return (nodes.join(c, ["repo_id", "id"], "left").join(outs, ["repo_id", "id"], "left")
            .select("repo_id", "id", F.coalesce("central", F.lit(False)).alias("central"),
                    F.coalesce("links_out", F.lit(0)).cast("bigint").alias("links_out")))


def ordered_list(df: DataFrame, key: str, order_cols: list[str], value: str, alias: str) -> DataFrame:
    """Per-key ordered array of ``value`` (sorted by ``order_cols``): the report's list fields."""
    s = F.struct(*[F.col(c) for c in order_cols], F.col(value).alias("__v"))
    return (df.groupBy(key).agg(F.array_sort(F.collect_list(s)).alias("__a"))
            .select(key, F.transform("__a", lambda x: x["__v"]).alias(alias)))
