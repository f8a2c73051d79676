"""Ingestion: path and size filters, signal flag, and which files' contents are analysed.

Input ``files(repo_id, path, tree_ord, size_bytes, content)`` is a listing of every file of every
repository. ``ingest`` is a projection of it: nothing is joined, shuffled or written, so a query over
paths reads no text at all. ``content`` is kept for signal and source files. A fetch quota and a
size limit exist as parameters (they were limits of a network client); neither applies by default.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import paths as P


def filter_tree(files: DataFrame, max_file_size: int | None = None) -> DataFrame:
    """Skip filter (dirs and extensions) and, if given, size limit; adds extension, is_signal, size default 0."""
    size = F.coalesce(F.col("size_bytes"), F.lit(0)).cast("bigint")
    kept = files.withColumn("size_bytes", size).where(~P.should_skip("path"))
    if max_file_size is not None:
        kept = kept.where(F.col("size_bytes") <= F.lit(max_file_size))
    return (kept
            .withColumn("extension", P.extension("path"))
            .withColumn("is_signal", P.is_signal("path")))


def quota_ranks(tree: DataFrame, max_source_files: int | None = K.MAX_SOURCE_FILES) -> DataFrame:
    """Rank the source files of each repository for content fetching.

    Pinned file names first, then by (depth, size, tree order): the same order as
    "pinned sorted, then the rest sorted", both stable, cut at ``max_source_files``.
    With a cap the window keeps only the top rows per partition before its shuffle
    (WindowGroupLimit), so a huge repository never sorts all its files in one task.
    """
    src = (tree.where(F.col("extension").isin(K.SOURCE_EXTENSIONS) & ~F.col("is_signal"))
           .select("repo_id", "path", "tree_ord", "size_bytes",
                   P.is_pinned("path").alias("pinned"), P.depth("path").alias("depth")))
    w = Window.partitionBy("repo_id").orderBy(
        F.col("pinned").desc(), F.col("depth"), F.col("size_bytes"), F.col("tree_ord"))
    ranked = src.withColumn("quota_rank", F.row_number().over(w))
    if max_source_files is not None:
        ranked = ranked.where(F.col("quota_rank") <= F.lit(max_source_files))
    return ranked


def ingest(files: DataFrame, max_file_size: int | None = None, max_source_files: int | None = None) -> DataFrame:
    """files -> tree(repo_id, path, tree_ord, extension, size_bytes, is_signal, fetched, content).

    With a quota, the ranks are computed on paths and sizes, and joined to the tree by path.
    """
    tree = filter_tree(files, max_file_size)
    if max_source_files is None:
        out = tree.withColumn("fetched", F.col("is_signal") | F.col("extension").isin(K.SOURCE_EXTENSIONS))
    else:
        picked = quota_ranks(tree, max_source_files).select("repo_id", "path", F.lit(True).alias("quota_pick"))
        out = (tree.join(picked, ["repo_id", "path"], "left")
               .withColumn("fetched", F.col("is_signal") | F.coalesce(F.col("quota_pick"), F.lit(False))))
    return out.select("repo_id", "path", "tree_ord", "extension", "size_bytes", "is_signal", "fetched",
                      F.when(F.col("fetched"), F.col("content")).alias("content"))


def has_content(c="content"):
    col = F.col(c) if isinstance(c, str) else c
    return col.isNotNull() & (F.length(col) > 0)
