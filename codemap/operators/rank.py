"""Retrieval: candidates, normalised signals, semantic shortlist, hybrid rank, budgeted pick.

Candidates are the files with content. Signals per candidate:
  pagerank  PageRank / max PageRank over all nodes of the repository (0 when unconverged)
  bm25      BM25 / max BM25 over candidates (when > 0)
  semantic  cosine similarity, computed only for the top-50 of 0.5·pagerank + 0.5·bm25
Score = (0.4·pagerank + 0.4·bm25 + 0.2·semantic) · path penalty · entry-point bonus.
The pick keeps the 6 best always, then up to 10 while the running token sum of the
truncated contents stays within the budget (stop at the first file that would exceed).
Every per-repository ranking is ``row_number() <= k`` so Spark keeps only the top rows
per partition before its shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import paths as P
from .ingest import has_content
from .semantic import cosine_scores

RANK_DIGITS = 9


def truncated(content) -> Column:
    """Content cut to 6000 characters plus the continuation marker; null/empty -> ''."""
    c = F.coalesce(F.col(content) if isinstance(content, str) else content, F.lit(""))
    return (F.when(F.length(c) > K.MAX_CHARS_PER_FILE,
                   F.concat(F.substring(c, 1, K.MAX_CHARS_PER_FILE), F.lit(K.TRUNCATION_MARKER)))
            .otherwise(c))


def token_estimate(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.floor(F.length(t) / F.lit(K.CHARS_PER_TOKEN)).cast("bigint")


def truncated_chars(chars) -> Column:
    """Length of ``truncated`` content from the content's length."""
    n = F.col(chars) if isinstance(chars, str) else chars
    return F.when(n > K.MAX_CHARS_PER_FILE, F.lit(K.MAX_CHARS_PER_FILE + len(K.TRUNCATION_MARKER))).otherwise(n)


def candidates(tree: DataFrame) -> DataFrame:
    return tree.where(has_content()).select("repo_id", "path", "tree_ord", "content")


def candidate_keys(tree: DataFrame) -> DataFrame:
    """The candidates without their texts: (repo_id, path, tree_ord, chars)."""
    return tree.where(has_content()).select("repo_id", "path", "tree_ord", F.length("content").alias("chars"))


def with_texts(selection: DataFrame, tree: DataFrame) -> DataFrame:
    """The picked files with ``full_content`` and the ``content`` cut for prompts."""
    texts = tree.select("repo_id", "path", F.col("content").alias("full_content"))
    return selection.join(texts, ["repo_id", "path"]).withColumn("content", truncated("full_content"))


def pagerank_signal(cands: DataFrame, pr: DataFrame) -> DataFrame:
    """(repo_id, path, pagerank): normalised by the max over all nodes; unconverged repos score 0."""
    mx = pr.groupBy("repo_id").agg(F.max("pagerank").alias("mx"),
                                  F.min(F.col("converged").cast("int")).alias("ok"))
    p = pr.select("repo_id", F.col("id").alias("path"), F.col("pagerank").alias("pr"))
    return (cands.select("repo_id", "path")
            .join(p, ["repo_id", "path"], "left")
            .join(mx, "repo_id", "left")
            .select("repo_id", "path",
                    F.when(F.coalesce(F.col("ok"), F.lit(0)) == 1,
                           F.coalesce(F.col("pr"), F.lit(0.0)) / F.col("mx")).otherwise(F.lit(0.0)).alias("pagerank")))


def semantic_shortlist(cands: DataFrame, pr_sig: DataFrame, bm25: DataFrame,
                       file_vectors: DataFrame | None, repo_vectors: DataFrame | None,
                       shortlist: int = K.SEMANTIC_SHORTLIST) -> DataFrame:
    """(repo_id, path, pre_rank, semantic): top-``shortlist`` by pre-rank get a similarity, others 0."""
    pre = (cands.select("repo_id", "path", "tree_ord")
           .join(pr_sig, ["repo_id", "path"]).join(bm25.select("repo_id", "path", "bm25"), ["repo_id", "path"])
           .select("repo_id", "path", "tree_ord",
                   (F.lit(K.PRERANK_WEIGHT) * F.col("pagerank") + F.lit(K.PRERANK_WEIGHT) * F.col("bm25")).alias("pre")))
    w = Window.partitionBy("repo_id").orderBy(F.round("pre", RANK_DIGITS).desc(), F.col("tree_ord"))
    top = pre.withColumn("pre_rank", F.row_number().over(w)).where(F.col("pre_rank") <= F.lit(shortlist))
    if file_vectors is None or repo_vectors is None:
        return top.select("repo_id", "path", F.col("pre_rank").cast("int").alias("pre_rank"),
                          F.lit(0.0).alias("semantic"))
    sem = cosine_scores(top, file_vectors, repo_vectors)
    return (top.join(sem, ["repo_id", "path"])
            .select("repo_id", "path", F.col("pre_rank").cast("int").alias("pre_rank"), "semantic"))


def hybrid_rank(cands: DataFrame, pr_sig: DataFrame, bm25: DataFrame, sem: DataFrame,
                entry_points: DataFrame | None) -> DataFrame:
    """(repo_id, path, tree_ord, chars, pagerank, bm25, semantic, penalty, bonus, score) for every candidate."""
    s = (cands.select("repo_id", "path", "tree_ord", "chars")
         .join(pr_sig, ["repo_id", "path"])
         .join(bm25.select("repo_id", "path", "bm25"), ["repo_id", "path"])
         .join(sem.select("repo_id", "path", "semantic"), ["repo_id", "path"], "left"))
    if entry_points is not None:
        ep = entry_points.select("repo_id", "path", F.lit(True).alias("is_entry")).distinct()
        s = s.join(ep, ["repo_id", "path"], "left")
    else:
        s = s.withColumn("is_entry", F.lit(None).cast("boolean"))
    sem_c = F.coalesce(F.col("semantic"), F.lit(0.0))
    bonus = F.when(F.coalesce(F.col("is_entry"), F.lit(False)), F.lit(K.ENTRY_BONUS)).otherwise(F.lit(1.0))
    pen = P.path_penalty("path")
    score = ((F.lit(K.WEIGHT_PAGERANK) * F.col("pagerank") + F.lit(K.WEIGHT_BM25) * F.col("bm25")
              + F.lit(K.WEIGHT_SEMANTIC) * sem_c) * pen * bonus)
    return s.select("repo_id", "path", "tree_ord", "chars", "pagerank", "bm25", sem_c.alias("semantic"),
                    pen.alias("penalty"), bonus.alias("bonus"), score.alias("score"))


def budget_select(ranked: DataFrame, token_budget=K.TOKEN_BUDGET_DEFAULT,
                  min_files: int = K.MIN_FILES, max_files: int = K.MAX_FILES) -> DataFrame:
    """ranked(repo_id, path, tree_ord, chars, score) -> (repo_id, rank, path, tree_ord, score, tokens, cum_tokens) of the picked files.

    Tokens are those of the truncated content, so its length is enough. ``token_budget`` is an int or a column name holding each repository's budget.
    """
    w = Window.partitionBy("repo_id").orderBy(F.round("score", RANK_DIGITS).desc(), F.col("tree_ord"))
    top = (ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.lit(max_files))
           .withColumn("tokens", F.floor(truncated_chars("chars") / F.lit(K.CHARS_PER_TOKEN)).cast("bigint")))
    cw = Window.partitionBy("repo_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    budget = F.col(token_budget) if isinstance(token_budget, str) else F.lit(token_budget)
    return (top.withColumn("cum_tokens", F.sum("tokens").over(cw))
            .where((F.col("rank") <= F.lit(min_files)) | (F.col("cum_tokens") <= budget))
            .select("repo_id", F.col("rank").cast("int").alias("rank"), "path", "tree_ord", "score", "tokens",
                    F.col("cum_tokens").cast("bigint").alias("cum_tokens")))


def compress_folders(tree: DataFrame, selection: DataFrame) -> DataFrame:
    """Unselected files counted by first path segment: (repo_id, folder, n_files, summary)."""
    rest = tree.select("repo_id", "path").join(selection.select("repo_id", "path"), ["repo_id", "path"], "left_anti")
    return (rest.groupBy("repo_id", P.top_folder("path").alias("folder"))
            .agg(F.count(F.lit(1)).alias("n_files"))
            .withColumn("summary", F.concat(F.col("n_files").cast("string"), F.lit(K.COMPRESSED_FOLDER_TEXT))))


def select_top_k(tree: DataFrame, pr: DataFrame, keywords: DataFrame, entry_points: DataFrame | None,
                 file_vectors: DataFrame | None = None, repo_vectors: DataFrame | None = None,
                 token_budget=K.TOKEN_BUDGET_DEFAULT, budgets: DataFrame | None = None) -> dict:
    """Whole retrieval composite; returns dict with 'ranked' (all candidates) and 'selection'.

    ``budgets(repo_id, token_budget)`` gives each repository its own budget (a request's);
    repositories missing from it use ``token_budget``.
    """
    from .lexical import bm25_scores
    # keys and numbers only until the files are picked; each is read several times below, so it is written once
    cands = materialise(candidate_keys(tree), "candidates")
    prs = materialise(pagerank_signal(cands, pr), "pagerank_signal")
    bm = materialise(bm25_scores(candidates(tree), keywords), "bm25")
    sem = semantic_shortlist(cands, prs, bm, file_vectors, repo_vectors)
    ranked = materialise(hybrid_rank(cands, prs, bm, sem, entry_points), "ranked")
    return {"ranked": ranked, "selection": pick(ranked, tree, token_budget, budgets)}


def pick(ranked: DataFrame, tree: DataFrame, token_budget=K.TOKEN_BUDGET_DEFAULT, budgets: DataFrame | None = None) -> DataFrame:
    """The selection of ranked files for one budget, or for each repository's own: the only part of retrieval that depends on it."""
    if budgets is not None:
        per_repo = (ranked.join(budgets.select("repo_id", F.col("token_budget").alias("__budget")), "repo_id", "left")
                    .withColumn("__budget", F.coalesce(F.col("__budget"), F.lit(token_budget))))
        picked = budget_select(per_repo, "__budget")
    else:
        picked = budget_select(ranked, token_budget)
    return materialise(with_texts(materialise(picked, "picked"), tree), "selection")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Stage boundary (written to the checkpoint folder, read back): see session.stage."""
    from ..session import stage
    return stage(df, name)
