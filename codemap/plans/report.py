"""End-to-end analysis: one report row per repository.

files -> graph (tree, edges, PageRank, central files) -> context (model reply table ->
typed context with fallbacks) -> retrieval (BM25 on the context keywords, entry-point
bonus, embeddings) -> evidence -> architecture reply table -> report. The model itself
is outside the job: prompts are produced as tables (``plans.prompts``) and replies are
read back as tables.
"""
from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import context as CX
from ..operators import evidence as EV
from ..operators import graph as G
from ..operators import pagerank as PR
from ..operators import rank as RK
from ..operators.llm_output import parse_architecture
from ..session import stage
from .ingestion import RepoGraph
from .prompts import architecture_prompt, context_prompt
from .versioned import VersionedTable, fingerprint


@dataclass
class Analysis:
    graph: RepoGraph
    context_files: DataFrame
    context: DataFrame
    ranked: DataFrame
    selection: DataFrame
    evidence: DataFrame
    compressed: DataFrame
    architecture: DataFrame
    repos: DataFrame


def latest_reply(parsed: DataFrame) -> DataFrame:
    """One parsed architecture reply per repository: the latest that parses, else the latest."""
    last = parsed.groupBy("repo_id").agg(F.max(F.struct("parse_ok", "response_id")).alias("b"))
    return parsed.join(last.select("repo_id", F.col("b.response_id").alias("response_id")), ["repo_id", "response_id"])


def analyse(files: DataFrame, context_replies: DataFrame, architecture_replies: DataFrame, repos: DataFrame,
            file_vectors: DataFrame | None = None, repo_vectors: DataFrame | None = None,
            token_budget: int = K.API_TOKEN_BUDGET, budgets: DataFrame | None = None, graph: RepoGraph | None = None) -> Analysis:
    """repos(repo_id, repo_url, default_branch). ``budgets(repo_id, token_budget)``: per-request
    budgets, honoured per repository (``token_budget`` for the rest). ``graph``: that of ``files``, if it is there already."""
    g = graph or RepoGraph(files)
    ctxf = RK.materialise(CX.context_files(g.tree, g.central(K.CONTEXT_CENTRAL_TOP_N)), "context_files")
    ctx = RK.materialise(CX.pick_context(CX.parse_context(context_replies)), "picked_context")
    fin = RK.materialise(CX.finalise_context(ctx, repos, g.tree, ctxf), "context")
    kw = fin.select("repo_id", F.posexplode("keywords").alias("kw_ord", "keyword"))
    eps = fin.select("repo_id", F.explode("entry_points").alias("path"))
    res = RK.select_top_k(g.tree, g.pagerank, kw, eps, file_vectors, repo_vectors, token_budget, budgets)
    arch = latest_reply(parse_architecture(architecture_replies)).drop("parse_ok")
    return Analysis(g, ctxf, fin, res["ranked"], *_picked(g, res["selection"]), arch, repos)


def _picked(g: RepoGraph, sel: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A selection with its evidence and what it leaves."""
    ev = RK.materialise(EV.cap_evidence(
        EV.extract_evidence(sel.select("repo_id", "path", F.col("full_content").alias("content"), F.col("rank").alias("file_rank")))), "evidence")
    return sel, ev, RK.compress_folders(g.tree, sel)


def repick(a: Analysis, budgets: DataFrame, token_budget: int = K.API_TOKEN_BUDGET) -> Analysis:
    """The analysis with other budgets(repo_id, token_budget): the graph, the context and the ranking stay, files are picked again."""
    sel, ev, comp = _picked(a.graph, RK.pick(a.ranked, a.graph.tree, token_budget, budgets))
    return replace(a, selection=sel, evidence=ev, compressed=comp)


def report_lists(a: Analysis) -> DataFrame:
    """The two lists of a report that grow with the repository, one row per entry: (repo_id, list, ord, value).

    ``signal_files`` in tree order; ``compressed_folders`` in the order of each folder's first file.
    """
    signals = a.graph.tree.where(F.col("is_signal")).select("repo_id", F.lit("signal_files").alias("list"), F.col("tree_ord").alias("ord"), F.col("path").alias("value"))
    rest = a.graph.tree.join(a.selection.select("repo_id", "path"), ["repo_id", "path"], "left_anti")
    first = (rest.groupBy("repo_id", F.substring_index("path", "/", 1).alias("folder")).agg(F.min("tree_ord").alias("ord")))
    folders = (a.compressed.join(first, ["repo_id", "folder"])
               .select("repo_id", F.lit("compressed_folders").alias("list"), "ord", F.concat(F.col("folder"), F.lit(": "), F.col("summary")).alias("value")))
    return signals.unionByName(folders)


def _first(lists: DataFrame, name: str, limit: int | None) -> DataFrame:
    """A list of ``report_lists`` as an ordered array, cut at ``limit`` entries if given."""
    part = lists.where(F.col("list") == name)
    if limit is not None:
        w = Window.partitionBy("repo_id").orderBy("ord")
        part = part.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit)
    return G.ordered_list(part, "repo_id", ["ord"], "value", name)


def report(a: Analysis, list_limit: int | None = None) -> DataFrame:
    """The report row. Its lists of signal files and of compressed folders grow with the repository: ``list_limit`` bounds them
    (``report_lists`` has them whole, as rows); the others are bounded by their own rules.
    """
    stats = G.repo_stats(a.graph.tree, a.graph.edges).drop("signal_files")
    settled = a.graph.pagerank.groupBy("repo_id").agg(F.min("converged").alias("graph_converged"))
    lists = report_lists(a)
    signals, comp = _first(lists, "signal_files", list_limit), _first(lists, "compressed_folders", list_limit)
    central = G.ordered_list(a.graph.central(K.REPORT_CENTRAL_TOP_N), "repo_id", ["rank"], "path", "top_central_files")
    picked = (a.selection.groupBy("repo_id")
              .agg(F.array_sort(F.collect_list(F.struct("rank", "path"))).alias("s"),
                   F.count(F.lit(1)).alias("total_selected"),
                   F.sum("tokens").cast("bigint").alias("estimated_tokens"))
              .select("repo_id", F.transform("s", lambda x: x["path"]).alias("selected_files"),
                      "total_selected", "estimated_tokens"))
    empty = F.array().cast("array<string>")
    arch_default = F.lit(K.UNPARSEABLE_ARCHITECTURE)
    out = (a.context.join(stats, "repo_id", "left").join(signals, "repo_id", "left")
           .join(central, "repo_id", "left").join(picked, "repo_id", "left").join(comp, "repo_id", "left")
           .join(settled, "repo_id", "left").join(a.architecture.drop("response_id"), "repo_id", "left")
           .join(a.repos, "repo_id", "left"))
    return out.select(
        "repo_id",
        F.col("summary").alias("repo_summary"), "tech_stack", "main_modules", "entry_points", "keywords",
        F.coalesce("narrative_summary", F.lit("")).alias("narrative_summary"),
        F.coalesce("architecture_mermaid", arch_default).alias("architecture_mermaid"),
        F.coalesce("flow_mermaid", empty).alias("flow_mermaid"),
        F.col("evidence_map"),
        F.coalesce("total_files", F.lit(0)).cast("bigint").alias("total_files"),
        F.coalesce("signal_files", empty).alias("signal_files"),
        F.coalesce("graph_nodes", F.lit(0)).cast("bigint").alias("graph_nodes"),
        F.coalesce("graph_edges", F.lit(0)).cast("bigint").alias("graph_edges"),
        # without convergence, centrality has no part in the ranking
        F.coalesce("graph_converged", F.lit(True)).alias("graph_converged"),
        F.coalesce("top_central_files", empty).alias("top_central_files"),
        "domain",
        F.coalesce("selected_files", empty).alias("selected_files"),
        F.coalesce("total_selected", F.lit(0)).cast("bigint").alias("total_selected"),
        F.coalesce("estimated_tokens", F.lit(0)).cast("bigint").alias("estimated_tokens"),
        F.coalesce("compressed_folders", empty).alias("compressed_folders"),
        F.substring_index("repo_id", "/", 1).alias("repo_owner"),
        F.substring_index("repo_id", "/", -1).alias("repo_name"),
        F.coalesce(F.when(F.col("default_branch") != "", F.col("default_branch")), F.lit(K.DEFAULT_BRANCH))
        .alias("default_branch"),
        # what the popup shows first: the narrative, else the repository summary
        F.coalesce(F.when(F.coalesce("narrative_summary", F.lit("")) != "", F.col("narrative_summary")),
                   F.col("summary")).alias("headline"))


def prompts(a: Analysis) -> tuple[DataFrame, DataFrame]:
    """(context prompts, architecture prompts), one row per repository each."""
    return (context_prompt(a.graph.tree, a.context_files, a.repos),
            architecture_prompt(a.context, a.selection, a.evidence))


def write_reports(rep: DataFrame, path: str, fmt: str = "json") -> None:
    """Sink: one report per repository and line, in as many files as there are tasks (no folder per repository)."""
    rep.write.mode("overwrite").format(fmt).save(path)


#: Part of every fingerprint: raised when a change of the code changes its results.
RULES = "1"


def refresh_reports(path: str, files: DataFrame, context_replies: DataFrame, architecture_replies: DataFrame, repos: DataFrame,
                    file_vectors: DataFrame | None = None, repo_vectors: DataFrame | None = None, token_budget: int = K.API_TOKEN_BUDGET) -> DataFrame:
    """The reports of ``repos``, kept under ``path`` and computed only for repositories of which anything has changed since the last call.

    Edges and PageRank are kept by the fingerprint of a repository's files, reports by that of all their inputs: another reply leaves
    the graph as it is, another file of one repository touches no other one.
    """
    spark = files.sparkSession
    of_files = stage(fingerprint(files.select("repo_id", "path", "tree_ord", "size_bytes", "content"), rules=RULES), "files_fingerprint")
    inputs = [df for df in (repos, of_files, context_replies, architecture_replies, file_vectors, repo_vectors) if df is not None]
    of_all = fingerprint(*inputs, rules=f"{RULES}/{token_budget}/{file_vectors is not None}/{repo_vectors is not None}")

    def only(df: DataFrame | None, ids: DataFrame) -> DataFrame | None:
        return None if df is None else df.join(ids, "repo_id", "left_semi")

    edges = VersionedTable(spark, f"{path}/edges").refresh(of_files, lambda ids: RepoGraph(only(files, ids)).edges)
    nodes = G.nodes_of(RepoGraph(files).tree)
    ranks = VersionedTable(spark, f"{path}/pagerank").refresh(of_files, lambda ids: PR.pagerank(only(nodes, ids), only(edges, ids)))

    def compute(ids: DataFrame) -> DataFrame:
        g = RepoGraph(only(files, ids))
        g.preset(edges=only(edges, ids), pagerank=only(ranks, ids))
        parts = [only(df, ids) for df in (context_replies, architecture_replies, repos, file_vectors, repo_vectors)]
        return report(analyse(g.files, *parts, token_budget, graph=g))

    return VersionedTable(spark, f"{path}/reports").refresh(of_all, compute)


__all__ = ["refresh_reports", "repick", "analyse", "report", "report_lists", "prompts", "write_reports", "Analysis"]
