"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator.

Each query builds its stand-in inputs from the driver tables (``sources.fixtures``)
and runs the library's own operators over the whole tables. Outputs are flat rows
(lists are joined with '|') so they compare across engines.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import paths as P
from ..operators import context as CX
from ..operators import evidence as EV
from ..operators import graph as G
from ..operators import imports as IM
from ..operators import ingest as I
from ..operators import lexical as LX
from ..operators import pagerank as PR
from ..operators import rank as RK
from ..operators import semantic as SM
from ..operators import text_index as TI
from ..operators import llm_output as LO
from ..sources import fixtures as X
from ..session import delete_on_exit, ensure_checkpoint_dir, stage
from ..sources import listing as SL
from . import report as RP
from .ingestion import RepoGraph, ingestion_report
from .prompts import context_prompt, context_prompt_parts, prompt_manifest
from .versioned import VersionedTable

SEP = "|"


def _graph(spark: SparkSession, sf_dir: str) -> RepoGraph:
    return RepoGraph(X.files(spark, sf_dir))


def joined(c: str, alias: str | None = None):
    return F.array_join(F.col(c), SEP).alias(alias or c)


# ---------------------------------------------------------------------------
# A/B: scans, path predicates
# ---------------------------------------------------------------------------
def _quota_filter(spark, sf_dir, quota):
    """The ingest filter with a size limit and a fetch quota; content lengths are taken before the join."""
    f = X.files(spark, sf_dir).withColumn("content", F.length("content"))
    return I.ingest(f, K.MAX_FILE_SIZE, quota).select(
        "repo_id", "path", "tree_ord", "extension", "size_bytes", "is_signal", "fetched",
        F.coalesce("content", F.lit(0)).cast("bigint").alias("content_chars"))


def q_ingest_filter(spark, sf_dir):
    return _quota_filter(spark, sf_dir, K.MAX_SOURCE_FILES)


def q_ingest_filter_quota10(spark, sf_dir):
    """The same with a quota of 10 files, which binds in every repository."""
    return _quota_filter(spark, sf_dir, 10)


def q_signal_files(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return g.tree.where(F.col("is_signal")).select(
        "repo_id", "path", "tree_ord", F.coalesce(F.length("content"), F.lit(0)).cast("bigint").alias("content_chars"))


def q_source_quota(spark, sf_dir):
    t = I.filter_tree(X.files(spark, sf_dir), K.MAX_FILE_SIZE)
    return I.quota_ranks(t, K.MAX_SOURCE_FILES).select(
        "repo_id", "path", F.col("quota_rank").cast("int").alias("quota_rank"), "pinned",
        F.col("depth").cast("bigint").alias("depth"), "size_bytes")


def q_ext_profile(spark, sf_dir):
    f = X.files(spark, sf_dir)
    return (f.groupBy("repo_id", P.extension("path").alias("extension"))
            .agg(F.count(F.lit(1)).alias("n_files"), F.sum("size_bytes").cast("bigint").alias("total_bytes")))


def q_language_profile(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return (g.tree.groupBy("repo_id", P.language("path").alias("language"))
            .agg(F.count(F.lit(1)).alias("n_files")))


def q_noise_files(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return g.tree.select("repo_id", "path", P.is_noise("path").alias("is_noise"))


def q_path_penalty(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return g.tree.select("repo_id", "path", P.path_penalty("path").alias("penalty"))


# ---------------------------------------------------------------------------
# C/D/E: imports, resolution, edges
# ---------------------------------------------------------------------------
def q_py_imports(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return IM.import_counts(IM.python_imports(g.tree))


def q_js_imports(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return IM.import_counts(IM.javascript_imports(g.tree))


def q_resolve_relative(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return g.resolved.where(F.col("module").startswith("."))


def q_resolve_absolute(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return g.resolved.where(~F.col("module").startswith("."))


def q_dependency_edges(spark, sf_dir):
    return _graph(spark, sf_dir).edges


# ---------------------------------------------------------------------------
# graph
# ---------------------------------------------------------------------------
def q_pagerank(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return g.pagerank.select("repo_id", F.col("id").alias("path"), F.round("pagerank", 9).alias("pagerank"),
                             "converged", F.col("iterations").cast("int").alias("iterations"))


def q_pagerank_spread(spark, sf_dir):
    """The same with every graph spread over the cluster, as graphs too large for a task are."""
    g = _graph(spark, sf_dir)
    pr = PR.pagerank(G.nodes_of(g.tree), g.edges, in_task=0)
    return pr.select("repo_id", F.col("id").alias("path"), F.round("pagerank", 9).alias("pagerank"), "converged", "iterations")


def q_central_files(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return g.central(K.REPORT_CENTRAL_TOP_N).select("repo_id", "rank", "path",
                                                   F.round("pagerank", 9).alias("pagerank"))


def q_repo_stats(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return G.repo_stats(g.tree, g.edges)


def q_degree_stats(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return G.degree_stats(g.tree, g.edges)


def q_graph_payload(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return G.graph_payload(g.central(K.REPORT_CENTRAL_TOP_N), g.edges)


def q_graph_links(spark, sf_dir):
    """Links of the graph page: (repo_id, source, target) between its nodes."""
    return _graph(spark, sf_dir).edges.select("repo_id", F.col("src").alias("source"), F.col("dst").alias("target"))


def q_ingestion_report(spark, sf_dir):
    r = ingestion_report(_graph(spark, sf_dir))
    return r.select("repo_id", "total_files", joined("signal_files"), "graph_nodes", "graph_edges",
                    joined("top_central_files"))


# ---------------------------------------------------------------------------
# retrieval
# ---------------------------------------------------------------------------
def r9(c):
    return F.round(F.col(c), 9).alias(c)


def entry_point_standin(tree: DataFrame) -> DataFrame:
    """Stand-in entry-point list (a context input): every file named main.py."""
    return tree.where(P.filename("path") == "main.py").select("repo_id", "path")


def _retrieval(spark, sf_dir, budget=K.TOKEN_BUDGET_DEFAULT):
    g = _graph(spark, sf_dir)
    kw = X.keywords(g.files)
    fv = X.file_vectors(spark, sf_dir, g.files)
    rv = X.repo_vectors(spark, sf_dir)
    res = RK.select_top_k(g.tree, g.pagerank, kw, entry_point_standin(g.tree), fv, rv, budget)
    return g, res


def q_truncate_tokens(spark, sf_dir):
    g = _graph(spark, sf_dir)
    c = RK.candidates(g.tree)
    t = RK.truncated("content")
    return c.select("repo_id", "path", F.length("content").cast("bigint").alias("chars"),
                    F.length(t).cast("bigint").alias("truncated_chars"), RK.token_estimate(t).alias("tokens"))


def q_repo_fits_budget(spark, sf_dir):
    g = _graph(spark, sf_dir)
    c = RK.candidates(g.tree)
    tot = c.groupBy("repo_id").agg(F.sum(RK.token_estimate(RK.truncated("content"))).cast("bigint").alias("total_tokens"))
    return tot.withColumn("fits", F.col("total_tokens") <= F.lit(K.API_TOKEN_BUDGET))


def q_bm25_corpus_stats(spark, sf_dir):
    g = _graph(spark, sf_dir)
    st = LX.corpus_stats(RK.candidates(g.tree))
    return (st["repo"].where(F.col("n_terms").isNotNull())
            .select("repo_id", "n_docs", r9("avgdl"), r9("average_idf"), "n_terms"))


def q_bm25_rank(spark, sf_dir):
    g = _graph(spark, sf_dir)
    b = LX.bm25_scores(RK.candidates(g.tree), X.keywords(g.files))
    return b.select("repo_id", "path", r9("bm25_raw"), r9("bm25"))


def _text_index(spark, g):
    """The corpus's inverted index, stored in the checkpoint folder."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/text-index-{uuid.uuid4().hex}"
    delete_on_exit(spark, path)
    return TI.build(RK.candidates(g.tree), path)


def q_bm25_index(spark, sf_dir):
    """The scores of every file, read from the stored index."""
    g = _graph(spark, sf_dir)
    b = _text_index(spark, g).scores(X.keywords(g.files))
    return b.select("repo_id", "path", r9("bm25_raw"), r9("bm25"))


def q_bm25_top(spark, sf_dir):
    """The shortlist's number of best files of each repository, with blocks skipped by their bounds."""
    g = _graph(spark, sf_dir)
    top = _text_index(spark, g).top(X.keywords(g.files), K.SEMANTIC_SHORTLIST)
    return top.select("repo_id", "rank", "path", r9("bm25_raw"))


def q_cosine_rank(spark, sf_dir):
    g = _graph(spark, sf_dir)
    s = SM.cosine_scores(RK.candidates(g.tree), X.file_vectors(spark, sf_dir, g.files), X.repo_vectors(spark, sf_dir))
    return s.select("repo_id", "path", r9("cos_raw"), r9("semantic"))


def q_semantic_shortlist(spark, sf_dir):
    g = _graph(spark, sf_dir)
    c = RK.candidate_keys(g.tree)
    prs = RK.pagerank_signal(c, g.pagerank)
    bm = LX.bm25_scores(RK.candidates(g.tree), X.keywords(g.files))
    s = RK.semantic_shortlist(c, prs, bm, X.file_vectors(spark, sf_dir, g.files), X.repo_vectors(spark, sf_dir))
    return s.select("repo_id", "path", "pre_rank", r9("semantic"))


def q_hybrid_rank(spark, sf_dir):
    _, res = _retrieval(spark, sf_dir)
    return res["ranked"].select("repo_id", "path", r9("pagerank"), r9("bm25"), r9("semantic"),
                                "penalty", "bonus", r9("score"))


def q_budget_select(spark, sf_dir):
    _, res = _retrieval(spark, sf_dir, K.API_TOKEN_BUDGET)
    return res["selection"].select("repo_id", "rank", "path", r9("score"), "tokens", "cum_tokens")


def q_select_top_k(spark, sf_dir):
    _, res = _retrieval(spark, sf_dir)
    return res["selection"].select("repo_id", "rank", "path", F.length("content").cast("bigint").alias("content_chars"),
                                   F.md5("content").alias("content_md5"))


def q_compress_folders(spark, sf_dir):
    g, res = _retrieval(spark, sf_dir, K.API_TOKEN_BUDGET)
    return RK.compress_folders(g.tree, res["selection"])


# ---------------------------------------------------------------------------
# evidence
# ---------------------------------------------------------------------------
def _evidence_of(spark, sf_dir, kind):
    g = _graph(spark, sf_dir)
    ev = EV.extract_evidence(RK.candidates(g.tree), (kind,))
    return ev.select("repo_id", "file", "pattern_ord", "match_ord", "method", "value")


def q_evidence_routes(spark, sf_dir):
    return _evidence_of(spark, sf_dir, "route")


def q_evidence_handlers(spark, sf_dir):
    return _evidence_of(spark, sf_dir, "handler")


def q_evidence_db_calls(spark, sf_dir):
    return _evidence_of(spark, sf_dir, "db_call")


def q_evidence_capped(spark, sf_dir):
    _, res = _retrieval(spark, sf_dir, K.API_TOKEN_BUDGET)
    sel = res["selection"].select("repo_id", "path", F.col("full_content").alias("content"), F.col("rank").alias("file_rank"))
    return EV.cap_evidence(EV.extract_evidence(sel)).select(
        "repo_id", "kind", "ev_rank", "file", "pattern_ord", "match_ord", "method", "value")


def q_evidence_links(spark, sf_dir):
    g = _graph(spark, sf_dir)
    links = EV.evidence_links(X.diagram_nodes(g.tree), X.evidence_map(g.tree), X.repos(g.files))
    return links.withColumn("rule", F.coalesce("rule", F.lit(-1)))


def q_evidence_validate(spark, sf_dir):
    g, res = _retrieval(spark, sf_dir, K.API_TOKEN_BUDGET)
    return EV.validate_evidence(X.evidence_map(g.tree), res["selection"])


# ---------------------------------------------------------------------------
# context
# ---------------------------------------------------------------------------
def _ctx_pieces(spark, sf_dir):
    g = _graph(spark, sf_dir)
    parsed = CX.parse_context(X.responses(spark, sf_dir))
    ctx = stage(CX.pick_context(parsed), "picked_context")
    cf = stage(CX.context_files(g.tree, g.central(K.CONTEXT_CENTRAL_TOP_N)), "context_files")
    return g, parsed, ctx, cf


def q_clean_llm_json(spark, sf_dir):
    r = X.responses(spark, sf_dir)
    return r.select("repo_id", "response_id", CX.clean_llm_json(F.col("raw")).alias("cleaned"))


def q_parse_context(spark, sf_dir):
    p = CX.parse_context(X.responses(spark, sf_dir))
    return p.select("repo_id", "response_id", "parse_ok", "summary", "domain", joined("tech_stack"),
                    joined("main_modules"), joined("entry_points"), joined("keywords"))


def q_context_score(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return g.tree.select("repo_id", "path", CX.context_score("path").alias("score"))


def q_entry_point_score(spark, sf_dir):
    g = _graph(spark, sf_dir)
    c = CX.content_or_empty()
    return g.tree.select("repo_id", "path", CX.entry_score("path", c).alias("score"),
                         CX.entry_valid("path", c).alias("valid"))


def q_context_files(spark, sf_dir):
    _, _, _, cf = _ctx_pieces(spark, sf_dir)
    return cf.select("repo_id", "ctx_rank", "path", "score")


def _raw_entry_points(ctx):
    return ctx.select("repo_id", F.posexplode("entry_points").alias("ep_ord", "raw")).withColumn(
        "ep_ord", F.col("ep_ord").cast("int"))


def q_entry_point_normalise(spark, sf_dir):
    g, _, ctx, _ = _ctx_pieces(spark, sf_dir)
    return CX.normalise_entry_points(_raw_entry_points(ctx), g.tree)


def q_entry_points(spark, sf_dir):
    g, _, ctx, _ = _ctx_pieces(spark, sf_dir)
    return CX.top_entry_points(CX.llm_entry_points(_raw_entry_points(ctx), g.tree))


def q_fallback_entry_points(spark, sf_dir):
    g, _, _, cf = _ctx_pieces(spark, sf_dir)
    fb = CX.fallback_entry_points(cf, g.tree)
    top = CX.top_entry_points(fb.select("repo_id", "path", "score"))
    return top.join(fb.select("repo_id", "path", "tier"), ["repo_id", "path"])


def q_fallback_keywords(spark, sf_dir):
    g, _, _, cf = _ctx_pieces(spark, sf_dir)
    return CX.fallback_keywords(cf, X.repos(g.files).select("repo_id"))


def q_clean_modules(spark, sf_dir):
    p = CX.parse_context(X.responses(spark, sf_dir)).where(F.col("parse_ok"))
    return p.select("repo_id", "response_id", F.array_join(CX.clean_modules(F.col("main_modules")), SEP).alias("main_modules"))


def q_context_finalise(spark, sf_dir):
    g, _, ctx, cf = _ctx_pieces(spark, sf_dir)
    fin = CX.finalise_context(ctx, X.repos(g.files), g.tree, cf)
    return fin.select("repo_id", "summary", "domain", joined("tech_stack"), joined("main_modules"),
                      joined("entry_points"), joined("keywords"))


# ---------------------------------------------------------------------------
# A1-A3: sources
# ---------------------------------------------------------------------------
def q_repo_id_normalise(spark, sf_dir):
    r = SL.normalise_repo_ids(X.requests(spark, sf_dir))
    return r.select("page_id", "repo_url", "owner", "repo", "repo_id", "error", "page_repo_url")


def q_scan_tree_listing(spark, sf_dir):
    listing = X.tree_listing(X.files(spark, sf_dir))
    return SL.scan_listing(listing)


def q_decode_content(spark, sf_dir):
    f = X.files(spark, sf_dir)
    dec = SL.decode_content(X.tree_listing(f))
    orig = f.select("repo_id", "path", F.col("content").alias("orig"))
    return (dec.join(orig, ["repo_id", "path"])
            .select("repo_id", "path", F.length("content").cast("bigint").alias("chars"), F.md5("content").alias("content_md5"),
                    (F.col("content") == F.col("orig")).alias("roundtrip_ok")))


# ---------------------------------------------------------------------------
# Model replies, prompts, report
# ---------------------------------------------------------------------------
def q_parse_architecture(spark, sf_dir):
    a = LO.parse_architecture(X.responses(spark, sf_dir))
    return a.select("repo_id", "response_id", "parse_ok", "narrative_summary", "architecture_mermaid",
                    joined("flow_mermaid"), F.size("evidence_map").cast("int").alias("evidence_entries"))


def q_normalise_flow(spark, sf_dir):
    a = LO.parse_architecture(X.responses(spark, sf_dir)).where(F.col("parse_ok"))
    return a.select("repo_id", "response_id", F.size("flow_mermaid").cast("int").alias("n_flows"), joined("flow_mermaid"))


def _analysis(spark, sf_dir):
    f = X.files(spark, sf_dir)
    replies = X.responses(spark, sf_dir)
    return RP.analyse(f, replies, replies, X.repos(f), X.file_vectors(spark, sf_dir, f), X.repo_vectors(spark, sf_dir),
                      K.API_TOKEN_BUDGET)


def q_context_prompt(spark, sf_dir):
    g, _, _, cf = _ctx_pieces(spark, sf_dir)
    p = context_prompt(g.tree, cf, X.repos(g.files))
    return p.select("repo_id", F.length("prompt").cast("bigint").alias("chars"), F.md5("prompt").alias("prompt_md5"), "prompt")


def q_context_prompt_parts(spark, sf_dir):
    """The manifest of the context prompts' parts."""
    g, _, _, cf = _ctx_pieces(spark, sf_dir)
    return prompt_manifest(context_prompt_parts(g.tree, cf, X.repos(g.files)))


def q_architecture_prompt(spark, sf_dir):
    a = _analysis(spark, sf_dir)
    _, p = RP.prompts(a)
    return p.select("repo_id", F.length("prompt").cast("bigint").alias("chars"), F.md5("prompt").alias("prompt_md5"), "prompt")


def q_repo_report(spark, sf_dir):
    return _report_row(RP.report(_analysis(spark, sf_dir)))


def _report_row(r):
    arrays = ["tech_stack", "main_modules", "entry_points", "keywords", "flow_mermaid", "signal_files",
              "top_central_files", "selected_files", "compressed_folders"]
    return r.select(*[joined(c) if c in arrays else
                      (F.size(c).cast("int").alias("evidence_entries") if c == "evidence_map" else F.col(c))
                      for c in r.columns])


def q_repo_report_stored(spark, sf_dir):
    """The reports as the versioned sink has them after a run with reuse."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/reports-{uuid.uuid4().hex}"
    delete_on_exit(spark, path)
    f, replies = X.files(spark, sf_dir), X.responses(spark, sf_dir)
    RP.refresh_reports(path, f, replies, replies, X.repos(f), X.file_vectors(spark, sf_dir, f), X.repo_vectors(spark, sf_dir), K.API_TOKEN_BUDGET)
    return _report_row(VersionedTable(spark, f"{path}/reports").read())


def q_repo_report_lists(spark, sf_dir):
    """The growing lists of the report, one row per entry."""
    return RP.report_lists(_analysis(spark, sf_dir))


QUERIES = {
    "ingest_filter": q_ingest_filter,
    "ingest_filter_quota10": q_ingest_filter_quota10,
    "signal_files": q_signal_files,
    "source_quota": q_source_quota,
    "ext_profile": q_ext_profile,
    "language_profile": q_language_profile,
    "noise_files": q_noise_files,
    "path_penalty": q_path_penalty,
    "py_imports": q_py_imports,
    "js_imports": q_js_imports,
    "resolve_relative": q_resolve_relative,
    "resolve_absolute": q_resolve_absolute,
    "dependency_edges": q_dependency_edges,
    "pagerank": q_pagerank,
    "pagerank_spread": q_pagerank_spread,
    "central_files": q_central_files,
    "repo_stats": q_repo_stats,
    "degree_stats": q_degree_stats,
    "graph_payload": q_graph_payload,
    "graph_links": q_graph_links,
    "ingestion_report": q_ingestion_report,
    "truncate_tokens": q_truncate_tokens,
    "repo_fits_budget": q_repo_fits_budget,
    "bm25_corpus_stats": q_bm25_corpus_stats,
    "bm25_rank": q_bm25_rank,
    "bm25_index": q_bm25_index,
    "bm25_top": q_bm25_top,
    "cosine_rank": q_cosine_rank,
    "semantic_shortlist": q_semantic_shortlist,
    "hybrid_rank": q_hybrid_rank,
    "budget_select": q_budget_select,
    "select_top_k": q_select_top_k,
    "compress_folders": q_compress_folders,
    "evidence_routes": q_evidence_routes,
    "evidence_handlers": q_evidence_handlers,
    "evidence_db_calls": q_evidence_db_calls,
    "evidence_capped": q_evidence_capped,
    "evidence_links": q_evidence_links,
    "evidence_validate": q_evidence_validate,
    "clean_llm_json": q_clean_llm_json,
    "parse_context": q_parse_context,
    "context_score": q_context_score,
    "entry_point_score": q_entry_point_score,
    "context_files": q_context_files,
    "entry_point_normalise": q_entry_point_normalise,
    "entry_points": q_entry_points,
    "fallback_entry_points": q_fallback_entry_points,
    "fallback_keywords": q_fallback_keywords,
    "clean_modules": q_clean_modules,
    "context_finalise": q_context_finalise,
    "repo_id_normalise": q_repo_id_normalise,
    "scan_tree_listing": q_scan_tree_listing,
    "decode_content": q_decode_content,
    "parse_architecture": q_parse_architecture,
    "normalise_flow": q_normalise_flow,
    "context_prompt": q_context_prompt,
    "context_prompt_parts": q_context_prompt_parts,
    "architecture_prompt": q_architecture_prompt,
    "repo_report": q_repo_report,
    "repo_report_stored": q_repo_report_stored,
    "repo_report_lists": q_repo_report_lists,
}
