"""Prompt tables: one model prompt per repository, assembled with ordered aggregates.

The wording is ours; what is assembled (and in which order, with which cuts) follows the
analysis: the first 250 tree paths, every signal file cut to 1200 characters, up to 15
context-file excerpts cut to 800 characters; for the architecture prompt, the context,
the selected files with their (truncated) contents and the capped evidence rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K

CONTEXT_TEMPLATE = [
    "Infer what this repository does and how it is organised.",
    "## File tree (first {n} files)".format(n=K.PROMPT_TREE_FILES),
    "{tree}",
    "## Signal files",
    "{signals}",
    "## Source excerpts",
    "{excerpts}",
    "Answer with one JSON object with the keys summary, domain, tech_stack, main_modules, entry_points, keywords.",
]
ARCH_TEMPLATE = [
    "Draw the architecture of this repository for a new developer.",
    "## Summary", "{summary}",
    "## Domain", "{domain}",
    "## Tech stack", "{stack}",
    "## Main modules", "{modules}",
    "## Paths of the chosen files", "{file_list}",
    "## What these files contain", "{files}",
    "## Facts found in them", "{evidence}",
    "Answer with one JSON object with the keys narrative_summary, architecture_mermaid, flow_mermaid, evidence_map.",
]


def ordered_join(df: DataFrame, key: str, order: str, text: Column, sep: str, alias: str) -> DataFrame:
    s = F.struct(F.col(order).alias("o"), text.alias("t"))
    return (df.groupBy(key).agg(F.array_sort(F.collect_list(s)).alias("a"))
            .select(key, F.array_join(F.transform("a", lambda x: x["t"]), sep).alias(alias)))


def _fill(template: list[str], parts: dict[str, Column]) -> Column:
    pieces = []
    for i, line in enumerate(template):
        if i:
            pieces.append(F.lit("\n\n"))
        if line.startswith("{") and line.endswith("}") and line[1:-1] in parts:
            pieces.append(F.coalesce(parts[line[1:-1]], F.lit("")))
        else:
            pieces.append(F.lit(line))
    return F.concat(*pieces)


def _context_sections(tree: DataFrame, ctx_files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(repo_id, tree) of the first paths, the signal files with their piece of text, (repo_id, excerpts) of the context files."""
    w = Window.partitionBy("repo_id").orderBy("tree_ord")
    first = tree.select("repo_id", "path", "tree_ord").withColumn("r", F.row_number().over(w)) \
        .where(F.col("r") <= F.lit(K.PROMPT_TREE_FILES))
    tree_s = ordered_join(first, "repo_id", "tree_ord", F.col("path"), "\n", "tree")
    signals = tree.where(F.col("is_signal")).select("repo_id", "tree_ord", F.concat(
        F.lit("### "), F.col("path"), F.lit("\n"), F.substring(F.coalesce("content", F.lit("")), 1, K.SIGNAL_EXCERPT_CHARS)).alias("piece"))
    exc = ctx_files.where(F.col("content").isNotNull() & (F.length("content") > 0))
    wx = Window.partitionBy("repo_id").orderBy("ctx_rank")
    exc = exc.withColumn("r", F.row_number().over(wx)).where(F.col("r") <= F.lit(K.PROMPT_EXCERPTS))
    exc_s = ordered_join(exc, "repo_id", "ctx_rank",
                         F.concat(F.lit("### "), F.col("path"), F.lit("\n"),
                                  F.substring("content", 1, K.EXCERPT_CHARS)), "\n\n", "excerpts")
    return tree_s, signals, exc_s


def context_prompt(tree: DataFrame, ctx_files: DataFrame, repos: DataFrame) -> DataFrame:
    """(repo_id, prompt). A prompt lists every signal file: see ``context_prompt_parts`` for repositories with very many."""
    tree_s, signals, exc_s = _context_sections(tree, ctx_files)
    sig_s = ordered_join(signals, "repo_id", "tree_ord", F.col("piece"), "\n\n", "signals")
    j = (repos.select("repo_id").join(tree_s, "repo_id", "left").join(sig_s, "repo_id", "left")
         .join(exc_s, "repo_id", "left"))
    return j.select("repo_id", _fill(CONTEXT_TEMPLATE, {
        "tree": F.col("tree"), "signals": F.col("signals"), "excerpts": F.col("excerpts")}).alias("prompt"))


#: Places of the tree whose signal files make one part of a prompt: at most so many excerpts.
PART_FILES = 256


def context_prompt_parts(tree: DataFrame, ctx_files: DataFrame, repos: DataFrame, part_files: int = PART_FILES) -> DataFrame:
    """(repo_id, section, part, text): the context prompt in parts of bounded size; in the order of section and part they concatenate to it.

    Section 0 goes up to the signal files, section 2 begins after them; between, a part holds the signal files of ``part_files`` places of
    the tree, so a part is joined from a bounded group wherever its repository's other parts are, and no row grows with the repository.
    """
    tree_s, signals, exc_s = _context_sections(tree, ctx_files)
    at = CONTEXT_TEMPLATE.index("{signals}")
    base = repos.select("repo_id").join(tree_s, "repo_id", "left").join(exc_s, "repo_id", "left")
    head = base.select("repo_id", F.lit(0).alias("section"), F.lit(0).cast("bigint").alias("part"),
                       F.concat(_fill(CONTEXT_TEMPLATE[:at], {"tree": F.col("tree")}), F.lit("\n\n")).alias("text"))
    tail = base.select("repo_id", F.lit(2).alias("section"), F.lit(0).cast("bigint").alias("part"),
                       F.concat(F.lit("\n\n"), _fill(CONTEXT_TEMPLATE[at + 1:], {"excerpts": F.col("excerpts")})).alias("text"))
    signals = signals.join(repos.select("repo_id"), "repo_id", "left_semi").withColumn("part", F.floor(F.col("tree_ord") / F.lit(part_files)))
    first = signals.groupBy("repo_id").agg(F.min("part").alias("first"))
    joined = (signals.groupBy("repo_id", "part").agg(F.array_sort(F.collect_list(F.struct("tree_ord", "piece"))).alias("a")).join(first, "repo_id")
              .select("repo_id", F.lit(1).alias("section"), "part",
                      F.concat(F.when(F.col("part") == F.col("first"), F.lit("")).otherwise(F.lit("\n\n")), F.array_join("a.piece", "\n\n")).alias("text")))
    return head.unionByName(joined).unionByName(tail)


def prompt_manifest(parts: DataFrame) -> DataFrame:
    """(repo_id, n_parts, chars): what a prompt's parts must add up to."""
    return parts.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_parts"), F.sum(F.length("text")).cast("bigint").alias("chars"))


def evidence_line(kind: Column, method: Column, value: Column, file: Column) -> Column:
    return F.concat(kind, F.lit(" "), F.when(method.isNotNull(), F.concat(method, F.lit(" "))).otherwise(F.lit("")),
                    value, F.lit(" ("), file, F.lit(")"))


def architecture_prompt(context: DataFrame, selection: DataFrame, capped_evidence: DataFrame) -> DataFrame:
    """context(repo_id, summary, domain, tech_stack, main_modules); selection(repo_id, rank, path, content);
    capped_evidence(repo_id, kind, ev_rank, file, method, value) -> (repo_id, prompt)."""
    flist = ordered_join(selection, "repo_id", "rank", F.concat(F.lit("- "), F.col("path")), "\n", "file_list")
    fbody = ordered_join(selection, "repo_id", "rank",
                         F.concat(F.lit("### "), F.col("path"), F.lit("\n```\n"), F.coalesce("content", F.lit("")),
                                  F.lit("\n```")), "\n\n", "files")
    kind_ord = (F.when(F.col("kind") == "route", F.lit(0)).when(F.col("kind") == "handler", F.lit(1))
                .otherwise(F.lit(2)))
    ev = capped_evidence.withColumn("o", kind_ord * F.lit(1000) + F.col("ev_rank"))
    ev_s = ordered_join(ev, "repo_id", "o",
                        evidence_line(F.col("kind"), F.col("method"), F.col("value"), F.col("file")), "\n", "evidence")
    j = context.join(flist, "repo_id", "left").join(fbody, "repo_id", "left").join(ev_s, "repo_id", "left")
    return j.select("repo_id", _fill(ARCH_TEMPLATE, {
        "summary": F.col("summary"), "domain": F.col("domain"),
        "stack": F.array_join("tech_stack", ", "), "modules": F.array_join("main_modules", ", "),
        "file_list": F.col("file_list"), "files": F.col("files"), "evidence": F.col("evidence")}).alias("prompt"))
