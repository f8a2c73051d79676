"""Evidence extraction (routes, handlers, database calls), per-repository caps, links.

Extraction is ``explode(regexp_extract_all(...))`` with JVM regex over file contents.
Patterns are the fixed ones in ``constants``; ``\\w`` is widened to Unicode letters and
digits (as in Python) and ``.`` stops only at ``\\n``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import paths as P
from .sorted_lookup import longest_prefixes

WORD = r"[\p{L}\p{N}_]"


def portable(pattern: str, multiline: bool = False) -> str:
    """Reference pattern -> JVM pattern (Unicode \\w, only \\n ends a line)."""
    return ("(?md)" if multiline else "(?d)") + pattern.replace(r"\w", WORD)


# (kind, pattern_ord, pattern, groups, multiline): groups = (method group or None, value group)
PATTERNS = [
    ("route", 0, K.ROUTE_PATTERN, (None, 1), False),
    ("route", 1, K.VERB_ROUTE_PATTERN, (1, 2), False),
    ("handler", 0, K.DEF_PATTERN, (None, 1), True),
    ("handler", 1, K.CLASS_PATTERN, (None, 1), True),
    ("db_call", 0, K.DB_CALL_PATTERN, (None, 1), False),
]


def _as_match(kind: str, pord: int):
    def build(z, i):
        return F.struct(F.lit(kind).alias("kind"), F.lit(pord).alias("pattern_ord"),
                        (i + 1).cast("int").alias("match_ord"), F.upper(z["m"]).alias("method"),
                        z["v"].alias("value"))
    return build


def extract_evidence(files: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """files(repo_id, path, content[, file_rank]) -> evidence(repo_id, kind, file, file_rank,
    pattern_ord, match_ord, method, value); match_ord counts from 1 within (file, pattern).

    ``kinds``: the kinds to look for (all, if none are given); patterns of others are not run. One pass: every pattern yields an array of match structs, the arrays are concatenated
    and exploded once, so the input is scanned a single time.
    """
    if "file_rank" not in files.columns:
        files = files.withColumn("file_rank", F.lit(None).cast("int"))
    src = files.where(F.col("content").isNotNull() & (F.length("content") > 0))
    arrays = []
    for kind, pord, pat, (mg, vg), ml in (p for p in PATTERNS if kinds is None or p[0] in kinds):
        jp = F.lit(portable(pat, ml))
        vals = F.regexp_extract_all("content", jp, F.lit(vg))
        meth = (F.regexp_extract_all("content", jp, F.lit(mg)) if mg
                else F.transform(vals, lambda _: F.lit(None).cast("string")))
        arrays.append(F.transform(F.arrays_zip(meth.alias("m"), vals.alias("v")), _as_match(kind, pord)))
    return (src.select("repo_id", F.col("path").alias("file"), "file_rank", F.explode(F.concat(*arrays)).alias("e"))
            .select("repo_id", "e.kind", "file", "file_rank", "e.pattern_ord", "e.match_ord", "e.method", "e.value"))


def cap_evidence(evidence: DataFrame, cap: int = K.EVIDENCE_CAP) -> DataFrame:
    """First ``cap`` rows per (repo, kind) in (file rank, pattern, position) order."""
    w = Window.partitionBy("repo_id", "kind").orderBy("file_rank", "file", "pattern_ord", "match_ord")
    return (evidence.withColumn("ev_rank", F.row_number().over(w))
            .where(F.col("ev_rank") <= F.lit(cap)).withColumn("ev_rank", F.col("ev_rank").cast("int")))


def deep_link(repo_url, branch, file, start_line, end_line):
    """{repo}/blob/{branch or main}/{file}#L{start}-L{end}; no anchor when start is 0/null."""
    br = F.coalesce(F.when(branch != "", branch), F.lit(K.DEFAULT_BRANCH))
    anchor = (F.when(F.coalesce(start_line, F.lit(0)) != 0,
                     F.concat(F.lit("#L"), start_line.cast("string"),
                              F.when(F.coalesce(end_line, F.lit(0)) != 0,
                                     F.concat(F.lit("-L"), end_line.cast("string"))).otherwise(F.lit(""))))
              .otherwise(F.lit("")))
    return F.concat(repo_url, F.lit("/blob/"), br, F.lit("/"), file, anchor)


def _stem(file_col):
    """File name without its last ASCII-word extension, lower-cased."""
    return F.lower(F.regexp_replace(P.filename(file_col), r"\.[A-Za-z0-9_]+$", ""))


def match_nodes(nodes: DataFrame, evidence_map: DataFrame) -> DataFrame:
    """Diagram nodes -> evidence entry (first in list order): by node id, else the entry whose file
    stem occurs in the lower-cased label, else whose file name occurs in it.

    nodes(repo_id, node_id, label); evidence_map(repo_id, ord, node_id, file, start_line, end_line)
    -> (repo_id, node_id, label, rule, ord). Containment goes by the places of a label, one row each: in the order of texts, every stem or name that a
    label has at a place is the one before that place's text or a prefix of it (``sorted_lookup.longest_prefixes``), and carries its prefixes along
    with the first entry that any of them up to there has. So rows are as many as characters in labels and in names, and
    no pairs of nodes and entries are formed. An empty label contains nothing.
    """
    em = evidence_map.select("repo_id", "ord", F.col("node_id").alias("e_node"), "file")
    by_id = (nodes.where(F.col("node_id") != "").select("repo_id", "node_id")
             .join(em.where(F.col("e_node") != "").groupBy("repo_id", "e_node").agg(F.min("ord").alias("ord"))
                   .withColumnRenamed("e_node", "node_id"), ["repo_id", "node_id"])
             .select("repo_id", "node_id", F.lit(0).alias("rule"), "ord"))
    keys = (em.select("repo_id", "ord", F.lit(1).alias("rule"), _stem("file").alias("key"))
            .unionByName(em.select("repo_id", "ord", F.lit(2).alias("rule"), F.lower(P.filename("file")).alias("key")))
            .groupBy("repo_id", "rule", "key").agg(F.min("ord").alias("ord")))
    low = F.lower(F.coalesce(F.col("label"), F.lit("")))
    labelled = nodes.select("repo_id", "node_id", low.alias("low")).where(F.length("low") > 0)
    firsts = keys.where(F.col("key") != "").groupBy("repo_id", "key").agg(F.min(F.struct("rule", "ord")).alias("best"))
    cuts = firsts.select("repo_id", "key", F.explode(F.sequence(F.lit(1), F.length("key"))).alias("n")).withColumn("prefix", F.expr("left(key, n)"))
    chains = (cuts.join(firsts.select("repo_id", F.col("key").alias("prefix"), "best"), ["repo_id", "prefix"])
              .groupBy("repo_id", "key").agg(F.array_sort(F.collect_list(F.struct("n", "best"))).alias("c")))
    # a key's prefixes that are keys, with the first entry of all that are as long or shorter: at most as many as it has characters
    value = F.expr("transform(c, (p, i) -> named_struct('n', p.n, 'best', array_min(transform(slice(c, 1, i + 1), q -> q.best))))")
    longest = firsts.groupBy("repo_id").agg(F.max(F.length("key")).alias("longest"))
    texts = (labelled.join(longest, "repo_id").select("repo_id", F.col("node_id").alias("id"), "low", "longest", F.explode(F.sequence(F.lit(1), F.length("low"))).alias("i"))
             .select("repo_id", "id", F.expr("substring(low, i, longest)").alias("text")).distinct())
    got = longest_prefixes(chains.select("repo_id", "key", value.alias("value")), texts)
    held = got.where(F.col("key").isNotNull()).select("repo_id", F.col("id").alias("node_id"), F.expr("filter(value, p -> startswith(text, left(key, p.n)))").alias("held"))
    by_text = (held.where(F.size("held") > 0).select("repo_id", "node_id", F.element_at("held", -1)["best"].alias("b"))
               .groupBy("repo_id", "node_id").agg(F.min("b").alias("b")).select("repo_id", "node_id", "b.rule", "b.ord"))
    # an empty stem or name is contained in every label that is not empty
    empty = (keys.where(F.col("key") == "").groupBy("repo_id", "rule").agg(F.min("ord").alias("ord"))
             .join(labelled.select("repo_id", "node_id"), "repo_id")
             .select("repo_id", "node_id", "rule", "ord"))
    best = (by_id.unionByName(by_text).unionByName(empty)
            .groupBy("repo_id", "node_id").agg(F.min(F.struct("rule", "ord")).alias("b")))
    return (nodes.select("repo_id", "node_id", "label")
            .join(best, ["repo_id", "node_id"], "left")
            .select("repo_id", "node_id", "label", F.col("b.rule").alias("rule"), F.col("b.ord").alias("ord")))


def evidence_links(nodes: DataFrame, evidence_map: DataFrame, repos: DataFrame) -> DataFrame:
    """Click-through link per diagram node: (repo_id, node_id, rule, file, url); unmatched -> nulls.

    repos(repo_id, repo_url, default_branch)."""
    m = match_nodes(nodes, evidence_map)
    em = evidence_map.select("repo_id", "ord", "file", "start_line", "end_line")
    j = m.join(em, ["repo_id", "ord"], "left").join(repos, "repo_id", "left")
    url = F.when(F.col("file").isNotNull(),
                 deep_link(F.col("repo_url"), F.col("default_branch"), F.col("file"),
                           F.col("start_line"), F.col("end_line")))
    return j.select("repo_id", "node_id", F.col("rule").cast("int").alias("rule"), "file", url.alias("url"))


def validate_evidence(evidence_map: DataFrame, selection: DataFrame) -> DataFrame:
    """Checks the rules the architecture prompt asks for: each entry names a node and a file from
    the selected files. (repo_id, ord, node_id, file, has_node, file_available)."""
    avail = selection.select("repo_id", F.col("path").alias("file"), F.lit(True).alias("file_available")).distinct()
    return (evidence_map.select("repo_id", "ord", "node_id", "file")
            .join(avail, ["repo_id", "file"], "left")
            .select("repo_id", "ord", "node_id", "file", (F.coalesce(F.col("node_id"), F.lit("")) != "").alias("has_node"),
                    F.coalesce(F.col("file_available"), F.lit(False)).alias("file_available")))
