"""Import resolution and the dependency-edge table, as equi-joins.

Rules per (importer, module):
* relative (starts with '.'): strip every leading '.' and '/', then try, in order,
  ``dir/x.py``, ``dir/x.js``, ``dir/x/index.js``, ``dir/x.ts``, ``dir/x.tsx``;
* absolute: ``a/b.py`` then ``a/b.js`` from the root (dots become '/'), else a file whose
  path ends with ``/last.py`` or ``/last.js`` (``last`` = text after the last dot);
  several such files: the smallest path.

The suffix rule is an equi-join against a suffix index (every segment-aligned proper
suffix of every path, pre-aggregated to its smallest path), so no theta join and no
per-key fan-out: each lookup key matches at most one row.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import paths as P


def suffix_index(tree: DataFrame) -> DataFrame:
    """(repo_id, suffix, match_path): for each proper, segment-aligned suffix, the smallest path."""
    d = P.depth("path")
    return (tree.select("repo_id", "path", d.alias("d")).where(F.col("d") >= 1)
            .select("repo_id", "path", F.explode(F.sequence(F.lit(1), F.col("d"))).alias("m"))
            .select("repo_id", "path", F.expr("substring_index(path, '/', -m)").alias("suffix"))
            .groupBy("repo_id", "suffix").agg(F.min("path").alias("match_path")))


def resolve_imports(imports: DataFrame, tree: DataFrame) -> DataFrame:
    """(repo_id, src, module) -> (repo_id, src, module, dst, rule); unresolved modules are dropped."""
    mods = imports.select("repo_id", "src", "module").distinct()
    paths = tree.select("repo_id", F.col("path").alias("cand"))

    rel = mods.where(F.col("module").startswith("."))
    clean = F.regexp_replace("module", r"^[./]+", "")
    rel_c = rel.select(
        "repo_id", "src", "module",
        F.posexplode(F.array(*[F.concat(P.dirname("src"), F.lit("/"), clean, F.lit(s))
                               for s in K.RELATIVE_CANDIDATE_SUFFIXES])).alias("prio", "cand"))

    ab = mods.where(~F.col("module").startswith("."))
    as_path = F.replace(F.col("module"), F.lit("."), F.lit("/"))
    abs_c = ab.select(
        "repo_id", "src", "module",
        F.posexplode(F.array(*[F.concat(as_path, F.lit(s)) for s in K.ABSOLUTE_CANDIDATE_SUFFIXES]))
        .alias("prio", "cand"))
    exact = (rel_c.unionByName(abs_c)
             .join(paths, ["repo_id", "cand"], "inner")
             .select("repo_id", "src", "module", F.col("prio").cast("int").alias("prio"),
                     F.col("cand").alias("dst")))

    last = F.substring_index(F.col("module"), ".", -1)
    sfx = suffix_index(tree)
    by_suffix = (ab.select("repo_id", "src", "module",
                           F.explode(F.array(*[F.concat(last, F.lit(s)) for s in K.ABSOLUTE_CANDIDATE_SUFFIXES]))
                           .alias("suffix"))
                 .join(sfx, ["repo_id", "suffix"], "inner")
                 .select("repo_id", "src", "module", F.lit(len(K.ABSOLUTE_CANDIDATE_SUFFIXES)).alias("prio"),
                         F.col("match_path").alias("dst")))

    best = (exact.unionByName(by_suffix)
            .groupBy("repo_id", "src", "module")
            .agg(F.min(F.struct("prio", "dst")).alias("b")))
    return best.select("repo_id", "src", "module", F.col("b.dst").alias("dst"), F.col("b.prio").alias("rule"))


def dependency_edges(resolved: DataFrame) -> DataFrame:
    """Directed importer -> imported edges, without self loops, deduplicated."""
    return (resolved.where(F.col("src") != F.col("dst"))
            .select("repo_id", "src", "dst").distinct())
